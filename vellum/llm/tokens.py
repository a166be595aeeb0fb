"""Words of texts as 64-bit hashes in flat arrays, for the operators on shingles.

A word is a run of letters, marks and digits of one kind; numbers keep their inner marks ("1,5" is one word), words their
inner apostrophes and hyphens. A Chinese or Japanese character is a word of its own. Texts compare in Unicode form NFKC,
case-folded, so letter case, punctuation, Unicode form and spacing don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import xxhash

CJK = "々-〇ぁ-ゖゝ-ゟァ-ヺー-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
THAI = "ก-ฺเ-๎"
CJK_CHAR = re.compile(f"[{CJK}]")
#: Words kept in a worker's table of hashes; it is emptied beyond that.
KEPT = 1_000_000


@cache
def word_pattern() -> re.Pattern:
    return re.compile(rf"[{CJK}]|[0-9]+(?:[.,:][0-9]+)*|[{plain()}]+(?:['’\-\u2010][{plain()}]+)*")


@cache
def plain() -> str:
    """Ranges of letters, marks and digits, without ASCII digits and Chinese and Japanese characters."""
    inside = re.compile(f"[{CJK}0-9]")
    out, start = [], None
    for c in range(0x20001):
        ok = c < 0x20000 and unicodedata.category(chr(c))[0] in "LMN" and not inside.match(chr(c))
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(re.escape(chr(start)) + "-" + re.escape(chr(c - 1)))
            start = None
    return "".join(out)


class Hashes(dict):
    """64-bit hashes of words, computed once a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


HASHES = Hashes()


def normal(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def words(text: str) -> list[str]:
    return word_pattern().findall(normal(text))


def hashed(found: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words that start at each word (also across ends of texts; see inside())."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[k : n + k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """Start positions, in the joined texts, of the runs that lie in one text."""
    ends = np.cumsum(lengths)
    own = np.maximum(lengths - width + 1, 0)
    starts = ends - lengths
    return np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(own.sum())


def groups(rows: Iterable[tuple], size: int = 4_000_000) -> Iterator[list[tuple]]:
    """Rows (…, text) in lists of about `size` characters: bounds a worker's memory whatever the texts. A longer text is
    a list of its own."""
    held, chars = [], 0
    for row in rows:
        n = len(row[-1] or "")
        if held and chars + n > size:
            yield held
            held, chars = [], 0
        held.append(row)
        chars += n
    if held:
        yield held


def batches(it: Iterator) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time."""
    for b in it:
        yield from zip(*(c.to_pylist() for c in b.columns))

"""Sentence boundaries across languages and scripts.

A blank line always ends a sentence, quoted or bracketed text belongs to the sentence around it, and in Thai a space that
touches no digit ends one. Every other end mark is a candidate that a maximum-entropy model classifies from the tokens beside
it: their identity, case, length, digits and script. Nothing is known beforehand of any language: there are no word lists. The
model is trained on boundaries that are reliable without it (see judged()), from counts of how words stand before periods.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

BLANK = re.compile(r"[^\S\r\n]*(?:\r\n|[\n\r  \u0085])(?:[^\S\r\n]*(?:\r\n|[\n\r  \u0085]))+\s*")
CLOSERS = "\"'”“’»«)\\]}」』）】》〉›‘"
MARK = re.compile(rf"(?:[.．。｡!?！？।॥…؟۔]+)(?:\s?[»›](?!\w)|[{CLOSERS}])*")
NEXT = re.compile(r"[^\s.,;:!?()\[\]{}\"“”„«»¿¡。！？、，；：」』「『（）।…]+")
LAST = re.compile(r"[^\s.,;:!?()\[\]{}\"“”„«»¿¡。！？、，；：」』「『（）।…]+$")
CJK = re.compile(f"[{tokens.CJK}]")
THAI = re.compile(f"[{tokens.THAI}]")
_TO_CJK = re.compile(f"^.*[{tokens.CJK}]", re.S)
_PIECE = f"[^0-9{NEXT.pattern[2:-2]}{tokens.CJK}]{{1,4}}"
#: Short pieces with inner periods: "p.m", "i.e".
DOTTED = re.compile(rf"(?<![^\s.,;:(\[\"“„«¿¡])(?:{_PIECE}\.)+{_PIECE}$")
WORD = re.compile(rf"(?<![^\s.,;:(\[\"“„«¿¡])(?:{_PIECE}\.)+{_PIECE}(?=\.)|{NEXT.pattern}")
#: Marks of one kind in different scripts.
KINDS = {"．": "。", "。": "。", "｡": "。", "？": "?", "！": "!", "؟": "?", "॥": "।", "۔": "।"}
#: Weights where there is nothing to learn from, in log odds; the regularisation is about them.
PRIOR = {"n=U": 1.0, "n=o": 1.0, "n=w": 1.0, "n=open": 1.0, "n=end": 1.0, "m=。": 1.0, "n=l": -1.0, "n=comma": -1.0, "n=p": -1.0}


def paragraphs(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in BLANK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def protected(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quoted and bracketed spans of a paragraph. A mark that isn't closed in its paragraph protects nothing;
    straight quotes pair in turn; an apostrophe inside a word is none."""
    stack: list[tuple[str, int]] = []
    spans = []
    for m in re.finditer(r'[()\[\]{}（）［］【】「」『』《》〈〉“”„«»‹›"]', text[a:b]):
        c, i = m.group(), a + m.start()
        want = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "】": "【", "」": "「", "』": "『", "》": "《", "〉": "〈", "”": "“„", "»": "«", "›": "‹", "“": "„", '"': '"', "«": "»"}.get(c, "")
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in want), None)
        if k is not None and not (c == "«" and not any(s == "»" for s, _ in stack)):
            spans.append((stack[k][1], i + 1))
            del stack[k:]
        elif c in "([{（［【「『《〈“„«‹\"":
            stack.append((c, i))
    out: list[tuple[int, int]] = []
    for s in sorted(spans):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def next_class(word: str, char: str) -> str:
    if not char:
        return "end"
    if char in "¿¡«“„‹「『(（[":
        return "open"
    if char.isdigit():
        return "d"
    if char in ",;:，；：、)]}）":
        return "comma"
    if not (char.isalpha() or unicodedata.category(char)[0] in "LM"):
        return "p"
    if char.isupper():
        return "U"
    if char.islower():
        return "camel" if re.match(r"[^\W\d_A-Z]{1,3}[A-Z]", word) else "l"
    return "o"


def word_type(word: str) -> str:
    """The word in the form in which it is counted: lower case; numbers, single capitals and Chinese or Japanese endings are
    one type each; a Latin word that follows such characters stands for itself."""
    word = word.strip("'’-*_")
    if word and CJK.match(word[-1]):
        return "<cjk>"
    word = _TO_CJK.sub("", word)
    if word[-1:].isdigit():
        return "#"
    return "<I>" if len(word) == 1 and word.isupper() else word.lower()


def before(text: str, a: int, i: int) -> tuple[str, int, bool]:
    """(type, start, dotted) of the word before the mark at i."""
    lo = max(a, i - 40)
    if m := DOTTED.search(text, lo, i):
        return m.group().lower(), m.start(), True
    m = LAST.search(text, lo, i)
    return (word_type(m.group()), m.start(), False) if m else ("", i, False)


def described(text: str, a: int, b: int, m: re.Match, words: int, nxt: int | None = None) -> tuple[list[str], tuple]:
    """(features, facts) of the mark m in the paragraph from a to b, `words` words after the last boundary. With nxt, what
    follows is read at nxt instead (the next paragraph), as if one space lay between. Facts are what labels go by: kind and
    text of the mark, class of what follows, type of the word before and of that after, whether the former is dotted."""
    mark, (low, at_low, dotted) = m.group(), before(text, a, m.start())
    at, end = (m.end(), b) if nxt is None else (nxt, len(text))
    gap_end = at
    while gap_end < end and text[gap_end].isspace():
        gap_end += 1
    tight = nxt is None and gap_end == at
    char = text[gap_end : gap_end + 1] if gap_end < end else ""
    found = NEXT.match(text, gap_end, min(end, gap_end + 30))
    word = found.group() if found else ""
    n, first = next_class(word, char), mark[0]
    # case tells nothing in text without it
    wide = low == "<cjk>" or first in "。．？！｡" or bool(CJK.match(char or " "))
    if n in ("l", "camel", "U") and (wide or (tight and CJK.search(text, max(a, m.start() - 60), min(b, m.end() + 60)))):
        n = "w"
    kind = "…" if first == "…" or mark.startswith("..") else KINDS.get(first, first)
    gap = "none" if tight else "space"
    out = ["bias", f"m={kind}", f"n={n}", f"m={kind},n={n}", f"len={min(words, 6)}", f"g={gap}", f"n={n},g={gap}", f"k={mark[:3]}"]
    if kind == ".":
        raw = text[at_low : m.start()]
        shape = low if low in ("#", "<cjk>", "<I>") else "dotted" if dotted else f"{min(len(low), 6)}{'U' if raw[:1].isupper() else 'l'}"
        name = low if len(low) <= 8 else "*"
        out += [f"s={shape}", f"s={shape},{n}", f"s={shape},{min(words, 4)}", f"w={name}", f"w={name},n={n}"]
        if dotted:
            out += [f"dotted,{n}", f"dotted,{gap}"]
        if low == "#":
            h = LAST.search(text, max(a, at_low - 30), len(text[:at_low].rstrip()))
            h = h.group().lower()[:8] if h else ""
            out += [f"h={h}", f"h={h},{n}"]
    if len(mark) > 1 and mark[-1] not in ".．。｡!?！？।॥…؟۔":
        out += ["q", f"q,{n}", f"q,{kind},{n}"]
    start = word[:2] if n in ("o", "w") else word.lower()[:10]
    out += [f"t={start}", f"t={start},{'.' if kind == '.' else 'x'}"]
    return out, (kind, mark, n, low, word_type(word), dotted)


def features(text: str, a: int, b: int, m: re.Match, words: int, nxt: int | None = None) -> list[str]:
    return described(text, a, b, m, words, nxt)[0]


def marks(text: str, a: int, b: int, spans: list[tuple[int, int]]) -> Iterator[tuple[re.Match, bool]]:
    """End marks of a paragraph with their closing marks; whether each lies inside a protected span. Periods between digits
    are none."""
    k = 0
    for m in MARK.finditer(text, a, b):
        i = m.start()
        if m.group() in (".", "．") and i > a and i + 1 < b and text[i - 1].isdigit() and text[i + 1].isdigit():
            continue
        while k < len(spans) and spans[k][1] <= i:
            k += 1
        inside = k < len(spans) and spans[k][0] <= i and m.end() < spans[k][1]
        yield m, inside


def evidence(texts: Iterable[str]) -> tuple[Counter, Counter]:
    """(counts, candidates) of texts: counts[(what, type)] are how often a type of word, or a text of a mark, occurs (total),
    stands before a period (dotted), ends a paragraph (end), begins one (begin), follows a number with a period (after).
    candidates[(where, facts, features)] counts the end marks, where: end of a paragraph, in brackets, or elsewhere."""
    counts, seen = Counter(), Counter()
    for text in texts:
        if is_thai(text):
            continue
        for m in WORD.finditer(text):
            counts["total", m.group().lower() if "." in m.group() else word_type(m.group())] += 1
        paras = paragraphs(text)
        for p, (a, b) in enumerate(paras):
            if m := NEXT.match(text, a):
                counts["begin", word_type(m.group())] += 1
            spans = protected(text, a, b)
            nxt = paras[p + 1][0] if p + 1 < len(paras) else paras[0][0]
            last, length = a, len(text[a:b].rstrip())
            for m, inside in marks(text, a, b, spans):
                words, final = len(text[last : m.start()].split()), m.end() - a >= length
                f, facts = described(text, a, b, m, words, nxt if final else None)
                kind, mark, n, low, after, _ = facts
                counts["dotted", low] += kind == "."
                if final and words < 3:
                    continue
                where = "end" if final else "in" if inside else "mid"
                if inside and not (kind == "." and text[next(s for s in spans if s[0] <= m.start() < s[1])[0]] in "([{（"):
                    continue
                seen[where, facts, tuple(f)] += 1
                if where != "in":
                    counts["total", "m:" + mark] += 1
                if final:
                    counts["end", "m:" + mark] += 1
                    counts["end", low] += kind == "."
                elif low == "#" and where == "mid":
                    counts["after", after] += 1
                if where == "mid" and n in ("U", "open", "o", "w"):
                    last = m.end()
    return counts, seen


def judged(where: str, facts: tuple, counts: dict, share: float) -> int | None:
    """1 or 0 where it is reliable without a model that a mark ends a sentence or doesn't, else None.

    Ends: marks at the ends of paragraphs; single ? ! and full-width marks; a period after a type that mostly stands without
    one, before a capital or a script without case (before a number, if it is a frequent type); a number before a word that often begins a paragraph. No ends: marks
    before lower case or a comma, periods in brackets, and what stands before (or as) a mark so often without ever ending a
    paragraph that chance doesn't explain it: abbreviations, titles, initials, dots of omission, marks within quotes. `share`
    is that of paragraph ends among all ends of sentences, by which chance is judged.
    """
    kind, mark, n, low, after, dotted = facts
    of = lambda what, key: counts.get((what, key), 0)
    if where == "end":
        return 1
    if where == "in":
        return None if low == "#" else 0
    if n in ("comma", "l"):
        return 0
    if len(mark) > 1 or kind == "…":
        return 0 if never_ends(of("total", "m:" + mark), of("end", "m:" + mark), share, 1e-2) else None
    if kind in "?!。।":
        return None if n == "p" else 1
    if low == "<cjk>":
        return 1
    if low == "#":
        total, begin = of("total", after), of("begin", after)
        if n != "U":
            return None
        return 0 if total >= 10 and not begin else 1 if begin >= max(2, 0.1 * total) else None
    total, before_period, end = of("total", low), of("dotted", low), of("end", low)
    # a type that always has its period needs less proof than one that often stands without
    if never_ends(before_period, end, share, 1e-2 if before_period >= 0.9 * total else 1e-6):
        return 0
    known = total >= 3 and before_period <= 0.5 * total and (len(low) > 1 or not low.isalpha()) and not dotted
    sure = known and total >= 20 and before_period <= 0.2 * total
    return 1 if known and n in ("U", "open", "o", "w") or sure and n == "d" else None


def never_ends(n: int, ends: int, share: float, level: float) -> bool:
    """Whether at most a fiftieth of n marks end a paragraph, and so few are improbable if they were ends of sentences."""
    if ends > 0.02 * n:
        return False
    return sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(ends + 1)) < level if n < 500 else True


def is_thai(text: str) -> bool:
    n = len(THAI.findall(text))
    return n > 0 and n * 4 > sum(c.isalpha() for c in text)


def split(text: str, weights: dict[str, float]) -> list[tuple[int, int]]:
    """Sentences of a text as half-open code-point offsets; every character that isn't white space is in exactly one."""
    cuts: list[tuple[int, int]] = []
    thai = is_thai(text)
    for a, b in paragraphs(text):
        ends = []
        spans = protected(text, a, b)
        if thai:
            for m in re.finditer(r"[^\S\r\n]+", text[a:b]):
                i, j = a + m.start(), a + m.end()
                if i == a or j == b or any(s < i < e for s, e in spans) or text[i - 1] in "\r\n" or text[j] in "\r\n":
                    continue
                if not (text[i - 1].isdigit() or text[j].isdigit()):
                    ends.append(j)
        else:
            last = a
            for m, inside in marks(text, a, b, spans):
                if inside or m.end() >= b:
                    continue
                words = len(text[last : m.start()].split())
                if sum(weights.get(f, 0.0) for f in features(text, a, b, m, words)) > 0:
                    ends.append(m.end())
                    last = m.end()
        for lo, hi in zip([a, *ends], [*ends, b]):
            part = text[lo:hi]
            kept = part.strip()
            if kept:
                at = lo + len(part) - len(part.lstrip())
                cuts.append((at, at + len(kept)))
    return cuts


#: About so many texts are read for labels, whatever the corpus.
SAMPLE = 4000
_SEP = "\u001f"


def train(docs: DataFrame, key: str, text: str, sample: int = SAMPLE) -> dict[str, float]:
    """Weights of the model, from a hash sample of about `sample` texts (a bounded, documented parameter). Word counts and
    equal candidates are summed before they reach the driver, of the words only those that can matter. Without labels the
    prior is the model."""
    n = docs.count()
    rate = min(1.0, sample / max(n, 1))
    some = docs.select(F.col(text).alias("text"), F.xxhash64(F.lit(5), key).alias("h")).filter(F.col("text").isNotNull() & (F.pmod("h", F.lit(1_000_000)) < int(rate * 1_000_000))).select("text")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, seen = evidence(t for t in batch.column(0).to_pylist() if t)
            what = [w for w, _ in counts] + [w for w, _, _ in seen]
            name = [k for _, k in counts] + [_SEP.join([*map(str, facts), *f]) for _, facts, f in seen]
            yield pa.RecordBatch.from_pydict({"what": pa.array(what, pa.string()), "name": pa.array(name, pa.string()), "n": pa.array([*counts.values(), *seen.values()], pa.int64())})

    of = lambda w: F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w)
    whats = ["total", "dotted", "end", "begin", "after", "in", "mid"]
    rows = some.mapInArrow(read, "what string, name string, n bigint").groupBy("name").agg(*[of(w) for w in whats]).filter("dotted > 0 or begin > 0 or after > 0 or end > 0 or mid > 0 or `in` > 0 or name like 'm:%'").orderBy("name").collect()
    counts, seen = {}, Counter()
    for r in rows:
        parts = r["name"].split(_SEP)
        for w in whats:
            if r[w] and len(parts) == 1:
                counts[w, r["name"]] = r[w]
            elif r[w]:
                seen[w, (*parts[:5], parts[5] == "True"), tuple(parts[6:])] += r[w]
    return fit(labelled(counts, seen))


def labelled(counts: dict, seen: dict) -> list[tuple[tuple[str, ...], int, int, int]]:
    """(features, ends, no ends, unlabelled) of the candidates."""
    ends = sum(k for (where, _, _), k in seen.items() if where == "end")
    likely = ends + sum(k for (where, f, _), k in seen.items() if where == "mid" and f[2] in ("U", "open", "o", "w"))
    share, out = ends / max(likely, 1), {}
    for (where, facts, f), k in seen.items():
        row = out.setdefault(f, [0, 0, 0])
        row[{1: 0, 0: 1, None: 2}[judged(where, facts, counts, share)]] += k
    return [(f, *row) for f, row in sorted(out.items())]


def fit(rows: list[tuple], steps: int = 60, rounds: int = 3, ridge: float = 1.0) -> dict[str, float]:
    """Maximum entropy on (features, ends, no ends, unlabelled) with a Gaussian prior about PRIOR: first on the labelled, then
    `rounds` times with the unlabelled in the shares that the model gives them. Accelerated gradient steps, scaled by a bound
    on each feature's curvature."""
    if not rows:
        return dict(PRIOR)
    index: dict[str, int] = {}
    for f, *_ in rows:
        for x in f:
            index.setdefault(x, len(index))
    r = np.concatenate([np.full(len(f), i) for i, (f, *_) in enumerate(rows)])
    c = np.concatenate([[index[x] for x in f] for f, *_ in rows]).astype(int)
    ends, others, open_ = (np.array([row[k] for row in rows], float) for k in (1, 2, 3))
    prior = np.array([PRIOR.get(x, 0.0) for x in index])
    widest = np.bincount(r).max()
    chance = lambda w: 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(rows)), -30, 30)))

    def climb(w: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        curve = np.bincount(c, n[r], len(index)) * 0.25 * widest + ridge
        ahead, t = w, 1.0
        for _ in range(steps):
            new = ahead + (np.bincount(c, (pos - n * chance(ahead))[r], len(index)) - ridge * (ahead - prior)) / curve
            faster = (1 + math.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = new + (t - 1) / faster * (new - w), new, faster
        return w

    w = climb(prior, ends, ends + others)
    for _ in range(rounds):
        w = climb(w, ends + open_ * chance(w), ends + others + open_)
    return PRIOR | {x: float(w[i]) for x, i in index.items()}


def sentences(docs: DataFrame, key: str, text: str, sample: int = SAMPLE, corpus: DataFrame | None = None) -> DataFrame:
    """(key, sent_start, sent_end): the sentences of every text. Null and blank texts have none. The model (one weight a
    feature of the bounded sample) goes to the tasks; texts are split in Arrow batches, without a shuffle. Equal keys are
    split once a row. The sample is drawn from `corpus` (with the same columns) where one is given."""
    weights = train(docs if corpus is None else corpus, key, text, sample)
    kind = dict(docs.dtypes)[key]

    def cut_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, starts, ends = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in split(t, weights) if t else []:
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "sent_start", "sent_end"])

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(cut_up, f"{key} {kind}, sent_start int, sent_end int")

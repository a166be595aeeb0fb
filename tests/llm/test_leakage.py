"""The search against an index of all shingles, and against planted passages."""

import random

import numpy as np

from vellum.llm import leakage as lk
from vellum.llm import tokens

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
HAN = [chr(0x4E00 + i) for i in range(3000)]


def say(n):
    return [rng.choice(WORDS) for _ in range(n)]


def altered(words, every):
    out = list(words)
    for i in range(every // 2, len(out), every):
        out[i] = rng.choice(WORDS)
    return out


def planted():
    items = [(100 + i, " ".join(say(75))) for i in range(20)] + [(200 + i, "".join(rng.choice(HAN) for _ in range(200))) for i in range(4)]
    docs, want = [], set()
    for d in range(160):
        body, (k, text) = say(rng.choice([20, 200, 3000])), items[d % len(items)]
        w = list(text) if k >= 200 else text.split()
        least = 60 if k >= 200 else 18
        n = rng.choice([least, least + 7, len(w)])
        at = rng.randint(0, len(w) - n)
        piece, kind = w[at : at + n], d % 4
        if kind == 1:
            piece = [rng.choice(HAN) if k >= 200 and i % 20 == 10 else x for i, x in enumerate(piece)] if k >= 200 else altered(piece, 18)
        if kind == 3:
            piece = piece[: least // 2]
        joined = ("" if k >= 200 else rng.choice([" ", "  ", "\n", ", "])).join(piece)
        joined = joined.upper() if kind == 2 else joined
        docs.append((d, " ".join(body[: len(body) // 2]) + " . " + joined + " . " + " ".join(body[len(body) // 2 :])))
        if kind != 3:
            want.add((d, k))
    return docs, items, want


def test_planted(spark):
    docs, items, want = planted()
    df = spark.createDataFrame([(d, t, d) for d, t in docs] + [(900, None, 0), (901, "", 0)], "doc_id int, text string, item_id int").drop("item_id")
    it = spark.createDataFrame([*items, (300, None), (301, ""), (302, "too short")], "item_id int, text string")
    got = {tuple(r) for r in lk.search(df, it, "doc_id", "text", "item_id", "text").collect()}
    assert got == want
    assert {tuple(r) for r in lk.search(df, it, "doc_id", "text", "item_id", "text", item_words=300).collect()} == want
    assert lk.search(df.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0
    assert lk.search(df, it.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_candidates_against_all_shingles():
    """Whatever an index of all shingles would find and verify, the hash functions find too."""
    docs, items, _ = planted()
    index = lk.Index(items)
    texts = [t for _, t in docs]
    got = set(lk.in_texts(index, texts))
    want = set()
    for d, t in enumerate(texts):
        h = tokens.hashed(tokens.words(t))
        s = tokens.rolling(h, lk.SHINGLE).tolist()
        for i, at in enumerate(map(index.shingles, range(len(index.keys)))):
            for b in range(0, len(s), lk.HALF):
                if any(v in at for v in s[b : b + lk.BLOCK]) and index.holds(i, h, b, min(b + lk.BLOCK, len(s))):
                    want.add((d, i))
                    break
    assert len(got & want) >= 0.99 * len(want) and got <= want


def brute(near, word, least):
    """Whether some passage of the item aligns with some part of the text: all starts, one row of edit distances each."""
    for b in range(len(word)):
        for a in range(len(near)):
            if near[a] != word[b]:
                continue
            row = {(0, 0): 0}
            best = {}
            n, m = min(len(word) - b, 40), min(len(near) - a, 44)
            d = np.full((n + 1, m + 1), 99)
            d[0] = np.arange(m + 1)
            d[:, 0] = np.arange(n + 1)
            for i in range(1, n + 1):
                for j in range(1, m + 1):
                    d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (word[b + i - 1] != near[a + j - 1]))
                    if i >= least and word[b + i - 1] == near[a + j - 1] and 10 * d[i, j] <= i:
                        return True
            del row, best
    return False


def test_alignment_against_edit_distance():
    r = random.Random(2)
    agree = 0
    for _ in range(60):
        word = [r.randint(0, 10**6) for _ in range(32)]
        n = r.randint(12, 26)
        piece = word[3 : 3 + n]
        for _ in range(r.randint(0, 3)):
            p = r.randrange(1, len(piece) - 1)
            kind = r.randint(0, 2)
            piece[p : p + 1] = [] if kind == 0 else [r.randint(0, 10**6)] if kind == 1 else [piece[p], r.randint(0, 10**6)]
        near = [r.randint(0, 10**6) for _ in range(6)] + piece + [r.randint(0, 10**6) for _ in range(6)]
        index = lk.Index([])
        index.words, index.least = [np.array(word, np.uint64)], [18]
        at = {}
        for i, v in enumerate(tokens.rolling(index.words[0], 5).tolist()):
            at.setdefault(v, []).append(i)
        index._shingles = {0: at}
        doc = np.array(near, np.uint64)
        got = index.holds(0, doc, 0, len(doc) - 4)
        assert got == brute(near, word, 18), (word, near)
        agree += got
    assert 10 < agree < 55


def test_fewest_kept_shingles():
    assert lk.fewest(18) == 6 and lk.fewest(60) == 26
    assert all(need >= 1 for _, need in lk.PARTITIONS) and lk.PARTITIONS[0][1] < lk.PARTITIONS[-1][1]


def test_index_against_plain_minima():
    """The tables hold every window's minimum of each item, long or short, and nothing else."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefghijklm") * 3 for _ in range(n))) for i, n in enumerate([3, 5, 9, 17, 18, 19, 40, 18])]
    index = lk.Index(items)
    assert index.keys == [1, 2, 3, 4, 5, 6, 7]
    for k in (0, lk.K - 1):
        _, _, values, first, owner = index.tables[k]
        got = {(int(v), int(o)) for v, a, b in zip(values, first, first[1:]) for o in owner[a:b]}
        want = set()
        for i, w in enumerate(index.words):
            h = lk.hash_k((lk.tokens.rolling(w, lk.SHINGLE) >> np.uint64(32)).astype(np.uint32), k)
            wide = min(14, len(h))
            want |= {(int(h[j : j + wide].min()), i) for j in range(len(h) - wide + 1)}
        assert got == want

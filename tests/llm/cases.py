"""Documents that operators must survive, and plain versions of their contracts."""

import hashlib
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h int, n int, t string, w double, d string, c0 string, rank int"
"""Columns of documents, and extra ones whose names operators may use themselves."""

SPACE = " \t\n\x0b\f\r"


def rows(texts, ids=None, langs=None, sources=None):
    out = []
    for i, text in enumerate(texts):
        d = i if ids is None else ids[i]
        out.append((d, text, langs[i] if langs else "en", sources[i] if sources else "s", None if text is None else len(text), "K", 1, None, "T", 2.5, None, "C", 7))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def strange():
    """Null, blank, tiny, huge, repeated, and texts of odd characters."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [None, "", "   ", "\n", "a", "a", "uno dos", "x" * 150_000, long, long, "ÄÖ ß ſK İ 😀😀 日本語 текст", "tab\tsep\x0bvt\x0cff\rcr\nnl", "é" * 30 + "\n" + "é" * 30, "Ａ１ ٣ _-_ 0"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def lines(docs, least=10):
    holders = {}
    parts = {d: (t or "").split("\n") for d, t in docs}
    key = lambda x: low(x.strip(SPACE))
    for d, ls in parts.items():
        for x in ls:
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(d)
    out = {}
    for d, ls in parts.items():
        kept = [x for x in ls if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and min(holders[key(x)]) != d)]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def shingles(text, k=5):
    w = words(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, percent=75):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        smallest[r] = min(smallest.get(r, d), d)
    return [(d, len(s), smallest[find(i)]) for i, (d, s) in enumerate(sets)]


def repeats(docs, length=35):
    seen = {}
    split = [(d, words(t)) for d, t in docs]
    for _, w in split:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha(kept)))
    return out


def leaks(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for i, t in items:
        if i is not None and (w := split(t)):
            k = min(window, len(w))
            for j in range(len(w) - k + 1):
                windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if found := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """source to target, by resharing what is over until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(full.values())
        target = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return full | target
        full |= {s: float(most * sizes[s]) for s in over}


def family(rng, size, copies, edits, vocabulary=4000):
    """A text and copies of it in which some words are others."""
    base = [f"v{rng.randrange(vocabulary)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def rng(seed):
    return random.Random(seed)

"""Queries that SQL does not express, against plain algorithms on the driver's tables."""

import difflib
import math
import re
import zlib
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from discera.functions.segment import split_sentences
from discera.functions.spans import find_spans
from discera.functions.text import fold_value
from discera.operators import graph as gr
from discera.plans.catalog import QUERIES
from discera.sources.html import text_of


def _rows(spark, data, name):
    return QUERIES[name](spark, data).collect()


@pytest.fixture(scope="module")
def edges(spark, data):
    return {(r.origen, r.destino): r.peso for r in QUERIES["g_build"](spark, data).collect()}


def _between(pairs):
    nodes = sorted({x for p in pairs for x in p})
    out = {v: sorted({b for a, b in pairs if a == v and b != v}) for v in nodes}
    far, paths = {}, {}
    for s in nodes:
        far[s, s], paths[s, s], queue = 0, 1, deque([s])
        while queue:
            v = queue.popleft()
            for u in out[v]:
                if (s, u) not in far:
                    far[s, u] = far[s, v] + 1
                    queue.append(u)
                if far[s, u] == far[s, v] + 1:
                    paths[s, u] = paths.get((s, u), 0) + paths[s, v]
    inf, n = math.inf, len(nodes)
    through = lambda v, s, t: paths[s, v] * paths[v, t] / paths[s, t] if far.get((s, v), inf) + far.get((v, t), inf) == far.get((s, t), -1) else 0
    return {v: sum(through(v, s, t) for s in nodes for t in nodes if v not in (s, t) and s != t) / max((n - 1) * (n - 2), 1) for v in nodes}


def test_betweenness(spark, data, edges):
    want = _between(list(edges))
    assert {r.nodo: r.intermediacion for r in _rows(spark, data, "g_betweenness")} == pytest.approx(want)
    r = np.random.default_rng(4)
    few = sorted({(f"n{a}", f"n{b}") for a, b in r.integers(0, 40, (90, 2)).tolist()})
    graph = spark.createDataFrame([(a, b, 1.0, "g") for a, b in few], "origen string, destino string, peso double, grafo string")
    want = _between(few)
    assert {x.nodo: x.intermediacion for x in gr.betweenness_by_source(graph).collect()} == pytest.approx(want)
    assert {x.nodo: x.intermediacion for x in gr.betweenness(graph).collect()} == pytest.approx(want)


def test_cliques(spark, data, edges):
    near = {}
    for a, b in edges:
        if a != b and (b, a) in edges:
            near.setdefault(a, set()).add(b)
    found = []

    def grow(r, p, x):
        if not p and not x:
            found.append(",".join(sorted(r)))
        for v in sorted(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    if sum(map(len, near.values())) < len(near) * (len(near) - 1):  # else all are one clique, and the plain way is slow
        grow(set(), set(near), set())
    else:
        found.append(",".join(sorted(near)))
    assert sorted(r.nodos for r in _rows(spark, data, "g_cliques")) == sorted(c for c in found if c.count(",") >= 2)


def _labels(pairs, rounds=10):
    near, label = {}, {}
    for a, b, w in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, Counter())[y] += w
    label = {v: v for v in near}
    for _ in range(rounds):
        votes = {v: Counter() for v in near}
        for v, us in near.items():
            for u, w in us.items():
                votes[v][label[u]] += w
        label = {v: min(c, key=lambda k: (-round(c[k], 9), k)) for v, c in votes.items()}
    return label


def test_communities(spark, data, edges):
    got = {r.nodo: r.comunidad for r in _rows(spark, data, "g_communities")}
    both = Counter()
    for (a, b), w in edges.items():
        both[a, b] += w
        if a != b:
            both[b, a] += w
    m = sum(w for (a, b), w in both.items() if a != b) / 2 + sum(w for (a, b), w in both.items() if a == b)
    degree = {v: sum(w for (a, b), w in both.items() if a == v and b != v) + 2 * both.get((v, v), 0) for v in got}

    def modularity(of):
        inside = sum(w if a != b else 2 * w for (a, b), w in both.items() if of[a] == of[b])
        return inside / (2 * m) - sum((sum(degree[v] for v in of if of[v] == c) / (2 * m)) ** 2 for c in set(of.values()))

    best = modularity(got)
    assert set(got) == set(degree) and best >= modularity({v: v for v in got}) - 1e-9
    groups = sorted(set(got.values()))
    for c in groups:  # no community gains by joining another
        assert all(modularity({v: d if x == c else x for v, x in got.items()}) <= best + 1e-9 for d in groups)


def test_similar_groups(spark, data):
    pairs = [(str(r.a), str(r.b), r.similitud) for r in _rows(spark, data, "g_sim_pairs")]
    assert {r.nodo: r.comunidad for r in _rows(spark, data, "g_sim_groups")} == _labels(pairs)


def test_semantic_groups(spark, data):
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    v = np.array([x / np.linalg.norm(x) for _, x in rows])
    s, found = v @ v.T, {}
    for i, (a, _) in enumerate(rows):
        for w, b, j in sorted((-s[i, j], b, j) for j, (b, _) in enumerate(rows) if j != i)[:10]:
            if -w >= 0.45:
                found[min(a, b), max(a, b)] = -w
    assert {r.nodo: r.comunidad for r in _rows(spark, data, "g_semantic")} == _labels([(str(a), str(b), w) for (a, b), w in found.items()])


def test_similarity_without_the_rule_on_shares(spark):
    r = np.random.default_rng(5)
    rows = [(i, [f"b{r.integers(3)}"] if r.random() < 0.9 else None, [f"t{x}" for x in r.integers(0, 6, r.integers(0, 4)).tolist()], [f"s{r.integers(9)}"]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, marca array<string>, tipo array<string>, talla array<string>")
    weights = {"marca": 2.0, "tipo": 1.0, "talla": 1.0}

    def score(a, b):
        sets = [(set(x or ()), set(y or ()), w) for x, y, w in zip(a[1:], b[1:], weights.values(), strict=True)]
        base = sum(w for x, y, w in sets if x | y)
        return sum(w * len(x & y) / len(x | y) for x, y, w in sets if x | y) / base if base else 0

    for least in (0.3, 0.5, 0.8):
        for share in (None, 0.25):
            common = Counter(f"{i}{v}" for row in rows for i, c in enumerate(row[1:]) for v in set(c or ()))
            fit = lambda a, b: any(f"{i}{v}" for i, (x, y) in enumerate(zip(a[1:], b[1:], strict=True)) for v in set(x or ()) & set(y or ()) if share is None or common[f"{i}{v}"] <= 15)  # noqa: E731, B023
            want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and score(a, b) >= least - 1e-12 and fit(a, b)}
            got = [(x.a, x.b) for x in gr.similarity_pairs(df, "k", weights, least - 1e-12, share).collect()]
            assert sorted(got) == sorted(want), (least, share)


def test_texts(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = sorted((d, i, x) for d, t in docs.items() for i, x in enumerate(split_sentences(t)))
    assert sorted(map(tuple, _rows(spark, data, "seg_sentences"))) == want
    assert all(re.findall(r"\w+", " ".join(split_sentences(t))) == re.findall(r"\w+", t or "") for t in docs.values())
    assert Counter(map(tuple, _rows(spark, data, "ext_all"))) == Counter((d, *s) for d, t in docs.items() for s in find_spans(t))
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r.texto for r in _rows(spark, data, "parse_html_text")}
    assert got == {i: text_of(h) for i, h in pages.items()}
    plain = lambda h: re.sub(r"(?is)<!--.*?-->|<(script|style|template|noscript|title)\b.*?</\1>|<[^>]*>", " ", h)
    words = lambda x: re.findall(r"[a-z]{3,}", x.lower())
    assert all(words(got[i]) == words(re.sub("&[a-z]+;", " ", plain(h))) for i, h in list(pages.items())[:50] if "&" not in plain(h))


def test_packs_and_ratios(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = []
    for d, t in docs.items():
        out = []
        for p in (t or "").split("\n") if t is not None else ():
            if out and len(out[-1]) + 1 + len(p) <= 400:
                out[-1] += "\n" + p
            else:
                out.append(p)
        want += [(d, i, x) for i, x in enumerate(out)]
    assert sorted(map(tuple, _rows(spark, data, "win_greedy_pack"))) == sorted(want)
    parts = {r.p_partkey: (r.p_name, r.p_type) for r in spark.read.parquet(f"{data}/part.parquet").collect()}
    assert {r.p_partkey: r.v for r in _rows(spark, data, "fn_seq_ratio")} == {k: difflib.SequenceMatcher(None, a, b).ratio() for k, (a, b) in parts.items()}
    assert all(r.tono == zlib.crc32(fold_value(r.event_type.strip()).encode()) % 7 for r in _rows(spark, data, "fn_stable_color"))


def test_counts_and_samples(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    exact = {r.event_type: r.n for r in events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n")).collect()}
    got = {r.event_type: r.usuarios for r in _rows(spark, data, "agg_approx_distinct")}
    assert set(got) == set(exact) and all(abs(got[k] - n) <= max(2, 0.15 * n) for k, n in exact.items())
    rows = _rows(spark, data, "ev_sample")
    assert len({r.event_id for r in rows}) == len(rows) <= 200 and rows == _rows(spark, data, "ev_sample")
    per = Counter((r.codigo, r.tipo_emocion == "purchase") for r in rows)
    assert max(per.values()) <= 5
    sizes = Counter(r.tipo_emocion == "purchase" for r in rows)
    strata = Counter()
    for r in events.collect():
        strata[r.user_id, r.event_type == "purchase"] += 1
    have = {p: sum(min(n, 5) for (_, q), n in strata.items() if q == p) for p in (True, False)}
    assert len(rows) == min(200, sum(have.values())) and (sizes[True] == 100 == sizes[False] or min(have.values()) < 100)
    again = _rows(spark, data, "ev_resample")
    good = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    assert {r.doc_id for r in again} <= good and len({r.doc_id for r in again}) == min(30, len(good)) and again == _rows(spark, data, "ev_resample")


def test_merge_suggestions(spark, data):
    n = {}
    from discera.functions.text import canonical_slug

    for r in spark.read.parquet(f"{data}/part.parquet").groupBy(canonical_slug(F.col("p_name")).alias("c")).count().collect():
        n[r.c] = r["count"]
    words = {c: {w for w in c.split("_") if len(w) > 2} for c in n}
    share = Counter(w for ws in words.values() for w in ws)
    root = {c: c for c in n}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a in n:
        for b in n:
            if a < b and any(share[w] <= 60 for w in words[a] & words[b]):
                jac = len(words[a] & words[b]) / len(words[a] | words[b])
                if max(jac, 0.9 if a in b or b in a else 0, difflib.SequenceMatcher(None, a, b).ratio()) >= 0.62:
                    root[find(a)] = find(b)
    groups = {}
    for c in n:
        groups.setdefault(find(c), []).append(c)
    want = sorted((min(g, key=lambda c: (-n[c], len(c), c)), ",".join(sorted(g))) for g in groups.values() if len(g) > 1)
    assert sorted((r.sugerido, r.miembros) for r in _rows(spark, data, "er_merge_suggest")) == want


def test_matches(spark, data):
    units = Counter()
    for r in QUERIES["g_key"](spark, data).collect():
        codigo, i, _ = r.clave.split(":")
        units[f"{codigo}:{int(i) // 3}"] += 1
    got = {r.unidad: r for r in _rows(spark, data, "ev_match")}
    assert set(got) == set(units) and all(got[u].tp + got[u].fn == n == got[u].tp + got[u].fp for u, n in units.items())
    (report,) = _rows(spark, data, "ev_report")
    assert (report.tp, report.fn) == (sum(r.tp for r in got.values()), sum(r.fn for r in got.values()))

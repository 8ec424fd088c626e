"""Operators that compare documents: lines, near copies, repeats, mixing, links of hosts, vectors, and the pipeline."""

import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from discera.llm import common, linededup, mixing, ngramjoin, substrings, topk, toxicity, urlgraph
from discera.llm import queries as q

from . import cases


def _register(data):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_against_sql(spark, data, name):
    want = _register(data).execute(q.oracle_sql()[name]).fetchdf()
    got = q.queries()[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    by = list(got.columns[:3])
    got, want = (x[sorted(x.columns)].sort_values(by).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert got[c].isna().tolist() == want[c].isna().tolist()
            assert np.allclose(got[c], want[c], equal_nan=True)
        else:
            assert got[c].tolist() == want[c].tolist()


def _line_docs():
    r = cases.rng(5)
    pool = [f"  Line number {i} of the pool " for i in range(12)] + ["short", "", " ", "É" * 10, "é" * 10, "\ttabbed line here\r", "TABBED line here"]
    return ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 7))) for _ in range(40)] + cases.strange()


def test_lines_against_brute_force(spark):
    texts = _line_docs()
    want = cases.lines(list(enumerate(texts)))
    for x in linededup.annotate(cases.frame(spark, cases.rows(texts))).collect():
        assert (x.ld_lines, x.ld_dropped, x.ld_text) == want[x.doc_id]
        assert x.k == "K" and x.h == 1
    kept = {x.doc_id: x.text for x in linededup.clean(cases.frame(spark, cases.rows(texts))).collect()}
    assert all(kept[d] == texts[d] for d, w in want.items() if not w[1])
    assert all(kept[d] == w[2] for d, w in want.items() if w[1] and w[2].strip(cases.SPACE))


def test_lines_of_repeated_and_null_ids(spark):
    line = "the same long line"
    rows = cases.rows([line, line, line, line + "\n" + line], ids=[4, 4, None, 9])
    got = sorted((str(x.doc_id), x.ld_lines, x.ld_dropped) for x in linededup.annotate(cases.frame(spark, rows)).collect())
    assert got == [("4", 1, 0), ("4", 1, 0), ("9", 2, 2), ("None", 1, 0)]
    three = linededup.annotate(cases.frame(spark, rows), min_docs=3)
    assert three.agg(F.sum("ld_dropped")).first()[0] == 0
    assert linededup.annotate(cases.frame(spark, []).where("false")).count() == 0


def _near_docs(seed):
    r = cases.rng(seed)
    texts = []
    for size, copies, edits in ((120, 40, 6), (60, 25, 4), (30, 12, 2), (12, 8, 1), (7, 6, 1)):
        texts += cases.family(r, size, copies, edits)
    # a chain: each a few words from the one before, far from the first
    w = [f"c{i}" for i in range(80)]
    for step in range(12):
        texts.append(" ".join(w))
        for i in range(step * 5, step * 5 + 2):
            w[i % 80] = f"n{step}_{i}"
    common_line = " ".join(f"boiler{i}" for i in range(14))
    texts += [common_line + " " + " ".join(f"u{j}_{i}" for i in range(r.randrange(3, 40))) for j in range(30)]
    texts += [texts[0].upper(), texts[3], texts[3], "a b c d", "A  B c\nd", "a b c", *cases.strange()]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_against_brute_force(spark, seed):
    texts = _near_docs(seed)
    want = cases.components(list(enumerate(texts)))
    got = ngramjoin.join(cases.frame(spark, cases.rows(texts)))
    assert sorted((x.doc_id, x.nj_size, x.nj_component) for x in got.collect()) == want
    kept = {x.doc_id for x in ngramjoin.keep_one(cases.frame(spark, cases.rows(texts))).collect()}
    assert kept == {d for d, _, c in want if d == c}


def test_near_copies_of_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = cases.rows([a, a, a + " z", b, b, None, "", a], ids=[5, 5, 3, 5, None, 7, 8, None])
    df = cases.frame(spark, rows)
    got = sorted((str(x.doc_id), x.nj_size, x.nj_component) for x in ngramjoin.join(df).collect())
    assert got == sorted([("5", 26, 3), ("5", 26, 3), ("3", 27, 3), ("5", 26, 5), ("None", 26, 5), ("7", 0, 7), ("8", 0, 8), ("None", 26, 3)])
    kept = sorted((str(x.doc_id), (x.text or "")[:2]) for x in ngramjoin.keep_one(df).collect())
    assert kept == [("3", "a0"), ("5", "b0"), ("7", ""), ("8", "")]
    assert ngramjoin.join(df.where("false")).count() == 0 and ngramjoin.keep_one(df.where("false")).count() == 0


def test_components(spark):
    r = cases.rng(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    want = {n: find(n) for e in edges for n in e if e[0] != e[1]}
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.root for x in got.collect()} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_saved_tables_are_forgotten(spark):
    df = common.saved(spark.range(10))
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 10 and os.path.exists(path)
    assert common.forget(spark) >= 1 and not os.path.exists(path) and common.forget(spark) == 0


def _repeat_docs(seed):
    r = cases.rng(seed)
    passages = [[f"p{j}_{r.randrange(40)}" for _ in range(r.choice((34, 35, 36, 50, 90)))] for j in range(6)]
    passages.append(["same"] * 50)  # all windows alike
    passages.append(["x", "y"] * 30)
    texts = []
    for i in range(50):
        w = [f"u{i}_{k}" for k in range(r.randrange(20))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(4)
            w += p[a : len(p) - r.randrange(4)] + [f"v{i}_{k}" for k in range(r.randrange(15))]
        texts.append(r.choice((" ", "\n", "  ")).join(w))
    return texts + [texts[0], "Same " * 40, *cases.strange()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_against_brute_force(spark, seed):
    texts = _repeat_docs(seed)
    got = substrings.digest(cases.frame(spark, cases.rows(texts)))
    assert sorted(map(tuple, got.collect())) == cases.repeats(list(enumerate(texts)))


def test_repeats_of_repeated_ids_and_extra_columns(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = cases.rows([a, a, a + " end", None], ids=[1, 1, None, None])
    got = sorted((str(x.doc_id), x.sd_words, x.sd_removed, x.sd_text, x.k) for x in substrings.dedup(cases.frame(spark, rows)).collect())
    assert got == [("1", 40, 40, "", "K"), ("1", 40, 40, "", "K"), ("None", 0, 0, "", "K"), ("None", 41, 40, "end", "K")]
    assert substrings.dedup(cases.frame(spark, []).where("false")).count() == 0


def test_mixing_against_brute_force(spark):
    r = cases.rng(4)
    sources = [r.choice(["b", "a", "Z", "é", None, "c"]) for _ in range(400)]
    texts = [" ".join(["w"] * r.randrange(0, 60 if s != "a" else 400)) for s in sources] + [None, ""]
    sources += ["a", "solo-vacío"]
    docs = cases.frame(spark, cases.rows(texts, sources=sources))
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(cases.words(t))
    want = cases.targets(sizes)
    rows = mixing.annotate(docs).collect()
    taken = {}
    for x in rows:
        n = len(cases.words(texts[x.doc_id]))
        rate = want[x.source] / sizes[x.source] if sizes[x.source] else 0
        assert x.mx_size == n and x.mx_source_size == sizes[x.source] and x.mx_target == pytest.approx(want[x.source])
        assert np.floor(rate) <= x.mx_copies <= min(2, np.floor(rate) + 1) and x.k == "K"
        taken[x.source] = taken.get(x.source, 0) + x.mx_copies * n
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= 0.15 * max(want[s], 500) for s in want)
    assert sorted(map(tuple, mixing.digest(docs).collect())) == sorted(map(tuple, mixing.digest(docs.repartition(3)).collect()))
    copies = {(x.doc_id, x.mix_copy) for x in mixing.mix(docs).collect()}
    assert copies == {(x.doc_id, i) for x in rows for i in range(x.mx_copies)}
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("text is null")).count() == 0


def _host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for sign in "?#":
        rest = rest.split(sign, 1)[0]
    host = rest.split("/", 1)[0]
    return cases.low(host), rest[len(host) :]


def _rule(host, path):
    best = None
    for kind, h, p in urlgraph.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, kind)
    return best or (None, None)


def _standing(pages, links, damping, rounds=300):
    """Distrust shares of hosts by dictionaries, after so many rounds that nothing moves any more."""
    hosts, yes, no = set(), {}, {}
    for u in pages:
        h, p = _host_path(u)
        if h:
            hosts.add(h)
            kind = _rule(h, p)[1]
            for name, d in (("allow", yes), ("block", no)):
                if kind == name:
                    d[h] = d.get(h, 0) + 1
    pairs = {}
    for a, b in links:
        if a and a != b:
            pairs[a, b] = pairs.get((a, b), 0) + 1
    nodes = set()
    for h in hosts | {b for _, b in pairs}:
        parts = h.split(".")
        nodes |= {".".join(parts[i:]) for i in range(max(1, len(parts) - 1))}
    tree = {}
    for n in nodes:
        if "." in n and "." in n.split(".", 1)[1]:
            tree[n, n.split(".", 1)[1]] = tree[n.split(".", 1)[1], n] = 1

    def ranks(direct, seeds):
        edges = {}
        for part in (direct, tree):
            total = {}
            for (a, _), w in part.items():
                total[a] = total.get(a, 0) + w
            for (a, b), w in part.items():
                edges.setdefault((a, b), 0)
                edges[a, b] += w / total[a]
        out = {}
        for (a, _), w in edges.items():
            out[a] = out.get(a, 0) + w
        s = sum(seeds.values())
        seeds = {h: n / s for h, n in seeds.items()}
        r = dict(seeds)
        for _ in range(rounds):
            new = {h: (1 - damping) * x for h, x in seeds.items()}
            for (a, b), w in edges.items():
                if a in r:
                    new[b] = new.get(b, 0) + damping * w / out[a] * r[a]
            r = new
        total = sum(r.values())
        return {h: x / total for h, x in r.items()}

    trust, doubt = ranks(pairs, yes), ranks({(b, a): w for (a, b), w in pairs.items()}, no)
    return {h: doubt.get(h, 0) / (trust.get(h, 0) + doubt.get(h, 0)) for h in hosts if trust.get(h, 0) + doubt.get(h, 0) > 0}


def test_url_filter_against_brute_force(spark):
    r = cases.rng(6)
    names = ["www.example.com", "a.example.com", "b.net", "x.b.net", "c.org", "d.c.org", "e.org", "f.io", "G.IO", "h.org", "lone.org"]
    rows, links = [], []
    for i in range(160):
        host = r.choice(names[:-1])
        url = f"https://{host}/{r.choice(('en', 'es', 'fr', ''))}/{i}" + r.choice(("", "?q=://x", "#f"))
        out = [r.choice(names[:-1]) for _ in range(r.randrange(4))]
        rows.append((i, url, "".join(f'<a href="http://{h}/p">x</a> <img src=//{h}>' for h in out)))
        links += [(cases.low(host), cases.low(h)) for h in out for _ in (0, 1)]
    odd = [None, "", "no scheme/en/", "https://", "http://EXAMPLE.com", "http://example.com?en/", "http://www.example.com:80/en/", "ftp://com/", "http://lone.org/a", "x://net/es/"]
    rows += [(200 + i, u, None) for i, u in enumerate(odd)]
    pages = spark.createDataFrame([(*x, "K", "h") for x in rows], "page_id long, url string, html string, host string, h string")
    standing = _standing([u for _, u, _ in rows], links, 0.85)
    got = urlgraph.judge(pages, rounds=72).collect()
    assert len(got) == len(rows)
    blocked = 0
    for x in got:
        host, path = _host_path(x.url)
        rule, kind = _rule(host, path)
        assert (x.uf_host, x.uf_path, x.uf_rule, x.host) == (host, path, rule, "K")
        share = standing.get(host)
        assert x.uf_distrust == (pytest.approx(share, abs=1e-5) if share is not None else None)
        if share is None or abs(share - 0.5) > 1e-5:
            assert x.uf_verdict == (kind or ("block" if share is not None and share >= 0.5 else "allow"))
        blocked += rule is None and x.uf_verdict == "block"
    assert blocked > 5
    assert urlgraph.judge(pages.where("false")).count() == 0


def test_hosts_with_equal_shares_far_from_seeds_and_of_many_labels(spark):
    link = lambda h: f'<a href="http://{h}/">'
    rows = [(0, "http://a.com/x", link("x.io")), (1, "http://x.io/", link("b.net")), (2, "http://b.net/es/", None)]
    got = {x.uf_host: (x.uf_distrust, x.uf_verdict) for x in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["x.io"] == (0.5, "block")
    chain = [f"h{i}.org" for i in range(60)] + ["b.net"]
    rows = [(i, f"http://{a}/", link(b)) for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False))] + [(99, "http://b.net/es/", None)]
    got = urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {x.uf_verdict for x in got.collect()} == {"block"} and {x.uf_distrust for x in got.collect()} == {1.0}
    long = ".".join(["a"] * 30_000)
    got = urlgraph.judge(spark.createDataFrame([(0, f"http://{long}.net/es/", None), (1, f"http://{long}.net/x", link("y.io"))], "page_id long, url string, html string")).collect()
    assert [x.uf_rule for x in sorted(got, key=lambda x: x.page_id)] == ["net/es/", None] and all(x.uf_host == long + ".net" for x in got)


def test_lines_in_linear_time(spark):
    def seconds(n):
        text = "\n".join(f"this is the line number {i}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, text + "\nthe last of all lines")], "doc_id long, text string")
        start = time.perf_counter()
        assert sorted(tuple(x)[:3] for x in linededup.digest(df).collect()) == [(1, n, 0), (2, n + 1, n)]
        return time.perf_counter() - start

    seconds(100)
    assert seconds(200_000) < 30 * max(seconds(20_000), 0.5)


def test_draws_of_rows_without_ids(spark):
    rows = cases.rows([f"w{i} " * 20 for i in range(1000)], ids=[None] * 1000, sources=["a"] * 500 + ["b"] * 500)
    got = mixing.annotate(cases.frame(spark, rows)).groupBy("source").agg(F.sum(F.col("mx_size") * F.col("mx_copies")).alias("taken"), F.max("mx_target").alias("target")).collect()
    assert all(abs(x.taken - x.target) < 0.1 * x.target for x in got)


def test_shingles_that_many_documents_share(spark):
    r = cases.rng(8)
    common = " ".join(f"boiler{i}" for i in range(14))
    texts = [f"{common} " + " ".join(f"u{i}_{j}" for j in range(r.randrange(2, 6))) for i in range(150)] + [f"{common} x{i % 3}" for i in range(60)]
    texts += cases.family(r, 40, 30, 2)
    want = cases.components(list(enumerate(texts)))
    got = ngramjoin.join(cases.frame(spark, cases.rows(texts)).repartition(6))
    assert sorted((x.doc_id, x.nj_size, x.nj_component) for x in got.collect()) == want


def test_lossy_counts_find_frequent_shingles():
    r = np.random.default_rng(3)
    seen, all_, frequent = [], 4000, ngramjoin._Frequent()
    for lo in range(0, all_, 100):
        sets = [np.unique(np.concatenate([r.integers(1000, 10**12, 40).astype(np.uint64), np.flatnonzero(r.random(10) < np.linspace(0.005, 0.3, 10)).astype(np.uint64)])) for _ in range(100)]
        frequent.add(np.concatenate(sets), 100)
        seen += sets
    names, counts = np.unique(np.concatenate(seen), return_counts=True)
    found, times = frequent.found()
    exact = dict(zip(names.tolist(), counts.tolist(), strict=True))
    assert set(names[counts >= ngramjoin.HOT * all_].tolist()) <= set(found.tolist())
    assert all(0 <= exact[n] - t <= ngramjoin.HOT / 8 * all_ for n, t in zip(found.tolist(), times.tolist(), strict=True))
    assert len(frequent.names) < 20_000


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = [(int(i), [float(x) for x in np.float32(r.normal(size=6) * (i % 3))]) for i in range(700)]
    vectors[150] = (150, vectors[50][1])
    vectors += [(3, vectors[3][1]), (700, None), (701, [1.0, None, 2.0]), (702, [float("nan")] * 6), (703, [float("inf")] + [0.0] * 5), (704, []), (750, [1.0, 2.0]), (None, [1.0] * 6)]
    valid = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for qi, qv in {i: v for i, v in valid if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in valid if i != qi)[:5]
        want += [(qi, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    df = spark.createDataFrame([(*x, "K") for x in vectors], "vec_id long, embedding array<float>, score string").repartition(5)
    got = topk.digest(df)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    blocks = topk.search(df.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, block_bytes=200)  # many blocks of queries
    assert sorted(map(tuple, blocks.collect())) == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [3.0e38]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert [(x.rank, x.vec_id, x.score) for x in topk.digest(few).orderBy("rank").collect()] == [(1, 1, (1 << 63) - 1), (2, 2, -65536)]
    assert topk.digest(few.where("false")).count() == 0
    wide = spark.createDataFrame([(0, [2.0, 0.0, 1e9]), (50, [1e307]), (1, [0.0] * 300_000 + [5.0]), (2, [1.0, -3.0]), (3, [1e305, 1.0]), (4, [4.0, 4.0, 2e9])], "vec_id long, embedding array<double>")
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in topk.digest(wide).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, (1 << 63) - 1), (0, 2, 4, min((1 << 63) - 1, 512 * 1024 + 256000000000 * 512000000000)), (0, 3, 2, 512 * 256), (0, 4, 1, 0)]


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {x.doc_id: x for x in toxicity.clean(docs, labels).collect()}
    texts = {d: x.text for d, x in clean.items()}
    texts = {d: t for d, (_, n, t) in cases.lines(sorted(texts.items())).items() if not n or t.strip(cases.SPACE)}
    texts = {d: texts[d] for d, n, c in cases.components(sorted(texts.items())) if d == c}
    hits = {d: (n, h) for d, n, h, *_ in cases.leaks(sorted(texts.items()), items)}
    stages = dict(p.STAGES)
    near = p.saved(stages["ngram_jaccard_join"](spark, p.saved(stages["line_dedup"](spark, p.saved(stages["toxicity"](spark, docs, data)), data)), data))
    assert {x.doc_id: x.text for x in near.collect()} == texts
    cut = {x.doc_id: x for x in stages["benchmark_decontamination"](spark, near, data).collect()}
    assert set(cut) == {d for d, (n, h) in hits.items() if h < n or not n}
    assert all(cut[d].text == texts[d] for d, (_, h) in hits.items() if not h)
    assert all(x.n_chars == len(x.text) for x in cut.values())
    final = p.run(spark, data).collect()
    sizes = {}
    for x in cut.values():
        sizes[x.source] = sizes.get(x.source, 0) + len(cases.words(x.text))
    want, copies = cases.targets(sizes), {}
    for x in final:
        assert x.text == cut[x.doc_id].text
        copies.setdefault(x.doc_id, []).append(x.mix_copy)
    for d, x in cut.items():
        rate = want[x.source] / sizes[x.source] if sizes[x.source] else 0
        assert sorted(copies.get(d, [])) in [list(range(int(np.floor(rate) + i))) for i in (0, 1)]
    assert [name for name, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources"]
    again = sorted((x.doc_id, x.mix_copy) for x in p.run(spark, data).collect())
    assert again == sorted((x.doc_id, x.mix_copy) for x in final)

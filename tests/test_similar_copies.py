"""Similar rows of which many are copies: each class is compared once, and nothing is lost."""

import numpy as np
import pytest

from discera.operators import graph as gr
from tests.test_without_sql import _labels

WEIGHTS = {"marca": 2.0, "tipo": 1.0, "talla": 1.0}
SCHEMA = "k long, marca array<string>, tipo array<string>, talla array<string>"


def _parts(classes, copies, seed=3):
    r = np.random.default_rng(seed)
    kinds = [([f"b{r.integers(5)}"], [f"t{x}" for x in r.integers(0, 6, r.integers(0, 4)).tolist()], [f"s{r.integers(9)}"] if r.random() < 0.9 else None) for _ in range(classes)]
    rows = [kinds[i] for i in range(classes) for _ in range(copies[i % len(copies)])]
    return [(int(k), *row) for k, row in zip(r.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize(("least", "share"), [(0.5, 0.25), (0.5, None), (0.75, 0.25), (0.9, None)])
def test_pairs_and_groups_of_copies(spark, monkeypatch, least, share):
    monkeypatch.setattr(gr, "CHUNK", 4)
    rows = _parts(24, (1, 1, 2, 3, 9))
    count = {}
    for row in rows:
        for v in {(i, x) for i, c in enumerate(row[1:]) for x in c or ()}:
            count[v] = count.get(v, 0) + 1

    def score(a, b):
        sets = [(set(x or ()), set(y or ()), w) for x, y, w in zip(a[1:], b[1:], WEIGHTS.values(), strict=True)]
        fit = any(share is None or count[i, v] <= max(int(len(rows) * share), 2) for i, (x, y, _) in enumerate(sets) for v in x & y)
        return sum(w * len(x & y) / len(x | y) for x, y, w in sets if x | y) / sum(w for x, y, w in sets if x | y) if fit else 0

    want = {(a[0], b[0]): round(s, 4) for a in rows for b in rows if a[0] < b[0] and (s := score(a, b)) >= least - 1e-12}
    df = spark.createDataFrame(rows, SCHEMA)
    got = gr.similarity_pairs(df, "k", WEIGHTS, least - 1e-12, share).collect()
    assert len(got) == len(want) and {(x.a, x.b): x.similitud for x in got} == pytest.approx(want, abs=2e-4)
    labels = {r.nodo: r.comunidad for r in gr.similarity_groups(df, "k", WEIGHTS, least - 1e-12, share).collect()}
    assert labels == _labels([(str(x.a), str(x.b), x.similitud) for x in got])


def test_links_do_not_grow_with_copies(spark):
    links = [gr.similarity_classes(spark.createDataFrame(_parts(30, copies), SCHEMA), "k", WEIGHTS)[1].where("a <> b").count() for copies in ((2,), (40,))]
    assert links[0] == links[1] > 0


def test_groups_of_a_key_in_two_classes(spark):
    df = spark.createDataFrame([(1, ["a"], ["x"], ["s"]), (1, ["b"], ["y"], ["t"]), (2, ["a"], ["x"], ["u"]), (3, ["b"], ["y"], ["v"])], SCHEMA)
    pairs = [(str(x.a), str(x.b), x.similitud) for x in gr.similarity_pairs(df, "k", WEIGHTS, 0.5, None).collect()]
    assert len(pairs) == 2
    assert {r.nodo: r.comunidad for r in gr.similarity_groups(df, "k", WEIGHTS, 0.5, None).collect()} == _labels(pairs)

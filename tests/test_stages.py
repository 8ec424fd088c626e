"""Stages around a model: policies, alignment, spans, vocabularies, blocks, genres, payloads."""

import json

import pytest
from pyspark.sql import functions as F

from discera.operators import infer as nf
from discera.operators import stages as sg
from discera.operators import state as st


def test_retries_wait_longer_and_permanent_errors_do_not():
    slept, asked = [], []

    def flaky(fail, error):
        def ask():
            asked.append(1)
            if len(asked) <= fail:
                raise error("x")
            return ["ok"]

        return ask

    policy = nf.Policy(retries=3, delays=(1, 5), sleep=slept.append)
    assert policy.call(flaky(3, nf.TransientError)) == ["ok"] and slept == [1, 5, 5]
    asked.clear()
    with pytest.raises(nf.TransientError):
        policy.call(flaky(9, nf.TransientError))
    assert len(asked) == 4
    asked.clear()
    with pytest.raises(nf.ModelError):
        policy.call(flaky(1, nf.ModelError))
    assert len(asked) == 1
    for bad in ({"retries": -1}, {"delays": ()}, {"breaker": -1}):
        with pytest.raises(ValueError):
            nf.Policy(**bad)


def test_errors_stay_with_their_rows_and_the_breaker_opens(spark):
    class Failing:
        """Fails on prompts with a word, in a way that the word names."""

        def generate(self, prompts):
            if any("gone" in p for p in prompts):
                raise nf.TransientError("gone")
            if any("wrong" in p for p in prompts):
                raise nf.ModelError("wrong")
            return ["{}"] * len(prompts)

    rows = spark.createDataFrame([(i, "wrong" if i == 5 else f"p{i}") for i in range(20)], "i long, p string").coalesce(1)
    policy = nf.Policy(retries=0, breaker=2, sleep=len)
    got = {r.i: r.error for r in nf.infer(rows, F.col("p"), Failing, batch=4, policy=policy).collect()}
    assert {i for i, e in got.items() if e} == {5}
    rows = spark.createDataFrame([(i, "gone" if i < 12 else "fine") for i in range(20)], "i long, p string").coalesce(1)
    got = [r.error for r in nf.infer(rows, F.col("p"), Failing, batch=4, policy=policy).orderBy("i").collect()]
    assert got[:8] == ["gone"] * 8 and set(got[8:]) == {"the model failed too often in this task"}
    never = nf.Policy(retries=0, breaker=0, sleep=len)
    assert [r.error for r in nf.infer(rows, F.col("p"), Failing, batch=4, policy=never).orderBy("i").collect()] == ["gone"] * 12 + [None] * 8


def test_alignment():
    item = lambda i, a, x: {"unit_idx": i, "ancla": a, "x": x}
    got = nf.aligned(json.dumps([item(2, "B", 1), item(1, " a  b", 2)]), 2, ["A B", "b"])
    assert [json.loads(x) for x in got] == [{"x": 2}, {"x": 1}]
    assert nf.aligned(json.dumps([item(0, "?", 1)]), 1, [None]) == [json.dumps({"x": 1})]
    for bad in ([item(0, "a", 1), item(2, "b", 1)], [item(0, "a", 1)], [item(0, "a", 1), item(0, "b", 1)], [item(0, "b", 1), item(1, "a", 1)], {"a": 1}, [1, 2]):
        with pytest.raises(nf.ModelError):
            nf.aligned(json.dumps(bad), 2, ["a", "b"])


def test_batches_are_halved_once(spark):
    class Short:
        def generate(self, prompts):
            if len(json.loads(prompts[0])) > 3:
                raise nf.ContextTooLong("too long")
            return nf.StubBatches().generate(prompts)

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(14)], "i long, p string").coalesce(1)
    for batch, fails in ((6, False), (14, True)):
        got = nf.infer_batches(rows, F.col("p"), F.col("p"), Short, batch=batch).collect()
        assert all((r.error is not None) == fails and (r.payload is None) == fails for r in got)


def test_spans_are_taken_once_and_exact_ones_first(spark):
    spans = spark.createDataFrame([("u", 1, 0, "Hola"), ("u", 2, 5, "hola"), ("u", 3, 9, "chau"), ("v", 4, 0, "STRASSE"), ("w", 5, 0, "Uno")], "u string, id long, inicio int, valor string")
    answers = spark.createDataFrame([("u", 0, " hola "), ("u", 1, "hola"), ("u", 2, "hola"), ("u", 3, ""), ("u", 4, "nada"), ("v", 0, "Straße"), ("w", 0, "uno"), ("w", 1, "Uno")], "u string, orden int, valor string")
    got = sorted((r.u, r.orden, r.id) for r in sg.match_spans(answers, spans, ["u"]).collect())
    assert got == [("u", 0, 2), ("u", 1, 1), ("v", 0, 4), ("w", 0, 5)]


def test_vocabulary_blocks_and_genres(spark):
    df = spark.createDataFrame([(1, ["Ánimo", "otro", "animo", "PODER "]), (2, None), (3, [])], "i long, v array<string>")
    assert [r.s for r in sg.closed_vocabulary(df, "v", ["poder", "ánimo"], "s").orderBy("i").collect()] == [["ánimo", "poder"], [], []]
    units = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "codigo string, unit_idx long")
    texts = spark.createDataFrame([("a", " " + "palabra " * 30), ("b", "  ")], "codigo string, texto string")
    got = {(r.codigo, r.unit_idx): r.hilo for r in sg.with_blocks(units, "judge", [(sg.Block("hilo", ("judge",), 5), texts)]).collect()}
    assert got["a", 0] == got["a", 1] == "palabra…" and got["b", 0] is None
    for bad in (("", ("x",), 1), ("a b", ("x",), 1), ("a", (), 1), ("a", ("x",), 0)):
        with pytest.raises(ValueError):
            sg.Block(*bad)
    genres = sg.Genres()
    genres.register(sg.Genre("tuit", context="hilo"))
    assert genres.get("tuit").context == "hilo" and genres.ids() == ["tuit"]
    with pytest.raises(ValueError):
        genres.register(sg.Genre("tuit"))
    with pytest.raises(ValueError):
        genres.register(sg.Genre("x", unit="palabra"))
    with pytest.raises(KeyError):
        genres.get("nota")
    genres.load("discera.none")
    assert len(sg.AGENTS) == 16


def test_flat_payloads(spark):
    rows = [(1, '{"a": 1, "b": {"x": "y", "z": null}}'), (2, '{"b": 5, "c\'d": [1]}'), (3, "plain"), (4, None)]
    df = spark.createDataFrame(rows, "i long, p string")
    one = {r.i: r.asDict() for r in st.flatten_keys(df, "p", "p").collect()}
    assert one[1]["p__a"] == "1" and json.loads(one[1]["p__b"]) == {"x": "y", "z": None} and one[2]["p__b"] == "5" and one[2]["p__c'd"] == "[1]" and one[3]["p"] == "plain" and set(one[4].values()) == {4, None}
    two = {r.i: r.asDict() for r in st.flatten_keys(df, "p", "p", levels=2).collect()}
    assert two[1]["p__b__x"] == "y" and two[1]["p__b__z"] == "" and two[1]["p__b"] is None and two[2]["p__b"] == "5"
    assert st.flatten_keys(df.where("false"), "p", "p").count() == 0

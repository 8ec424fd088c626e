"""Every function that takes documents, on tables with an extra column for each name that the operators use themselves."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from discera.llm import common, decontam, langid, linededup, mixing, ngramjoin, secrets, substrings, toxicity, urlgraph

from . import cases

TEXTS = ["you are a pathetic idiot", "a calm day in the park and more words here", None, "the same long line\nthe same long line", "the same long line\nother", "password = abcdefgh1", "", " ".join(f"q{i}" for i in range(40))] * 2
LABELS = [(i, 0, i % 2) for i in range(8)]
BENCH = [(0, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11")]


def _names():
    """What stands in quotes in the operators' sources and could be a column's name."""
    found = {"o0_", "o1_", "key", "rank"}
    for module in (common, decontam, langid, linededup, mixing, ngramjoin, secrets, substrings, toxicity, urlgraph):
        with open(module.__file__) as f:
            found |= set(re.findall(r"['\"]([A-Za-z_][A-Za-z_0-9]{0,15})['\"]", f.read()))
    return sorted({x.lower() for x in found} - {"doc_id", "text", "lang", "source", "url", "html", "page_id"})


NAMES = _names()


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(i, f"http://h{i}.net/es/", "<a href='http://x.org/'>") for i in range(4)], "page_id long, url string, html string")
    more = lambda df, key: df.select("*", *(F.concat(F.lit(n + " "), key).alias(n) for n in NAMES))
    return common.saved(more(docs, "doc_id")), common.saved(more(pages, "page_id")), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), spark.createDataFrame(BENCH, "item_id long, text string")


ADDING = {
    "score": lambda d, labels, _: toxicity.score(d, labels),
    "scan": lambda d, *_: secrets.scan(d),
    "decontam": lambda d, _, bench: decontam.annotate(d, bench, clean=True),
    "identify": lambda d, *_: langid.identify(d),
    "join": lambda d, *_: ngramjoin.join(d),
    "dedup": lambda d, *_: substrings.dedup(d),
    "lines": lambda d, *_: linededup.annotate(d),
    "mixing": lambda d, *_: mixing.annotate(d),
    "mix": lambda d, *_: mixing.mix(d),
}
CLEANING = {
    "toxicity": lambda d, labels, _: toxicity.clean(d, labels),
    "lines": lambda d, *_: linededup.clean(d),
    "keep_one": lambda d, *_: ngramjoin.keep_one(d),
    "decontam": lambda d, _, bench: decontam.clean(d, bench),
}


def _unchanged(df, key):
    names = df.columns
    assert len({n.lower() for n in names}) == len(names)
    for r in df.select(key, *NAMES).collect():
        assert all(r[n] == f"{n} {r[key]}" for n in NAMES)


@pytest.mark.parametrize("name", sorted(ADDING))
def test_added_columns(tables, name):
    docs, _, labels, bench = tables
    got = ADDING[name](docs, labels, bench)
    assert got.columns[: len(docs.columns)] == docs.columns and len(got.columns) > len(docs.columns)
    _unchanged(got, "doc_id")


@pytest.mark.parametrize("name", sorted(CLEANING))
def test_cleaned_documents(tables, name):
    docs, _, labels, bench = tables
    got = CLEANING[name](docs, labels, bench)
    assert got.columns == docs.columns
    _unchanged(got, "doc_id")


def test_pages(tables):
    got = urlgraph.judge(tables[1])
    assert got.columns[: len(tables[1].columns)] == tables[1].columns and len(got.columns) == len(tables[1].columns) + 5
    _unchanged(got, "page_id")


def test_pipeline(spark, tables, tmp_path):
    docs, _, labels, bench = tables
    for name, df in (("documents", docs.withColumn("n_chars", F.length("text").cast("long"))), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = p.run(spark, str(tmp_path))
    _unchanged(got, "doc_id")
    assert got.count() > 0


def test_strange_rows_of_all(spark):
    rows = cases.rows(["a b c d e f", None, "a b c d e f", ""], ids=[None, None, 3, 3])
    docs = cases.frame(spark, rows)
    labels, bench = spark.createDataFrame([(3, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(None, "a b c"), (1, None), (2, "a b c"), (2, "b c")], "item_id long, text string")
    for name, f in ADDING.items():
        if name != "mix":
            assert f(docs, labels, bench).count() == 4, name
            assert f(docs.where("false"), labels.where("false"), bench.where("false")).count() == 0, name
    got = sorted((str(x.doc_id), x.text or "", x.dc_hit, x.dc_items) for x in decontam.annotate(docs, bench).collect())
    assert got == [("3", "", 0, []), ("3", "a b c d e f", 3, ["2"]), ("None", "", 0, []), ("None", "a b c d e f", 3, ["2"])]
    assert {x.dc_hit for x in decontam.annotate(docs, bench.where("false")).collect()} == {0}

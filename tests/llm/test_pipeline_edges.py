"""Every stage of the pipeline on documents with nulls, blanks, huge texts, repeated rows and extra columns, and on empty tables."""

import pytest

import corpus_pipeline as p

from . import cases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    texts = [f"you are a pathetic idiot and a worthless clown number {i}" for i in range(40)] + [f"a calm day number {i} in the quiet park of town {i}" for i in range(40)]
    passage = " ".join(f"q{i}" for i in range(30))
    own = " ".join(f"o{i}" for i in range(80))
    texts += [passage, own + " " + passage + " end", *cases.strange(), *cases.family(cases.rng(1), 60, 5, 2), None, "last"]
    ids = list(range(len(texts)))
    ids[-1] = ids[-2] = None
    ids[50] = 49  # a doc_id that stands twice
    sources = ["a" if i % 3 else None for i in ids[:-2]] + [None, "z"]
    cases.frame(spark, cases.rows(texts, ids=ids, sources=sources)).write.parquet(str(root / "documents.parquet"))
    labels = [(i, 0, 1 if i < 40 else 0) for i in range(80)] + [(None, None, 1), (3, None, 0), (60, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(0, passage), (1, None), (None, "x y"), (2, "")], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stages_keep_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        docs = p.saved(stage(spark, docs, folder))
        seen[name] = docs.collect()
        assert docs.columns == columns + ["mix_copy"] * (name == "mixing_sources")
        assert all(r.k == "K" and r.rank == 7 for r in seen[name])
    text = lambda name: [r.text for r in seen[name]]
    calm = {f"a calm day number {i} in the quiet park of town {i}" for i in range(40)}
    assert not any("idiot" in (t or "") for t in text("toxicity")) and calm <= set(text("toxicity"))
    assert calm <= set(text("line_dedup")) and calm <= set(text("ngram_jaccard_join")) and calm <= set(text("benchmark_decontamination"))
    assert None in text("line_dedup") and "" in text("benchmark_decontamination")
    assert len([t for t in text("ngram_jaccard_join") if t and t.startswith("v")]) == 1
    assert not any("q7" in (t or "") for t in text("benchmark_decontamination")) and any((t or "").endswith("o79  end") for t in text("benchmark_decontamination"))
    assert len(seen["mixing_sources"]) > 0


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in p.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name

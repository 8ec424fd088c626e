"""Every query of the library against its SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from discera.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _cell(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else f"{float(v):.8g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is None else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_queries_without_sql_are_known():
    """Those that SQL does not express are held against plain algorithms in test_without_sql.py."""
    assert set(QUERIES) - set(SQL) == {"agg_approx_distinct", "er_merge_suggest", "ev_match", "ev_report", "ev_resample", "ev_sample", "ext_all", "fn_seq_ratio", "fn_stable_color", "g_betweenness", "g_cliques", "g_communities", "g_semantic", "g_sim_groups", "parse_html_text", "seg_sentences", "win_greedy_pack"}

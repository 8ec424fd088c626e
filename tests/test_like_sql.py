"""Odd rows on which a query once differed from its SQL."""

import duckdb

from discera.plans.catalog import QUERIES, SQL
from tests.test_without_sql import _labels

TEXTS = ["the on of", "THE ón the of", "the on\nof", "the on  of", "the on\tthe of", "the o\u0301n of", "thé on of", "the on\xa0of", "on of", "", None, "x on the of y The"]


def test_text_query_reads_texts_as_they_are(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(?::BIGINT)) AS doc_id, unnest(?::VARCHAR[]) AS text", [len(TEXTS), TEXTS])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    want = sorted(r[0] for r in con.execute(SQL["filter_text_query"]).fetchall())
    assert sorted(r.doc_id for r in QUERIES["filter_text_query"](spark, str(tmp_path)).collect()) == want == [0, 1, 6, 11]


def test_merged_lines_of_one_number_keep_the_first(spark, tmp_path):
    # 20 orders have two lines of the same number and supplier, the second in a file that is larger, so read before
    (tmp_path / "lineitem.parquet").mkdir()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    line = "SELECT i AS l_orderkey, 5 + 0 * i AS l_suppkey, 3::INT AS l_linenumber, '{}' AS l_linestatus FROM range({}) r(i)"
    for name, status, n in (("a", "O", 20), ("b", "F", 50000)):
        con.execute(f"COPY ({line.format(status, n)}) TO '{tmp_path}/lineitem.parquet/{name}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(SQL["set_merge_entities"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["set_merge_entities"](spark, str(tmp_path)).collect())
    assert [r[2] for r in want[:21]] == ["O"] * 20 + ["F"]
    assert got == want


def test_merged_lines_without_supplier_or_number(spark, tmp_path):
    # lines without a supplier stay so, and those without a number stand last
    lines = [(1, None, 1, "a"), (1, 2, 3, "b"), (1, 1, 1, "c"), (2, None, None, "d"), (2, None, 4, "e"), (3, 1, None, "f"), (3, 1, 2, "g"), (3, 2, None, "h"), (4, 7, None, None), (4, 7, 9, "i"), (None, 1, 5, "j"), (None, 2, 6, "k")]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_linestatus VARCHAR)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?)", lines)
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = {tuple(r) for r in QUERIES["set_merge_entities"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(SQL["set_merge_entities"]).fetchall())
    assert got == {(1, None, "a"), (1, 2, "b"), (2, None, "e"), (3, 2, "h"), (4, 7, "i"), (None, 2, "k")}


def test_similar_parts_of_values_that_most_have(spark, tmp_path):
    # half of the parts share a brand, the other half type and size: all 380 pairs of the two halves are similar
    con = duckdb.connect()
    con.execute("""CREATE TABLE part AS SELECT i AS p_partkey, CASE WHEN i % 2 = 0 THEN 'hot' ELSE 'b' || i END AS p_brand,
        CASE WHEN i % 2 = 1 THEN 'common' ELSE 't' || i END AS p_type, CASE WHEN i % 2 = 1 THEN 0 ELSE i END::INT AS p_size FROM range(1, 41) r(i)""")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    want = sorted((a, b, 0.5, "tipo, talla" if a % 2 else "marca") for b in range(1, 41) for a in range(1, b) if a % 2 == b % 2)
    got = sorted(tuple(r) for r in QUERIES["g_sim_pairs"](spark, str(tmp_path)).collect())
    assert len(got) == 380 and got == want == sorted(con.execute(SQL["g_sim_pairs"]).fetchall())
    assert {r.nodo: r.comunidad for r in QUERIES["g_sim_groups"](spark, str(tmp_path)).collect()} == _labels([(str(a), str(b), s) for a, b, s, _ in want])

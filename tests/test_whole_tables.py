"""Queries over whole tables, against sums and small algorithms that cut nothing."""

import datetime
from collections import Counter

import duckdb
import pytest

from discera.plans import catalog_files as files
from discera.plans import catalog_graph as graphs
from discera.plans import catalog_groups as groups
from discera.plans import catalog_text as texts
from discera.plans.catalog import QUERIES
from discera.plans.views import Tables


class Small(Tables):
    """Tables given as rows."""

    def __init__(self, spark, **tables):
        super().__init__(spark, "")
        self.__dict__.update({name: spark.createDataFrame(rows, schema) for name, (rows, schema) in tables.items()})


EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"


def _events(n, user=7):
    return [(i, user, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), ("click", "error", "purchase")[i % 3], 1.0, f'{{"k": {i % 100}}}') for i in range(n)]


@pytest.fixture(scope="module")
def whole(data):
    con = duckdb.connect()
    return lambda sql: con.execute(sql.replace("{", f"'{data}/").replace("}", ".parquet'")).fetchall()


def _edges(whole):
    return {(a, b): n for a, b, n in whole("SELECT c_nationkey::VARCHAR, s_nationkey::VARCHAR, count(*) FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY ALL")}


def test_graph_of_all_orders(spark, data, whole):
    edges = _edges(whole)
    assert {(r.origen, r.destino): r.peso for r in QUERIES["g_build"](spark, data).collect()} == edges
    assert {(r.origen, r.destino) for r in QUERIES["g_mutual"](spark, data).collect()} == {(a, b) for a, b in edges if a != b and (b, a) in edges}
    out, into = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    assert {r.nodo: (r.grado_entrada, r.grado_salida) for r in QUERIES["g_degree"](spark, data).collect()} == {n: (into[n], out[n]) for n in {*out, *into}}
    nodes, total = sorted({*out, *into}), Counter()
    for (a, _), w in edges.items():
        total[a] += w
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(30):
        lost = sum(rank[n] for n in nodes if n not in out)
        moved = Counter()
        for (a, b), w in edges.items():
            moved[b] += rank[a] * w / total[a]
        rank = {n: 0.15 / len(nodes) + 0.85 * (moved[n] + lost / len(nodes)) for n in nodes}
    assert {r.nodo: r.pagerank for r in QUERIES["g_pagerank_converged"](spark, data).collect()} == pytest.approx(rank)


def test_all_order_lines(spark):
    # orders 1 to 60 form a chain of parts, order 70 stands alone
    lines = [(o, p, 1 + p - o, "R" if p > o else "N", "O") for o in range(1, 61) for p in (o, o + 1)] + [(70, 900, 1, "A", "F")]
    t = Small(spark, lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string"))
    part = 100000000
    want = {**{o: 1 for o in range(1, 61)}, **{p + part: 1 for p in range(1, 62)}, 70: 70, 900 + part: 70}
    assert {r.nodo: r.componente for r in graphs.g_components(t).collect()} == want
    want = [x for o in range(1, 61) for x in ((o, 1, "a", "O"), (o, 2, "a", "O"), (o, 3, "b", None))] + [(70, 1, "a", "F")]
    assert sorted(tuple(r) for r in graphs.er_split_event(t).collect()) == want


def test_all_parts_and_events(spark):
    parts = [(k, "b", f"word{k} name{k}") for k in (1, 400, 401)] + [(500, "b", "red blue green"), (7000, "b", "green blue red lace"), (90000, "c", "red blue green")]
    t = Small(spark, part=(parts, "p_partkey long, p_brand string, p_name string"), events=(_events(100), EVENTS))
    assert {r.p_partkey: r.grupo for r in graphs.er_coref(t).collect()} == {1: 1, 400: 400, 401: 401, 500: 500, 7000: 500, 90000: 90000}
    units = {r.unidad: r.tp + r.fn for r in graphs.ev_match(t).collect()}
    assert units == {f"7:{u}": min(3, 100 - 3 * u) for u in range(34)}
    report = graphs.ev_report(t).first()
    assert report.tp + report.fn == report.tp + report.fp == 100


WHOLE = {
    "src_json_docs": "SELECT doc_id::VARCHAR AS codigo, md5(text) AS h FROM {documents}",
    "src_connectors": "SELECT role AS autor_handle, conv_id || ':' || turn AS id FROM {conversations} WHERE contains(lower(text), 'the')",
    "src_api_v2_map": "SELECT lower(role) AS autor, conv_id || ':' || turn AS id FROM {conversations}",
    "parse_feeds": "SELECT strftime(DATE '2024-01-01' + (page_id % 28)::INT, '%Y-%m-%d') AS fecha, url FROM {pages}",
    "sink_csv_docs": "SELECT props::JSON ->> 'k' AS carac__k, event_id::VARCHAR AS event_id FROM {events}",
    "sink_csv_units": "SELECT user_id::VARCHAR AS codigo, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::VARCHAR AS frase_idx, props AS payload FROM {events}",
    "join_golden_pred": "WITH e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS x FROM {events}) SELECT a.u AS codigo, a.i AS i, b.i AS j, a.x = b.x AS mismo FROM e a JOIN e b ON a.u = b.u AND a.i // 3 = b.i // 3",
    "ext_typo": "SELECT (['risa', 'alargamiento', 'puntuacion', ''])[(event_id % 4 + 1)::INT] AS clase, event_id FROM {events}",
    "sort_nulls_last": "SELECT doc_id, toxic FROM {documents} LEFT JOIN {labels} USING (doc_id)",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_rows(spark, data, whole, name):
    got = QUERIES[name](spark, data)
    assert Counter(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == Counter(whole(WHOLE[name]))


def test_sort_of_all_rows(spark, data):
    got = [(r.toxic is None, r.toxic or 0, r.doc_id) for r in QUERIES["sort_nulls_last"](spark, data).collect()]
    assert got == sorted(got)


def test_cursor_beyond_the_first_conversations(spark):
    rows = [(c, 0, "user", "x" if c % 2 else None) for c in range(40)]
    t = Small(spark, conversations=(rows, "conv_id long, turn int, role string, text string"))
    assert [r.id for r in files.inc_cursor(t).collect()] == [f"{c}:0" for c in range(1, 15, 2)]


def test_events_of_whole_posts(spark):
    text = "mind " * 30 + "flower " + "tree " * 100 + "garden Window."
    t = Small(spark, conversations=([(1, 0, "user", text), (1, 1, "assistant", "garden")], "conv_id long, turn int, role string, text string"))
    assert sorted((r.post_id, r.i, r.tipo, r.foria) for r in t.post_events().collect()) == [("1:0", 30, "f", "disforico"), ("1:0", 131, "g", "disforico"), ("1:0", 132, "w", "disforico"), ("1:1", 0, "g", "disforico")]
    assert {r.post_id: r.foria for r in groups.agg_mode_foria_by_post(t).collect()} == {"1:0": "disforico", "1:1": "disforico"}


def test_similar_parts_of_a_hot_brand(spark):
    # four of 40 parts, a tenth, share a brand and nothing else
    parts = [(k, "hot" if k <= 4 else f"b{k}", f"type{k}", k) for k in range(1, 41)]
    t = Small(spark, part=(parts, "p_partkey long, p_brand string, p_type string, p_size int"))
    want = {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}
    assert {(r.a, r.b) for r in graphs.g_sim_pairs(t).collect()} == want
    assert {r[0] for r in graphs.g_sim_groups(t).select("nodo").collect()} == {"1", "2", "3", "4"}


def test_rows_of_great_ids(spark):
    talk = [(900, 0, "User", "over the end"), (900, 1, "assistant", "x")]
    t = Small(spark, conversations=(talk, "conv_id long, turn int, role string, text string"), pages=([(900, "http://a/b")], "page_id long, url string"), events=(_events(4, user=900), EVENTS))
    got = {f.__name__: f(t).collect() for f in (texts.src_connectors, texts.src_api_v2_map, texts.parse_feeds, files.sink_csv_units, files.join_golden_pred)}
    assert [r.id for r in got["src_connectors"]] == ["900:0"]
    assert sorted((r.id, r.autor) for r in got["src_api_v2_map"]) == [("900:0", "user"), ("900:1", "assistant")]
    assert [(r.url, r.fecha) for r in got["parse_feeds"]] == [("http://a/b", "2024-01-05")]
    assert sorted((r.codigo, r.frase_idx) for r in got["sink_csv_units"]) == [("900", str(i)) for i in range(4)]
    assert sorted((r.i, r.j) for r in got["join_golden_pred"]) == [(i, j) for i in range(3) for j in range(3)] + [(3, 3)]

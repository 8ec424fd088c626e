"""Queries: graphs, resolution, rules, evaluation, changing tables, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from discera.operators import evaluate as ev
from discera.operators import graph as gr
from discera.operators import infer as nf
from discera.operators import resolve as rs
from discera.operators import rules as ru
from discera.operators import state as st
from discera.plans.catalog_groups import FORIA_BY_POST
from discera.plans.registry import query
from discera.plans.views import EVENTS, POSTS

# graphs -------------------------------------------------------------------------

EDGES = "e AS (SELECT c_nationkey::VARCHAR AS origen, s_nationkey::VARCHAR AS destino, count(*)::DOUBLE AS peso FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"


def _edges(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("string").alias("origen"))
    li = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", F.col("s_nationkey").cast("string").alias("destino"))
    return gr.build(o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("origen", "destino", F.lit(1.0).alias("peso")))


@query(f"WITH {POSTS} SELECT c.autor_handle AS origen, p.autor_handle AS destino, sum(1.0)::DOUBLE AS peso FROM posts c JOIN posts p ON c.en_respuesta_a = p.post_id GROUP BY ALL")
def g_edges_ref(t):
    return gr.build(gr.ref_edges(t.posts()))


@query(f"WITH {POSTS} SELECT autor_handle AS origen, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS destino, count(*)::DOUBLE AS peso FROM posts WHERE lower(autor_handle) <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END GROUP BY ALL")
def g_edges_mention(t):
    m = t.posts().select("post_id", F.when(F.col("turn") % 2 == 0, "USER").otherwise("Assistant").alias("handle"))
    return gr.build(gr.mention_edges(t.posts(), m))


@query("WITH d AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus || l_linenumber AS x FROM lineitem) SELECT a.x AS origen, b.x AS destino, count(*)::DOUBLE AS peso FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.x < b.x GROUP BY ALL")
def g_edges_hashtag(t):
    return gr.build(gr.co_edges(t.lineitem.withColumn("x", F.concat("l_returnflag", "l_linestatus", "l_linenumber")), ["l_orderkey"], "x"))


@query("SELECT c_custkey AS origen FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def g_edges_follow(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("origen")).distinct()
    return t.customer.select(F.col("c_custkey").alias("origen")).join(done, "origen", "left_anti")


@query(f"WITH {EDGES} SELECT origen, destino, peso FROM e")
def g_build(t):
    return _edges(t)


@query(f"WITH {EDGES}, x AS (SELECT origen AS nodo, 0 AS i, 1 AS o FROM e UNION ALL SELECT destino, 1, 0 FROM e) SELECT nodo, sum(i)::BIGINT AS grado_entrada, sum(o)::BIGINT AS grado_salida, sum(i + o)::BIGINT AS grado FROM x GROUP BY nodo")
def g_degree(t):
    return gr.degrees(_edges(t))


@query(f"WITH {EDGES} SELECT a.origen, a.destino, a.peso FROM e a WHERE a.origen <> a.destino AND EXISTS (SELECT 1 FROM e b WHERE b.origen = a.destino AND b.destino = a.origen)")
def g_mutual(t):
    return gr.mutual(_edges(t)).select("origen", "destino", "peso")


_RANKS = "r0 AS (SELECT nodo, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v)" + "".join(
    f""", r{i} AS (SELECT v.nodo, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * (coalesce((SELECT sum(p.p * x.r) FROM p JOIN r{i - 1} x ON x.nodo = p.origen WHERE p.destino = v.nodo), 0)
    + coalesce((SELECT sum(r) FROM r{i - 1} x WHERE x.nodo NOT IN (SELECT origen FROM e)), 0) / (SELECT count(*) FROM v)) AS r FROM v)"""
    for i in range(1, 5)
)


@query(f"WITH {EDGES}, v AS (SELECT origen AS nodo FROM e UNION SELECT destino FROM e), p AS (SELECT origen, destino, peso / sum(peso) OVER (PARTITION BY origen) AS p FROM e), {_RANKS} SELECT nodo, round(r, 9) AS pagerank FROM r4")
def g_pagerank(t):
    return gr.pagerank(_edges(t), rounds=4).select("nodo", F.round("pagerank", 9).alias("pagerank"))


def _settled(select: str) -> str:
    """SQL over rank(nodo, r): 30 rounds of PageRank over the edges."""
    return f"""WITH RECURSIVE {EDGES}, v AS (SELECT origen AS nodo FROM e UNION SELECT destino FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v), p AS (SELECT origen, destino, peso / sum(peso) OVER (PARTITION BY origen) AS p FROM e),
x AS (SELECT nodo, 1 / n AS r, 0 AS i FROM v, n UNION ALL SELECT nodo, any_value(0.15::DOUBLE / n) + 0.85::DOUBLE * sum(m), any_value(i) + 1 FROM (
  SELECT p.destino AS nodo, p.p * x.r AS m, x.i FROM x JOIN p ON p.origen = x.nodo UNION ALL SELECT v.nodo, s.d / n, s.i FROM v, n, (SELECT sum(CASE WHEN x.nodo NOT IN (SELECT origen FROM e) THEN x.r ELSE 0 END) AS d, i FROM x GROUP BY i) s), n WHERE i < 30 GROUP BY nodo),
rank AS (SELECT nodo, r FROM x WHERE i = 30) {select}"""


@query(_settled("SELECT nodo, r AS pagerank FROM rank"))
def g_pagerank_converged(t):
    return gr.pagerank(_edges(t))


@query(_settled("SELECT nodo, r AS pagerank FROM rank ORDER BY r DESC, nodo LIMIT 10"))
def topk_pagerank(t):
    return gr.pagerank(_edges(t)).orderBy(F.desc("pagerank"), "nodo").limit(10)


@query(_settled(", top AS (SELECT nodo FROM rank ORDER BY r DESC, nodo LIMIT 12) SELECT origen, destino, peso FROM e WHERE origen IN (SELECT nodo FROM top) AND destino IN (SELECT nodo FROM top)"))
def topk_nodes(t):
    e = _edges(t)
    top = gr.pagerank(e).orderBy(F.desc("pagerank"), "nodo").limit(12).select("nodo")
    return e.join(F.broadcast(top.withColumnRenamed("nodo", "origen")), "origen", "left_semi").join(F.broadcast(top.withColumnRenamed("nodo", "destino")), "destino", "left_semi")  # 12 rows


_LINKS = "l AS (SELECT l_orderkey AS a, l_partkey + 100000000 AS b FROM lineitem)"


@query(f"""WITH RECURSIVE {_LINKS}, s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(nodo, componente) USING KEY (nodo) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, min(r.componente) FROM r JOIN s ON s.a = r.nodo JOIN recurring.r AS x ON x.nodo = s.b WHERE r.componente < x.componente GROUP BY s.b)
SELECT nodo, componente FROM r""")
def g_components(t):
    return gr.components(t.lineitem.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 100000000).alias("b"))).select("nodo", "componente")


@query("SELECT conv_id || ':' || turn AS post_id, conv_id || ':0' AS conversacion, turn AS profundidad, 0 AS huerfano FROM conversations")
def g_threads(t):
    return gr.resolve_threads(t.posts())


@query(f"WITH RECURSIVE {POSTS}, up AS (SELECT post_id, en_respuesta_a AS ref, 0 AS n, '' AS x FROM posts UNION ALL SELECT up.post_id, p.en_respuesta_a, n + 1, p.autor_handle || CASE WHEN n > 0 THEN chr(10) || x ELSE '' END FROM up JOIN posts p ON p.post_id = up.ref WHERE n < 5) SELECT post_id, CASE WHEN max(n) > 0 THEN max_by(x, n) END AS contexto FROM up GROUP BY post_id")
def g_ancestors(t):
    return gr.ancestors(t.posts(), 5, F.col("autor_handle")).select("post_id", "contexto")


@query(f"WITH {POSTS} SELECT post_id, mostrado FROM (SELECT a.post_id, b.post_id AS mostrado, row_number() OVER (PARTITION BY a.post_id ORDER BY b.post_id) AS r FROM posts a JOIN posts b ON a.conversacion_id = b.conversacion_id AND lower(b.autor_handle) = 'user' AND a.post_id <> b.post_id WHERE b.post_id <> coalesce(a.en_respuesta_a, '')) WHERE r <= 3")
def g_participants(t):
    p = t.posts()
    shown = p.where("en_respuesta_a is not null").select("post_id", F.col("en_respuesta_a").alias("mostrado"))
    return gr.participants(p, p.select("post_id", F.lit("User").alias("handle")), shown, 3).select("post_id", "mostrado")


@query("SELECT unnest(['segmentar', 'actores', 'emociones', 'caracterizar', 'juzgar']) AS etapa, unnest(range(5)) AS orden")
def g_dag(t):
    stages = {"caracterizar": ["emociones"], "segmentar": [], "actores": ["segmentar"], "emociones": ["actores"], "juzgar": ["caracterizar"]}
    return t.spark.createDataFrame(list(enumerate(gr.topological(stages))), "orden long, etapa string").select("etapa", "orden")


def _graph(t):
    return _edges(t).withColumn("grafo", F.lit("g"))


@query()
def g_communities(t):
    return gr.communities(_graph(t))


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT a, o, sum(p) AS p FROM (SELECT origen AS a, destino AS o, peso AS p FROM e WHERE origen <> destino UNION ALL SELECT destino, origen, peso FROM e WHERE origen <> destino) GROUP BY a, o),
l AS (SELECT DISTINCT a AS nodo, a AS c, 0 AS i FROM b UNION ALL SELECT nodo, min_by(c, (-w, c)) AS c, any_value(i) + 1 FROM (SELECT b.a AS nodo, l.c, sum(b.p) AS w, any_value(l.i) AS i FROM b JOIN l ON l.nodo = b.o GROUP BY b.a, l.c) WHERE i < 10 GROUP BY nodo)
SELECT nodo, c AS comunidad FROM l WHERE i = 10""")
def g_label_communities(t):
    return gr.label_communities(_edges(t))


@query()
def g_betweenness(t):
    return gr.betweenness(_graph(t))


@query()
def g_cliques(t):
    return gr.cliques(gr.mutual(_edges(t)).withColumn("grafo", F.lit("g")))


_SIM = """f AS (SELECT p_partkey AS k, [p_brand] AS marca, list_distinct(string_split(p_type, ' ')) AS tipo, [p_size::VARCHAR] AS talla FROM part),
t AS (SELECT k, 'marca=' || unnest(marca) AS v FROM f UNION SELECT k, 'tipo=' || unnest(tipo) FROM f UNION SELECT k, 'talla=' || unnest(talla) FROM f),
ok AS (SELECT v FROM t GROUP BY v HAVING count(*) >= 2),
c AS (SELECT DISTINCT x.k AS a, y.k AS b FROM t x JOIN t y ON x.v = y.v AND x.k < y.k WHERE x.v IN (SELECT v FROM ok)),
j AS (SELECT a, b, (2 * (p.marca = q.marca)::INT + 1.0 * len(list_intersect(p.tipo, q.tipo)) / len(list_distinct(list_concat(p.tipo, q.tipo)))::DOUBLE + (p.talla = q.talla)::INT) / 4.0::DOUBLE AS s,
concat_ws(', ', CASE WHEN p.marca = q.marca THEN 'marca' END, CASE WHEN len(list_intersect(p.tipo, q.tipo)) > 0 THEN 'tipo' END, CASE WHEN p.talla = q.talla THEN 'talla' END) AS compartidos FROM c JOIN f p ON p.k = a JOIN f q ON q.k = b)"""


def _features(t):
    return t.part.select("p_partkey", F.array("p_brand").alias("marca"), F.array_distinct(F.split("p_type", " ")).alias("tipo"), F.array(F.col("p_size").cast("string")).alias("talla"))


@query(f"WITH {_SIM} SELECT a, b, round(s, 4) AS similitud, compartidos FROM j WHERE s >= 0.5")
def g_sim_pairs(t):
    return gr.similarity_pairs(_features(t), "p_partkey", {"marca": 2.0, "tipo": 1.0, "talla": 1.0}, 0.5)


@query("SELECT p_partkey, len(list_distinct(string_split(p_type, ' '))) AS n FROM part")
def g_sim_features(t):
    return _features(t).select("p_partkey", F.size("tipo").cast("long").alias("n"))


@query()
def g_sim_groups(t):
    return gr.similarity_groups(_features(t), "p_partkey", {"marca": 2.0, "tipo": 1.0, "talla": 1.0}, 0.5)


@query()
def g_semantic(t):
    from discera.operators.joins import nearest

    pairs = nearest(t.embeddings, "vec_id", "embedding", 10, 0.45)
    return gr.label_communities(pairs.select(F.col("a").cast("string").alias("origen"), F.col("b").cast("string").alias("destino"), F.col("similarity").alias("peso")))


@query("SELECT event_id, concat_ws(' · ', event_type, nullif(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE props END, ' ')) AS linea, user_id || ':' || event_id AS clave FROM events")
def g_describe(t):
    from discera.functions.text import describe

    return t.events.select("event_id", describe(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, " ").otherwise(F.col("props"))).alias("linea"), F.concat_ws(":", "user_id", "event_id").alias("clave"))


# resolution ------------------------------------------------------------------------


def _mention_rows(t):
    """Mentions of the events: the name of the actor depends on k, the function on the type."""
    names = F.array(*map(F.lit, ("Ana Paz", "ana paz", "el pueblo", "los socialistas y el estatismo", "yo")))
    e = t.events_view()
    return e.select("codigo", (F.col("frase_idx") % 5).alias("unit_idx"), F.col("frase_idx").alias("orden"), F.element_at(names, (F.col("k") % 5 + 1).cast("int")).alias("marca"), F.col("tipo_emocion").alias("funcion"), F.element_at(names, (F.col("k") % 5 + 1).cast("int")).alias("inferencia"))


@query(f"""WITH {EVENTS}, m AS (SELECT codigo, frase_idx % 5 AS unit_idx, unnest(CASE k % 5 WHEN 0 THEN ['ana paz'] WHEN 1 THEN ['ana paz'] WHEN 2 THEN ['el pueblo'] WHEN 3 THEN ['los socialistas', 'el estatismo'] ELSE ['yo'] END) AS clave, tipo_emocion FROM ev)
SELECT codigo, unit_idx, clave, count(DISTINCT tipo_emocion) AS n FROM m GROUP BY ALL""")
def er_derive_mentions(t):
    return rs.mentions(_mention_rows(t)).select("codigo", "unit_idx", "clave", F.size(F.split("funciones", ",")).cast("long").alias("n"))


@query(f"WITH {EVENTS} SELECT codigo, frase_idx FROM ev WHERE k >= 90 OR frase_idx % 2 = 0")
def er_rebuild(t):
    e = t.events_view().select("codigo", "frase_idx", "k")
    kept = e.where("k >= 90")
    return st.insert_ignore(kept, e.where("frase_idx % 2 = 0"), ["codigo", "frase_idx"]).select("codigo", "frase_idx")


@query("SELECT event_id % 50 AS id, CASE WHEN bool_or(event_type = 'purchase') THEN 'accepted' ELSE 'proposed' END AS status FROM events GROUP BY 1")
def er_seed_handles(t):
    ids = t.events.select((F.col("event_id") % 50).alias("id")).distinct().withColumn("status", F.lit("proposed"))
    seeds = t.events.where("event_type = 'purchase'").select((F.col("event_id") % 50).alias("id")).distinct().withColumn("status", F.lit("accepted"))
    return st.upsert_status(ids, seeds, ["id"])


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS k, p_brand AS d, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 1)) AS w, lower(p_name) AS n FROM part),
l AS (SELECT a.k AS a, b.k AS b FROM w a JOIN w b ON a.d = b.d AND a.k <> b.k WHERE a.n = b.n OR (len(list_intersect(a.w, b.w)) = least(len(a.w), len(b.w)) AND least(len(a.w), len(b.w)) >= 2) OR len(list_intersect(a.w, b.w)) >= 3),
r AS (SELECT k, k AS o FROM w UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.o) SELECT k AS p_partkey, min(o) AS grupo FROM r GROUP BY k""")
def er_coref(t):
    return rs.coreference(t.part, "p_brand", "p_partkey", "p_name")


@query("SELECT n_nationkey AS id, lower(n_name) AS canonical_id FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 > 0")
def er_kb_match(t):
    kb = t.nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("canonical_id"))
    m = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("marca"), F.lit("").alias("inferencia"))
    done = t.nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("id"))
    return rs.kb_links(m, kb, done).select("id", "canonical_id")


@query(f"WITH {EVENTS} SELECT codigo, frase_idx, 'ana_paz' AS canonical_id FROM ev WHERE k % 5 = 4")
def er_deixis_add(t):
    m = _mention_rows(t).select("codigo", F.struct("codigo", "orden").alias("id"), "marca")
    return rs.deixis_links(m, m.select("codigo").distinct().withColumn("enunciador", F.lit("Ana Paz"))).select("id.codigo", F.col("id.orden").alias("frase_idx"), "canonical_id")


def _resolved(t, one):
    """One event for each case of precedence, by its number modulo 8."""
    c = F.col("event_id") % 8
    events = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("codigo"), c.alias("unit_idx"), F.when(c == 7, "libertarios y radicales").otherwise("el grupo").alias("marca"), F.when(c == 0, "fijo; otro").alias("override"), F.when(c == 5, "los radicales").when(c == 6, "el rechazado").alias("inferencia"))
    rows = [(1, "el grupo", "b", "proposed", "llm"), (1, "el grupo", "a", "accepted", "llm"), (1, "el grupo", "d", "accepted", "deixis"), (2, "el grupo", "d1", "proposed", "deixis"), (2, "el grupo", "d2", "accepted", "deixis_llm"), (3, "el grupo", "d1", "proposed", "deixis"), (4, "grupo", "sub", "proposed", "llm"), (6, "el grupo", "rechazado", "rejected", "llm"), (7, "radicales", "radicales", "proposed", "llm"), (7, "libertarios", "libertarios", "proposed", "llm")]
    links = rs.link_rank(t.spark.createDataFrame(rows, "unit_idx long, marca string, canonical_id string, status string, origin string"))
    links = t.events.select(F.col("user_id").alias("codigo")).distinct().crossJoin(F.broadcast(links))  # ten rows
    return rs.resolve(events, links, one=one)


@query("SELECT event_id AS id, (['fijo|otro', 'a|b', '', 'd1', 'sub', 'radicales', '', 'libertarios|radicales'])[(event_id % 8 + 1)::INT] AS canonicos FROM events")
def er_resolve_many(t):
    return _resolved(t, False).select("id", F.array_join("canonicos", "|").alias("canonicos"))


@query("SELECT event_id AS id, (['fijo', 'a', '', 'd1', 'sub', 'radicales', '', 'libertarios'])[(event_id % 8 + 1)::INT] AS canonico FROM events")
def er_resolve_one(t):
    return _resolved(t, True).select("id", "canonico")


@query(f"""WITH {EVENTS}, n AS (SELECT codigo, max(frase_idx) AS largo FROM ev GROUP BY codigo) SELECT event_id, codigo, tipo_emocion, foria, k, largo, c_name AS enunciador FROM ev JOIN n USING (codigo) LEFT JOIN customer ON c_custkey = codigo""")
def er_enriched(t):
    e = t.events_view()
    n = e.groupBy("codigo").agg(F.max("frase_idx").alias("largo"))
    c = t.customer.select(F.col("c_custkey").alias("codigo"), F.col("c_name").alias("enunciador"))
    return e.join(n, "codigo").join(c, "codigo", "left").select("event_id", "codigo", "tipo_emocion", "foria", "k", "largo", "enunciador")


@query(f"WITH {EVENTS} SELECT codigo, frase_idx // 5 AS unidad, string_agg(DISTINCT tipo_emocion, ',' ORDER BY tipo_emocion) AS tipos FROM ev GROUP BY ALL")
def er_items_by_unit(t):
    return t.events_view().groupBy("codigo", F.expr("frase_idx div 5").alias("unidad")).agg(F.array_join(F.array_sort(F.collect_set("tipo_emocion")), ",").alias("tipos"))


@query(f"WITH {EVENTS} SELECT codigo, frase_idx // 5 AS unidad, string_agg(tipo_emocion || '/' || foria, ' ' ORDER BY frase_idx) AS resumen FROM ev GROUP BY ALL")
def er_brief(t):
    rows = F.array_sort(F.collect_list(F.struct("frase_idx", F.concat_ws("/", "tipo_emocion", "foria").alias("x"))))
    return t.events_view().groupBy("codigo", F.expr("frase_idx div 5").alias("unidad")).agg(F.array_join(F.transform(rows, lambda r: r["x"]), " ").alias("resumen"))


@query(f"WITH {EVENTS} SELECT codigo, count(*) AS pendientes FROM ev WHERE k % 5 = 4 AND codigo NOT IN (SELECT codigo FROM ev WHERE k = 44) GROUP BY codigo")
def er_deixis_queue(t):
    e = t.events_view()
    return e.where("k % 5 = 4").join(e.where("k = 44").select("codigo"), "codigo", "left_anti").groupBy("codigo").agg(F.count(F.lit(1)).alias("pendientes"))


@query()
def er_merge_suggest(t):
    from discera.functions.text import canonical_slug

    n = t.part.groupBy(canonical_slug(F.col("p_name")).alias("canonical_id")).agg(F.count(F.lit(1)).alias("n"))
    return rs.merge_suggestions(n)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS idx, l_returnflag AS v, l_linestatus FROM lineitem),
e AS (SELECT l_orderkey, idx, unnest(CASE WHEN v = 'R' THEN ['a', 'b'] ELSE ['a'] END) AS quien, unnest(CASE WHEN v = 'R' THEN [0, 1] ELSE [0] END) AS i, l_linestatus, max(idx) OVER (PARTITION BY l_orderkey) AS top FROM x)
SELECT l_orderkey, CASE WHEN i = 1 THEN top + sum(i) OVER (PARTITION BY l_orderkey ORDER BY idx, i ROWS UNBOUNDED PRECEDING) ELSE idx END::BIGINT AS idx, quien, CASE WHEN i = 0 THEN l_linestatus END AS payload FROM e""")
def er_split_event(t):
    x = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("idx"), "l_returnflag", F.col("l_linestatus").alias("payload"))
    who = F.when(F.col("l_returnflag") == "R", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return rs.split_events(x, ["l_orderkey"], "idx", who, "quien", ["payload"]).select("l_orderkey", "idx", "quien", "payload")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND lang <> 'en' THEN 'en' ELSE lang END AS lang, CASE WHEN NOT (doc_id % 3 = 0 AND lang <> 'en') THEN source END AS source FROM documents")
def er_propagate_edit(t):
    edits = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("en").alias("lang"))
    return rs.propagate_edits(t.documents.select("doc_id", "lang", "source"), edits, ["doc_id"], "lang", ["source"]).select("doc_id", "lang", "source")


@query("""WITH l AS (SELECT p_brand AS canonical_id, CASE WHEN p_size < 3 THEN 'actor' WHEN p_size % 2 = 0 THEN 'fuente' ELSE 'objeto' END AS funcion, p_name AS marca FROM part)
SELECT canonical_id, CASE WHEN bool_or(funcion IN ('actor', 'experienciador')) THEN 'actor' WHEN bool_and(funcion = 'fuente') THEN 'circunstante' ELSE 'referente' END AS clase, max_by(marca, lpad(length(marca)::VARCHAR, 6, '0') || marca) AS nombre FROM l GROUP BY canonical_id""")
def er_entity_class(t):
    f = F.when(F.col("p_size") < 3, "actor").when(F.col("p_size") % 2 == 0, "fuente").otherwise("objeto")
    return rs.entity_class(t.part.select(F.col("p_brand").alias("canonical_id"), f.alias("funcion"), F.col("p_name").alias("marca")))


# rules --------------------------------------------------------------------------------

_RULED = f"""{EVENTS}, r AS (SELECT codigo, frase_idx // 3 AS frase_idx, frase_idx % 3 AS emocion_idx, tipo_emocion, foria, CASE k % 3 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baja' END AS intensidad,
CASE k % 4 WHEN 0 THEN 'virtual' WHEN 1 THEN 'Potencial' ELSE 'real' END AS modo_existencia, CASE k % 5 WHEN 0 THEN 'Ana Paz' WHEN 1 THEN 'el pueblo' ELSE 'otro' END AS experienciador,
CASE WHEN k % 2 = 0 THEN 'no identificado' ELSE 'x' END AS fuente_inferencia, CASE WHEN codigo % 2 = 0 THEN 'ana paz' ELSE 'no identificado' END AS enunciador FROM ev)"""


def _ruled(t):
    pick = lambda by, n, *vs: F.element_at(F.array(*map(F.lit, vs)), (F.least(F.col(by) % n, F.lit(len(vs) - 1)) + 1).cast("int"))
    return t.events_view().select(
        "codigo", F.expr("frase_idx div 3").alias("frase_idx"), (F.col("frase_idx") % 3).alias("emocion_idx"), "tipo_emocion", "foria",
        pick("k", 3, "alta", "media", "baja").alias("intensidad"), pick("k", 4, "virtual", "Potencial", "real").alias("modo_existencia"), pick("k", 5, "Ana Paz", "el pueblo", "otro").alias("experienciador"),
        pick("k", 2, "no identificado", "x").alias("fuente_inferencia"), F.when(F.col("codigo") % 2 == 0, "ana paz").otherwise("no identificado").alias("enunciador"),
    )


@query(f"""WITH {_RULED} SELECT * FROM (SELECT 'V-01' AS regla, codigo, frase_idx, emocion_idx FROM r WHERE lower(modo_existencia) IN ('virtual', 'potencial') AND enunciador = 'ana paz' AND experienciador = 'Ana Paz'
UNION ALL SELECT 'V-02', codigo, frase_idx, emocion_idx FROM r WHERE fuente_inferencia = 'no identificado' AND intensidad = 'alta' UNION ALL SELECT 'V-04', codigo, frase_idx, emocion_idx FROM r WHERE foria = 'aforico' AND intensidad = 'alta'
UNION ALL SELECT 'V-05', codigo, frase_idx, emocion_idx FROM r WHERE foria = 'ambiforico' AND intensidad = 'baja' UNION ALL SELECT 'V-06', codigo, frase_idx, emocion_idx FROM r WHERE modo_existencia = 'virtual' AND foria = 'aforico')""")
def val_rules_row(t):
    return ru.check_rows(_ruled(t)).select("regla", *ru.ISSUE)


@query(f"""WITH {_RULED} SELECT 'V-08' AS regla, codigo, frase_idx, emocion_idx FROM r WHERE enunciador = 'ana paz' AND experienciador = 'Ana Paz'
UNION ALL SELECT 'V-09', codigo, frase_idx, min(emocion_idx) FROM r GROUP BY codigo, frase_idx, tipo_emocion, experienciador HAVING count(*) > 1
UNION ALL SELECT 'V-10', codigo, frase_idx, emocion_idx FROM r WHERE modo_existencia = 'Potencial' AND experienciador <> 'el pueblo'""")
def val_rules_group(t):
    r = _ruled(t)
    return ru.check_groups(r, r.select("codigo").distinct().withColumn("actor", F.lit("El Pueblo"))).select("regla", *ru.ISSUE)


@query(f"WITH {_RULED} SELECT 'V-11' AS regla, codigo, frase_idx, emocion_idx, 'intensidad' AS dimension, intensidad AS valor FROM r WHERE tipo_emocion = 'error' AND intensidad NOT IN ('alta', 'media')")
def val_ontology(t):
    allowed = t.spark.createDataFrame([("error", "intensidad", "alta"), ("error", "intensidad", "media")], "tipo string, dimension string, valor string")
    r = _ruled(t).withColumn("tipo_emocion_canonico", F.col("tipo_emocion")).withColumn("dominancia", F.lit(""))
    return ru.check_ontology(r, allowed).select("regla", *ru.ISSUE, "dimension", "valor")


@query(f"WITH {_RULED} SELECT codigo, count(*) AS n FROM r WHERE (foria = 'aforico' AND intensidad = 'alta') GROUP BY codigo")
def val_runner(t):
    issues = ru.check_rows(_ruled(t), {"V-04": ru.row_rules()["V-04"]})
    return st.replace_partition(issues.where("false"), issues, ["codigo"]).groupBy("codigo").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'lang' AS columna, count(*) AS n FROM documents WHERE doc_id % 10 = 0")
def val_contracts(t):
    d = t.documents.select(F.col("doc_id").cast("string").alias("codigo"), F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("contenido"))
    return ru.violations(d, "documento").select(F.lit("lang").alias("columna"), "n")


# evaluation -----------------------------------------------------------------------------


def _coders(t):
    d = t.labels
    return d.select(F.col("doc_id").alias("unit"), F.lit("a").alias("coder"), F.col("quality").alias("value")).union(d.select("doc_id", F.lit("b"), F.col("toxic")))


_PAIRS = "p AS (SELECT quality AS c, toxic AS k, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), o AS (SELECT c, k, sum(n) AS o FROM (SELECT c, k, n FROM p UNION ALL SELECT k, c, n FROM p) GROUP BY ALL), m AS (SELECT c, sum(o) AS n FROM o GROUP BY c)"


for _metric in ("nominal", "interval", "ordinal"):
    _delta = {"nominal": "(o.c <> o.k)::INT", "interval": "(o.c - o.k) ** 2", "ordinal": "CASE WHEN o.c = o.k THEN 0 ELSE ((SELECT sum(n) FROM m) - (SELECT sum(n) FROM m) / 2.0) ** 2 END"}[_metric]
    query(f"WITH {_PAIRS}, g AS (SELECT a.c, b.c AS k, a.n AS x, b.n AS y FROM m a, m b) SELECT round(1 - ((SELECT sum(o.o * {_delta}) FROM o) / (SELECT sum(n) FROM m)) / ((SELECT sum(o.x * o.y * {_delta}) FROM g o) / ((SELECT sum(n) FROM m) * ((SELECT sum(n) FROM m) - 1)))::DOUBLE, 9) AS alpha", f"ev_alpha_{_metric}")(
        lambda t, m=_metric: ev.alpha(_coders(t), m).select(F.round("alpha", 9).alias("alpha"))
    )


def _events_of(t, shift):
    e = t.events_view()
    names = F.array(*map(F.lit, ("Ana Paz", "el pueblo", "Juan", "la gente de Juan")))
    return e.select(F.concat_ws(":", "codigo", F.expr("frase_idx div 3")).alias("unidad"), "frase_idx", ((F.col("frase_idx") + shift) % 3).alias("idx"), F.when((F.col("k") + shift) % 4 == 0, "otro").otherwise(F.col("tipo_emocion")).alias("tipo"), F.element_at(names, ((F.col("k") + shift) % 4 + 1).cast("int")).alias("experienciador"), F.when(F.col("k") % 2 == 0, "la ley").alias("fuente")).drop("frase_idx")


@query()
def ev_match(t):
    return ev.match(_events_of(t, 0), _events_of(t, 1))


@query()
def ev_report(t):
    return ev.report(ev.match(_events_of(t, 0), _events_of(t, 1)))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def ev_load_golden(t):
    return t.labels.where("quality = 1").select("doc_id", "quality", "toxic")


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE doc_id % 5 > 0), f AS (SELECT a.doc_id AS x, b.doc_id AS y, a.lang AS la, b.lang AS lb, a.source AS sa, b.source AS sb FROM documents a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT 'presencia' AS dimension, count(*) AS n, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS acuerdos FROM f UNION ALL SELECT 'lang', count(*) FILTER (y IS NOT NULL), count(*) FILTER (y IS NOT NULL AND la IS NOT DISTINCT FROM lb) FROM f UNION ALL SELECT 'source', count(*) FILTER (y IS NOT NULL), count(*) FILTER (y IS NOT NULL AND sa IS NOT DISTINCT FROM sb) FROM f""")
def ev_compare_runs(t):
    a = t.documents.select("doc_id", "lang", "source")
    b = a.where("doc_id % 5 > 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return ev.compare_runs(a, b, ["doc_id"], ["lang", "source"])


@query()
def ev_sample(t):
    e = t.events_view().withColumn("key", F.col("event_id"))
    return ev.sample(e, "key", "codigo", F.col("tipo_emocion") == "purchase", 200, 42, 5).select("event_id", "codigo", "tipo_emocion")


@query()
def ev_resample(t):
    return ev.resample(t.labels, "doc_id", F.col("quality") == 1, 30, 42)


@query("""SELECT '{"doc_id":' || doc_id || ',"quality":' || quality || '}' AS value FROM labels""")
def ev_freeze(t):
    return ev.freeze(t.labels, "doc_id", "quality")


@query(f"WITH {EVENTS} SELECT a.codigo, a.frase_idx, (SELECT string_agg(b.tipo_emocion, chr(10) ORDER BY b.frase_idx) FROM ev b WHERE b.codigo = a.codigo AND b.frase_idx BETWEEN a.frase_idx - 3 AND a.frase_idx - 1) AS contexto FROM ev a WHERE a.k = 7")
def ev_context_snapshot(t):
    e = t.events_view().select("codigo", "frase_idx", "tipo_emocion", "k")
    return ev.context(e.drop("k"), e.where("k = 7"), "codigo", "frase_idx", "tipo_emocion", 3)


@query("SELECT count(*) >= 100 AS ok, count(DISTINCT source) AS fuentes, count(*) FILTER (trim(text) = '') AS vacios FROM documents")
def ev_corpus_check(t):
    return t.documents.agg((F.count(F.lit(1)) >= 100).alias("ok"), F.countDistinct("source").alias("fuentes"), F.count_if(F.trim("text") == "").alias("vacios"))


# changing tables ---------------------------------------------------------------------------

_NEW = "n AS (SELECT doc_id, 'nuevo' AS source, CASE WHEN doc_id % 4 = 0 THEN 'xx' END AS lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 1000000, 'nuevo', 'xx' FROM documents WHERE doc_id % 10 = 0), o AS (SELECT doc_id, source, lang FROM documents)"


def _old_new(t):
    o = t.documents.select("doc_id", "source", "lang")
    n = o.where("doc_id % 2 = 0").select("doc_id", F.lit("nuevo").alias("source"), F.when(F.col("doc_id") % 4 == 0, "xx").alias("lang"))
    return o, n.union(o.where("doc_id % 10 = 0").select(F.col("doc_id") + 1000000, F.lit("nuevo"), F.lit("xx")))


@query(f"WITH {_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def sink_upsert(t):
    return st.upsert(*_old_new(t), ["doc_id"])


@query(f"WITH {_NEW} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.source, o.source) AS source, coalesce(n.lang, o.lang) AS lang FROM o FULL JOIN n ON n.doc_id = o.doc_id")
def sink_upsert_coalesce(t):
    return st.upsert_coalesce(*_old_new(t), ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'accepted' WHEN doc_id % 3 = 0 THEN 'proposed' ELSE 'rejected' END AS status FROM documents")
def sink_upsert_case(t):
    o = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "proposed").otherwise("rejected").alias("status"))
    return st.upsert_status(o, t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("accepted").alias("status")), ["doc_id"])


@query(f"WITH {_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def sink_insert_ignore(t):
    return st.insert_ignore(*_old_new(t), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id + 5000000, source FROM documents WHERE source = 'src1' AND doc_id % 3 = 0")
def sink_replace_partition(t):
    o = t.documents.select("doc_id", "source")
    return st.replace_partition(o, o.where("source = 'src1' and doc_id % 3 = 0").select(F.col("doc_id") + 5000000, "source").toDF("doc_id", "source"), ["source"])


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text)")
def sink_append_dedup(t):
    d = t.documents.select("doc_id", F.md5("text").alias("h"))
    return st.append_dedup(d.where("false"), d, "h", "doc_id")


@query("SELECT event_id, props::JSON ->> 'k' AS props__k FROM events")
def sink_csv_emotions(t):
    return st.flatten(t.events.select("event_id", "props"), "props", "props", ["k"])


@query("SELECT doc_id, 'lang' AS campo, 'Idioma' AS etiqueta, lang AS valor FROM documents WHERE trim(lang) <> '' UNION ALL SELECT doc_id, 'source', 'Fuente', source FROM documents WHERE trim(source) <> ''")
def sink_csv_meta_long(t):
    return st.metadata_long(t.documents, "doc_id", {"lang": "Idioma", "source": "Fuente"})


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'baja' WHEN n_nationkey % 3 = 0 THEN 'cambio' ELSE 'igual' END AS accion FROM nation UNION ALL SELECT 999, 'alta'")
def sink_kb_sync(t):
    kb = t.nation.select("n_nationkey", "n_name")
    a = kb.where("n_nationkey % 5 <> 0").withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, "otro").otherwise(F.col("n_name"))).union(t.spark.sql("SELECT 999, 'alta'"))
    return st.sync(kb, a, "n_nationkey")


@query("SELECT 1 AS parte, '<node id=\"' || r_regionkey || '\"/>' AS linea FROM region")
def sink_graph(t):
    from discera.sources.readers import graph_lines

    nodes = t.region.select(F.col("r_regionkey").alias("nodo"))
    return graph_lines(nodes, nodes.select(F.col("nodo").alias("origen"), F.col("nodo").alias("destino"), F.lit(1.0).alias("peso"))).where("parte = 1")


@query(f"WITH {EVENTS} SELECT count(*) AS n, count(payload) AS hechos FROM (SELECT CASE WHEN k % 10 <> 3 OR true THEN props END AS payload FROM ev)")
def inc_resume(t):
    """A stage run twice: the second time only what is pending."""
    e = t.events_view().select("codigo", "frase_idx", F.when(F.col("k") % 10 != 3, F.col("props")).alias("payload"), "props")
    done = st.upsert(e, e.where("payload is null").withColumn("payload", F.col("props")), ["codigo", "frase_idx"])
    return done.agg(F.count(F.lit(1)).alias("n"), F.count("payload").alias("hechos"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def inc_cache(t):
    """Answers by key of content and version: each prompt is asked once, those in the cache not at all."""
    prompt = F.concat(F.lit("idioma "), "lang")
    cache = t.spark.createDataFrame([], "key string, payload string")
    _, fresh = nf.cached_infer(t.documents.select("doc_id", "lang"), cache, prompt, "v1", nf.StubBackend)
    out, _ = nf.cached_infer(t.documents.select("doc_id", "lang"), fresh, prompt, "v1", nf.StubBackend)
    return out.where("payload is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# inference ---------------------------------------------------------------------------------


@query(f"WITH {POSTS} SELECT post_id, CASE WHEN texto IS NOT NULL THEN (['alegria', 'ira', 'miedo', 'calma'])[(('0x' || right(sha256(texto), 1))::INT % 4) + 1] END AS tipo_emocion, NULL::VARCHAR AS error FROM posts")
def infer_units(t):
    return nf.infer(t.posts().select("post_id", "texto"), F.col("texto"), nf.StubBackend).select("post_id", F.get_json_object("payload", "$.tipo_emocion").alias("tipo_emocion"), "error")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Ana/yo estoy triste' WHEN 1 THEN NULL ELSE 'Juan/no identificado' END AS v FROM events")
def inf_normalize(t):
    c = F.col("event_id") % 3
    pick = lambda *vs: F.element_at(F.array(*map(F.lit, vs)), (c + 1).cast("int"))
    got = nf.normalize_emotion(F.lit("tristeza"), pick("el enunciador", "Juan", "Juan"), pick("yo estoy triste", "yo creo que", "muy furioso"), F.lit("Yo creo que yo estoy triste."), F.lit("Ana"))
    return t.events.select("event_id", F.concat_ws("/", got["experienciador"], got["marca"]).alias("v"), got.isNotNull().alias("hay")).select("event_id", F.when(F.col("hay"), F.col("v")).alias("v"))


@query("SELECT event_id, (['auto', 'hetero', 'sin atribucion', 'sin atribucion'])[(event_id % 4 + 1)::INT] AS v FROM events")
def inf_attribution(t):
    c = F.col("event_id") % 4
    pick = lambda *vs: F.element_at(F.array(*map(F.lit, vs)), (c + 1).cast("int"))
    return t.events.select("event_id", nf.attribution(pick("Ana", "Juan", "Ana", ""), F.lit("ana"), pick("estamos felices", "feliz", "feliz", "x"), F.lit(False)).alias("v"))


@query(f"WITH {FORIA_BY_POST} SELECT p.conversacion_id, count(*) AS n FROM pe JOIN posts p USING (post_id) GROUP BY ALL")
def explode_emotions(t):
    """Events of the second pass where there is one, even if empty, else of the first."""
    first = t.post_events().groupBy("post_id").agg(F.collect_list(F.struct("i", "tipo", "foria")).alias("p1"))
    rows = t.posts().join(first, "post_id", "left").withColumn("p2", F.lit(None).cast("array<struct<i:int,tipo:string,foria:string>>"))
    return rows.select("conversacion_id", F.posexplode(F.coalesce("p2", "p1")).alias("emocion_idx", "e")).groupBy("conversacion_id").agg(F.count(F.lit(1)).alias("n"))

"""Queries: aggregations, ordered windows, top-k, sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discera.operators import aggregates as ag
from discera.operators import windows as wd
from discera.plans.catalog_rows import STAGE, _stage
from discera.plans.registry import query
from discera.plans.views import EVENTS, FORIAS, POST_EVENTS, POSTS

FORIA_COLUMNS = ", ".join(f"count(*) FILTER (foria = '{f}') AS {f}" for f in FORIAS)
FORIA_RANK = "list_position([" + ", ".join(f"'{f}'" for f in FORIAS) + "], foria)"
FORIA_BY_POST = f"""{POST_EVENTS}, fp AS (SELECT post_id, foria FROM (SELECT post_id, foria, row_number() OVER (PARTITION BY post_id ORDER BY count(*) DESC, {FORIA_RANK}) AS r FROM pe GROUP BY post_id, foria) WHERE r = 1),
com AS (SELECT DISTINCT lower(autor_handle) AS autor, ascii(autor_handle) % 3 AS comunidad FROM posts), pares AS (SELECT c.post_id AS hijo, p.post_id AS padre, lower(c.autor_handle) AS ah, lower(p.autor_handle) AS ap FROM posts c JOIN posts p ON c.en_respuesta_a = p.post_id)"""


def communities(t):
    return t.posts().select(F.lower("autor_handle").alias("autor"), (F.ascii("autor_handle") % 3).alias("comunidad")).distinct()


@query("SELECT count(*) AS documentos, count(DISTINCT source) AS fuentes, count(DISTINCT lang) AS lenguas, sum(n_chars)::BIGINT AS caracteres FROM documents")
def agg_count_scalar(t):
    return t.documents.agg(F.count(F.lit(1)).alias("documentos"), F.countDistinct("source").alias("fuentes"), F.countDistinct("lang").alias("lenguas"), F.sum("n_chars").alias("caracteres"))


@query(f"""WITH {STAGE}, s AS (SELECT *, codigo % 5 <> 0 AS applies, codigo % 7 <> 0 AS inside FROM st)
SELECT count(*) FILTER (applies AND inside AND payload IS NULL AND error IS NULL) AS pending, count(*) FILTER (applies AND inside AND error IS NOT NULL) AS failed,
count(*) FILTER (applies AND inside AND payload IS NOT NULL AND error IS NULL) AS completed, count(*) FILTER (NOT applies) AS not_applicable, count(*) FILTER (applies AND NOT inside) AS out_of_scope FROM s""")
def agg_status_conditional(t):
    return ag.status(_stage(t.events_view()), "payload", "error", F.col("codigo") % 5 != 0, F.col("codigo") % 7 != 0)


@query("SELECT d.lang, l.toxic, count(*) AS n, count(*) FILTER (l.quality = 1) AS buenos FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL ORDER BY l.toxic NULLS LAST")
def agg_case_sum(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("buenos")).orderBy(F.asc_nulls_last("toxic"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS usuarios FROM events GROUP BY event_type")
def agg_group_count_distinct(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("usuarios"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count_by_type(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def agg_freq_ordered(t):
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand")


@query("SELECT user_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS tipos FROM events GROUP BY user_id")
def agg_group_concat(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("tipos"))


@query("SELECT c_nationkey AS origen, s_nationkey AS destino, sum(l_quantity) AS peso FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def agg_sum_edges(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    li = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "s_nationkey", "l_quantity")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("c_nationkey").alias("origen"), F.col("s_nationkey").alias("destino")).agg(F.sum("l_quantity").alias("peso"))


@query("SELECT conv_id::VARCHAR || ':0' AS conversacion, count(*) AS n_posts, max(turn) AS profundidad_max, string_agg(DISTINCT role, ',' ORDER BY role) AS participantes FROM conversations GROUP BY conv_id")
def agg_threads(t):
    from discera.operators.graph import resolve_threads

    return ag.threads(t.posts(), resolve_threads(t.posts()))


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS parte FROM documents GROUP BY lang")
def agg_value_counts(t):
    n = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("lang", "n", F.round(F.col("n") / F.col("t"), 6).alias("parte"))  # total is one row


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS r FROM c)
SELECT user_id, sum(c)::BIGINT AS n, count(*) AS tipos, (SELECT event_type FROM m WHERE m.user_id = c.user_id AND r = 1) AS modal FROM c GROUP BY user_id ORDER BY n DESC, user_id LIMIT 15""")
def agg_actor_profile(t):
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("tipos"))
    top = n.orderBy(F.desc("n"), "user_id").limit(15)
    return top.join(ag.dominant(t.events, ["user_id"], "event_type", "modal"), "user_id").select("user_id", "n", "tipos", "modal")


@query(f"WITH {FORIA_BY_POST} SELECT post_id, foria FROM fp")
def agg_mode_foria_by_post(t):
    return ag.foria_by_post(t.post_events())


@query(f"""WITH {POST_EVENTS}, c AS (SELECT post_id, foria, count(*) AS c, min(i) AS i FROM pe WHERE foria <> 'indeterminado' GROUP BY ALL)
SELECT post_id, foria FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY c DESC, i) AS r FROM c) WHERE r = 1""")
def agg_mode_first_seen(t):
    return ag.dominant(t.post_events().where("foria <> 'indeterminado'"), ["post_id"], "foria", "foria", F.col("i"))


@query("SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def agg_mode_smallest(t):
    return ag.dominant(t.documents, ["source"], "lang", "lang")


@query("""WITH u AS (SELECT p_brand AS tag, p_partkey AS orden, CASE WHEN p_size % 4 < 2 THEN 'a' WHEN p_size % 4 = 2 THEN 'b' ELSE 'c' END AS funcion FROM part),
c AS (SELECT tag, funcion, count(*) AS c, min(orden) AS o FROM u GROUP BY ALL), t AS (SELECT tag, sum(c)::BIGINT AS usos, count(*) AS k FROM c GROUP BY tag)
SELECT tag, usos, CASE WHEN 2 * c >= usos OR k = 1 THEN funcion ELSE 'mixto' END AS funcion FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY c DESC, o) AS r FROM c) JOIN t USING (tag) WHERE r = 1""")
def agg_hashtag_rollup(t):
    f = F.when(F.col("p_size") % 4 < 2, "a").when(F.col("p_size") % 4 == 2, "b").otherwise("c")
    return ag.hashtag_rollup(t.part.select(F.col("p_brand").alias("tag"), F.col("p_partkey").alias("orden"), f.alias("funcion")))


@query("SELECT w AS valor, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY w")
def agg_hashtag_sync(t):
    return t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("valor")).groupBy("valor").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 12)
SELECT user_id, event_type, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY user_id))::DOUBLE, 6) AS parte FROM events WHERE user_id IN (SELECT user_id FROM a) GROUP BY user_id, event_type""")
def agg_pivot_actor_emotion(t):
    top = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(12).select("user_id")
    n = t.events.join(top, "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("parte", F.round(F.col("n") / F.sum("n").over(W.partitionBy("user_id")), 6))


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def agg_pivot_doc_profile(t):
    return t.documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)


@query("""WITH top AS (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 3), total AS (SELECT user_id, count(*) AS t FROM events GROUP BY user_id)
SELECT user_id, event_type, round(count(*) / any_value(t)::DOUBLE, 6) AS parte FROM events JOIN total USING (user_id) WHERE event_type IN (SELECT event_type FROM top) GROUP BY ALL""")
def agg_radar(t):
    top = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3).select("event_type")
    total = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("t"))
    n = t.events.join(F.broadcast(top), "event_type", "left_semi").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))  # 3 rows
    return n.join(total, "user_id").select("user_id", "event_type", F.round(F.col("n") / F.col("t"), 6).alias("parte"))


@query(f"""WITH {EVENTS}, x AS (SELECT codigo, min(frase_idx) AS lo, max(frase_idx) AS hi FROM ev GROUP BY codigo),
b AS (SELECT codigo, floor((frase_idx - lo) * 10 / (hi - lo)::DOUBLE)::BIGINT AS bin, tipo_emocion, count(*) AS c FROM ev JOIN x USING (codigo) WHERE hi > lo GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codigo, bin ORDER BY c DESC, tipo_emocion) AS r FROM b WHERE bin < 10) WHERE r = 1)
SELECT g.codigo, g.bin, coalesce(m.tipo_emocion, 'neutro') AS valor FROM (SELECT codigo, unnest(range(10)) AS bin FROM x) g LEFT JOIN m ON m.codigo = g.codigo AND m.bin = g.bin""")
def agg_bins(t):
    return ag.bins(t.events_view(), "codigo", "frase_idx", "tipo_emocion", 10)


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS dia, event_type, count(*) AS c FROM events GROUP BY ALL)
SELECT dia, event_type AS dominante, round(c / t::DOUBLE, 6) AS parte FROM (SELECT *, sum(c) OVER (PARTITION BY dia) AS t, row_number() OVER (PARTITION BY dia ORDER BY c DESC, event_type) AS r FROM c) WHERE r = 1""")
def agg_timeline(t):
    e = t.events.withColumn("dia", F.date_format("ts", "yyyy-MM-dd"))
    n = e.groupBy("dia").agg(F.count(F.lit(1)).alias("t"))
    return ag.dominant(e, ["dia"], "event_type", "dominante", count="c").join(n, "dia").select("dia", "dominante", F.round(F.col("c") / F.col("t"), 6).alias("parte")).orderBy("dia")


@query(f"WITH {EVENTS} SELECT codigo, round(avg(CASE foria WHEN 'euforico' THEN 1 WHEN 'disforico' THEN -1 ELSE 0 END), 6) AS x, round(avg(CASE WHEN k >= 66 THEN 3 WHEN k >= 33 THEN 2 ELSE 1 END), 6) AS y FROM ev GROUP BY codigo")
def agg_scatter(t):
    x = F.when(F.col("foria") == "euforico", 1).when(F.col("foria") == "disforico", -1).otherwise(0)
    y = F.when(F.col("k") >= 66, 3).when(F.col("k") >= 33, 2).otherwise(1)
    return t.events_view().groupBy("codigo").agg(F.round(F.avg(x), 6).alias("x"), F.round(F.avg(y), 6).alias("y"))


@query(f"WITH {EVENTS} SELECT codigo, frase_idx, round(CASE WHEN m > 0 THEN frase_idx / m::DOUBLE * 100 END, 6) AS pos FROM (SELECT *, max(frase_idx) OVER (PARTITION BY codigo) AS m FROM ev)")
def agg_curve(t):
    m = F.max("frase_idx").over(W.partitionBy("codigo"))
    return t.events_view().select("codigo", "frase_idx", F.round(F.when(m > 0, F.col("frase_idx") / m * 100), 6).alias("pos"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM d GROUP BY l_suppkey)
SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n_ab, any_value(p.n) AS n_a, any_value(q.n) AS n_b, count(*) / least(any_value(p.n), any_value(q.n))::DOUBLE AS asociacion
FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey JOIN n p ON p.l_suppkey = x.l_suppkey JOIN n q ON q.l_suppkey = y.l_suppkey GROUP BY ALL""")
def agg_cooccur(t):
    return ag.cooccurrence(t.lineitem, ["l_orderkey"], "l_suppkey")


@query(f"WITH {EVENTS} SELECT tipo_emocion, foria, count(*) AS n, sum(k)::BIGINT AS repeticiones FROM ev WHERE k % 2 = 0 GROUP BY ALL")
def agg_emoji(t):
    return t.events_view().where("k % 2 = 0").groupBy("tipo_emocion", "foria").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("repeticiones"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def agg_tecno_usage(t):
    return t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, props::JSON ->> 'k' AS clase, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def agg_reframing(t):
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')")
    return t.events.where(F.col("event_type").isin("click", "view")).groupBy("event_type", k.alias("clase")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FORIA_BY_POST} SELECT comunidad, tipo, count(*) AS n, {FORIA_COLUMNS} FROM pe JOIN posts USING (post_id) JOIN com ON autor = lower(autor_handle) GROUP BY ALL")
def agg_community_profile(t):
    return ag.community_profile(t.post_events(), t.posts(), communities(t))


_GRID = "(SELECT unnest([" + ", ".join(f"'{f}'" for f in FORIAS) + "]) AS f)"


@query(f"""WITH {FORIA_BY_POST}, n AS (SELECT a.foria AS f_padre, b.foria AS f_hijo, count(*) AS n FROM pares JOIN fp a ON a.post_id = padre JOIN fp b ON b.post_id = hijo GROUP BY ALL)
SELECT p.f AS f_padre, h.f AS f_hijo, coalesce(n.n, 0) AS n FROM {_GRID} p, {_GRID} h LEFT JOIN n ON n.f_padre = p.f AND n.f_hijo = h.f""")
def agg_transition(t):
    return ag.transitions(t.posts(), ag.foria_by_post(t.post_events()))


@query(f"""WITH {FORIA_BY_POST}, n AS (SELECT CASE WHEN x.comunidad = y.comunidad THEN 'intra' ELSE 'inter' END AS alcance, a.foria AS f_padre, b.foria AS f_hijo, count(*) AS n
FROM pares JOIN fp a ON a.post_id = padre JOIN fp b ON b.post_id = hijo JOIN com x ON x.autor = ap JOIN com y ON y.autor = ah GROUP BY ALL)
SELECT s.s AS alcance, p.f AS f_padre, h.f AS f_hijo, coalesce(n.n, 0) AS n FROM (SELECT unnest(['intra', 'inter']) AS s) s, {_GRID} p, {_GRID} h LEFT JOIN n ON n.alcance = s.s AND n.f_padre = p.f AND n.f_hijo = h.f""")
def agg_transition_scope(t):
    return ag.transitions(t.posts(), ag.foria_by_post(t.post_events()), communities(t))


@query(f"""WITH {FORIA_BY_POST} SELECT x.comunidad AS comunidad_origen, y.comunidad AS comunidad_destino, CASE WHEN x.comunidad = y.comunidad THEN 'intra' ELSE 'inter' END AS alcance, count(*) AS respuestas, {FORIA_COLUMNS}
FROM pares JOIN fp ON post_id = hijo JOIN com x ON x.autor = ap JOIN com y ON y.autor = ah GROUP BY ALL""")
def agg_flow(t):
    return ag.flow(t.posts(), ag.foria_by_post(t.post_events()), communities(t))


@query(f"""WITH {FORIA_BY_POST}, t AS (SELECT DISTINCT post_id, tipo FROM pe), g AS (SELECT tipo, count(*) AS c FROM pares JOIN t ON post_id = padre GROUP BY tipo HAVING count(*) >= 5),
b AS (SELECT tipo, count(*) AS b FROM pares JOIN t ON post_id = hijo GROUP BY tipo), r AS (SELECT x.tipo, count(*) AS r FROM pares JOIN t x ON x.post_id = padre JOIN t y ON y.post_id = hijo AND y.tipo = x.tipo GROUP BY x.tipo), n AS (SELECT count(*) AS n FROM pares)
SELECT tipo AS tipo_emocion, n AS pares, c AS pares_con_padre, coalesce(r, 0) AS replicas, round(coalesce(r, 0) / c::DOUBLE, 4) AS p_condicional, round(coalesce(b, 0) / n::DOUBLE, 4) AS p_base,
CASE WHEN coalesce(b, 0) > 0 THEN round((coalesce(r, 0) / c::DOUBLE) / (b / n::DOUBLE), 3) END AS lift FROM g LEFT JOIN b USING (tipo) LEFT JOIN r USING (tipo), n""")
def agg_lift(t):
    return ag.lift(ag.replies(t.posts()), t.post_events().select("post_id", "tipo"))


@query("""SELECT p_brand, string_agg(p_type || ' (' || c || ')', ', ' ORDER BY r) AS perfil FROM (SELECT p_brand, p_type, count(*) AS c, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r <= 3 GROUP BY p_brand""")
def agg_group_topk_label(t):
    return ag.group_top(t.part, "p_brand", "p_type")


@query(f"WITH {POSTS} SELECT autor_handle, (turn % 3)::BIGINT AS grupo, count(*) AS n FROM posts GROUP BY ALL")
def agg_group_author(t):
    return t.posts().groupBy("autor_handle", (F.col("turn") % 3).alias("grupo")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT DISTINCT doc_id, lang AS grupo, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS termino FROM documents),
c AS (SELECT grupo, termino, count(*) AS c FROM w WHERE length(termino) >= 4 AND NOT regexp_full_match(termino, '[0-9]+') GROUP BY ALL),
s AS (SELECT grupo, termino, c, (c / (sum(c) OVER (PARTITION BY grupo))::DOUBLE) / ((sum(c) OVER (PARTITION BY termino))::DOUBLE / (sum(c) OVER ())::DOUBLE) AS score FROM c)
SELECT * FROM (SELECT grupo, termino, c, score, row_number() OVER (PARTITION BY grupo ORDER BY score DESC, c DESC, termino)::INT AS puesto FROM s WHERE c >= 2) WHERE puesto <= 8""")
def agg_terms(t):
    return ag.terms(t.documents, "text", "lang")


@query("SELECT count(*) FILTER (contains(lower(text), 'the')) AS unidades, count(DISTINCT CASE WHEN contains(lower(text), 'the') THEN source END) AS fuentes, count(DISTINCT CASE WHEN contains(lower(text), 'the') THEN lang END) AS lenguas FROM documents")
def agg_search_counts(t):
    hit = F.contains(F.lower("text"), F.lit("the"))
    return t.documents.agg(F.count_if(hit).alias("unidades"), F.countDistinct(F.when(hit, F.col("source"))).alias("fuentes"), F.countDistinct(F.when(hit, F.col("lang"))).alias("lenguas"))


@query("SELECT event_type AS modelo, count(*) AS entradas, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS aciertos, round(sum((props::JSON ->> 'k')::BIGINT) / (sum((props::JSON ->> 'k')::BIGINT) + count(*))::DOUBLE, 6) AS tasa FROM events GROUP BY event_type")
def agg_cache_stats(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy(F.col("event_type").alias("modelo")).agg(F.count(F.lit(1)).alias("entradas"), F.sum(k).alias("aciertos"), F.round(F.sum(k) / (F.sum(k) + F.count(F.lit(1))), 6).alias("tasa"))


@query("""SELECT user_id, count(value) AS n, CASE WHEN count(value) < 100 THEN list_sort(list(value))[(count(value) // 2 + 1)::INT] ELSE quantile_cont(value, 0.5) END AS p50,
CASE WHEN count(value) < 100 THEN max(value) ELSE quantile_cont(value, 0.99) END AS p99 FROM events GROUP BY user_id""")
def agg_percentiles(t):
    return ag.percentiles(t.events, ["user_id"], "value")


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= 100")
def agg_percentiles_large(t):
    return ag.percentiles(t.events, ["event_type"], "value").where("n >= 100").select("event_type", "p50", "p99", "n")


@query("SELECT source, count(DISTINCT lang) > 1 AS mixed, string_agg(DISTINCT lang, ',' ORDER BY lang) AS modelos FROM documents GROUP BY source")
def agg_models_by_stage(t):
    s = F.array_sort(F.collect_set("lang"))
    return t.documents.groupBy("source").agg((F.size(s) > 1).alias("mixed"), F.array_join(s, ",").alias("modelos"))


@query(f"WITH {POSTS} SELECT conversacion_id, sha256(string_agg(post_id || '|' || coalesce(texto, ''), chr(10) ORDER BY turn)) AS firma FROM posts GROUP BY conversacion_id")
def agg_signature(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("|", "post_id", F.coalesce("texto", F.lit(""))).alias("x"))))
    return t.posts().groupBy("conversacion_id").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["x"]), "\n"), 256).alias("firma"))


for _kind in ("cube", "rollup"):
    query(f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2 FROM lineitem GROUP BY {_kind}(l_returnflag, l_linestatus)", f"agg_{_kind}")(
        lambda t, k=_kind: getattr(t.lineitem, k)("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n")).where("n >= 10").drop("n")


@query()
def agg_approx_distinct(t):
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("usuarios"))


# ordered windows ---------------------------------------------------------------


@query(f"""WITH {EVENTS}, w AS (SELECT codigo, frase_idx, list(tipo_emocion ORDER BY frase_idx) FILTER (k % 3 > 0) OVER (PARTITION BY codigo ORDER BY frase_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev)
SELECT codigo, frase_idx, CASE WHEN coalesce(len(prev), 0) = 0 THEN '(sin contexto)' ELSE array_to_string(prev[-5:], chr(10)) END AS contexto FROM w""".replace("list(tipo_emocion ORDER BY frase_idx) FILTER (k % 3 > 0)", "list(tipo_emocion) FILTER (k % 3 > 0)"))
def win_rolling_prev(t):
    return wd.previous(t.events_view().withColumn("resumen", F.when(F.col("k") % 3 > 0, F.col("tipo_emocion"))), "codigo", "frase_idx", "resumen", last=5).select("codigo", "frase_idx", "contexto")


@query(f"""WITH {EVENTS}, w AS (SELECT codigo, frase_idx, list(tipo_emocion) FILTER (k % 3 > 0) OVER (PARTITION BY codigo ORDER BY frase_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev)
SELECT codigo, frase_idx, md5(CASE WHEN coalesce(len(prev), 0) = 0 THEN '(sin contexto)' ELSE array_to_string(prev, chr(10)) END) AS contexto FROM w""")
def win_full_prev(t):
    return wd.previous(t.events_view().withColumn("resumen", F.when(F.col("k") % 3 > 0, F.col("tipo_emocion"))), "codigo", "frase_idx", "resumen").select("codigo", "frase_idx", F.md5("contexto").alias("contexto"))


@query(f"WITH {EVENTS} SELECT codigo, frase_idx, max(frase_idx) OVER (PARTITION BY codigo) AS largo FROM ev")
def win_doc_max(t):
    return t.events_view().select("codigo", "frase_idx", F.max("frase_idx").over(W.partitionBy("codigo")).alias("largo"))


@query("SELECT event_type, event_id, dense_rank() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS puesto FROM events")
def win_rank_in_group(t):
    return t.events.select("event_type", "event_id", (F.dense_rank().over(W.partitionBy("event_type", "user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("puesto"))


_RUNS = f"""{EVENTS}, f AS (SELECT *, CASE WHEN lag(tipo_emocion) OVER (PARTITION BY codigo ORDER BY frase_idx) = tipo_emocion THEN 0 ELSE 1 END AS nueva FROM ev),
r AS (SELECT *, sum(nueva) OVER (PARTITION BY codigo ORDER BY frase_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS racha FROM f)"""


@query(f"WITH {_RUNS} SELECT codigo, racha, any_value(tipo_emocion) AS valor, min(frase_idx) AS desde, count(*) AS n FROM r GROUP BY codigo, racha")
def win_runs(t):
    r = wd.runs(t.events_view(), ["codigo"], "frase_idx", "tipo_emocion")
    return r.groupBy("codigo", "racha").agg(F.min("tipo_emocion").alias("valor"), F.min("frase_idx").alias("desde"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RUNS}, a AS (SELECT *, count(*) OVER (PARTITION BY codigo, racha) AS n, row_number() OVER (PARTITION BY codigo, racha ORDER BY frase_idx) AS orden FROM r)
SELECT codigo, frase_idx, n, orden::INT AS orden, orden = 1 AS primario, CASE WHEN n >= 3 THEN 'saturado' WHEN n = 2 THEN 'intensificado' ELSE 'simple' END AS intensidad FROM a""")
def win_run_attrs(t):
    return wd.run_attributes(wd.runs(t.events_view(), ["codigo"], "frase_idx", "tipo_emocion"), ["codigo"], "frase_idx").select("codigo", "frase_idx", "n", "orden", "primario", "intensidad")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 6")
def win_topn_group(t):
    return wd.first_n(t.documents, ["source"], [F.desc("n_chars"), F.col("doc_id")], 6).select("source", "doc_id")


@query("SELECT o_orderkey, m + row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS nuevo FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m, l_returnflag FROM lineitem) WHERE l_returnflag = 'R'")
def win_next_idx(t):
    m = F.max("l_linenumber").over(W.partitionBy("l_orderkey"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", m.alias("m"), "l_returnflag").where("l_returnflag = 'R'")
    return rows.select("o_orderkey", (F.col("m") + F.row_number().over(W.partitionBy("o_orderkey").orderBy("l_linenumber"))).cast("long").alias("nuevo"))


@query()
def win_greedy_pack(t):
    return t.documents.select("doc_id", F.posexplode(wd.pack(F.split("text", "\n"), 400)).alias("trozo", "texto"))


@query(f"""WITH RECURSIVE {POSTS}, tree AS (SELECT post_id, conversacion_id, lpad(turn::VARCHAR, 6, '0') AS path, 0 AS nivel FROM posts WHERE en_respuesta_a IS NULL
UNION ALL SELECT c.post_id, c.conversacion_id, path || '/' || lpad(turn::VARCHAR, 6, '0'), nivel + 1 FROM posts c JOIN tree ON c.en_respuesta_a = tree.post_id)
SELECT post_id, nivel::BIGINT AS nivel, row_number() OVER (PARTITION BY conversacion_id ORDER BY path) AS orden FROM tree""")
def win_tree_order(t):
    return wd.tree_order(t.posts(), "turn").select("post_id", "nivel", "orden")


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS antes FROM events")
def win_sql_frames(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.sum("value").over(w.rowsBetween(-2, 0)).alias("s3"), F.rank().over(W.partitionBy("user_id").orderBy(F.desc("value"))).cast("long").alias("r"), F.ntile(4).over(w).cast("long").alias("q"), F.lag("value").over(w).alias("antes"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS desde, event_type, count(*) AS n FROM events GROUP BY ALL")
def win_tumbling(t):
    return t.events.groupBy(F.window("ts", "1 hour").start.alias("desde"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nueva FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, min(ts) AS desde, count(*) AS n FROM s GROUP BY user_id, s""")
def win_session(t):
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("desde"), "n")


# top-k and sets ------------------------------------------------------------------


@query("SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY toxic NULLS LAST, doc_id")
def sort_nulls_last(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "toxic").orderBy(F.asc_nulls_last("toxic"), "doc_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def sort_multi(t):
    best = F.max_by("o_orderkey", F.struct((F.col("o_orderstatus") == "F").alias("f"), "o_totalprice", F.negative("o_orderkey").alias("k")))
    return t.orders.groupBy("o_custkey").agg(best.alias("o_orderkey"))


@query("SELECT w AS valor, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY w ORDER BY n DESC, valor LIMIT 50")
def topk_values(t):
    return t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("valor")).groupBy("valor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "valor").limit(50)


@query("SELECT p_brand, count(*) AS usos FROM part GROUP BY p_brand ORDER BY usos DESC, p_brand LIMIT 25")
def topk_hashtags(t):
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("usos")).orderBy(F.desc("usos"), "p_brand").limit(25)


@query(f"WITH {EVENTS} SELECT tipo_emocion, foria, row_number() OVER (ORDER BY {FORIA_RANK}, tipo_emocion) AS orden FROM (SELECT DISTINCT tipo_emocion, foria FROM ev)")
def sort_dominant_then_alpha(t):
    top = ag.dominant(t.events_view(), ["tipo_emocion"], "foria", "foria")
    return top.select("tipo_emocion", "foria", F.row_number().over(W.orderBy(ag.rank_of(F.col("foria"), FORIAS), "tipo_emocion")).cast("long").alias("orden"))  # one row per type


@query("""SELECT doc_id, (SELECT string_agg(w, ',' ORDER BY p, w) FROM (SELECT w, CASE WHEN position(w IN text) = 0 THEN 1000000 ELSE position(w IN text) END AS p FROM (SELECT unnest(['the', 'de', 'und', 'of']) AS w))) AS orden FROM documents""")
def sort_by_evidence(t):
    from discera.operators.infer import order_by_evidence

    marks = F.array(*map(F.lit, ("the", "de", "und", "of")))
    return t.documents.select("doc_id", F.array_join(order_by_evidence(F.array_sort(marks), F.col("text")), ",").alias("orden"))


@query("SELECT c_nationkey AS k, 'c' AS lado FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def set_union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("lado")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("lado")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect_keys(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_emotion_key(t):
    return wd.first_n(t.events, ["user_id", "event_type"], [F.col("event_id")], 1).select("user_id", "event_type", "event_id")


@query(f"WITH {EVENTS} SELECT codigo, tipo_emocion, foria, min(frase_idx) AS frase_idx FROM ev GROUP BY ALL")
def dedup_emotion_slug(t):
    return wd.first_n(t.events_view(), ["codigo", "tipo_emocion", "foria"], [F.col("frase_idx")], 1).select("codigo", "tipo_emocion", "foria", "frase_idx")


@query("SELECT p_partkey, w, min(i)::INT AS i FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part) GROUP BY ALL")
def dedup_referents(t):
    rows = t.part.select("p_partkey", F.posexplode(F.split(F.lower("p_name"), " ")).alias("i", "w"))
    return wd.first_n(rows, ["p_partkey", "w"], [F.col("i")], 1).select("p_partkey", "w", "i")


@query("SELECT user_id, event_type, min(event_id) AS event_id, string_agg(DISTINCT props, '; ' ORDER BY props) AS fuentes FROM events GROUP BY ALL")
def dedup_collapse_merge(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.array_join(F.array_sort(F.collect_set("props")), "; ").alias("fuentes"))


@query("SELECT text_md5, n FROM (SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY md5(text)) WHERE n > 1")
def dedup_unique_check(t):
    return t.documents.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT DISTINCT ON (l_orderkey, s) l_orderkey, s AS l_suppkey, l_linestatus FROM (SELECT l_orderkey, CASE WHEN l_suppkey = 1 THEN 2 ELSE l_suppkey END AS s, l_suppkey, l_linestatus, l_linenumber FROM lineitem) ORDER BY l_orderkey, s, (l_suppkey <> 1) DESC, l_linenumber""")
def set_merge_entities(t):
    from discera.operators.resolve import merge_entities

    # lines of one number stand in the order of the files and of their rows there
    place = [F.col(f"_metadata.{c}") for c in ("file_path", "row_index")]
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_linestatus", "l_linenumber", *place)
    return merge_entities(lines, "l_suppkey", 1, 2, ["l_orderkey"], [F.asc_nulls_last("l_linenumber"), "file_path", "row_index"]).select("l_orderkey", "l_suppkey", "l_linestatus")

"""Queries: files written and read back, the knowledge base, scrapers, context, incremental stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from discera.functions import spans as sp
from discera.functions import text as fx
from discera.operators import evaluate as ev
from discera.operators import filters as fl
from discera.operators import graph as gr
from discera.operators import state as st
from discera.operators import windows as wd
from discera.plans.catalog_rows import STAGE, _stage
from discera.plans.catalog_text import _raw_posts
from discera.plans.registry import query
from discera.plans.storage import new_folder
from discera.plans.views import EVENTS, POSTS
from discera.sources import knowledge as kn
from discera.sources import readers as rd
from discera.sources import scrape as sc
from discera.sources.connector import MemoryPlatform, pages


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS codigos, sum(length(text))::BIGINT AS caracteres FROM documents")
def src_docs(t):
    path = new_folder(t.spark)
    t.documents.select(F.col("doc_id").cast("string").alias("codigo"), F.col("text").alias("contenido")).write.option("header", True).option("escape", '"').csv(path)
    return rd.load_documents(t.spark, path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("codigo").alias("codigos"), F.sum(F.length("contenido")).alias("caracteres"))


@query("SELECT 'posts' AS tabla, count(*) AS n FROM conversations UNION ALL SELECT 'documentos', count(*) FILTER (trim(text) <> '' OR true) FROM conversations UNION ALL SELECT 'autores', count(DISTINCT role) FROM conversations")
def src_posts(t):
    path = new_folder(t.spark)
    _raw_posts(t).drop("plataforma").write.json(path)
    bundle = rd.load_posts(t.spark, path)
    out = None
    for name, df in bundle.items():
        n = df.agg(F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.union(n)
    return out


class _Archive:
    """A site whose pages are their URLs."""

    def fetch(self, url):
        return f"<html><head><title>{url}</title></head><body><p>Texto de la nota.</p><p>Compartir</p></body></html>"


@query("SELECT url, any_value(url) AS titulo, 'Texto de la nota.' AS contenido FROM pages WHERE page_id % 28 BETWEEN 4 AND 9 GROUP BY url")
def src_scrape(t):
    entries = t.pages.select("url", F.expr("date_add(date'2024-01-01', int(page_id % 28))").alias("fecha"))
    got = sc.fetch(sc.in_range(entries, "2024-01-05", "2024-01-10"), _Archive())
    return sc.documents(got, ["Compartir"])


def _kb(t):
    path = new_folder(t.spark)
    body = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("n_name").alias("k"), F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.struct(F.array(F.lit("tuit")).alias("generos")))).when(F.col("n_nationkey") % 3 == 1, F.to_json(F.struct(F.array(F.lit("nota")).alias("generos")))).otherwise("{}").alias("v")))).alias("emociones")))
    t.nation.agg(body.alias("value")).write.text(path)
    return kn.read_entries(t.spark, path, "emociones")


@query("SELECT n_name AS nombre FROM nation")
def scan_json_kb(t):
    return _kb(t).select("nombre")


@query("SELECT n_name AS nombre FROM nation WHERE n_nationkey % 3 <> 1")
def filter_kb_by_genre(t):
    return kn.for_genre(_kb(t), "tuit").select("nombre")


@query(f"""WITH RECURSIVE {POSTS}, o AS (SELECT post_id, en_respuesta_a, CASE WHEN turn % 3 <> 1 THEN 'origin' ELSE 'satellite' END AS fuente FROM posts WHERE turn % 3 <> 1 OR turn % 2 = 1),
up AS (SELECT post_id, en_respuesta_a AS ref, 1 AS n FROM o WHERE fuente = 'origin' AND en_respuesta_a IS NOT NULL UNION ALL SELECT up.post_id, p.en_respuesta_a, n + 1 FROM up JOIN o p ON p.post_id = up.ref WHERE n < 5 AND p.en_respuesta_a IS NOT NULL)
SELECT up.post_id, 'padre_' || n AS relacion, ref, coalesce(o.fuente, 'unavailable') AS fuente FROM up LEFT JOIN o ON o.post_id = up.ref""")
def build_context_satellite(t):
    p = t.posts().withColumn("cita_a", F.lit(None).cast("string")).withColumn("reposteo_a", F.lit(None).cast("string"))
    return gr.context_satellite(p.where("turn % 3 <> 1"), p.where("turn % 2 = 1")).select("post_id", "relacion", "ref", "fuente")


def _appended(t, kind):
    path = new_folder(t.spark)
    d = t.documents.select(F.col("doc_id").cast("string").alias("id"), "lang")
    rd.append_files(d.where("int(id) % 2 = 0"), path, "id", "lang", kind)
    rd.append_files(d, path, "id", "lang", kind)
    return (t.spark.read.json(path) if kind == "json" else rd.read_csv(t.spark, path)).select("id", "lang")


@query("SELECT doc_id::VARCHAR AS id, lang FROM documents")
def sink_append_dedup_jsonl(t):
    return _appended(t, "json")


@query("SELECT doc_id::VARCHAR AS id, lang FROM documents")
def sink_append_dedup_csv(t):
    return _appended(t, "csv")


@query("SELECT event_id::VARCHAR AS event_id, props::JSON ->> 'k' AS carac__k FROM events")
def sink_csv_docs(t):
    path = new_folder(t.spark)
    rd.write_csv(st.flatten(t.events.select("event_id", "props"), "props", "carac", ["k"]), path)
    return rd.read_csv(t.spark, path)


@query(f"WITH {EVENTS} SELECT codigo::VARCHAR AS codigo, frase_idx::VARCHAR AS frase_idx, props AS payload FROM ev")
def sink_csv_units(t):
    path = new_folder(t.spark)
    rd.write_csv(t.events_view().select("codigo", "frase_idx", F.col("props").alias("payload")), path)
    return rd.read_csv(t.spark, path)


@query("SELECT 'nation' AS tabla, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def sink_full(t):
    path = new_folder(t.spark)
    counts = rd.export_run({"nation": t.nation, "region": t.region}, path)
    read = [t.spark.read.option("header", True).csv(f"{path}/{name}").agg(F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("n")) for name in counts]
    return read[0].union(read[1])


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def sink_table(t):
    path = new_folder(t.spark)
    rd.write_csv(t.region, path)
    return rd.read_csv(t.spark, path)


@query("SELECT count(*) AS n, true AS marca FROM region")
def sink_csv_bom(t):
    path = new_folder(t.spark)
    rd.write_csv_bom(t.region, path)
    raw = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    lines = F.size(F.split(F.btrim(F.decode("content", "UTF-8"), F.lit(" \n\r")), "\n")) - 1
    return raw.agg(F.sum(lines).alias("n"), F.max(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marca"))


@query("SELECT doc_id, quality FROM labels WHERE quality = 1")
def sink_golden_jsonl(t):
    path = new_folder(t.spark)
    rd.write_jsonl(t.labels.where("quality = 1").select("doc_id", "quality"), path, ["doc_id"])
    return t.spark.read.schema("doc_id long, quality int").json(path)


@query(f"WITH {EVENTS} SELECT a.codigo, a.frase_idx AS i, b.frase_idx AS j, a.tipo_emocion = b.tipo_emocion AS mismo FROM ev a JOIN ev b ON a.codigo = b.codigo AND a.frase_idx // 3 = b.frase_idx // 3")
def join_golden_pred(t):
    e = t.events_view().select("codigo", F.expr("frase_idx div 3").alias("u"), "frase_idx", "tipo_emocion")
    g, p = e.withColumnsRenamed({"frase_idx": "i", "tipo_emocion": "x"}), e.withColumnsRenamed({"frase_idx": "j", "tipo_emocion": "y"})
    return g.join(p, ["codigo", "u"]).select("codigo", "i", "j", (F.col("x") == F.col("y")).alias("mismo"))


@query("SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' '))))::DOUBLE AS v FROM part")
def fn_jaccard(t):
    return t.part.select("p_partkey", fx.jaccard(F.split("p_name", " "), F.split("p_type", " ")).alias("v"))


@query("SELECT event_id, (['risa', 'alargamiento', 'puntuacion', ''])[(event_id % 4 + 1)::INT] AS clase FROM events")
def ext_typo(t):
    text = F.element_at(F.array(*map(F.lit, ("jajaja sí", "holaaaa sí", "qué?! sí", "nada sí"))), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", F.coalesce(F.get(sp.spans(text), F.lit(0))["extra"], F.lit("")).alias("clase"))


@query("SELECT event_id, (CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 5 WHEN 2 THEN 90 ELSE 60 END)::DOUBLE AS v FROM events")
def fn_rate_limit_wait(t):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    header = F.element_at(F.array(F.lit("mañana"), F.lit("1704067201"), F.lit("2024-01-01T00:01:30Z"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", fx.rate_limit_wait(header, now).alias("v"))


@query(f"WITH {POSTS} SELECT post_id, CASE turn % 3 WHEN 0 THEN autor_handle || ': hola' WHEN 1 THEN '?: hola' END AS v FROM posts")
def fn_embedded_quote(t):
    value = F.struct(F.lit(" hola ").alias("text"))
    flat = F.to_json(F.struct(F.struct(F.struct(value.alias("value"), F.struct(F.concat(F.lit("@"), "autor_handle").alias("handle")).alias("author")).alias("record")).alias("embed")))
    deep = F.to_json(F.struct(F.struct(F.struct(F.struct(value.alias("value")).alias("record")).alias("record")).alias("embed")))
    q = fx.embedded_quote(F.when(F.col("turn") % 3 == 0, flat).when(F.col("turn") % 3 == 1, deep).otherwise('{"embed": 3'))
    return t.posts().select("post_id", q.alias("q")).select("post_id", F.when(F.col("q").isNotNull(), F.concat_ws(": ", "q.autor_handle", "q.texto")).alias("v"))


@query("""SELECT event_id, (props::JSON ->> 'k') AS k, 'si' AS visto FROM events""")
def fn_json_map_update(t):
    m = F.from_json(fx.map_update(F.col("props"), F.create_map(F.lit("visto"), F.lit("si"))), "map<string,string>")
    return t.events.select("event_id", m["k"].alias("k"), m["visto"].alias("visto"))


@query(f"WITH {EVENTS} SELECT event_id, codigo || ':' || frase_idx || ':' || (frase_idx % 3) AS clave FROM ev")
def g_key(t):
    return t.events_view().select("event_id", F.concat_ws(":", "codigo", "frase_idx", F.col("frase_idx") % 3).alias("clave"))


@query(f"WITH {STAGE} SELECT count(*) AS pendientes FROM st WHERE payload IS NULL")
def inc_pending(t):
    """Errors stay until they are cleared; then their rows are pending again."""
    rows = fl.retry(_stage(t.events_view()), "payload", "error", "failed")
    return fl.pending(rows.withColumn("payload", F.when(F.col("k") % 10 == 7, F.col("payload")).otherwise(F.col("payload"))), "payload", "error").where("k % 10 = 3").agg(F.count(F.lit(1)).alias("pendientes"))


@query("SELECT conv_id || ':' || turn AS id FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS r FROM conversations WHERE text IS NOT NULL) WHERE r <= 7")
def inc_cursor(t):
    """Pages of an archive up to max_items."""
    import pandas as pd

    # every text holds the empty query, so the cursor never comes to a post beyond the eighth
    rows = t.posts().where("texto is not null").orderBy(F.col("conversacion_id").cast("long"), "turn").limit(8).select(F.col("post_id").alias("id"), "texto")

    def run(parts):
        records = [r for pdf in parts for r in pdf.to_dict("records")]
        yield pd.DataFrame(pages(MemoryPlatform(records, 3), "", 7), columns=["id", "texto"])[["id"]]

    return rows.mapInPandas(run, "id string")


@query(f"""WITH {EVENTS}, f AS (SELECT *, CASE WHEN lag(foria) OVER (PARTITION BY codigo ORDER BY frase_idx) = foria THEN 0 ELSE 1 END AS nueva FROM ev), r AS (SELECT *, sum(nueva) OVER (PARTITION BY codigo ORDER BY frase_idx ROWS UNBOUNDED PRECEDING) AS racha FROM f)
SELECT codigo, max(n) AS larga FROM (SELECT codigo, racha, count(*) AS n FROM r GROUP BY ALL) GROUP BY codigo""")
def inc_runs(t):
    r = wd.runs(t.events_view(), ["codigo"], "frase_idx", "foria").groupBy("codigo", "racha").agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("codigo").agg(F.max("n").alias("larga"))


@query(f"WITH {EVENTS} SELECT a.codigo, a.frase_idx, (SELECT string_agg(b.tipo_emocion, chr(10) ORDER BY b.frase_idx) FROM ev b WHERE b.codigo = a.codigo AND b.frase_idx BETWEEN a.frase_idx - 2 AND a.frase_idx - 1) AS contexto FROM ev a WHERE a.frase_idx < 3")
def ev_context_all(t):
    e = t.events_view().select("codigo", "frase_idx", "tipo_emocion")
    return ev.context(e, e.where("frase_idx < 3"), "codigo", "frase_idx", "tipo_emocion", 2)

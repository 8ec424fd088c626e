"""Queries: label functions, segmentation, spans, pages, sources, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from discera.functions import segment as sg
from discera.functions import spans as sp
from discera.functions import text as fx
from discera.plans.catalog_rows import fold_sql
from discera.plans.registry import query
from discera.plans.storage import new_folder
from discera.plans.views import POSTS
from discera.sources import html as ht
from discera.sources import readers as rd

# labels of the events, as a model would return them: a type with alternatives, lists or signs around it
LABELS = ("Argentina / Estado argentino", "frustración, arrepentimiento", "sentirse engañado", "indignación',", "la población mundial", "los socialistas y el estatismo", "Milei, el presidente", "encuentro entre Sánchez, Trump y Milei", "paz y prosperidad", "nosotros (gobierno)", "tenemos", "el enunciador", "los enunciatarios", "")


def _labels(t):
    return t.events.select("event_id", F.element_at(F.array(*map(F.lit, LABELS)), (F.col("event_id") % len(LABELS) + 1).cast("int")).alias("etiqueta"))


def _expected(name: str, values: list, make, kind: str = "VARCHAR"):
    """A label function, and the expected value of each label."""
    cells = ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" for v in values)
    query(f"SELECT event_id, ([{cells}])[(event_id % {len(LABELS)} + 1)::INT]::{kind} AS v FROM events", name)(lambda t: _labels(t).select("event_id", make(F.col("etiqueta")).alias("v")))


_expected("fn_sanitize_referent", ["Argentina", "frustración, arrepentimiento", "sentirse engañado", "indignación", "la población mundial", "los socialistas y el estatismo", "Milei, el presidente", "encuentro entre Sánchez, Trump y Milei", "paz y prosperidad", "nosotros (gobierno)", "tenemos", "el enunciador", "los enunciatarios", ""], fx.sanitize_referent)
_expected("fn_sanitize_emotion", ["Argentina", "frustración", "engañado", "indignación", "la población mundial", "los socialistas y el estatismo", "Milei", "encuentro entre Sánchez", "paz y prosperidad", "nosotros (gobierno)", "tenemos", "el enunciador", "los enunciatarios", ""], fx.sanitize_emotion)
_expected("fn_split_coordination", ["Argentina / Estado argentino", "frustración, arrepentimiento", "sentirse engañado", "indignación',", "la población mundial", "los socialistas|el estatismo", "Milei, el presidente", "encuentro entre Sánchez, Trump y Milei", "paz|prosperidad", "nosotros (gobierno)", "tenemos", "el enunciador", "los enunciatarios", ""], lambda c: F.array_join(fx.split_coordination(c), "|"))
_expected("fn_is_deictic", [False, False, False, False, False, False, False, False, False, True, True, False, False, False], fx.is_deictic, "BOOLEAN")
_expected("fn_is_first_person", [False, False, False, False, False, False, False, False, False, True, False, False, False, False], fx.is_first_person, "BOOLEAN")
_expected("fn_resolve_role", ["", "", "", "", "", "", "", "", "", "", "", "Ana Paz", "el pueblo", ""], lambda c: fx.resolve_role(c, F.lit("Ana Paz"), F.array(F.lit("el pueblo"))))
_expected("fn_invalid_canonical", [False, False, False, False, False, True, False, True, True, True, False, False, False, False], lambda c: fx.invalid_canonical(fx.slug(c)), "BOOLEAN")
_expected("fn_is_role_label", [False] * 11 + [True, False, False], fx.is_role_label, "BOOLEAN")
_expected("fn_resolve_possessive", ["Carlitos", "círculo cercano de Carlitos"] * 7, lambda c: F.get(fx.resolve_possessive(F.array(F.lit("Carlitos"), F.lit("su círculo cercano"))), (F.col("event_id") % 2).cast("int")))
_expected("fn_classify_reference", ["identico", "solapamiento_parcial", "distinto", "valor_ausente", "mismo_canonico", "identico", "solapamiento_parcial", "distinto", "valor_ausente", "mismo_canonico", "identico", "solapamiento_parcial", "distinto", "valor_ausente"], lambda c: F.element_at(F.array(
    fx.classify_reference(F.lit("Javier Milei"), F.lit("javier milei")), fx.classify_reference(F.lit("Javier Milei"), F.lit("Milei")), fx.classify_reference(F.lit("Javier Milei"), F.lit("la oposición")),
    fx.classify_reference(F.lit(None).cast("string"), F.lit("Javier Milei")), fx.classify_reference(F.lit("el jefe"), F.lit("Ana"), F.lit("ana"), F.lit("ana"))), (F.col("event_id") % len(LABELS) % 5 + 1).cast("int")))
_expected("inf_literal_mark", [True, False] * 7, lambda c: F.when(F.col("event_id") % 2 == 0, fx.literal_mark(F.lit("Está furioso"), F.lit("Hoy esta FURIOSO, dijo"))).otherwise(fx.literal_mark(F.lit("esta furio"), F.lit("Hoy esta furioso"))), "BOOLEAN")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || chr(10) || 'b' ELSE 'b' END AS v FROM documents")
def fn_strip_boilerplate(t):
    return t.documents.select("doc_id", fx.strip_boilerplate(F.when(F.col("doc_id") % 2 == 0, "a\n Compartir \nb").otherwise("leer también\nb\n"), ["compartir", "leer también"]).alias("v"))


@query()
def fn_stable_color(t):
    return t.events.groupBy("event_type").agg(F.max(fx.stable_tone(F.col("event_type"))).alias("tono"))


@query()
def fn_seq_ratio(t):
    from discera.operators.resolve import sequence_ratio

    return t.part.select("p_partkey", sequence_ratio("p_name", "p_type").alias("v"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(a, lambda x: length(x) >= 30)) > 0 THEN len(list_filter(a, lambda x: length(x) >= 30)) ELSE least(len(a), 1) END AS n FROM p""")
def seg_paragraphs(t):
    return t.documents.select("doc_id", F.size(sg.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).cast("long").alias("n"))


@query("SELECT doc_id, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS n FROM documents")
def seg_document(t):
    return t.documents.select("doc_id", F.length(F.get(sg.document(F.col("text")), F.lit(0))).cast("long").alias("n"))


@query()
def seg_sentences(t):
    return t.documents.select("doc_id", F.posexplode(sg.sentences("text")).alias("unit_idx", "frase"))


@query()
def ext_all(t):
    return t.documents.select("doc_id", F.explode(sp.spans("text")).alias("s")).select("doc_id", "s.*")


_TAGGED = "'hola #Uno_' || doc_id || ' @Ana.B, mirá https://x.com/' || doc_id || '...'"


def _tagged(t):
    return t.documents.select("doc_id", F.concat(F.lit("hola #Uno_"), "doc_id", F.lit(" @Ana.B, mirá https://x.com/"), "doc_id", F.lit("...")).alias("texto"))


@query("SELECT doc_id, 'uno_' || doc_id AS tag FROM documents")
def ext_hashtags(t):
    return _tagged(t).select("doc_id", F.explode(sp.hashtags(F.col("texto"))).alias("tag"))


@query("SELECT doc_id, 'ana.b' AS handle FROM documents")
def ext_mentions(t):
    return _tagged(t).select("doc_id", F.explode(sp.mentions(F.col("texto"))).alias("handle"))


@query("SELECT doc_id, 'https://x.com/' || doc_id AS url, 'x.com' AS dominio FROM documents")
def ext_urls(t):
    return _tagged(t).select("doc_id", F.explode(sp.urls(F.col("texto"))).alias("url")).select("doc_id", "url", fx.domain(F.col("url")).alias("dominio"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[!?]{2,}')) AS n FROM documents")
def ext_punctuation(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[!?]{2,}")).cast("long").alias("n"))


@query("SELECT doc_id, 'fin 😀' AS emojis, 3 AS inicio FROM documents")
def ext_emojis(t):
    s = t.documents.select("doc_id", F.explode(sp.spans(F.lit("fin😀"))).alias("s")).where("s.tipo = 'emoji'")
    return s.select("doc_id", F.concat(F.lit("fin "), "s.valor").alias("emojis"), F.col("s.inicio").alias("inicio"))


@query("SELECT doc_id, 'basta fmi' AS valor, 'mayusculas:expresion' AS alcance FROM documents")
def ext_caps(t):
    s = t.documents.select("doc_id", F.explode(sp.spans(F.lit("y dijo BASTA FMI otra vez"))).alias("s"))
    return s.select("doc_id", F.col("s.norm").alias("valor"), F.col("s.extra").alias("alcance"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ana' END AS handle FROM documents")
def ext_repost_prefix(t):
    return t.documents.select("doc_id", sp.repost_handle(F.when(F.col("doc_id") % 2 == 0, "RT @ana: hola").otherwise("hola RT @ana")).alias("handle"))


@query("SELECT doc_id, text[1:3] || '«' || text[4:6] || '»' || text[7:] AS v FROM documents WHERE length(text) > 6")
def ext_mark_run(t):
    return t.documents.where("length(text) > 6").select("doc_id", sp.mark_run(F.col("text"), F.lit(3), F.lit(6)).alias("v"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'alegria' WHEN 1 THEN 'alegria' END AS afecto FROM events")
def fn_emoji_affect(t):
    rows = t.events.select("event_id", F.element_at(F.array(*map(F.lit, ("👍", "👍🏽", "🤷", "🗿"))), (F.col("event_id") % 4 + 1).cast("int")).alias("valor"))
    lexicon = t.spark.createDataFrame([("👍", "alegria"), ("🤷", "duda"), ("🤷", "ironia")], "emoji string, afecto string")
    return sp.emoji_affect(rows, lexicon).select("event_id", "afecto")


@query(f"WITH {POSTS} SELECT post_id, regexp_extract(lower(texto), '[a-z]+', 0) AS primera FROM posts")
def g_context_spans(t):
    return t.posts().select("post_id", F.regexp_extract(F.lower("texto"), "[a-z]+", 0).alias("primera"))


@query("""SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's')) AS titulo, regexp_extract(html, '<html[^>]*lang="([^"]+)', 1) AS lang FROM pages""")
def parse_html_meta(t):
    return t.pages.select("page_id", ht.title(F.col("html")).alias("titulo"), ht.language(F.col("html")).alias("lang"))


@query()
def parse_html_text(t):
    return t.pages.select("page_id", ht.html_text("html").alias("texto"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<a[^>]*href=["'']([^"'']*)', 1)) AS n FROM pages""")
def parse_html_links(t):
    return t.pages.select("page_id", F.size(ht.links(F.col("html"))).cast("long").alias("n"))


@query("SELECT url, strftime(DATE '2024-01-01' + (page_id % 28)::INT, '%Y-%m-%d') AS fecha FROM pages")
def parse_feeds(t):
    p = t.pages.select("url", F.expr("date_add(date'2024-01-01', int(page_id % 28))").alias("fecha"))
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>"), F.col("fecha").cast("string"), F.lit("T00:00:00Z</lastmod></url>"))
    return ht.sitemap(p.select(F.concat(F.lit("<urlset>"), entry, F.lit("</urlset>")).alias("value"))).select("url", F.col("fecha").cast("string").alias("fecha"))


_POST_ROWS = "SELECT conv_id || ':' || turn AS post_id, role AS autor_handle, CASE WHEN turn > 0 THEN 'reply' ELSE 'original' END AS tipo, 0 AS es_repost_puro, trim(text, ' ' || chr(10) || chr(9)) AS texto FROM conversations"


def _raw_posts(t):
    p = t.posts()
    return p.select(F.col("post_id").alias("id"), F.concat(F.lit("@"), "autor_handle").alias("autor_handle"), F.col("texto"), F.col("en_respuesta_a"), F.lit(None).cast("string").alias("cita_a"), F.lit(None).cast("string").alias("reposteo_a"), F.lit(" ").alias("plataforma"))


@query("SELECT conv_id || ':' || turn AS post_id, role AS autor_handle, CASE WHEN turn > 0 THEN 'reply' ELSE 'original' END AS tipo, 0 AS es_repost_puro, 'x' AS plataforma FROM conversations")
def norm_post_row(t):
    return rd.normalize_posts(_raw_posts(t)).select("post_id", "autor_handle", "tipo", "es_repost_puro", "plataforma")


@query("SELECT conv_id || ':' || turn AS codigo, '@' || role || ': ' || trim(text)[1:60] AS titulo FROM conversations")
def derive_docs(t):
    return rd.documents_of_posts(rd.normalize_posts(_raw_posts(t))).select("codigo", "titulo")


@query("SELECT 'x' AS plataforma, role AS autor_handle, count(*) AS n_posts FROM conversations GROUP BY role")
def derive_authors(t):
    return rd.authors_of_posts(rd.normalize_posts(_raw_posts(t))).select("plataforma", "autor_handle", "n_posts")


@query("SELECT conv_id || ':' || turn AS post_id, role AS autor_handle, CASE WHEN turn > 0 THEN 'reply' ELSE 'original' END AS tipo FROM conversations")
def src_csv_mapped(t):
    p = t.posts().select(F.col("post_id").alias("tweet_id"), F.col("texto").alias("full_text"), F.col("autor_handle").alias("screen_name"), F.col("en_respuesta_a").alias("in_reply_to_status_id"))
    return rd.posts_mapped(p).select("post_id", "autor_handle", "tipo")


@query("SELECT conv_id || ':' || turn AS post_id, 'u' || role AS autor_handle, CASE WHEN turn > 0 THEN 'reply' ELSE 'original' END AS tipo FROM conversations")
def src_jsonl_mixed(t):
    ref = F.when(F.col("en_respuesta_a").isNotNull(), F.array(F.struct(F.lit("replied_to").alias("type"), F.col("en_respuesta_a").alias("id"))))
    tweet = F.struct(F.col("post_id").alias("id"), F.col("texto").alias("text"), F.col("autor_handle").alias("author_id"), ref.alias("referenced_tweets"))
    users = F.array(F.struct(F.col("autor_handle").alias("id"), F.concat(F.lit("u"), "autor_handle").alias("username"), F.lit("N").alias("name")))
    page = F.to_json(F.struct(F.array(tweet).alias("data"), F.struct(users.alias("users")).alias("includes")))
    flat = F.to_json(F.struct(F.col("post_id").alias("id"), F.col("texto"), F.concat(F.lit("u"), "autor_handle").alias("autor_handle"), "en_respuesta_a"))
    lines = t.posts().select(F.when(F.col("turn") % 2 == 0, page).otherwise(flat).alias("value"))
    return rd.posts_mixed(lines).select("post_id", "autor_handle", "tipo")


@query("SELECT conv_id || ':' || turn AS id, lower(role) AS autor FROM conversations")
def src_api_v2_map(t):
    ref = F.lit(None).cast("array<struct<type:string,id:string>>")
    tweet = F.struct(F.col("post_id").alias("id"), F.col("texto").alias("text"), F.lit("7").alias("author_id"), ref.alias("referenced_tweets"))
    users = F.array(F.struct(F.lit("7").alias("id"), F.lower("autor_handle").alias("username"), F.lit("N").alias("name")))
    lines = t.posts().select(F.to_json(F.struct(F.array(tweet).alias("data"), F.struct(users.alias("users")).alias("includes"))).alias("value"))
    return rd.posts_mixed(lines).select(F.col("post_id").alias("id"), F.col("autor_handle").alias("autor"))


def _written(t, df, kind: str):
    """A folder of files of some kind, written and read back by the readers."""
    path = new_folder(t.spark)
    {"json": lambda: df.write.json(path), "csv": lambda: df.write.option("header", True).option("escape", '"').csv(path)}[kind]()
    return path


@query("SELECT doc_id::VARCHAR AS codigo, md5(text) AS h FROM documents")
def src_csv_docs(t):
    path = _written(t, t.documents.select(F.col("doc_id").cast("string").alias("codigo"), F.col("text").alias("contenido")), "csv")
    return rd.documents_csv(t.spark, path).select("codigo", F.md5("contenido").alias("h"))


@query("SELECT doc_id::VARCHAR AS codigo, md5(text) AS h FROM documents")
def src_json_docs(t):
    rows = t.documents.select(F.expr("doc_id div 500 * 2 + doc_id % 2").alias("g"), F.col("doc_id").cast("string").alias("codigo"), F.col("text").alias("contenido"))
    one = rows.groupBy("g").agg(F.when(F.col("g") % 2 == 0, F.to_json(F.collect_list(F.struct("codigo", "contenido")))).otherwise(F.to_json(F.map_from_entries(F.collect_list(F.struct("codigo", F.struct("contenido")))))).alias("value"))
    path = new_folder(t.spark)
    one.select("value").write.option("maxRecordsPerFile", 1).text(path)  # each file is one JSON value
    return rd.documents_json(t.spark, path).select("codigo", F.md5("contenido").alias("h"))


@query("SELECT conv_id || ':' || turn AS post_id, role AS autor_handle, md5(trim(text)) AS h FROM conversations")
def src_jsonl_posts(t):
    path = _written(t, _raw_posts(t).select("id", "texto", "autor_handle", "en_respuesta_a"), "json")
    return rd.load_posts(t.spark, path)["posts"].select("post_id", "autor_handle", F.md5("texto").alias("h"))


@query("SELECT count(*) AS n, count(DISTINCT role) AS autores FROM conversations")
def src_csv_posts(t):
    path = _written(t, _raw_posts(t).select("id", "texto", "autor_handle", "en_respuesta_a"), "csv")
    return rd.normalize_posts(rd.posts_csv(t.spark, path)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("autor_handle").alias("autores"))


@query("SELECT conv_id || ':' || turn AS id, role AS autor_handle FROM conversations WHERE contains(lower(text), 'the')")
def src_connectors(t):
    from discera.sources.connector import MemoryPlatform, pages

    import pandas as pd

    def run(parts):  # each conversation in a batch of posts plays one account's archive, paged by a cursor
        for pdf in parts:
            found = [post for _, archive in pdf.groupby("conversacion_id") for post in pages(MemoryPlatform(archive.to_dict("records"), 3), "the")]
            yield pd.DataFrame(found, columns=["id", "autor_handle", "texto"])[["id", "autor_handle"]]

    return t.posts().where("texto is not null").select(F.col("post_id").alias("id"), "autor_handle", "texto", "conversacion_id").mapInPandas(run, "id string, autor_handle string")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS desde, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(t):
    """The windows of a stream over the table's file, by availableNow; all are closed by a last row far in the future."""
    from discera.streaming import streams

    root = new_folder(t.spark)
    t.events.select("ts", "event_type").withColumn("k", F.lit(0)).union(t.spark.sql("SELECT timestamp'2100-01-01' AS ts, 'end' AS event_type, 1 AS k")).repartition(1).write.partitionBy("k").parquet(f"{root}/in")
    stream = streams.read(t.spark, f"{root}/in", "ts timestamp, event_type string, k int")
    streams.write(streams.tumbling(stream, "ts", "1 day", "event_type"), f"{root}/out", f"{root}/checkpoint")
    return t.spark.read.schema("desde timestamp, event_type string, n long").parquet(f"{root}/out").where("event_type <> 'end'").select("event_type", "desde", "n")


@query("SELECT event_type, user_id, coalesce(min(CASE WHEN event_id % 2 = 0 THEN event_id END), min(event_id)) AS event_id FROM events GROUP BY event_type, user_id")
def inc_dedup_append(t):
    """Two sessions: the second appends only what the first has not seen."""
    from discera.operators.state import append_dedup

    e = t.events.select("event_id", F.concat_ws("/", "event_type", "user_id").alias("k"), "event_type", "user_id")
    first = append_dedup(e.where("false"), e.where("event_id % 2 = 0"), "k", "event_id")
    return append_dedup(first, e.where("event_id % 2 = 1"), "k", "event_id").select("event_type", "user_id", "event_id")

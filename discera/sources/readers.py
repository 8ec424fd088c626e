"""Readers of documents and posts, with normalisation and row checks; writers of analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from discera.functions.text import blank_to_null
from discera.operators.rules import validate

# fixed values: columns of a normalised post, and names under which third-party files carry them
POST_DDL = (
    "id string, texto string, autor_handle string, autor_display string, plataforma string, fecha string, lang string, tipo string, conversacion_id string, "
    "en_respuesta_a string, cita_a string, reposteo_a string, metricas map<string,bigint>, media array<struct<tipo:string,url:string,alt:string>>, url string, raw string"
)
ALIASES = {
    "id": ("id", "tweet_id", "post_id", "status_id", "id_str"),
    "texto": ("texto", "text", "full_text", "content", "body", "contenido"),
    "autor_handle": ("autor_handle", "username", "screen_name", "user", "author", "handle", "autor"),
    "autor_display": ("autor_display", "name", "display_name", "author_name"),
    "fecha": ("fecha", "created_at", "date", "timestamp", "datetime"),
    "en_respuesta_a": ("en_respuesta_a", "in_reply_to_status_id", "in_reply_to", "reply_to", "parent_id"),
    "cita_a": ("cita_a", "quoted_status_id", "quoted_id", "quote_id"),
    "reposteo_a": ("reposteo_a", "retweeted_status_id", "retweet_id", "repost_of"),
    "conversacion_id": ("conversacion_id", "conversation_id", "thread_id"),
    "lang": ("lang", "language", "idioma"),
    "url": ("url", "link", "permalink"),
}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)


def documents_csv(spark: SparkSession, path: str) -> DataFrame:
    return check_documents(read_csv(spark, path))


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or an object of objects whose keys become codes."""
    whole = spark.read.option("wholetext", True).text(path)
    listed = whole.where(F.col("value").rlike(r"^\s*\[")).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    keyed = whole.where(F.col("value").rlike(r"^\s*\{")).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("k", "v")).select(F.map_concat(F.create_map(F.lit("codigo"), F.col("k")), F.map_filter("v", lambda a, b: a != "codigo")).alias("m"))
    rows = listed.union(keyed)
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())  # the files' field names
    return check_documents(rows.select(*(F.col("m")[k].alias(k) for k in keys)))


def check_documents(df: DataFrame) -> DataFrame:
    """Codes are there, once each; contents are not blank."""
    df = df.withColumns({c: blank_to_null(F.col(c)) for c in ("codigo", "contenido") if c in df.columns})
    validate(df, "documento")
    unique(df, "codigo")
    return df


def unique(df: DataFrame, key: str) -> DataFrame:
    twice = df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError(f"{key} stands more than once: {', '.join(str(r[0]) for r in twice)}")
    return df


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    return documents_json(spark, path) if path.endswith(".json") else documents_csv(spark, path)


def posts_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(POST_DDL).option("mode", "FAILFAST").json(path)


def posts_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path)


def normalize_posts(df: DataFrame, platform: str = "x") -> DataFrame:
    """Trimmed fields, handles without @, a platform, and a type inferred from references: repost before reply before quote."""
    have = set(df.columns)
    col = lambda c: blank_to_null(F.trim(F.col(c))) if c in have else F.lit(None).cast("string")
    kind = F.coalesce(col("tipo"), F.when(col("reposteo_a").isNotNull(), "repost").when(col("en_respuesta_a").isNotNull(), "reply").when(col("cita_a").isNotNull(), "quote").otherwise("original"))
    text = F.coalesce(F.trim("texto"), F.lit("")) if "texto" in have else F.lit("")
    named = [col(c).alias(c) for c in ("autor_display", "fecha", "lang", "conversacion_id", "en_respuesta_a", "cita_a", "reposteo_a", "url")]
    kept = [F.col(c) for c in ("metricas", "media", "raw") if c in have]
    out = df.select(col("id").alias("post_id"), text.alias("texto"), F.regexp_replace(col("autor_handle"), "^@+", "").alias("autor_handle"), F.coalesce(col("plataforma"), F.lit(platform)).alias("plataforma"), kind.alias("tipo"), *named, *kept)
    return out.withColumn("es_repost_puro", F.when((F.col("tipo") == "repost") & (F.col("texto") == ""), 1).otherwise(0))


def documents_of_posts(posts: DataFrame) -> DataFrame:
    """Posts that are no pure reposts, as documents titled by handle and the first 60 characters."""
    title = F.concat(F.lit("@"), "autor_handle", F.lit(": "), F.substring("texto", 1, 60))
    return posts.where("es_repost_puro = 0").select(F.col("post_id").alias("codigo"), F.col("texto").alias("contenido"), title.alias("titulo"), "fecha")


def authors_of_posts(posts: DataFrame) -> DataFrame:
    """Accounts with their first display name that is not blank, by post id, and their number of posts."""
    return posts.groupBy("plataforma", "autor_handle").agg(F.min_by(blank_to_null(F.col("autor_display")), F.when(blank_to_null(F.col("autor_display")).isNotNull(), F.col("post_id"))).alias("autor_display"), F.count(F.lit(1)).alias("n_posts"))


def load_posts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """posts, documentos and autores of a file of posts."""
    raw = posts_csv(spark, path) if path.endswith(".csv") else posts_jsonl(spark, path)
    posts = unique(validate(normalize_posts(raw), "post"), "post_id")
    return {"posts": posts, "documentos": documents_of_posts(posts), "autores": authors_of_posts(posts)}


def resolve_aliases(columns: list[str], mapping: dict[str, str] | None = None) -> dict[str, str]:
    """Which of a file's columns carries which field: by the given mapping, else by the first alias."""
    low = {c.strip().lower(): c for c in columns}
    found = dict(mapping or {})
    for field, names in ALIASES.items():
        if field not in found and (name := next((low[n] for n in names if n in low), None)):
            found[field] = name
    if missing := [f for f in ("id", "texto", "autor_handle") if f not in found]:
        raise KeyError(f"no column for {', '.join(missing)} among {', '.join(columns)}")
    return found


def posts_mapped(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """A third-party table as normalised posts."""
    found = resolve_aliases(df.columns, mapping)
    return normalize_posts(df.select(*(F.col(f"`{c}`").cast("string").alias(f) for f, c in found.items())))


def posts_mixed(lines: DataFrame) -> DataFrame:
    """JSON lines (column value) of any known shape: a normalised post, a tweet of an API, or a page {data, includes}."""
    v = F.try_parse_json("value")
    rows = lines.where(F.trim("value") != "").select(v.alias("v"))
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    pages = rows.where(F.try_variant_get("v", "$.data", "variant").isNotNull())
    users = F.try_variant_get("v", "$.includes.users", "array<struct<id:string,username:string,name:string>>")
    tweets = F.try_variant_get("v", "$.data", "array<variant>")
    paged = pages.select(F.explode(tweets).alias("t"), users.alias("u")).select(F.col("t").alias("v"), "u")
    author = F.get(F.filter("u", lambda x: x["id"] == get("$.author_id")), F.lit(0))
    refs = F.try_variant_get("v", "$.referenced_tweets", "array<struct<type:string,id:string>>")
    ref = lambda kind: F.get(F.filter(refs, lambda x: x["type"] == kind), F.lit(0))["id"]

    def tweet(df: DataFrame, handle: Column, display: Column) -> DataFrame:
        return df.select(get("$.id").alias("id"), get("$.text").alias("texto"), handle.alias("autor_handle"), display.alias("autor_display"), get("$.created_at").alias("fecha"), get("$.lang").alias("lang"), get("$.conversation_id").alias("conversacion_id"), ref("replied_to").alias("en_respuesta_a"), ref("quoted").alias("cita_a"), ref("retweeted").alias("reposteo_a"))

    single = rows.where(F.try_variant_get("v", "$.data", "variant").isNull())
    normal = single.where(get("$.texto").isNotNull()).select(*(get(f"$.{c}").alias(c) for c in ("id", "texto", "autor_handle", "autor_display", "fecha", "lang", "conversacion_id", "en_respuesta_a", "cita_a", "reposteo_a")))
    alone = single.where(get("$.texto").isNull() & get("$.text").isNotNull())
    return normalize_posts(normal.unionByName(tweet(paged, author["username"], author["name"])).unionByName(tweet(alone, F.coalesce(get("$.username"), get("$.author_id")), get("$.name"))))


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> None:
    """An analysis table as CSV files with headers, one for each task (single: one in all, for tables that a person opens); lists and maps as JSON."""
    nested = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}
    out = df.withColumns(nested)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_csv_bom(df: DataFrame, path: str) -> None:
    """A table as CSV that spreadsheet programs read as UTF-8: the first header begins with a byte order mark."""
    write_csv(df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]), path, single=True)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON lines, in order over the files' names."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def append_files(df: DataFrame, path: str, key: str, order: str, kind: str = "json") -> int:
    """Appends the rows whose key no file of the folder has, each once; returns their number. CSV columns may grow: readers take the union of headers."""
    from discera.operators.state import append_dedup

    spark = df.sparkSession
    try:
        old = spark.read.json(path) if kind == "json" else read_csv(spark, path)
        seen = old.select(F.col(key).cast(dict(df.dtypes)[key]).alias(key)).distinct()
    except AnalysisException:  # no folder or no file yet
        seen = df.select(key).where("false")
    new = append_dedup(df.where("false"), df, key, order).join(seen, key, "left_anti").select(df.columns).persist()
    n = new.count()
    if n:
        (new.write.mode("append").json(path) if kind == "json" else new.write.mode("append").option("header", True).option("escape", '"').csv(path))
    new.unpersist()
    return n


def export_run(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Writes every table, and returns the number of rows of each."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
    return {name: df.count() for name, df in tables.items()}


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as the lines of a GEXF file, with the columns part and line: head, nodes, edges, tail. Sort by both to read it in order."""
    text = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")], "parte int, linea string")
    n = nodes.select(F.lit(1).alias("parte"), F.concat(F.lit('<node id="'), text("nodo"), F.lit('"/>')).alias("linea"))
    e = edges.select(F.lit(3).alias("parte"), F.concat(F.lit('<edge source="'), text("origen"), F.lit('" target="'), text("destino"), F.lit('" weight="'), F.col("peso"), F.lit('"/>')).alias("linea"))
    return frame.union(n).union(e)

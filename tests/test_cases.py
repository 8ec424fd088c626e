"""Small cases of operators whose semantics SQL on the driver's tables does not show."""

import json

import pytest
from pyspark.sql import functions as F

from discera.functions import segment, spans
from discera.functions import text as fx
from discera.operators import aggregates as ag
from discera.operators import evaluate as ev
from discera.operators import filters as fl
from discera.operators import graph as gr
from discera.operators import infer as nf
from discera.operators import resolve as rs
from discera.operators import rules as ru
from discera.operators import state as st
from discera.operators import windows as wd
from discera.sources import html as ht
from discera.sources import readers as rd
from discera.sources.connector import MemoryPlatform, PostSource, pages
from discera.streaming import streams


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_threads(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "x"), ("e", "d"), ("p", "q"), ("q", "p")]
    got = gr.resolve_threads(spark.createDataFrame(rows, "post_id string, en_respuesta_a string"))
    assert sorted(map(tuple, got.collect())) == [("a", "a", 0, 0), ("b", "a", 1, 0), ("c", "a", 2, 0), ("d", "x", None, 1), ("e", "x", None, 1), ("p", "p", None, 1), ("q", "q", None, 1)]


def test_long_threads(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(200)]
    got = {r.post_id: (r.conversacion, r.profundidad) for r in gr.resolve_threads(spark.createDataFrame(chain, "post_id string, en_respuesta_a string")).collect()}
    assert got == {str(i): ("0", i) for i in range(200)}


def test_tree_order(spark):
    rows = [("a", None, "c", 0), ("b", "a", "c", 2), ("d", "a", "c", 1), ("e", "b", "c", 5), ("f", "d", "c", 9)]
    df = spark.createDataFrame(rows, "post_id string, en_respuesta_a string, conversacion_id string, fecha int")
    assert [r.post_id for r in wd.tree_order(df, "fecha").orderBy("orden").collect()] == ["a", "d", "f", "b", "e"]


def test_folding_is_unicode_folding(spark):
    for t in ("ÁÉÍÓÚ Ü Ñ ç", "Crème brûlée", "àâãåäìîïòõöùûý", "abc_1"):
        assert one(spark, fx.fold(F.lit(t)).alias("v")).v == fx.fold_value(t)


def test_slugs(spark):
    got = one(spark, fx.canonical_slug(F.lit("el presidente de la nación argentina")).alias("a"), fx.slug(F.lit("¡Hola, Mundo!")).alias("b"), fx.canonical_slug(F.lit(None).cast("string")).alias("c"))
    assert tuple(got) == ("presidente_nacion_argentina", "hola_mundo", "")


def test_spans():
    kinds = lambda t: [(s[0], s[1], s[2], s[5]) for s in spans.find_spans(t)]
    assert kinds("FMI") == []
    assert kinds("BASTA FMI") == [("tecnografismo", "BASTA FMI", "basta fmi", "mayusculas:expresion")]
    assert kinds("GOOOOL") == [("tecnografismo", "GOOOOL", "gol", "alargamiento")]
    assert kinds("jajaja no") == [("tecnografismo", "jajaja", "risa", "risa")]
    assert kinds("qué?! ...") == [("tecnografismo", "?!", "interrogacion_exclamacion", "puntuacion"), ("tecnografismo", "...", "suspensivos", "puntuacion")]
    assert kinds("clarin.com/nota...") == [("url", "clarin.com/nota", "clarin.com", "")]
    assert kinds("@ana hola #Paz dijo #Fin") == [("mencion", "@ana", "ana", "vocativo_inicial"), ("hashtag", "#Paz", "paz", "integrada"), ("hashtag", "#Fin", "fin", "pospuesta")]
    assert spans.find_spans(None) == []
    for text in ("@a #b http://c.d/e?f#g JAJAJA siiii!!! 😀😀", "X" * 500):
        for _, value, _, a, b, _ in spans.find_spans(text):
            assert text[a:b] == value


def test_sentences():
    assert segment.split_sentences("El Sr. Pérez llegó tarde a la reunión. Nadie dijo nada al respecto! Fin.") == ["El Sr. Pérez llegó tarde a la reunión.", "Nadie dijo nada al respecto! Fin."]
    long = "; ".join(["una parte de la oración que es larga"] * 15)
    assert max(map(len, segment.split_sentences(long))) <= 400
    assert segment.split_sentences("") == [] and segment.split_sentences("Sí.") == ["Sí."]


def test_paragraphs(spark):
    got = one(spark, segment.paragraphs(F.lit("x")).alias("a"), segment.paragraphs(F.lit("a" * 40 + "\n\nbb")).alias("b"), segment.paragraphs(F.lit("")).alias("c"))
    assert tuple(got) == (["x"], ["a" * 40], [])


def test_rolling_context_counts_non_empty_units(spark):
    rows = [("d", i, None if i == 1 else f"e{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc string, idx int, v string")
    got = {r.idx: r.contexto for r in wd.previous(df, "doc", "idx", "v", last=5).collect()}
    assert got[0] == wd.EMPTY and got[1] == "e0" and got[6] == "e0\ne2\ne3\ne4\ne5" and got[7] == "e2\ne3\ne4\ne5\ne6"


def test_runs_break_at_gaps(spark):
    rows = [("u", 0, "😀", 1), ("u", 1, "😀", 2), ("u", 3, "😀", 4)]
    df = spark.createDataFrame(rows, "u string, a int, v string, b int")
    from pyspark.sql import Window as W

    near = F.col("a") - F.lag("b").over(W.partitionBy("u").orderBy("a")) <= 0
    got = wd.run_attributes(wd.runs(df, ["u"], "a", "v", near), ["u"], "a")
    assert [(r.n, r.intensidad) for r in got.orderBy("a").collect()] == [(2, "intensificado"), (2, "intensificado"), (1, "simple")]


def test_pack(spark):
    got = one(spark, wd.pack(F.array(*map(F.lit, ("aa", "bb", "c" * 9, "d"))), 6).alias("v")).v
    assert got == ["aa\nbb", "c" * 9, "d"]


def test_modes_and_percentiles(spark):
    rows = [("p", "disforico"), ("p", "euforico"), ("q", "aforico"), ("q", "aforico"), ("q", "euforico"), ("r", "??")]
    assert {r.post_id: r.foria for r in ag.foria_by_post(spark.createDataFrame(rows, "post_id string, foria string")).collect()} == {"p": "euforico", "q": "aforico", "r": "indeterminado"}
    v = spark.createDataFrame([("a", x) for x in (4.0, 1.0, 3.0, 2.0)] + [("b", 7.0), ("c", None)], "g string, v double")
    assert {r.g: (r.p50, r.p99) for r in ag.percentiles(v, ["g"], "v").collect()} == {"a": (3.0, 4.0), "b": (7.0, 7.0), "c": (None, None)}


def test_hashtag_rollup(spark):
    rows = [("x", 0, "A"), ("x", 1, "A"), ("x", 2, "B"), ("x", 3, "B"), ("y", 0, "A"), ("y", 1, "B"), ("y", 2, "C")]
    assert {r.tag: r.funcion for r in ag.hashtag_rollup(spark.createDataFrame(rows, "tag string, orden int, funcion string")).collect()} == {"x": "A", "y": "mixto"}


def test_bins(spark):
    df = spark.createDataFrame([("d", i, "a" if i < 9 else "z") for i in range(10)] + [("s", 3, "a")], "doc string, p int, v string")
    got = [(r.doc, r.bin, r.valor) for r in ag.bins(df, "doc", "p", "v", 10).collect()]
    assert len(got) == 20 and ("d", 9, "neutro") in got and all(v != "z" for _, _, v in got)
    assert {v for d, _, v in got if d == "s"} == {"neutro"}


def test_lift(spark):
    pairs = spark.createDataFrame([(f"p{i}", f"h{i}") for i in range(10)], "padre string, hijo string")
    types = [(f"p{i}", "t") for i in range(5)] + [(f"h{i}", "t") for i in (0, 1, 2, 3, 7)] + [(f"p{i}", "u") for i in range(4)]
    got = ag.lift(pairs, spark.createDataFrame(types, "post_id string, tipo string")).collect()
    assert [(r.tipo_emocion, r.p_condicional, r.p_base, r.lift) for r in got] == [("t", 0.8, 0.5, 1.6)]


def test_filters(spark):
    df = spark.createDataFrame([("x",), ("X",), (None,)], "v string")
    assert [r.v for r in fl.apply_selection(df, [{"field": "v", "op": "ne", "value": "x"}]).collect()] == [None]
    with pytest.raises(KeyError):
        fl.apply_selection(df, [{"field": "w", "op": "eq", "value": 1}])
    with pytest.raises(ValueError):
        fl.apply_selection(df, [{"field": "v", "op": "eq", "value": "z"}], must_match=True)
    j = spark.createDataFrame([(json.dumps({"v": v}),) for v in ("x", "X", None)] + [("{bad",), (None,)], "p string")
    assert j.where(fl.json_condition(F.col("p"), "v", "ne", "x")).count() == 1
    assert j.where(fl.json_condition(F.col("p"), "v", "in", [])).count() == 0
    assert fl.variants("el (gran) presidente") == ["el gran presidente", "el presidente"]
    assert df.where(fl.text_query(F.lit("Él dijo: el gran Presidente"), '"el (gran) presidente" dijo')).count() == 3


def test_alpha(spark):
    nan = None
    coders = [[1, 2, 3, 3, 2, 1, 4, 1, 2, nan, nan, nan], [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, nan, 3], [nan, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, nan], [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, nan]]
    rows = [(u, str(c), v) for c, line in enumerate(coders) for u, v in enumerate(line)]
    df = spark.createDataFrame(rows, "unit int, coder string, value int")
    for metric, want in (("nominal", 0.743), ("interval", 0.849), ("ordinal", 0.815)):
        assert ev.alpha(df, metric).first().alpha == pytest.approx(want, abs=6e-4)
    assert ev.alpha(df.where("unit = 0")).first().alpha is None


def test_match(spark):
    schema = "unidad string, idx int, tipo string, experienciador string, fuente string"
    g = spark.createDataFrame([("u", 0, "a", "Ana", None), ("v", 0, "ira", "el pueblo", "la ley"), ("v", 1, "ira", "Juan", None)], schema)
    p = spark.createDataFrame([("u", 0, "b", "Luis", None), ("v", 0, "ira", "Juan", None), ("v", 1, "miedo", "pueblo unido", "ley"), ("w", 0, "x", "y", None)], schema)
    got = {r.unidad: tuple(r)[1:] for r in ev.match(g, p).collect()}
    assert got == {"u": (0, 1, 1, 0, 0, 0, 0), "v": (2, 0, 0, 1, 2, 1, 1)}
    assert ev.report(ev.match(g, p)).first().f1 == pytest.approx(2 / 3)


def test_sample_is_balanced_and_stable(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).alias("doc"), (F.col("id") % 3 == 0).alias("pos"))
    a = ev.sample(df, "id", "doc", F.col("pos"), 40, 7, 3)
    assert a.count() == 40 and a.where("pos").count() == 20 and a.groupBy("doc", "pos").count().agg(F.max("count")).first()[0] <= 3
    assert sorted(a.collect()) == sorted(ev.sample(df.repartition(7), "id", "doc", F.col("pos"), 40, 7, 3).collect())


def test_coreference(spark):
    rows = [(0, "d", "Javier Milei"), (1, "d", "javier milei"), (2, "d", "presidente Javier Milei"), (3, "d", "Milei"), (4, "e", "Javier Milei"), (5, "d", "víctimas del holocausto"), (6, "d", "víctimas del atentado")]
    got = {r.id: r.grupo for r in rs.coreference(spark.createDataFrame(rows, "id long, doc string, actor string"), "doc", "id", "actor").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_mentions_merge(spark):
    rows = [("d", 0, 0, "Ana", "actor", "no identificado"), ("d", 0, 1, "ana", "fuente", "Ana Paz"), ("d", 0, 2, "Luis y Marta", "actor", "Luis Gil y Marta Sol"), ("d", 0, 3, "paz y amor", "fuente", "una consigna")]
    got = {r.clave: (r.marca, r.inferencia, r.funciones) for r in rs.mentions(spark.createDataFrame(rows, "codigo string, unit_idx int, orden int, marca string, funcion string, inferencia string")).collect()}
    assert got == {"ana": ("Ana", "Ana Paz", "actor,fuente"), "luis": ("Luis", "Luis Gil", "actor"), "marta": ("Marta", "Marta Sol", "actor"), "paz y amor": ("paz y amor", "una consigna", "fuente")}


def test_graph_algorithms(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")]
    g = spark.createDataFrame([("g", x, y, 1.0) for x, y in edges], "grafo string, origen string, destino string, peso double")
    assert {r.nodo: r.comunidad for r in gr.communities(g).collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1}
    assert [r.nodos for r in gr.cliques(g).orderBy("orden").collect()] == ["a,b,c", "d,e,f"]
    between = {r.nodo: r.intermediacion for r in gr.betweenness(g).collect()}
    assert between["c"] == pytest.approx(6 / 20) and between["a"] == 0 and between["d"] == pytest.approx(7 / 20, abs=0.1)
    assert {r.intermediacion for r in gr.betweenness(g, most=3).collect()} == {None}
    ranks = {r.nodo: r.pagerank for r in gr.pagerank(g).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["d"] > ranks["a"]
    labels = {r.nodo: r.comunidad for r in gr.label_communities(g).collect()}
    assert len(set(labels.values())) <= 3 and labels["a"] == labels["b"]
    assert gr.topological({"d": ["b", "c"], "a": [], "b": ["a"], "c": ["a"]}) == ["a", "b", "c", "d"]
    assert gr.closure({"a": [], "b": ["a"], "c": ["a"]}, ["c"]) == ["a", "c"]
    with pytest.raises(ValueError):
        gr.topological({"a": ["b"], "b": ["a"]})


def test_similarity(spark):
    rows = [(1, ["x"], ["e"], []), (2, ["x"], ["d"], []), (3, ["y"], ["q"], ["m"])]
    got = gr.similarity_pairs(spark.createDataFrame(rows, "k int, tipo array<string>, foria array<string>, mediador array<string>"), "k", {"tipo": 1.0, "foria": 1.0, "mediador": 1.0})
    assert [tuple(r) for r in got.collect()] == [(1, 2, 0.5, "tipo")]


def test_state(spark):
    old = spark.createDataFrame([(1, "proposed", "a"), (2, "accepted", "b"), (3, "rejected", None)], "id int, status string, x string")
    new = spark.createDataFrame([(1, "accepted", None), (2, "proposed", "n"), (3, "accepted", "z"), (4, "proposed", "q")], "id int, status string, x string")
    assert sorted(map(tuple, st.upsert_status(old, new, ["id"]).collect())) == [(1, "accepted", "a"), (2, "accepted", "b"), (3, "rejected", None), (4, "proposed", "q")]
    assert sorted(map(tuple, st.upsert_coalesce(old, new, ["id"]).collect())) == [(1, "accepted", "a"), (2, "proposed", "n"), (3, "accepted", "z"), (4, "proposed", "q")]
    assert sorted(r.id for r in st.insert_ignore(old, new, ["id"]).collect()) == [1, 2, 3, 4]


def test_contracts(spark):
    good = spark.createDataFrame([("d", 0, 0, "e", "t", "m", "i", "real", None)], "codigo string, frase_idx int, emocion_idx int, experienciador string, tipo_emocion string, fuente_marca string, fuente_inferencia string, modo_existencia string, extra string")
    assert ru.validate(good, "evento") is good
    with pytest.raises(ValueError):
        ru.validate(good.withColumn("frase_idx", F.lit(-1)), "evento")
    with pytest.raises(ValueError):
        ru.validate(good.withColumn("tipo_emocion", F.lit(None).cast("string")), "evento")
    with pytest.raises(KeyError):
        ru.validate(good.drop("codigo"), "evento")


def test_readers(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"x1": {"contenido": "uno", "medio": "m"}, "x2": {"contenido": "dos"}}), encoding="utf-8")
    assert {(r.codigo, r.contenido, r.medio) for r in rd.load_documents(spark, str(tmp_path / "d.json")).collect()} == {("x1", "uno", "m"), ("x2", "dos", None)}
    (tmp_path / "d.csv").write_text('codigo,contenido\na,"dos\nlíneas, ""citadas"""\na,otra\n', encoding="utf-8")
    with pytest.raises(ValueError):
        rd.load_documents(spark, str(tmp_path / "d.csv"))
    lines = [{"id": "1", "texto": " hola ", "autor_handle": "@@ana", "metricas": {"likes": 3}}, {"id": "2", "texto": "", "autor_handle": "b", "reposteo_a": "1"}, {"id": "3", "texto": "sí", "autor_handle": "b", "en_respuesta_a": "1"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n", encoding="utf-8")
    bundle = rd.load_posts(spark, str(tmp_path / "p.jsonl"))
    assert {(r.post_id, r.texto, r.autor_handle, r.tipo, r.es_repost_puro) for r in bundle["posts"].collect()} == {("1", "hola", "ana", "original", 0), ("2", "", "b", "repost", 1), ("3", "sí", "b", "reply", 0)}
    assert sorted(r.titulo for r in bundle["documentos"].collect()) == ["@ana: hola", "@b: sí"]
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "texto": "x"\n', encoding="utf-8")
    with pytest.raises(Exception):
        rd.posts_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    out = rd.export_run({"posts": bundle["posts"]}, str(tmp_path / "out"))
    assert out == {"posts": 3} and spark.read.option("header", True).csv(str(tmp_path / "out/posts")).count() == 3
    with pytest.raises(KeyError):
        rd.resolve_aliases(["id", "texto"])


def test_html_and_feeds(spark):
    page = '<html lang="es"><head><title> T </title><meta property="og:title" content="O"><meta content="D" name="description"><link rel="canonical" href="https://a.b/c"><script type="application/ld+json">{"author": {"name": "N"}}</script><script>var x = "<p>";</script></head><body><p>Uno &amp; dos<br>tres</p><p>cuatro</p></body></html>'
    assert ht.text_of(page).split("\n")[-3:] == ["Uno & dos", "tres", "cuatro"]
    c = F.lit(page)
    got = one(spark, ht.title(c).alias("a"), ht.meta(c, "og:title").alias("b"), ht.meta(c, "description").alias("c"), ht.canonical(c).alias("d"), ht.json_ld(c, "$.author.name").alias("e"))
    assert tuple(got) == ("T", "O", "D", "https://a.b/c", "N")
    rss = "<rss><item><link>https://a/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item></rss>"
    atom = '<feed><entry><link rel="alternate" href="https://a/2"/><updated>2024-03-06T00:00:00Z</updated></entry></feed>'
    feeds = ht.feed(spark.createDataFrame([(rss,), (atom,)], "value string"))
    assert sorted((r.url, str(r.fecha)) for r in feeds.collect()) == [("https://a/1", "2024-03-05"), ("https://a/2", "2024-03-06")]


def test_connector(spark):
    posts = [{"id": str(i), "texto": "hola" if i % 2 else "chau", "autor_handle": "a", "fecha": None} for i in range(9)]
    assert [p["id"] for p in pages(MemoryPlatform(posts), "hola", 3)] == ["1", "3", "5"]
    PostSource.platform = MemoryPlatform(posts)
    spark.dataSource.register(PostSource)
    df = spark.read.format("discera_posts").option("query", "hola|chau").load()
    assert df.count() == 9 and df.where("texto = 'hola'").count() == 4


def test_inference(spark):
    class Flaky:
        def generate(self, prompts):
            if any("mal" in p for p in prompts):
                raise RuntimeError("no")
            return ["{}"] * len(prompts)

    df = spark.createDataFrame([(i, "mal" if i == 5 else f"p{i}") for i in range(12)], "id int, p string")
    got = {r.id: (r.payload, r.error) for r in nf.infer(df, F.col("p"), Flaky, batch=8).collect()}
    assert got[5] == (None, "no") and all(v == ("{}", None) for k, v in got.items() if k != 5)


def test_streams(spark, tmp_path):
    rows = [(f"k{i % 4}", i // 3, f"2024-01-01 00:0{i // 2}:00") for i in range(12)]
    df = spark.createDataFrame(rows, "k string, v int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):
        df.where(f"v % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: streams.read(spark, str(tmp_path / "in"), df.schema)
    streams.write(streams.dedup(stream(), "k", "ts"), str(tmp_path / "d"), str(tmp_path / "cd"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "d")).collect()) == ["k0", "k1", "k2", "k3"]
    streams.write_upserts(stream().select("k", "v"), str(tmp_path / "u"), str(tmp_path / "cu"), ["k"])
    assert spark.read.parquet(str(tmp_path / "u/v=1")).count() == 4
    runs = streams.run_lengths(stream().select("k", F.col("v"), F.lit("x").alias("tipo")), "k", "v", "tipo")
    q = runs.writeStream.format("memory").queryName("runs").outputMode("update").option("checkpointLocation", str(tmp_path / "cr")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT k, max(n) AS n FROM runs GROUP BY k").agg(F.sum("n")).first()[0] == 12
    for make in (lambda s: streams.sliding(s, "ts", "2 minutes", "1 minute", "k"), lambda s: streams.sessions(s, "ts", "90 seconds", "k")):
        name = f"w{id(make)}"
        make(stream()).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

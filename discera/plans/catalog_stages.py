"""Queries: stages around a model (with stubs that answer by the prompt's hash), and payloads made flat."""

from __future__ import annotations

from pyspark.sql import functions as F

from discera.functions import text as fx
from discera.operators import infer as nf
from discera.operators import stages as sg
from discera.operators import state as st
from discera.plans.registry import query
from discera.plans.views import EVENTS, POSTS


def label_sql(prompt: str) -> str:
    """What the stub answers: its four labels by the prompt's hash, whose last digit decides."""
    return f"(['alegria', 'ira', 'miedo', 'calma'])[(('0x' || right(sha256({prompt}), 1))::INT % 4) + 1]"


_SHOWN = {c: f"{c} {i}" for i, c in enumerate(sorted({c for a in sg.AGENTS.values() for c in a.shows}))}


def _prompt_sql(agent: sg.Agent) -> str:
    return f"'{agent.name}'" + "".join(f" || chr(10) || '{c}: {_SHOWN[c]} ' || lang || doc_id" for c in agent.shows)


@query(" UNION ALL ".join(f"SELECT doc_id, '{a.name}' AS agente, '{a.level}' AS nivel, {label_sql(_prompt_sql(a))} AS valor, '{','.join(a.fields)}' AS campos FROM documents" for a in sg.AGENTS.values()))
def stage_agents(t):
    """All agents over the documents."""
    out = None
    docs = t.documents.select("doc_id", *(F.concat(F.lit(f"{v} "), "lang", "doc_id").alias(c) for c, v in _SHOWN.items()))
    for a in sg.AGENTS.values():
        got = sg.run_agent(docs.select("doc_id", *a.shows), a, lambda a=a: nf.StubBackend(fields=a.fields))
        rows = got.where("error is null").select("doc_id", F.lit(a.name).alias("agente"), F.lit(a.level).alias("nivel"), F.col(a.fields[-1]).alias("valor"), F.lit(",".join(a.fields)).alias("campos"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"""WITH {EVENTS}, w AS (SELECT codigo, frase_idx, tipo_emocion || ' ' || k AS frase, list(foria) FILTER (k % 3 > 0) OVER (PARTITION BY codigo ORDER BY frase_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev),
c AS (SELECT codigo, frase_idx, frase, CASE WHEN coalesce(len(prev), 0) = 0 THEN '(sin contexto)' ELSE array_to_string(prev[-3:], chr(10)) END AS contexto FROM w)
SELECT codigo, frase_idx, {label_sql("contexto || chr(10) || frase")} AS tipo FROM c""")
def stage_emotions_pass2(t):
    units = t.events_view().select("codigo", "frase_idx", F.concat_ws(" ", "tipo_emocion", "k").alias("frase"), F.when(F.col("k") % 3 > 0, F.col("foria")).alias("primera"))
    return sg.second_pass(units, "codigo", "frase_idx", "frase", "primera", nf.StubBackend).select("codigo", "frase_idx", F.get_json_object("payload", "$.tipo_emocion").alias("tipo"))


@query(f"WITH {POSTS} SELECT post_id, {label_sql('texto')} AS tipo FROM posts WHERE texto IS NOT NULL")
def infer_aligned(t):
    """Batches whose items come back in another order and counted from 1, each with its unit's first word."""
    posts = t.posts().where("texto is not null")
    got = nf.infer_batches(posts.select("post_id", "texto"), F.col("texto"), F.get(F.split("texto", " "), F.lit(0)), lambda: nf.StubBatches(base=1))
    return got.where("error is null").select("post_id", F.get_json_object("payload", "$.tipo_emocion").alias("tipo"))


_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH p AS (SELECT conv_id, turn, {_TRIM} AS t FROM conversations),
h AS (SELECT conv_id, CASE WHEN t <> '' THEN CASE WHEN ceil(length(t) / 3) <= 20 THEN t ELSE rtrim(regexp_replace(t[1:60], '\\s+\\S*$', '')) || '…' END END AS hilo FROM p WHERE turn = 0)
SELECT conv_id::VARCHAR AS codigo, turn AS unit_idx, hilo, CASE WHEN t <> '' THEN CASE WHEN ceil(length(t) / 3) <= 10 THEN t ELSE '…' || ltrim(regexp_replace(right(t, 30), '^\\S*\\s+', '')) END END AS reciente FROM p LEFT JOIN h USING (conv_id)""")
def stage_context_blocks(t):
    p = t.posts().select(F.col("conversacion_id").alias("codigo"), F.col("turn").alias("unit_idx"), "texto")
    head, recent = sg.Block("hilo", ("emotions",), 20), sg.Block("reciente", ("emotions", "judge"), 10, "unidad", keep_tail=True)
    other = sg.Block("otro", ("judge",), 5)
    blocks = [(head, p.where("unit_idx = 0").select("codigo", "texto")), (recent, p), (other, p)]
    return sg.with_blocks(p.select("codigo", "unit_idx"), "emotions", blocks).select("codigo", "unit_idx", "hilo", "reciente")


@query(f"""WITH {EVENTS}, s AS (SELECT codigo, frase_idx // 20 AS unidad, event_id AS id, tipo_emocion AS f, row_number() OVER (PARTITION BY codigo, frase_idx // 20, tipo_emocion ORDER BY k % 2 = 0, frase_idx) AS r FROM ev),
a AS (SELECT codigo, frase_idx // 20 AS unidad, frase_idx AS orden, tipo_emocion AS f, row_number() OVER (PARTITION BY codigo, frase_idx // 20, tipo_emocion ORDER BY frase_idx) AS r FROM ev WHERE k % 3 > 0)
SELECT codigo, unidad, orden, id FROM a JOIN s USING (codigo, unidad, f, r)""")
def stage_tecno_usage(t):
    """Answers in lower case, and spans of which half are in capitals."""
    e = t.events_view().withColumn("unidad", F.expr("frase_idx div 20"))
    spans = e.select("codigo", "unidad", F.col("event_id").alias("id"), F.col("frase_idx").alias("inicio"), F.when(F.col("k") % 2 == 0, F.upper("tipo_emocion")).otherwise(F.col("tipo_emocion")).alias("valor"))
    return sg.match_spans(e.where("k % 3 > 0").select("codigo", "unidad", F.col("frase_idx").alias("orden"), F.col("tipo_emocion").alias("valor")), spans, ["codigo", "unidad"])


_SEMAS = {"red": "RED", "blue": "Blue", "ring": "ríng", "small": "small"}


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEMAS.items()) + " END), lambda x: x IS NOT NULL), ',') AS semas FROM part")
def stage_semas(t):
    return sg.closed_vocabulary(t.part.select("p_partkey", F.split("p_name", " ").alias("v")), "v", list(_SEMAS.values()), "s").select("p_partkey", F.array_join("s", ",").alias("semas"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 2) THEN 'referencia_gramatical' END AS modalidad FROM events")
def fn_modality_lexical(t):
    mark = F.element_at(F.array(*map(F.lit, ("Nosotros (el gobierno)", "el presidente", "'Tú / usted'", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", fx.lexical_modality(mark).alias("modalidad"))


def _payloads(t):
    conf = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"conf":{"a":'), F.col("event_id") % 3, F.lit(',"b":[1,2]}'))).otherwise("")
    return t.events.select("event_id", F.concat(F.lit('{"tipo":"'), "event_type", F.lit('","n":'), F.col("event_id") % 5, F.lit(',"nada":null'), conf, F.lit("}")).alias("payload"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a":' || event_id % 3 || ',"b":[1,2]}' END AS p__conf, (event_id % 5)::VARCHAR AS p__n, '' AS p__nada, event_type AS p__tipo FROM events""")
def fn_json_flatten1(t):
    return st.flatten_keys(_payloads(t), "payload", "p")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 3)::VARCHAR END AS p__conf__a, CASE WHEN event_id % 2 = 0 THEN '[1,2]' END AS p__conf__b, (event_id % 5)::VARCHAR AS p__n, '' AS p__nada, event_type AS p__tipo FROM events""")
def fn_json_flatten2(t):
    return st.flatten_keys(_payloads(t), "payload", "p", levels=2)

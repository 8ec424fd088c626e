"""Graphs: edge builders, merged weights, degrees, PageRank, components, threads, communities, cliques, similarity."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discera.operators.joins import split_join
from discera.plans.storage import saved


def ref_edges(posts: DataFrame, ref: str = "en_respuesta_a") -> DataFrame:
    """Author to author of the post referred to, if that is captured; self-loops stay."""
    target = posts.select(F.col("post_id").alias(ref), F.col("autor_handle").alias("destino"))
    return posts.where(F.col(ref).isNotNull()).select(F.col("autor_handle").alias("origen"), ref).join(target, ref).select("origen", "destino", F.lit(1.0).alias("peso"))


def mention_edges(posts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Author to the lowered handle mentioned; mentions of oneself are dropped. mentions: post_id, handle."""
    e = posts.select("post_id", F.col("autor_handle").alias("origen")).join(mentions, "post_id").select("origen", F.lower("handle").alias("destino"))
    return e.where(F.lower("origen") != F.col("destino")).withColumn("peso", F.lit(1.0))


def co_edges(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """Undirected co-occurrence a < b of a group's distinct labels."""
    from discera.functions.text import sorted_pairs

    sets = df.groupBy(*group).agg(F.collect_set(label).alias("s"))
    return sets.select(F.explode(sorted_pairs(F.col("s"))).alias("p")).select(F.col("p.a").alias("origen"), F.col("p.b").alias("destino"), F.lit(1.0).alias("peso"))


def build(edges: DataFrame) -> DataFrame:
    """Parallel edges merged, weights summed."""
    return edges.groupBy("origen", "destino").agg(F.sum("peso").alias("peso"))


def degrees(graph: DataFrame) -> DataFrame:
    """Distinct neighbours of merged edges by direction; a self-loop counts once in and once out."""
    ends = graph.select(F.explode(F.array(F.struct(F.col("origen").alias("nodo"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("destino").alias("nodo"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    d = ends.groupBy("x.nodo").agg(F.sum("x.i").alias("grado_entrada"), F.sum("x.o").alias("grado_salida"))
    return d.select("nodo", "grado_entrada", "grado_salida", (F.col("grado_entrada") + F.col("grado_salida")).alias("grado"))


def mutual(graph: DataFrame) -> DataFrame:
    """Edges whose reverse exists; weights are those of their own direction."""
    back = graph.select(F.col("destino").alias("origen"), F.col("origen").alias("destino"))
    return graph.where("origen <> destino").join(back, ["origen", "destino"], "left_semi")


def pagerank(graph: DataFrame, rounds: int = 30, damping: float = 0.85, cut: int = 5) -> DataFrame:
    """Weighted PageRank; the mass of nodes without out-edges is spread evenly."""
    graph = saved(graph)
    out = graph.groupBy("origen").agg(F.sum("peso").alias("t"))
    flow = saved(split_join(graph, out, ["origen"]).select("origen", "destino", (F.col("peso") / F.col("t")).alias("p")))
    nodes = saved(graph.select(F.col("origen").alias("nodo")).union(graph.select("destino")).distinct().join(out.select(F.col("origen").alias("nodo"), F.lit(True).alias("sale")), "nodo", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("nodo", F.lit(0.0).alias("pagerank"))
    ranks = nodes.select("nodo", F.lit(1.0 / n).alias("r"))
    for i in range(rounds):
        sinks = nodes.where("sale is null").join(ranks, "nodo").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("d"))
        moved = flow.join(ranks, flow["origen"] == ranks["nodo"]).groupBy("destino").agg(F.sum(F.col("p") * F.col("r")).alias("m"))
        ranks = nodes.select("nodo").join(moved, F.col("nodo") == F.col("destino"), "left").crossJoin(F.broadcast(sinks)).select("nodo", (F.lit((1 - damping) / n) + damping * (F.coalesce("m", F.lit(0.0)) + F.col("d") / n)).alias("r"))  # sinks is one row
        if i % cut == cut - 1:
            ranks = saved(ranks)
    return ranks.select("nodo", F.col("r").alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """nodo, componente: the smallest node reachable, by alternating large and small stars; edges: a, b."""
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or before == (now["n"], now["h"]):
            return e.select(F.col("u").alias("nodo"), F.col("v").alias("componente")).union(e.select("v", "v").distinct())
        before = (now["n"], now["h"])
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = saved(split_join(large, least, ["u"]).select(star.alias("x")).select("x.u", "x.v").where("u <> v").distinct())


def resolve_threads(posts: DataFrame, path: str | None = None, hops: int = 512) -> DataFrame:
    """Each post's conversation (root post), depth and whether it is an orphan, by pointer doubling.

    An ancestor that is not captured makes the post an orphan of that ancestor's conversation;
    on a cycle, or beyond so many hops, it is an orphan of its own. Depth is null for orphans.
    With path (a column of text segments) the segments from the root on, joined by '/', are carried too.
    """
    seg = F.col(path) if path else F.lit("")
    s = posts.select("post_id", F.coalesce("en_respuesta_a", "post_id").alias("anc"), F.when(F.col("en_respuesta_a").isNull(), 0).otherwise(1).alias("d"), seg.alias("path"))
    s = saved(s)
    known = s.select(F.col("post_id").alias("anc"), F.col("anc").alias("anc2"), F.col("d").alias("d2"), F.col("path").alias("p2"))
    step = 1
    while step < hops:
        more = known.where("d2 > 0")
        open_ = s.join(more.select("anc", "anc2", "d2", "p2"), "anc", "left")
        s = saved(open_.select("post_id", F.coalesce("anc2", "anc").alias("anc"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.when(F.col("p2").isNull() | F.lit(not path), F.col("path")).otherwise(F.concat_ws("/", "p2", "path")).alias("path")))
        known = s.select(F.col("post_id").alias("anc"), F.col("anc").alias("anc2"), F.col("d").alias("d2"), F.col("path").alias("p2"))
        step *= 2
        if s.join(known.where("d2 > 0").select("anc"), "anc", "left_semi").isEmpty():
            break
    end = posts.select(F.col("post_id").alias("anc"), F.col("en_respuesta_a").isNull().alias("raiz"), seg.alias("p0"))
    t = s.join(end, "anc", "left")
    whole = F.when(F.col("d") > 0, F.concat_ws("/", "p0", "path")).otherwise(F.col("path"))
    return t.select(
        "post_id",
        F.when(F.col("raiz").isNull() | F.col("raiz"), F.col("anc")).otherwise(F.col("post_id")).alias("conversacion"),
        F.when(F.coalesce("raiz", F.lit(False)), F.col("d")).cast("long").alias("profundidad"),
        F.when(F.coalesce("raiz", F.lit(False)), 0).otherwise(1).alias("huerfano"),
        *([whole.alias("path")] if path else []),
    )


def ancestors(posts: DataFrame, k: int, text: Column) -> DataFrame:
    """The texts of up to k nearest ancestors, the farthest first, one per line."""
    p = posts.select("post_id", "en_respuesta_a", text.alias("t"))
    up = p.select("post_id", F.col("en_respuesta_a").alias("ref"))
    parts = None
    for level in range(1, k + 1):
        met = up.join(p.select(F.col("post_id").alias("ref"), F.col("en_respuesta_a").alias("next"), "t"), "ref")
        level_rows = met.select("post_id", F.lit(-level).alias("nivel"), "t")
        parts = level_rows if parts is None else parts.union(level_rows)
        up = met.select("post_id", F.col("next").alias("ref")).where("ref is not null")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("nivel", "t"))), lambda x: x["t"])
    return posts.select("post_id").join(parts.groupBy("post_id").agg(F.array_join(rows, "\n").alias("contexto")), "post_id", "left")


def participants(posts: DataFrame, mentions: DataFrame, shown: DataFrame, n: int) -> DataFrame:
    """For each post, up to n posts of its conversation by accounts it mentions, without itself and those already shown (post_id, mostrado)."""
    me = mentions.join(posts.select("post_id", "conversacion_id"), "post_id").select("post_id", "conversacion_id", F.lower("handle").alias("autor"))
    other = posts.select("conversacion_id", F.lower("autor_handle").alias("autor"), F.col("post_id").alias("mostrado"))
    pairs = me.join(other, ["conversacion_id", "autor"]).where("post_id <> mostrado").select("post_id", "mostrado").distinct().join(shown, ["post_id", "mostrado"], "left_anti")
    return pairs.withColumn("r", F.row_number().over(W.partitionBy("post_id").orderBy("mostrado"))).where(F.col("r") <= n).drop("r")


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities by label propagation, at any size: each node takes the label with the greatest weight among its neighbours and itself, ties to the smallest."""
    both = saved(edges.where("origen <> destino").select("origen", "destino", "peso").union(edges.where("origen <> destino").select("destino", "origen", "peso")).groupBy("origen", "destino").agg(F.sum("peso").alias("peso")))
    labels = both.select(F.col("origen").alias("nodo")).distinct().withColumn("c", F.col("nodo"))
    for _ in range(rounds):
        votes = both.join(labels, both["destino"] == labels["nodo"]).groupBy("origen", "c").agg(F.sum("peso").alias("w"))
        best = votes.groupBy("origen").agg(F.min(F.struct((-F.col("w")).alias("w"), "c")).alias("m"))
        new = saved(best.select(F.col("origen").alias("nodo"), F.col("m.c").alias("c")))
        same = new.join(labels, ["nodo", "c"], "left_anti").isEmpty()
        labels = new
        if same:
            break
    return labels.select("nodo", F.col("c").alias("comunidad"))


# Algorithms on one graph in memory, for graphs within the bound that each operator states.


def _adjacency(pdf: pd.DataFrame) -> dict:
    adj: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in zip(pdf["origen"], pdf["destino"], pdf["peso"], strict=True):
        adj[a][b] += w
        if a != b:
            adj[b][a] += w
    return adj


def _louvain(adj: dict) -> dict:
    """Communities of greatest modularity, greedily: nodes in order move while that gains; then communities become nodes."""
    total = sum(w for a in adj for b, w in adj[a].items() if a != b) / 2 + sum(adj[a].get(a, 0) for a in adj)
    where = {v: v for v in adj}
    level = {a: dict(n) for a, n in adj.items()}
    while total > 0:
        own = {v: v for v in level}
        degree = {v: sum(w for u, w in level[v].items() if u != v) + 2 * level[v].get(v, 0.0) for v in level}
        mass = dict(degree)
        moved = True
        while moved:  # each move gains, so this ends
            moved = False
            for v in sorted(level, key=str):
                links: dict = defaultdict(float)
                for u, w in level[v].items():
                    if u != v:
                        links[own[u]] += w
                mass[own[v]] -= degree[v]
                gain = lambda c, v=v, links=links: links.get(c, 0.0) - mass[c] * degree[v] / (2 * total)
                best = min([own[v], *links], key=lambda c: (-gain(c), str(c)))
                if gain(best) <= gain(own[v]) + 1e-12:
                    best = own[v]
                moved |= best != own[v]
                own[v] = best
                mass[best] += degree[v]
        if len(set(own.values())) == len(level):
            break
        where = {v: own[c] for v, c in where.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        for v in level:
            for u, w in level[v].items():
                a, b = own[v], own[u]
                merged[a][b] += w if v != u and a != b else w / 2 if v != u else w
        level = {a: dict(n) for a, n in merged.items()}
    groups: dict = defaultdict(list)
    for v, c in where.items():
        groups[c].append(v)
    ranked = sorted((sorted(g, key=str) for g in groups.values()), key=lambda g: (-len(g), str(g[0])))
    return {v: i for i, g in enumerate(ranked) for v in g}


def communities(graph: DataFrame, by: str = "grafo") -> DataFrame:
    """Louvain communities of each graph (column by), numbered by size and first node. A graph is handled in one task, so this is for analysis graphs; label_communities has no such bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _louvain(_adjacency(pdf))
        return pd.DataFrame({by: pdf[by].iloc[0], "nodo": [str(v) for v in found], "comunidad": list(found.values())})

    return graph.groupBy(by).applyInPandas(run, f"{by} string, nodo string, comunidad long")


def betweenness(graph: DataFrame, by: str = "grafo", most: int = 2000) -> DataFrame:
    """Unweighted directed betweenness, normalised; null for graphs of more than `most` nodes, a rule of the measure's report: betweenness_by_source has no such bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["origen"]) | set(pdf["destino"]), key=str)
        score: dict = dict.fromkeys(nodes, 0.0 if len(nodes) <= most else None)
        if len(nodes) <= most:
            out = defaultdict(set)
            for a, b in zip(pdf["origen"], pdf["destino"], strict=True):
                if a != b:
                    out[a].add(b)
            for s in nodes:
                order, before, paths, far = [], defaultdict(list), {s: 1.0}, {s: 0}
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for u in out[v]:
                        if u not in far:
                            far[u] = far[v] + 1
                            queue.append(u)
                        if far[u] == far[v] + 1:
                            paths[u] = paths.get(u, 0.0) + paths[v]
                            before[u].append(v)
                share: dict = defaultdict(float)
                for v in reversed(order):
                    for u in before[v]:
                        share[u] += paths[u] / paths[v] * (1 + share[v])
                    if v != s:
                        score[v] += share[v]
            n = len(nodes)
            if n > 2:
                score = {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}
        return pd.DataFrame({by: pdf[by].iloc[0], "nodo": [str(v) for v in nodes], "intermediacion": [score[v] for v in nodes]})

    return graph.groupBy(by).applyInPandas(run, f"{by} string, nodo string, intermediacion double")


MOST_EDGES = 20_000_000
"""Distinct edges of one graph that betweenness_by_source sends to all tasks (16 bytes each)."""


def betweenness_by_source(graph: DataFrame) -> DataFrame:
    """Unweighted directed betweenness of one graph, normalised, for any number of nodes: exact, with the sources dealt over the tasks.

    The distinct edges go to all tasks as numbers, behind a check of their count (MOST_EDGES; beyond that it is an
    error); each task walks the graph from its share of the sources and returns one row a node, whatever their number.
    """
    import numpy as np
    import pyarrow as pa

    edges = saved(graph.where("origen <> destino").select(F.col("origen").cast("string").alias("a"), F.col("destino").cast("string").alias("b")).distinct())
    if edges.count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} distinct edges")
    loops = graph.select(F.col("origen").cast("string").alias("nodo")).union(graph.select(F.col("destino").cast("string")))
    names = sorted(r.nodo for r in loops.distinct().collect())  # twice the edges at most
    number = {n: i for i, n in enumerate(names)}
    n, t = len(names), edges.toArrow()
    a, b = (np.array([number[x] for x in t.column(c).to_pylist()], np.int64) for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    begin, to = np.searchsorted(a[order], np.arange(n + 1)), b[order].astype(np.int32)

    def run(batches):
        score = np.zeros(n)
        for batch in batches:
            for s in np.asarray(batch.column(0)).tolist():
                far, paths = np.full(n, -1, np.int32), np.zeros(n)
                far[s], paths[s] = 0, 1.0
                layers = [np.array([s])]
                while len(layers[-1]):
                    at = layers[-1]
                    size = begin[at + 1] - begin[at]
                    source = np.repeat(at, size)
                    target = to[np.repeat(begin[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                    fresh = far[target] < 0
                    far[target[fresh]] = len(layers)
                    next_ = far[target] == len(layers)
                    np.add.at(paths, target[next_], paths[source[next_]])
                    layers.append(np.unique(target[fresh]))
                share = np.zeros(n)
                for depth in range(len(layers) - 2, -1, -1):
                    at = layers[depth]
                    size = begin[at + 1] - begin[at]
                    source = np.repeat(at, size)
                    target = to[np.repeat(begin[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                    down = far[target] == depth + 1
                    np.add.at(share, source[down], paths[source[down]] / paths[target[down]] * (1 + share[target[down]]))
                share[s] = 0.0
                score += share
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(score)], ["i", "s"])

    spark = graph.sparkSession
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    total = spark.range(0, n, 1, parts).mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    named = spark.createDataFrame(list(enumerate(names)), "i long, nodo string")
    return total.join(named, "i").select("nodo", (F.col("s") / F.lit(float(max((n - 1) * (n - 2), 1)))).alias("intermediacion"))


def cliques(graph: DataFrame, by: str = "grafo", least: int = 3) -> DataFrame:
    """Maximal cliques of at least so many nodes of the undirected graph, the largest first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(set)
        for a, b in zip(pdf["origen"], pdf["destino"], strict=True):
            if a != b:
                near[a].add(b)
                near[b].add(a)
        found, stack = [], [(set(), set(near), set())]
        while stack:
            r, p, x = stack.pop()
            if not p and not x:
                if len(r) >= least:
                    found.append(sorted(map(str, r)))
                continue
            if len(r) + len(p) < least:
                continue
            pivot = max(p | x, key=lambda u: len(near[u] & p))
            for v in sorted(p - near[pivot], key=str):
                stack.append((r | {v}, p & near[v], x & near[v]))
                p, x = p - {v}, x | {v}
        found.sort(key=lambda c: (-len(c), c[0], c))
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(found), "orden": list(range(len(found))), "nodos": [",".join(c) for c in found]})

    return graph.groupBy(by).applyInPandas(run, f"{by} string, orden long, nodos string")


GROUP, CHUNK = 4096, 256


def _common(a: str, b: str) -> Column:
    """The number of values in both arrays; single values, the usual case, are compared without a hash set."""
    one = F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), 1).otherwise(0)
    return F.when((F.size(a) <= 1) & (F.size(b) <= 1), one).otherwise(F.size(F.array_intersect(a, b)))


def similarity_classes(df: DataFrame, key: str, weights: dict[str, float], least: float = 0.5, max_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs of similarity_pairs between classes of rows with the same components: members (k, id, m: rows of the class), and links (a, b, na, nb, similitud, compartidos), one for each pair of classes whose rows are similar.

    A link from a class to itself stands for the pairs of its rows. Shares count rows. Values meet in the order of their
    components, the one with the fewest pairs first. A class needs only those of its leading components without which the
    rest, by weight, stays below `least`: a pair that reaches it has its first common value among these on both sides, and
    is looked at there, once.
    """
    whole = lambda c: F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>")))).cast("array<string>")
    names = [f"c{i}" for i in range(len(weights))]
    rows = saved(df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *(F.sort_array(F.array_distinct(whole(c))).alias(n) for n, c in zip(names, weights))))
    n = rows.count()
    classes = saved(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("m")).withColumn("id", F.monotonically_increasing_id()))
    members = saved(split_join(rows, classes, names).select("k", "id", "m"))
    counts = saved(classes.select("m", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("vs")) for i, c in enumerate(names)))).alias("x")).select("m", "x.i", F.explode("x.vs").alias("v")).groupBy("i", "v").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("classes")))
    common: list[set[str]] = [set() for _ in weights]
    if max_share is not None:  # at most the mean number of values of a row, divided by max_share
        for r in counts.where(F.col("n") > max(int(n * max_share), 2)).collect():
            common[r.i].add(r.v)
    proposing = counts.where(F.col("n") <= max(int(n * max_share), 2)) if max_share is not None else counts
    cost = {r.i: r.p for r in proposing.groupBy("i").agg(F.sum(F.col("classes").cast("double") * (F.col("classes") - 1)).alias("p")).collect()}
    order = sorted(range(len(weights)), key=lambda i: (cost.get(i, 0.0), i))
    w = list(weights.values())

    has = lambda i: F.size(f"c{i}") > 0
    named = lambda i: F.transform(f"c{i}", lambda v: F.concat(F.lit(f"{order.index(i):04d}="), v))
    total = sum((F.when(has(i), F.lit(float(w[i]))).otherwise(0.0) for i in range(len(w))), F.lit(0.0))
    tokens, passed = F.array().cast("array<string>"), F.lit(0.0)
    for at, i in enumerate(order):
        # what the values met so far can no longer bring, were none of them common to a pair
        rest = sum((F.when(has(j), F.lit(float(w[j]))).otherwise(0.0) for j in order[at:]), F.lit(0.0)) + passed
        off = sorted(common[i])
        fit = F.array_except(named(i), F.array(*(F.lit(f"{at:04d}={x}") for x in off))) if off else named(i)
        tokens = F.when(rest >= F.lit(least) * total - 1e-9, F.concat(tokens, F.array_sort(fit))).otherwise(tokens)
        if off:
            passed = passed + F.when(F.arrays_overlap(f"c{i}", F.array(*map(F.lit, off))), F.lit(float(w[i]))).otherwise(0.0)
    # a value's classes meet in tiles: GROUP of one side, dealt by id, with all of the other
    groups = counts.select(F.concat(F.element_at(F.array(*(F.lit(f"{order.index(i):04d}=") for i in range(len(w)))), F.col("i") + 1), "v").alias("t"), F.ceil(F.col("classes") / GROUP).cast("int").alias("groups")).where(F.col("classes") > 1)
    dealt = classes.withColumn("ts", tokens)
    spread = dealt.select(*classes.columns, "ts", F.posexplode("ts").alias("at", "t"))
    sides = split_join(spread, groups, ["t"]).withColumn("ts", F.slice("ts", F.lit(1), F.col("at"))).drop("at")  # the values before this one
    side = lambda s: ("t", "g", *(F.col(c).alias(f"{s}_{c}") for c in (*classes.columns, "ts")))
    parts = int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sum(cost.values()) / 1e6, 1e5)))
    left = sides.withColumn("g", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).repartition(parts, "t", "g").select(*side("a"))
    right = sides.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(*side("b"))
    both = left.join(right, ["t", "g"]).where((F.col("a_id") < F.col("b_id")) & (_common("a_ts", "b_ts") == 0))
    ends = lambda a, b: (F.col(f"{a}id").alias("a"), F.col(f"{b}id").alias("b"), F.col(f"{a}m").alias("na"), F.col(f"{b}m").alias("nb"))
    both = both.select(*ends("a_", "b_"), *(_common(f"a_c{i}", f"b_c{i}").alias(f"s{i}") for i in range(len(w))), *((F.size(f"a_c{i}") + F.size(f"b_c{i}")).alias(f"n{i}") for i in range(len(w))))
    inside = dealt.where((F.col("m") > 1) & (F.size("ts") > 0))
    both = both.union(inside.select(*ends("", ""), *(F.size(c) for c in names), *(2 * F.size(c) for c in names)))
    top = sum((F.when(F.col(f"n{i}") > 0, w[i] * F.col(f"s{i}") / (F.col(f"n{i}") - F.col(f"s{i}"))).otherwise(0.0) for i in range(len(w))), F.lit(0.0))
    base = sum((F.when(F.col(f"n{i}") > 0, F.lit(float(w[i]))).otherwise(0.0) for i in range(len(w))), F.lit(0.0))
    shared = F.concat_ws(", ", *(F.when(F.col(f"s{i}") > 0, c) for i, c in enumerate(weights)))
    scored = both.withColumn("s", F.try_divide(top, base)).where(F.col("s") >= least)
    return members, saved(scored.select("a", "b", "na", "nb", F.round("s", 4).alias("similitud"), shared.alias("compartidos")))


def similarity_pairs(df: DataFrame, key: str, weights: dict[str, float], least: float = 0.5, max_share: float | None = None) -> DataFrame:
    """Pairs a < b by the weighted mean Jaccard of their components (array columns); components empty on both sides do not count.

    Every value proposes, however many rows have it, so the result is that of all pairs; a caller who names
    max_share gets only pairs that share a value which at most max(max_share * n, 2) rows have. Null values and
    null components count as absent; rows without a key take no part.
    Rows with the same components are compared once, as a class; then the links of classes become those of
    their rows, CHUNK rows of one side with CHUNK of the other at a time.
    """
    members, links = similarity_classes(df, key, weights, least, max_share)
    return _expanded(members, links)


def _expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs of rows that links between classes stand for."""
    spark = links.sparkSession
    chunks = members.groupBy("id", F.pmod(F.xxhash64("k"), F.ceil(F.col("m") / CHUNK)).alias("g")).agg(F.collect_list("k").alias("ks"))
    side = lambda s: chunks.select(F.col("id").alias(s), F.col("g").alias(f"g{s}"), F.col("ks").alias(f"k{s}"))
    pairs = links.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(pairs / 4e6, 1e5)))
    met = links.drop("na", "nb").join(side("a"), "a").join(side("b"), "b").repartition(parts, "a", "b", "ga", "gb")
    each = met.select(F.col("a") == F.col("b"), "similitud", "compartidos", "kb", F.explode("ka").alias("x")).toDF("inside", "similitud", "compartidos", "kb", "x").select("inside", "similitud", "compartidos", "x", F.explode("kb").alias("y"))
    each = each.where((F.col("x") < F.col("y")) | (~F.col("inside") & (F.col("x") > F.col("y"))))
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similitud", "compartidos")


def similarity_groups(df: DataFrame, key: str, weights: dict[str, float], least: float = 0.5, max_share: float | None = None, rounds: int = 10) -> DataFrame:
    """label_communities of similarity_pairs (nodo, comunidad), without making the pairs of rows: the similarities, of four decimals, are added as whole numbers.

    Rows of a class have the same neighbours but for themselves, so votes are counted by class and label, and a row takes
    its own one off. Of the labels that one class alone holds, only the two that most of its rows have (then the smallest) can win.
    """
    members, links = similarity_classes(df, key, weights, least, max_share)
    if not members.groupBy("k").count().where("count > 1").isEmpty():  # a node in several classes
        pairs = _expanded(members, links)
        return label_communities(pairs.select(F.col("a").cast("string").alias("origen"), F.col("b").cast("string").alias("destino"), F.col("similitud").alias("peso")), rounds)
    weight = F.round(F.col("similitud") * 10000).cast("long").alias("w")
    other = links.where("a <> b")
    both = saved(links.select("a", "b", weight).union(other.select("b", "a", weight)))
    own = both.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("own"))
    nodes = members.select(F.col("k").cast("string").alias("nodo"), "id").withColumn("c", F.col("nodo"))
    nodes = saved(split_join(nodes, both.select(F.col("a").alias("id")).distinct(), ["id"]).select("nodo", "id", "c"))
    for _ in range(rounds):
        held = saved(nodes.groupBy("id", "c").agg(F.count(F.lit(1)).alias("n")))
        spread = split_join(held, held.groupBy("c").agg(F.count(F.lit(1)).alias("classes")), ["c"])
        first = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "c"))
        alone = spread.where("classes = 1").withColumn("r", first).where("r <= 2")
        told = alone.select("id", "c", "n").union(spread.where("classes > 1").select("id", "c", "n"))
        votes = saved(both.join(told, both["b"] == told["id"]).groupBy("a", "c").agg(F.sum(F.col("w") * F.col("n")).alias("w")).select(F.col("a").alias("id"), "c", "w"))
        best = votes.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("w"), "c"))).where("r <= 2")
        best = best.groupBy("id").agg(*(F.max(F.when(F.col("r") == r, F.struct((-F.col("w")).alias("w"), "c"))).alias(f"m{r}") for r in (1, 2)))
        mine = held.select("id", "c").join(votes, ["id", "c"], "left").join(own, "id", "left").join(best, "id")
        rest = F.col("w") - F.coalesce("own", F.lit(0))
        stay = F.when(rest > 0, F.struct((-rest).alias("w"), F.col("c").alias("c")))
        taken = F.least(F.when(F.col("m1.c") != F.col("c"), F.col("m1")).otherwise(F.col("m2")), stay)["c"]
        moves = saved(mine.select("id", "c", taken.alias("to")))
        if moves.where("c <> to").isEmpty():
            break
        nodes = saved(split_join(nodes, moves, ["id", "c"]).select("nodo", "id", F.col("to").alias("c")))
    return nodes.select("nodo", F.col("c").alias("comunidad"))


def topological(stages: dict[str, list[str]]) -> list[str]:
    """Stages after all they depend on; among ready ones, in the order of declaration."""
    done: list[str] = []
    rest = list(stages)
    while rest:
        ready = next((s for s in rest if all(d in done for d in stages[s])), None)
        if ready is None:
            raise ValueError(f"a cycle among {', '.join(rest)}")
        rest.remove(ready)
        done.append(ready)
    return done


def closure(stages: dict[str, list[str]], wanted: list[str]) -> list[str]:
    """The wanted stages and all they depend on, in order."""
    need, stack = set(), list(wanted)
    while stack:
        if (s := stack.pop()) not in need:
            need.add(s)
            stack += stages[s]
    return [s for s in topological(stages) if s in need]


def context_satellite(posts: DataFrame, outside: DataFrame, depth: int = 5) -> DataFrame:
    """What each post refers to, and where it was found: post_id, relacion (padre_1 .. padre_n, cita, reposteo), ref, fuente (origin, satellite) or unavailable.

    posts: post_id, en_respuesta_a, cita_a, reposteo_a; outside: the same columns for posts that can be
    fetched. Parents are followed to so many levels, through the corpus and the posts outside it.
    """
    columns = ("post_id", "en_respuesta_a")
    fetched = outside.join(posts.select("post_id"), "post_id", "left_anti").select(*columns, F.lit("satellite").alias("fuente"))
    known = posts.select(*columns, F.lit("origin").alias("fuente")).union(fetched)
    found = known.select(F.col("post_id").alias("ref"), F.col("en_respuesta_a").alias("next"), "fuente")
    up = posts.where(F.col("en_respuesta_a").isNotNull()).select("post_id", F.col("en_respuesta_a").alias("ref"))
    parts = []
    for level in range(1, depth + 1):
        met = up.join(found, "ref", "left")
        parts.append(met.select("post_id", F.lit(f"padre_{level}").alias("relacion"), "ref", F.coalesce("fuente", F.lit("unavailable")).alias("fuente")))
        up = met.where(F.col("next").isNotNull()).select("post_id", F.col("next").alias("ref"))
    for column, name in (("cita_a", "cita"), ("reposteo_a", "reposteo")):
        refs = posts.where(F.col(column).isNotNull()).select("post_id", F.col(column).alias("ref"))
        parts.append(refs.join(found, "ref", "left").select("post_id", F.lit(name).alias("relacion"), "ref", F.coalesce("fuente", F.lit("unavailable")).alias("fuente")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out

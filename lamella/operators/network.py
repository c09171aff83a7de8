"""Graphs as ``src, dst, weight`` edge tables (inventory section J)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lamella.core import bounded, checkpointed
from lamella.functions.special import normal_two_sided

MAX_EDGES = 1_000_000


def simplify(edges: DataFrame) -> DataFrame:
    """Undirected: no loops, one canonical edge per pair with the mean weight."""
    return (edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .agg(F.avg("weight").alias("weight")))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degree(edges).groupBy("degree").agg(F.count("*").alias("n"))


def label_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: smallest node id of each component.

    Each round takes the minimum over neighbours (combined map-side, so a hub costs
    one partial row per task) and then jumps to the root's root; labels are
    checkpointed so the plan stays one round long.
    """
    e = checkpointed(both_ways(edges).select("src", "dst").distinct())
    lab = checkpointed(e.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("root")))
    for _ in range(max_rounds):
        seen = e.join(lab.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("_m"))
        step = lab.join(seen, "node").select("node", F.col("root").alias("_old"), F.least("root", "_m").alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root", "left") \
            .select("node", "_old", F.least("root", F.coalesce("_up", "root")).alias("root"))
        jump = checkpointed(jump)
        lab = jump.select("node", "root")
        if jump.where("root <> _old").isEmpty():
            return lab
    raise RuntimeError("components did not converge")


def components(edges: DataFrame, min_size: int = 1) -> DataFrame:
    """``node, root, component, size``: components by falling size, named subnetwork1.."""
    lab = label_components(edges)
    size = lab.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("size"), "root")
    named = size.withColumn("component", F.concat(F.lit("subnetwork"), F.row_number().over(w).cast("string")))
    return lab.join(named, "root")


def component_stats(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Nodes, edges and nodes per layer (the part of the id before ':') of each component."""
    n = comp.withColumn("layer", F.substring_index("node", ":", 1)).groupBy("component", "layer").agg(F.count("*").alias("c"))
    per = n.groupBy("component").agg(F.sum("c").alias("n_nodes"),
                                     F.concat_ws(";", F.array_sort(F.collect_list(F.concat_ws("=", "layer", F.col("c").cast("string"))))).alias("layers"))
    e = edges.join(comp.select(F.col("node").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("n_edges"))
    return per.join(e, "component", "left").na.fill(0, ["n_edges"])


def _adjacency(edges: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Neighbour lists of a filtered graph (size checked) for per-source traversals."""
    rows = bounded(edges.select("src", "dst").distinct(), MAX_EDGES, "edges")
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    ix = {v: i for i, v in enumerate(names)}
    nb: list[set] = [set() for _ in names]
    for a, b in rows:
        if a != b:
            nb[ix[a]].add(ix[b])
            nb[ix[b]].add(ix[a])
    return names, [np.array(sorted(s), int) for s in nb]


def _per_source(edges: DataFrame, fn, schema: str, sources: list[str] | None = None) -> DataFrame:
    """Run ``fn(source index, names, neighbours)`` for each source on the executors."""
    names, nb = _adjacency(edges)
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast((names, nb))
    want = set(sources) if sources is not None else None
    src = spark.createDataFrame([(i,) for i, v in enumerate(names) if want is None or v in want], "i int").repartition(16)

    def run(it):
        nm, adj = shared.value
        for pdf in it:
            for i in pdf["i"]:
                out = fn(int(i), nm, adj)
                if len(out):
                    yield out

    return src.mapInPandas(run, schema)


def _bfs(s, adj):
    dist, sigma, order = np.full(len(adj), -1), np.zeros(len(adj)), [s]
    dist[s], sigma[s] = 0, 1
    for v in order:
        for w in adj[v]:
            if dist[w] < 0:
                dist[w] = dist[v] + 1
                order.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
    return dist, sigma, order


def betweenness(edges: DataFrame) -> DataFrame:
    """Undirected, unnormalized; dependencies per source, added over sources."""
    def one(s, names, adj):
        dist, sigma, order = _bfs(s, adj)
        delta = np.zeros(len(adj))
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
        delta[s] = 0
        hit = np.flatnonzero(delta)
        return pd.DataFrame({"node": [names[i] for i in hit], "d": delta[hit]})

    d = _per_source(edges, one, "node string, d double").groupBy("node").agg((F.sum("d") / 2).alias("betweenness"))
    return nodes_of(edges).join(d, "node", "left").na.fill(0.0)


def filter_nodes(edges: DataFrame, min_degree: int | None = None, min_betweenness: float | None = None, which: str = "all") -> DataFrame:
    """Drop nodes with degree (or betweenness) at most the limit; only first- or second-column nodes if asked."""
    low = None
    if min_degree is not None:
        low = degree(edges).where(F.col("degree") <= min_degree).select("node")
    if min_betweenness is not None:
        b = betweenness(edges).where(F.col("betweenness") <= min_betweenness).select("node")
        low = b if low is None else low.union(b).distinct()
    if which != "all":
        side = edges.select(F.col("src" if which == "first" else "dst").alias("node"))
        low = low.join(side, "node", "left_semi")
    return exclude_nodes(edges, low)


def exclude_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ``ids`` (column ``node``); orphans vanish with their edges."""
    return (edges.join(ids.select(F.col("node").alias("src")), "src", "left_anti")
            .join(ids.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "weight"))


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once.  Edges point from the lower to the higher degree, which bounds the out-degree of hubs."""
    d = degree(edges)
    e = (simplify(edges).select("src", "dst")
         .join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src")
         .join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst"))
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    e = checkpointed(e)
    path = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    return path.join(e.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi")


def transitivity(edges: DataFrame) -> DataFrame:
    """Global clustering coefficient: 3 x triangles over connected triples."""
    s = simplify(edges)
    wedges = degree(s).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples")).withColumn("_one", F.lit(1))
    t = triangles(s).agg(F.count("*").alias("triangles")).withColumn("_one", F.lit(1))
    return t.join(wedges, "_one").select("triangles", "triples", (3 * F.col("triangles") / F.col("triples")).alias("clustering"))


def topology(edges: DataFrame) -> DataFrame:
    """Diameter, radius, mean distance and clustering coefficient."""
    def one(s, names, adj):
        dist, _, _ = _bfs(s, adj)
        r = dist[dist > 0]
        return pd.DataFrame({"ecc": [int(r.max()) if len(r) else 0], "total": [float(r.sum())], "n": [len(r)]})

    d = _per_source(edges, one, "ecc int, total double, n int").agg(
        F.max("ecc").alias("diameter"), F.min("ecc").alias("radius"), (F.sum("total") / F.sum("n")).alias("mean_distance")).withColumn("_one", F.lit(1))
    return d.join(transitivity(edges).withColumn("_one", F.lit(1)), "_one").drop("_one")


def communities(edges: DataFrame, queries: DataFrame | None = None, min_size: int = 5) -> DataFrame:
    """Label propagation (most frequent neighbour label, ties to the smallest), members of kept communities.

    A node moves when another label has more votes than its own, and only the nodes that come first (by hash) among their
    neighbours that want to move do so in a round.  So every move adds an edge inside a community and the rounds end, with
    no node left that wants to move.  Counts are combined before the shuffle; one (node, label) row per neighbour label.
    """
    e = checkpointed(both_ways(simplify(edges)).select("src", "dst"))
    lab = checkpointed(e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    turn = 0
    while True:
        votes = e.join(lab.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("c"))
        votes = votes.join(lab.select(F.col("node").alias("src"), F.col("label").alias("own")), "src")
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(-F.col("c"), "label")).alias("_b"), F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("c"))), F.lit(0)).alias("_own"))
        want = checkpointed(best.where(-F.col("_b.col1") > F.col("_own")).select("node", F.col("_b.label").alias("new"), F.xxhash64("node", F.lit(turn)).alias("h")))
        if want.isEmpty():
            break
        other = e.join(want.select(F.col("node").alias("src"), "h"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.struct("h", "src")).alias("_o"))
        go = want.join(other, "node", "left").where(F.col("_o").isNull() | (F.struct("h", F.col("node").alias("src")) > F.col("_o"))).select("node", "new")
        lab = checkpointed(lab.join(go, "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        turn += 1
    size = lab.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    if queries is not None:
        q = lab.join(queries.select("node"), "node", "left_semi").groupBy("label").agg(F.count("*").alias("n_query"))
        size = size.join(q, "label")
    return lab.join(size, "label")


def community_test(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """Rank-sum test of members' inside degree against outside degree; ordered by p.

    The two samples of a community are degrees, so ranks are taken over counts per value.
    """
    e = both_ways(simplify(edges)).join(comm.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src") \
        .join(comm.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst", "left")
    inside = F.col("ls") == F.col("ld")
    d = e.groupBy(F.col("ls").alias("label"), "src").agg(F.count_if(inside).alias("in"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("out"))
    v = d.select("label", F.explode(F.array(F.struct(F.lit(1).alias("g"), F.col("in").alias("v")),
                                            F.struct(F.lit(0).alias("g"), F.col("out").alias("v")))).alias("x")).select("label", "x.g", "x.v")
    c = v.groupBy("label", "v").agg(F.sum("g").alias("a"), F.count("*").alias("c"))
    cum = F.sum("c").over(W.partitionBy("label").orderBy("v"))
    c = c.withColumn("rank", cum - (F.col("c") - 1) / 2)
    s = c.groupBy("label").agg(F.sum("a").alias("n1"), F.sum("c").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("r"),
                               F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r") - n1 * (n1 + 1) / 2
    z0 = u - n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (z0 - F.signum(z0) * 0.5) / F.nullif(sd, F.lit(0.0))
    s = s.select("label", u.alias("w"), F.coalesce(z, F.lit(0.0)).alias("z"))
    return s.withColumn("pval", normal_two_sided("z"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman modularity of ``labels`` (node, label), unweighted."""
    e = simplify(edges)
    l = labels.select("node", "label")
    j = e.join(l.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(l.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
    ends = j.select(F.explode(F.array("ls", "ld")).alias("label"), (F.col("ls") == F.col("ld")).cast("double").alias("same"))
    g = ends.groupBy("label").agg(F.count("*").alias("d"), (F.sum("same") / 2).alias("inside")).withColumn("_one", F.lit(1))
    tot = g.groupBy("_one").agg((F.sum("d") / 2).alias("_m"))
    return g.join(tot, "_one").agg(F.sum(F.col("inside") / F.col("_m") - (F.col("d") / (2 * F.col("_m"))) ** 2).alias("modularity"))


def distances_from(edges: DataFrame, a: str, b: str | None = None) -> DataFrame:
    """``node, depth`` by frontier joins from ``a``, one level per round, until ``b`` or nothing new is met."""
    e = both_ways(edges).select("src", "dst").distinct()
    spark = edges.sparkSession
    seen = front = spark.createDataFrame([(a, 0)], "node string, depth int")
    d = 0
    while True:
        d += 1
        nxt = (e.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
               .join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        front = checkpointed(nxt)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if b is not None and not front.where(F.col("node") == b).isEmpty():
            return seen


def shortest_paths(edges: DataFrame, a: str, b: str, limit: int | None = 50) -> DataFrame:
    """The first ``limit`` (None: all) shortest paths from ``a`` to ``b`` in order.

    The nodes on shortest paths are found level by level from ``b``; then paths grow from ``a`` over those nodes only, so every
    prefix has an end and the first prefixes of a level hold the first paths.
    """
    e = both_ways(edges).select("src", "dst").distinct()
    spark = edges.sparkSession
    depth = checkpointed(distances_from(edges, a, b))
    hit = depth.where(F.col("node") == b).select("depth").first()
    if hit is None:
        return spark.createDataFrame([], "path array<string>")
    on = [spark.createDataFrame([(b,)], "node string")]
    for level in range(hit[0] - 1, -1, -1):
        at = depth.where(F.col("depth") == level).select("node")
        on.append(checkpointed(e.join(on[-1].select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().join(at, "node", "left_semi")))
    paths = spark.createDataFrame([([a], a)], "path array<string>, head string")
    for nodes in on[-2::-1]:
        step = e.join(nodes.select(F.col("node").alias("dst")), "dst")
        grown = paths.join(step, F.col("head") == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("head"))
        paths = checkpointed(grown if limit is None else grown.orderBy("path").limit(limit))
    return paths.select("path")


def module(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Induced subgraph of ``ids`` if connected, else the union of shortest paths between them."""
    spark = edges.sparkSession
    n = spark.createDataFrame([(i,) for i in ids], "node string")
    inner = edges.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    inner = checkpointed(inner)
    if not inner.isEmpty():
        lab = label_components(inner)
        if lab.count() == len(set(ids)) and lab.select("root").distinct().count() == 1:
            return inner.select("src", "dst", "weight")
    return _path_union(edges, ids)


def _path_union(edges: DataFrame, seeds: list[str]) -> DataFrame:
    """Edges on one shortest path between every two seeds; one traversal per seed."""
    want = sorted(set(seeds))

    def one(s, names, adj):
        dist, _, order = _bfs(s, adj)
        ix = {v: i for i, v in enumerate(names)}
        out = set()
        for t in (ix[x] for x in want if x in ix):
            while dist[t] > 0:
                up = min(v for v in adj[t] if dist[v] == dist[t] - 1)
                out.add((min(names[up], names[t]), max(names[up], names[t])))
                t = up
        return pd.DataFrame(sorted(out), columns=["src", "dst"])

    keep = _per_source(edges, one, "src string, dst string", want).distinct()
    return simplify(edges).join(keep, ["src", "dst"], "left_semi")


def min_network(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Minimum connected network: non-seed leaves dropped, union of shortest paths between the seeds (the ``limit`` best connected)."""
    e = simplify(edges)
    d = degree(e)
    leaves = d.where("degree = 1").join(seeds.select("node"), "node", "left_anti")
    e = checkpointed(exclude_nodes(e, leaves))
    top = degree(e).join(seeds.select("node"), "node", "left_semi")
    if limit is not None:
        top = top.orderBy(F.desc("degree"), "node").limit(limit)
    return _path_union(e, [r[0] for r in top.collect()])


def node_table(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """id, label, degree, betweenness."""
    t = degree(edges).join(betweenness(edges), "node")
    if labels is not None:
        t = t.join(labels.select("node", "label"), "node", "left")
    else:
        t = t.withColumn("label", F.substring_index("node", ":", -1))
    return t.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "node")).orderBy(F.desc("degree"), F.desc("betweenness"), "node")

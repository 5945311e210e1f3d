"""Clustering on neighbour graphs: communities by modularity, spectral clusters, spanning trees.

Graphs are edge tables. Every step is a join on a node and an aggregation with partial sums, and is
checkpointed, so that plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept as _kept
from .learn import _margin, _matrix, _squares, _with_blocks

#: Rows of a block of ``linked_within``.
BLOCK = 8192


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, w), each pair in both directions, weighted by how often it is there; loops go. An edge
    table without weights counts one a row."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w.cast("double")).alias("w"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(pairs.select("b", "a", "w"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest node reachable, for every node (id). Labels jump to the label of their
    label, so that long chains take few rounds."""
    label = _kept(nodes.select("id", F.col("id").alias("component")))
    while True:
        low = edges.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("low"))
        new = label.join(low, "id", "left").select("id", F.least("component", "low").alias("component"))
        up = new.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = _kept(new.join(up, "component").select("id", F.least("component", "up").alias("component")))
        same = new.join(label.withColumnRenamed("component", "was"), "id").where("component <> was").isEmpty()
        label = new
        if same:
            return label


# --- communities ----------------------------------------------------------------------


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of communities (id, cluster) on undirected weighted ``edges``: the share of weight inside less what the
    strengths let expect, times ``resolution``."""
    both = undirected(edges)
    own = both.join(labels.withColumnRenamed("id", "src"), "src").join(labels.select(F.col("id").alias("dst"), F.col("cluster").alias("other")), "dst")
    each = own.groupBy("cluster").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cluster") == F.col("other"), F.col("w"))).alias("inside"))
    total = each.agg(F.sum("k")).first()[0]
    return each.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / total - resolution * (F.col("k") / total) ** 2)).first()[0] if total else 0.0


def _coin(node: str | Column, round_: int, level: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(round_), F.lit(level)), F.lit(2))


def _moves(edges: DataFrame, nodes: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, best, gain): for each node the community next to it that raises the quality most, ties to the
    smallest. nodes: id, k (strength), c (community), and ``within``: only neighbours of equal ones count."""
    strength = nodes.groupBy("c").agg(F.sum("k").alias("kc"))
    other = nodes.select(F.col("id").alias("dst"), F.col("c").alias("to"), F.col("within").alias("_w"))
    own = nodes.select(F.col("id").alias("src"), "k", "c", "within")
    links = edges.join(other, "dst").join(own, "src").where("within <=> _w").groupBy("src", "to").agg(F.sum("w").alias("w"), F.first("k").alias("k"), F.first("c").alias("c"))
    links = links.join(strength.withColumnRenamed("c", "to"), "to")
    here = F.col("to") == F.col("c")
    worth = F.col("w") - resolution * F.col("k") * (F.col("kc") - F.when(here, F.col("k")).otherwise(0.0)) / total
    # a node without a link into its own community leaves nothing but the strength of the others there
    each = links.withColumn("worth", worth).groupBy("src").agg(
        F.max(F.when(here, F.col("worth"))).alias("stay"), F.max_by(F.when(~here, F.col("to")), F.when(~here, F.struct("worth", -F.col("to")))).alias("best"), F.max(F.when(~here, F.col("worth"))).alias("go"),
        F.first("k").alias("k"), F.first("c").alias("c"),
    )
    each = each.join(strength, "c")
    stay = F.coalesce("stay", -resolution * F.col("k") * (F.col("kc") - F.col("k")) / total)
    return each.select(F.col("src").alias("id"), "best", (F.col("go") - stay).alias("gain")).where("best is not null and gain > 1e-12")


def _moved(edges: DataFrame, nodes: DataFrame, total: float, resolution: float, level: int, rounds: int) -> DataFrame:
    """Rounds in which half of the nodes, by a hash, move where they gain most; until none would."""
    for r in range(rounds):
        go = _moves(edges, nodes, total, resolution).select("id", "best")
        new = _kept(nodes.join(go, "id", "left"))
        if new.where("best is not null").isEmpty():
            break
        nodes = new.withColumn("c", F.when(_coin("id", r, level) == 0, F.coalesce("best", "c")).otherwise(F.col("c"))).drop("best")
    return nodes


def _refined(edges: DataFrame, nodes: DataFrame, total: float, resolution: float, level: int, rounds: int) -> DataFrame:
    """Parts of communities that hang together: all nodes start alone; in each round those that are alone and
    drew one side move, within their community, to where a node of the other side or of a larger part is."""
    fine = nodes.select("id", "k", F.col("id").alias("c"), F.col("c").alias("within"))
    for r in range(rounds):
        size = fine.groupBy("c").agg(F.count("*").alias("n"))
        alone = fine.join(size, "c").where("n = 1").select("id", (_coin("id", r, level + 1000) == 0).alias("leaves"))
        go = _moves(edges, fine, total, resolution).select("id", "best").join(alone, "id")
        # not to a node that leaves itself
        stays = go.join(alone.where("leaves").select(F.col("id").alias("best")), "best", "left_anti").select("id", "best", "leaves")
        new = _kept(fine.join(stays, "id", "left"))
        if new.where("best is not null").isEmpty():
            break
        fine = new.withColumn("c", F.when(F.col("leaves"), F.coalesce("best", "c")).otherwise(F.col("c"))).drop("best", "leaves")
    return fine.select("id", F.col("c").alias("part"))


def leiden(edges: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 5) -> DataFrame:
    """(id, cluster): communities of an undirected graph (src, dst and, if there is one, w) of high modularity
    with ``resolution``; each hangs together and is called by its smallest node.

    Levels of local moving, refinement and aggregation: half of the nodes, drawn by a hash, move at a
    time, which makes reruns equal; the nodes of the next level are the refined parts, which start in
    their communities. Ends when a level joins nothing or raises the quality no more.
    """
    base = _kept(undirected(edges))
    ids = _kept(base.select(F.col("src").alias("id")).distinct())
    total = base.agg(F.sum("w")).first()[0]
    if not total:
        return ids.withColumn("cluster", F.col("id"))
    home = ids.withColumn("node", F.col("id"))  # which node of the level a node of the graph is in
    graph = base
    nodes = _kept(base.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
    best, found = -1.0, None
    for level in range(levels):
        plain = nodes.withColumn("within", F.lit(0))
        nodes = _moved(graph, plain, total, resolution, level, rounds).drop("within")
        labels = _kept(home.join(nodes.select(F.col("id").alias("node"), F.col("c").alias("cluster")), "node").select("id", "cluster"))
        quality = modularity(base, labels, resolution)
        if quality <= best + 1e-9:
            break
        best, found = quality, labels
        parts = _kept(_refined(graph, nodes, total, resolution, level, rounds))
        joined = nodes.join(parts, "id")
        fewer = joined.groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.first("c").alias("c"))
        if parts.select("part").distinct().count() == parts.count():
            break
        home = _kept(home.join(parts.withColumnRenamed("id", "node"), "node").select("id", F.col("part").alias("node")))
        a, b = parts.select(F.col("id").alias("src"), F.col("part").alias("a")), parts.select(F.col("id").alias("dst"), F.col("part").alias("b"))
        graph = _kept(graph.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        nodes = _kept(fewer)
    inner = base.join(found.withColumnRenamed("id", "src"), "src").join(found.select(F.col("id").alias("dst"), F.col("cluster").alias("_c")), "dst").where("cluster = _c").select("src", "dst")
    return components(_kept(inner), ids).select("id", F.col("component").alias("cluster"))


# --- spectral clusters ----------------------------------------------------------------


def _gram(df: DataFrame, column: str) -> np.ndarray:
    """Inner products of all components of an array column over the rows, summed by partition."""

    def sums(frames):
        total = None
        for f in frames:
            if len(f):
                x = _matrix(f, column)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    rows = df.select(column).mapInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    v = np.array([r["v"] for r in rows])
    return v.reshape(int(np.sqrt(len(v))), -1)


def _combined(df: DataFrame, column: str, by: np.ndarray) -> DataFrame:
    """(id, x): rows of an array column times a small matrix."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "x": list(_matrix(f, column) @ by) if len(f) else []})

    return df.select("id", column).mapInPandas(run, "id bigint, x array<double>")


def spectral_embedding(edges: DataFrame, k: int, extra: int = 3, rounds: int = 5, steps: int = 6, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(id, x) with the k leading eigenvectors of the normalised adjacency, and their eigenvalues.

    Block power iteration with restarts: in a round the graph is applied ``steps`` times to a block of k + ``extra``
    vectors; the driver sees only the inner products of all of them, makes them orthogonal and takes their
    leading Ritz vectors as the next block.
    """
    both = undirected(edges)
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    scaled = both.join(degree.select(F.col("id").alias("src"), F.col("d").alias("_a")), "src").join(degree.select(F.col("id").alias("dst"), F.col("d").alias("_b")), "dst")
    graph = _kept(scaled.select("src", "dst", (F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))).alias("w")))
    width = min(k + extra, degree.count())
    noise = lambda i: (F.pmod(F.xxhash64("id", F.lit(i), F.lit(seed)), F.lit(2_000_003)) - 1_000_001) / 1e6
    block = _kept(degree.select("id", F.array(*[noise(i) for i in range(width)]).alias("x")))
    values = np.zeros(width)
    for _ in range(rounds):
        every = block.withColumnRenamed("x", "k")
        now = block
        for _ in range(steps):
            applied = graph.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"))
            now = _kept(applied.agg(F.array(*[F.sum(F.col("w") * F.col("x")[i]) for i in range(width)]).alias("x")))
            every = every.join(now, "id").select("id", F.concat("k", "x").alias("k"))
        every = _kept(every)
        gram = _gram(every, "k")
        n = width * steps
        scale = 1 / np.sqrt(np.maximum(np.diag(gram)[:n], 1e-300))
        w, v = np.linalg.eigh(gram[:n, :n] * scale[:, None] * scale)
        good = w > w.max() * 1e-10
        base = scale[:, None] * v[:, good] / np.sqrt(w[good])
        inner = base.T @ gram[:n, width : n + width] @ base
        values, u = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:width]
        values, turn = values[order], np.zeros((n + width, width))
        turn[:n, : len(order)] = base @ u[:, order]
        block = _kept(_combined(every, "k", turn))
    return block.select("id", F.slice("x", 1, k).alias("x")), values[:k]


def spectral(edges: DataFrame, k: int, seed: int = 42, **more) -> DataFrame:
    """(id, cluster): k-means of the rows of the leading eigenvectors of the normalised graph, each row
    divided by its length."""
    return rows_clustered(spectral_embedding(edges, k, **more)[0], k, seed)


def rows_clustered(x: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k-means of vectors (id, x) of length one."""
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    unit = x.withColumn("v", array_to_vector(F.transform("x", lambda v: v / F.greatest(length, F.lit(1e-300)))))
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster", initMode="k-means||", initSteps=5).fit(unit).transform(unit).select("id", "cluster")


# --- spanning trees -------------------------------------------------------------------


def _nearest_outside(df: DataFrame, key: str, vec: str, some: DataFrame) -> DataFrame:
    """(src, dst, dist): the nearest row of another component for each row of ``some``, exactly, in blocks."""

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64), "dist": np.zeros(0)})]
        a = a[a["_ask"]] if len(a) else a
        if len(a) and len(b):
            y, other, part = _matrix(b, vec), b[key].to_numpy(), b["_c"].to_numpy()
            for low in range(0, len(a), 512):
                f = a.iloc[low : low + 512]
                x = _matrix(f, vec)
                d = _squares(x, y)
                d[f["_c"].to_numpy()[:, None] == part[None, :]] = np.inf
                best = d.min(axis=1)
                row, at = np.nonzero((d <= (best + _margin(x, y))[:, None]) & np.isfinite(best)[:, None])
                dist = np.sqrt(((x[row] - y[at]) ** 2).sum(axis=1))
                order = np.lexsort((other[at], dist, row))
                row, at, dist = row[order], at[order], dist[order]
                first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
                out.append(pd.DataFrame({"src": f[key].to_numpy()[row[first]], "dst": other[at[first]], "dist": dist[first]}))
        return pd.concat(out)

    asked = df.join(some.withColumn("_ask", F.lit(True)), key, "left").withColumn("_ask", F.coalesce("_ask", F.lit(False)))
    found = _with_blocks(asked, key, near, "src bigint, dst bigint, dist double")
    return found.groupBy("src").agg(F.min(F.struct("dist", "dst")).alias("x")).select("src", "x.dst", "x.dist")


def spanning_tree(df: DataFrame, key: str, vec: str, edges: DataFrame, height: float | None = None) -> DataFrame:
    """(src, dst, dist): the minimum spanning tree of all rows by Euclidean distance, ties by keys.

    Rounds in which every component takes its shortest way out. ``edges`` are the k nearest of each row (src, dst,
    rank, dist): they tell it unless a row whose neighbours are all inside its component might have a
    shorter one, as its farthest neighbour is nearer than the way found; such rows are searched for in blocks.
    With ``height`` only edges up to it: a forest, for which fewer rows are searched.
    """
    most = math.inf if height is None else height
    rows = df.select(F.col(key).cast("long").alias(key), vec)
    ids = _kept(rows.select(F.col(key).alias("id")))
    edges = _kept(edges.select("src", "dst", "dist"))
    reach = edges.groupBy("src").agg(F.max("dist").alias("far"))
    label, tree = _kept(ids.withColumn("c", F.col("id"))), None
    while label.select("c").distinct().count() > 1:
        a, b = label.select(F.col("id").alias("src"), "c"), label.select(F.col("id").alias("dst"), F.col("c").alias("_d"))
        out = edges.join(a, "src").join(b, "dst").where("c <> _d")
        best = out.groupBy("c").agg(F.min("dist").alias("found"))
        leaving = out.select("src").distinct()
        inside = a.join(leaving, "src", "left_anti").join(reach, "src", "left").join(best, "c", "left").where((F.col("found").isNull() | F.col("far").isNull() | (F.col("far") <= F.col("found"))) & (F.col("far").isNull() | (F.col("far") <= most))).select(F.col("src").alias(key))
        inside = _kept(inside)
        ways = out.select("src", "dst", "dist", "c")
        if not inside.isEmpty():
            labelled = rows.join(label.select(F.col("id").alias(key), F.col("c").alias("_c")), key)
            ways = ways.unionByName(_nearest_outside(labelled, key, vec, inside).join(a, "src").select("src", "dst", "dist", "c"))
        # ties are broken by the pair, whichever side looks, so that no cycle can arise
        pair = F.struct("dist", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        new = ways.where(F.col("dist") <= most).groupBy("c").agg(F.min(pair).alias("x")).select(F.col("x.u").alias("src"), F.col("x.v").alias("dst"), "x.dist").distinct()
        new = _kept(new)
        if new.isEmpty():
            break
        tree = new if tree is None else _kept(tree.union(new))
        ends = tree.select("src", "dst").union(tree.select("dst", "src"))
        label = components(ends, ids).select("id", F.col("component").alias("c"))
    return tree if tree is not None else df.sparkSession.createDataFrame([], "src bigint, dst bigint, dist double")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the places 0 to n - 1 that each is joined to by pairs of places."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        while True:  # to the end of each chain
            up = new[new]
            if (up == new).all():
                break
            new = up
        low = new
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    return low


def _within(x: np.ndarray, y: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of two matrices up to ``height`` apart: by one product, exactly where rounding might tell."""
    d, margin = _squares(x, y), _margin(x, y)
    row, at = np.nonzero(d <= height * height + margin)
    near = d[row, at] > height * height - margin
    sure = ~near
    sure[near] = np.sqrt(((x[row[near]] - y[at[near]]) ** 2).sum(axis=1)) <= height
    return row[sure], at[sure]


def linked_within(df: DataFrame, key: str, vec: str, height: float) -> DataFrame:
    """(id, component): the smallest key that each row reaches by steps of at most ``height``, for all rows.

    First the rows of a block are linked, in two cuts into blocks by different hashes, which takes a multiple of the rows.
    A row of the largest component needs no more among its own: only the others are compared with all rows, in
    blocks, which give the components that they join and no pairs.
    """
    rows = _kept(df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")))
    ids, n = rows.select("id"), rows.count()
    usable = rows.where(F.col("v").isNotNull())
    blocks = max(1, -(-n // BLOCK))

    def inside(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        x, own = _matrix(f, "v"), f["id"].to_numpy()
        low = np.arange(len(own))
        for i in range(0, len(own), 512):
            row, at = _within(x[i : i + 512], x[i:], height)
            low = _joined(len(own), np.concatenate([low[row + i], np.arange(len(own))]), np.concatenate([low[at + i], low]))
        return pd.DataFrame({"src": own, "dst": own[low]})

    cuts = [usable.withColumn("_b", F.pmod(F.xxhash64("id", F.lit(c)), F.lit(blocks)).cast("int")).groupBy("_b").applyInPandas(inside, "src bigint, dst bigint") for c in range(2 if blocks > 1 else 1)]
    stars = cuts[0].union(cuts[1]) if len(cuts) > 1 else cuts[0]
    found = components(_both(_kept(stars.where("src <> dst"))), ids)
    if blocks == 1:
        return found
    most = found.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", "component"))).first()[0]
    labelled = _kept(usable.join(found, "id"))
    asked = labelled.where(F.col("component") != most)
    parts = -(-asked.count() // BLOCK)
    if not parts:
        return found

    def across(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["_ask"]], f[~f["_ask"]]
        names, at = np.unique(np.concatenate([a["component"], b["component"]]).astype(np.int64), return_inverse=True)
        low, mine, other = np.arange(len(names)), at[: len(a)], at[len(a) :]
        if len(a) and len(b):
            y = _matrix(b, "v")
            for i in range(0, len(a), 512):
                row, to = _within(_matrix(a.iloc[i : i + 512], "v"), y, height)
                low = _joined(len(names), np.concatenate([mine[row + i], np.arange(len(names))]), np.concatenate([other[to], low]))
        return pd.DataFrame({"src": names, "dst": names[low]})

    dealt = lambda frame, mine, copies, ask: frame.select("id", "component", "v", F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_met"), F.lit(ask).alias("_ask"))
    sent = dealt(asked, parts, blocks, True).withColumns({"_p": F.col("_own"), "_q": F.col("_met")}).union(dealt(labelled, blocks, parts, False).withColumns({"_p": F.col("_met"), "_q": F.col("_own")}))
    more = _kept(sent.groupBy("_p", "_q").applyInPandas(across, "src bigint, dst bigint").where("src <> dst").distinct())
    names = components(_both(more), found.select(F.col("component").alias("id")).distinct())
    return found.join(names.select(F.col("id").alias("component"), F.col("component").alias("_c")), "component").select("id", F.col("_c").alias("component"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def single_linkage(df: DataFrame, key: str, vec: str, edges: DataFrame | None = None, clusters: int | None = None, height: float | None = None, name: str = "cluster") -> DataFrame:
    """Rows with the smallest key of their cluster: single linkage, cut at a height or into a number of
    clusters (the tree's longest edges, ties by keys, are cut). A height alone needs no tree and no ``edges``."""
    if clusters is None and height is not None:
        found = linked_within(df, key, vec, height)
        return df.join(found.select(F.col("id").alias(key), F.col("component").alias(name)), key)
    return cut(df, key, spanning_tree(df, key, vec, edges, height), clusters, height, name)


def cut(df: DataFrame, key: str, tree: DataFrame, clusters: int | None = None, height: float | None = None, name: str = "cluster") -> DataFrame:
    """Rows with the smallest key of their part of a spanning tree, of which edges are cut."""
    if clusters is not None:
        longest = tree.orderBy(F.desc("dist"), F.desc("src"), F.desc("dst")).limit(clusters - 1)
        tree = tree.join(F.broadcast(longest), ["src", "dst", "dist"], "left_anti")
    if height is not None:
        tree = tree.where(F.col("dist") <= height)
    ids = df.select(F.col(key).cast("long").alias("id"))
    found = components(_kept(tree.select("src", "dst").union(tree.select("dst", "src"))), ids)
    return df.join(found.select(F.col("id").alias(key), F.col("component").alias(name)), key)


def cluster_sizes(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(rank, n): the sizes of clusters from the largest."""
    sizes = labels.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.select(F.row_number().over(Window.orderBy(F.desc("n"), cluster)).alias("rank"), "n")

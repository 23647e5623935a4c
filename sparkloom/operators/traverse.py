"""Graph traversal as rounds of joins (T-core, T1-T10, G12).

A round joins its frontier with the edges. A frontier of few bytes is broadcast, so that the edges are only scanned; for a
larger one the edges are bucketed by their start, once, heavy starts salted over several buckets. What was met lies in one
table bucketed by (origin, node), to which every round appends: a round shuffles what it finds, nothing it found before, a
lost executor costs one round, and no plan grows with their number. The driver sees two numbers a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkloom.sources.shared import append_bucketed, bucketed, written

#: Characters of a frontier up to which it is broadcast.
BROADCAST_CHARS = 16 << 20


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Graph:
    """Edges ``(src, dst, kind)`` with string ends; repeated edges are kept, those without an end left out.

    ``heavy``: edges of one start from which it is spread over several buckets.
    """

    def __init__(self, edges: DataFrame, heavy: int = 1_000_000):
        self.spark, self.heavy = edges.sparkSession, heavy
        self._edges = edges.select("src", "dst", "kind").where("src is not null and dst is not null")
        self._table: tuple[str, DataFrame | None] | None = None

    @classmethod
    def reversed(cls, edges: DataFrame, heavy: int = 1_000_000) -> Graph:
        return cls(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"), heavy)

    def edges(self, kinds: list[str] | None = None) -> DataFrame:
        return self._edges if kinds is None else self._edges.where(F.col("kind").isin(*kinds))

    def _bucketed(self) -> tuple[str, DataFrame | None]:
        """The edges' table, and the number of parts of each heavy start (none if no start is heavy)."""
        if self._table is None:
            counts = self._edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.heavy)
            heavy = written(counts.select("src", F.ceil(F.col("n") / self.heavy).cast("int").alias("parts")), "heavy")
            rows, heavy = (self._edges.withColumn("part", F.lit(0)), None) if heavy.isEmpty() else (self._edges, heavy)
            if heavy is not None:  # at most one row for ``self.heavy`` edges
                part = F.pmod(F.xxhash64("dst", "kind"), F.coalesce("parts", F.lit(1))).cast("int")
                rows = rows.join(F.broadcast(heavy), "src", "left").withColumn("part", part).drop("parts")
            self._table = bucketed(rows, "graph", ["src", "part"], _buckets(self.spark)), heavy
        return self._table

    def leaving(self, frontier: DataFrame, chars: int, kinds: list[str] | None = None, fan_out: int | None = None) -> DataFrame:
        """The frontier's rows (``src`` and others, of ``chars`` characters in all) with the edges that leave them.

        ``fan_out``: only the first so many edges of each start in the order (kind, dst).
        """
        near = chars <= BROADCAST_CHARS
        if near:
            edges, frontier, on = self.edges(kinds), F.broadcast(frontier), ["src"]
        else:
            name, heavy = self._bucketed()
            edges, on = self.spark.table(name), ["src", "part"]
            edges = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
            if heavy is not None:
                parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
                frontier = frontier.join(F.broadcast(heavy), "src", "left").withColumn("part", F.explode(parts)).drop("parts")
            else:
                frontier = frontier.withColumn("part", F.lit(0))
        if fan_out:
            if near:
                edges = edges.join(F.broadcast(frontier.select("src").distinct()), "src", "left_semi")
            rank = F.row_number().over(Window.partitionBy("src").orderBy("kind", "dst"))
            edges = edges.withColumn("_rank", rank).where(F.col("_rank") <= fan_out).drop("_rank")
        return frontier.join(edges, on)


def _size(rows: DataFrame) -> tuple[int, int]:
    """Rows and characters of a round."""
    n, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("origin") + F.length("node"))).first()
    return n, chars or 0


def reach(
    graph: Graph,
    starts: DataFrame,
    max_steps: int,
    kinds: list[str] | None = None,
    blocked: DataFrame | None = None,
    fan_out: int | None = None,
    max_nodes: int | None = None,
    together: bool = False,
    barred: DataFrame | None = None,
) -> DataFrame:
    """``(origin, node, depth, parent, kind)``: nodes within ``max_steps`` edges of each start, by breadth-first rounds.

    ``starts``, ``blocked`` and ``barred`` have a column ``node``. Blocked nodes are reached but not left (sanitizers), barred
    ones not reached. A node's parent is the smallest ``(kind, node)`` of the round before. With ``max_nodes`` the rounds end
    once an origin's nodes together reach it; the last round is kept whole. ``together``: all starts are one origin, ``*``; a
    node is met once, however many starts lead to it. Starts are in the result at depth 0, known to the graph or not.
    """
    spark = graph.spark
    first = starts.select((F.lit("*") if together else F.col("node")).alias("origin"), "node").where("node is not null").distinct()
    first = first.select("origin", "node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("depth"))
    keys, buckets = ["origin", "node"], _buckets(spark)
    met = bucketed(first, "reach", keys, buckets, "depth")
    total = 0
    for step in range(1, max_steps + 1):
        frontier = spark.table(met).where(F.col("depth") == step - 1)
        count, chars = _size(frontier)
        total += count if step > 1 else 0
        if not count or (max_nodes and total >= max_nodes):
            break
        frontier = frontier.select("origin", F.col("node").alias("src"))
        if blocked is not None:
            frontier = frontier.join(blocked.select(F.col("node").alias("src")), "src", "left_anti")
        found = graph.leaving(frontier, chars, kinds, fan_out).groupBy("origin", F.col("dst").alias("node")).agg(F.min(F.struct("kind", "src")).alias("by"))
        if barred is not None:
            found = found.join(barred.select("node"), "node", "left_anti")
        new = found.join(spark.table(met).select(*keys), keys, "left_anti")
        new = new.select("origin", "node", F.col("by.src").alias("parent"), F.col("by.kind").alias("kind"), F.lit(step).alias("depth"))
        append_bucketed(new, met, keys, buckets, "depth")
    return spark.table(met).select("origin", "node", "depth", "parent", "kind")


def reached_targets(
    edges: DataFrame, starts: DataFrame, targets: DataFrame, max_steps: int, kinds: list[str] | None = None, blocked: DataFrame | None = None
) -> DataFrame:
    """``(start, target, depth)``: which targets each start reaches, over how many edges, and not through a blocked node.

    The search goes from the side with fewer nodes, so that pairs are kept of that side only; a target or start met on the
    way is one more node, no end. A start that is a target reaches itself at depth 0.
    """
    ends = [written(side.select("node").where("node is not null").distinct(), "ends") for side in (starts, targets)]
    if ends[0].count() <= ends[1].count():
        found = reach(Graph(edges), ends[0], max_steps, kinds, blocked)
        return found.join(ends[1], "node", "left_semi").select(F.col("origin").alias("start"), F.col("node").alias("target"), "depth")
    # Against the edges: what may not be left is not reached at all.
    found = reach(Graph.reversed(edges), ends[1], max_steps, kinds, barred=blocked)
    return found.join(ends[0], "node", "left_semi").select(F.col("node").alias("start"), F.col("origin").alias("target"), "depth")


def paths(found: DataFrame, targets: DataFrame) -> DataFrame:
    """``(origin, node, path)``: the nodes from the origin to each target ``(origin, node)`` that ``reach`` found.

    All paths go back together, one edge a round, along the parents.
    """
    steps = found.select("origin", F.col("node").alias("at"), "parent")
    goal = targets.select("origin", "node").distinct()
    level = goal.join(found.select("origin", "node"), ["origin", "node"], "left_semi").select("origin", "node", F.col("node").alias("at"), F.array("node").alias("path"))
    done = []
    while True:
        level = written(level.join(steps, ["origin", "at"]), "paths")
        done.append(level.where("parent is null").select("origin", "node", "path"))
        level = level.where("parent is not null")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level = level.select("origin", "node", F.col("parent").alias("at"), F.concat(F.array("parent"), "path").alias("path"))


def path_to(found: DataFrame, target: str) -> list[str]:
    """Nodes of the shortest path to one target, of its smallest origin; none if it was not found."""
    best = found.where(F.col("node") == target).orderBy("depth", "origin").limit(1)
    at = paths(found, best).first()
    return at["path"] if at else []


def expand(graph: Graph, starts: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """``(level, src, dst, kind)``: edges met layer by layer, duplicates included."""
    layer, layers = written(starts.select(F.col("node").alias("src")).where("node is not null").distinct(), "expand"), []
    for level in range(1, depth + 1):
        chars = layer.agg(F.sum(F.length("src"))).first()[0] or 0
        met = written(graph.leaving(layer, chars, kinds).select(F.lit(level).alias("level"), "src", "dst", "kind"), "expand")
        layers.append(met)
        layer = met.select(F.col("dst").alias("src")).distinct()
        if level < depth:
            layer = written(layer, "expand")
    return reduce(DataFrame.unionByName, layers)


def first_nodes(found: DataFrame, limit: int) -> DataFrame:
    """Exactly the first ``limit`` nodes in the order (depth, node)."""
    return found.orderBy("depth", "node").limit(limit)

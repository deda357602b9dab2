"""Rank and reachability over edges (caller, callee).

The loops run on the driver, one round a step; each round's state is written to
the shared checkpoint folder, so that plans stay short and lost executors cost one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(direction, id) of one node."""
    down = edges.filter(F.col("caller") == node).select(F.lit("callee").alias("direction"), F.col("callee").alias("id"))
    return down.unionByName(edges.filter(F.col("callee") == node).select(F.lit("caller").alias("direction"), F.col("caller").alias("id")))


def pagerank(nodes: DataFrame | None, edges: DataFrame, damping: float = 0.85, rounds: int = 30, every: int = 5) -> DataFrame:
    """(id, rank): ranks sum to 1; what nodes without callees hold is spread evenly; repeated edges count.

    Without ``nodes`` they are the ends of the edges. Nodes that nobody calls have
    one rank in every round: what they give each callee, as a share of it, is summed
    once, and the rounds go over the other nodes and the edges between those.
    """
    known = edges.select("caller", "callee")
    if nodes is not None:
        ids = nodes.select("id").distinct()
        known = known.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")
    known = cut(known)
    out = known.groupBy("caller").agg(F.count("callee").alias("degree"))
    called = known.groupBy("callee").agg((F.count("caller") > 0).alias("called"))
    ends = out.join(called, F.col("caller").eqNullSafe(F.col("callee")), "full_outer")
    ends = ends.select(F.coalesce("caller", "callee").alias("id"), F.when(F.col("caller").isNotNull() & (F.col("degree") > 0), F.col("degree")).alias("degree"), (F.col("callee").isNotNull() & F.coalesce("called", F.lit(False))).alias("called"))
    if nodes is not None:
        ends = ids.join(ends, "id", "left").withColumn("called", F.coalesce("called", F.lit(False)))
    ends = cut(ends)
    n, lone = ends.agg(F.count("*"), F.count_if(~F.col("called") & F.col("degree").isNull())).first()
    givers = ends.filter("degree is not null").select(F.col("id").alias("caller"), "degree", "called")
    shares = known.join(givers, "caller").groupBy(F.when(F.col("called"), F.col("caller")).alias("caller"), "callee").agg(F.sum(1 / F.col("degree")).alias("share")).filter("callee is not null")
    shares = cut(shares)
    links = shares.filter("caller is not null")
    fed = shares.filter("caller is null").select(F.col("callee").alias("id"), F.col("share").alias("fed"))
    # the row without an id stands for all nodes that nobody calls; ``loose`` is how many nodes of a row have no callees
    state = ends.filter("called").join(fed, "id", "left").select("id", F.coalesce("fed", F.lit(0.0)).alias("fed"), F.when(F.col("degree").isNull(), 1).otherwise(0).cast("long").alias("loose"))
    state = state.unionByName(ends.sparkSession.range(1).select(F.lit(None).cast(ends.schema["id"].dataType).alias("id"), F.lit(0.0).alias("fed"), F.lit(lone).cast("long").alias("loose")))
    state = cut(state.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for k in range(rounds):
        given = links.join(state.select(F.col("id").alias("caller"), "rank"), "caller").groupBy(F.col("callee").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        whole = state.agg(F.sum(F.col("loose") * F.col("rank")).alias("held"), F.max(F.when(F.col("id").isNull(), F.col("rank"))).alias("own"))
        rank = (1 - damping) / max(n, 1) + damping * (F.coalesce("given", F.lit(0.0)) + F.col("fed") * F.col("own") + F.col("held") / max(n, 1))
        state = state.drop("rank").join(given, "id", "left").crossJoin(F.broadcast(whole)).select("id", "fed", "loose", rank.alias("rank"))
        if (k + 1) % every == 0:
            state = cut(state)
    uncalled = ends.filter(~F.col("called")).select("id").crossJoin(F.broadcast(state.filter("id is null").select("rank")))
    return state.filter("id is not null").select("id", "rank").unionByName(uncalled)


#: Bytes of ids up to which a frontier is sent to the workers; a larger one is joined by shuffling.
SENT_BYTES = 8 << 20


def _weight(ids: DataFrame) -> tuple[int, int]:
    """Rows, and the bytes that their ids take at most."""
    n, size = ids.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id") + 16), F.lit(0))).first()
    return n, size


def _expand(seen: DataFrame, frontier: DataFrame, size: int, edges: DataFrame, depth: int) -> DataFrame:
    frontier = frontier.select(F.col("id").alias("callee"))
    found = edges.join(F.broadcast(frontier) if size <= SENT_BYTES else frontier, "callee").groupBy(F.col("caller").alias("id")).agg(F.min("callee").alias("via"))
    return cut(found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "via"))


def callers(edges: DataFrame, seeds: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """(id, depth, via): who reaches a seed within ``depth`` steps, each once, by the least discoverer.

    With a budget the search ends with the round that reaches it, and the first rows by (depth, id) stay.
    """
    frontier = cut(seeds.select("id").distinct())
    seen = frontier.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    found, (_, size) = 0, _weight(frontier)
    edges = cut(edges.select("caller", "callee")) if depth > 1 else edges
    for d in range(1, max(1, depth) + 1):
        frontier = _expand(seen, frontier, size, edges, d)
        n, size = _weight(frontier)
        seen, found = seen.unionByName(frontier), found + n
        if not n or budget is not None and found >= budget:
            break
    out = seen.filter("depth > 0")
    return out if budget is None else out.orderBy("depth", "id").limit(budget)


def dirty_set(edges: DataFrame, changed: DataFrame, fold_changed: DataFrame) -> DataFrame:
    """(id): the changed, and callers of what is dirty and has a changed fold, until nothing is added."""
    open_ids = fold_changed.select("id").distinct()
    frontier = cut(changed.select("id").distinct())
    seen, depth = frontier.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")), 0
    edges, (_, size) = cut(edges.select("caller", "callee")), _weight(frontier)
    while True:
        depth += 1
        frontier = _expand(seen, frontier.join(open_ids, "id", "left_semi"), size, edges, depth)
        n, size = _weight(frontier)
        if not n:
            return seen.select("id")
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen)

"""Shards of nearly equal size along a key order, by sampled splitters.

Records are ordered by source, then id. Sample points are drawn in proportion to
size (a key gets the whole part of its size over the sampling interval, and one
more with the fraction's probability, by a hash). Boundaries are the sample's
quantiles. Ranges that still hold more than LIMIT times the target are divided at
the keys where the exact running size passes multiples of it. Every record then
goes to the shard of its range, one partition (and file) a shard, sorted.

A record's size is the bytes of its text and RECORD_BYTES. Records with one key
that together exceed a quarter of the target are parted, by a hash of position
and text, into keys of at most about that size each.

Defined cases: null texts have size RECORD_BYTES; null sources and ids come
first. Rows without an id are ordered by their text's MD5 too. Rows with an equal
key stay together unless the key is parted. A record above the target has a shard
that may exceed it. An empty table gives no rows. Columns pass unchanged in the
struct ``row`` beside the shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, row_of, table, uniform

TARGET_BYTES = 16 << 20
RECORD_BYTES = 64
SAMPLES_PER_SHARD = 64
LIMIT = 1.25
SEED = "shard-1"
#: Parts of a crowded key hold about the target over this.
PARTS = 4
_KEY = ("k1", "k2", "k3")
_ALL = (*_KEY, "k4")


def _keys(source: Column, doc_id: Column, text: Column) -> list[Column]:
    return [source.cast("string").alias("k1"), doc_id.cast("long").alias("k2"), F.when(doc_id.isNull(), F.md5(text.cast("binary"))).alias("k3")]


def _order(names=_ALL) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in names]


def _tail(k2: np.ndarray, has2: np.ndarray, k3: list, k4: np.ndarray) -> np.ndarray:
    """Id, MD5 and part as byte strings whose order is the keys'."""
    out = np.zeros((len(k2), 5), ">u8")
    out[:, 0] = has2
    out[:, 1] = np.where(has2, k2, 0).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    for i in np.flatnonzero(~has2):
        if k3[i] is not None:
            out[i, 2], out[i, 3] = int(k3[i][:16], 16), int(k3[i][16:], 16)
    out[:, 4] = k4
    return out.view("S40").reshape(-1)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.fill_null(0)), np.asarray(column.is_valid())


class Splitters:
    """Sorted boundary keys; a record belongs after those that are below its own."""

    def __init__(self, points: list[tuple]):
        points = sorted(set(points), key=lambda p: (p[0] is not None, p[0] or ""))
        tails = _tail(np.array([p[1] or 0 for p in points], np.int64), np.array([p[1] is not None for p in points], bool), [p[2] for p in points], np.array([p[3] for p in points], np.int64))
        places = [(p[0] is not None, p[0] or "") for p in points]
        order = sorted(range(len(points)), key=lambda i: (places[i], tails[i].ljust(40, b"\0")))
        self.sources, self.tails = [places[i] for i in order], tails[order] if len(order) else tails

    def __len__(self) -> int:
        return len(self.sources)

    def below(self, k1: pa.Array, k2: pa.Array, k3: pa.Array, k4: pa.Array) -> np.ndarray:
        """Number of boundaries below each key."""
        coded = k1.dictionary_encode(null_encoding="encode")
        which, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        tails = _tail(*_ids(k2), k3.to_pylist() if k2.null_count else [], np.asarray(k4))
        out = np.zeros(len(which), np.int32)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(names) + 1))
        for n, name in enumerate(names):
            own = order[bounds[n] : bounds[n + 1]]
            place = (name is not None, name or "")
            lo, hi = bisect_left(self.sources, place), bisect_right(self.sources, place)
            out[own] = lo + np.searchsorted(self.tails[lo:hi], tails[own], "left") if hi > lo else lo
        return out

    def column(self) -> Column:
        @F.arrow_udf("int")
        def ranges(k1: pa.Array, k2: pa.Array, k3: pa.Array, k4: pa.Array) -> pa.Array:
            return pa.array(self.below(k1, k2, k3, k4), pa.int32())

        return ranges(*_ALL)


def _running(drawn: DataFrame) -> DataFrame:
    """Adds upto, the sum of times up to each key: sums within key ranges, and those of the ranges before."""
    parts = cut(drawn.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, times in parts.groupBy("part").agg(F.sum("times")).orderBy("part").collect():
        offsets.append((part, before))
        before += times
    starts = drawn.sparkSession.createDataFrame(offsets, "part int, before long")
    within = F.sum("times").over(Window.partitionBy("part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(starts), "part").withColumn("upto", F.col("before") + within)


def plan(docs: DataFrame, target: int = TARGET_BYTES) -> tuple[Splitters, DataFrame]:
    """The boundaries, one a shard, kept on the driver; and (k1, k2, k3, parts) of crowded keys, fewer than PARTS a shard."""
    size = (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + RECORD_BYTES).cast("long")
    rows = docs.select(*_keys(F.col("source"), F.col("doc_id"), F.col("text").cast("string")), size.alias("size"))
    keys = rows.groupBy(*_KEY).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    parts = F.when((F.col("n") > 1) & (F.col("size") * PARTS > target), F.least("n", F.ceil(F.col("size") * PARTS / F.lit(float(target))))).otherwise(1).cast("int")
    keys = cut(keys.withColumn("parts", parts))
    crowded = keys.filter("parts > 1").select(*_KEY, "parts")
    keys = keys.select(*_KEY, "size", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k4")).withColumn("size", F.expr("size * (k4 + 1) DIV parts - size * k4 DIV parts"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // target))
    interval = total / (shards * SAMPLES_PER_SHARD)
    u = F.when(F.col("parts") > 1, uniform(SEED, *map(F.col, _ALL))).otherwise(uniform(SEED, *map(F.col, _KEY)))
    drawn = keys.withColumn("times", F.floor(F.col("size") / F.lit(interval or 1.0) + u).cast("long")).filter("times > 0").select(*_ALL, "times")
    whole = drawn.agg(F.sum("times")).first()[0] or 1
    at = _running(drawn)
    chosen = at.filter(F.expr(f"upto * {shards} DIV {whole} > (upto - times) * {shards} DIV {whole} AND upto < {whole}"))
    points = [tuple(r) for r in chosen.select(*_ALL).collect()]
    within = keys.withColumn("range", Splitters(points).column())
    overfull = within.groupBy("range").agg(F.sum("size").alias("all")).filter(F.col("all") > LIMIT * target)
    inside = within.join(overfull, "range").select("range", *_ALL, "size")
    w = Window.partitionBy("range").orderBy(*_order())
    run = inside.withColumn("after", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("piece", F.expr(f"(after - size) DIV {target}")).withColumn("next", F.lead("piece").over(w))
    return Splitters([*points, *(tuple(r) for r in run.filter("next > piece").select(*_ALL).collect())]), crowded


def shard(docs: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(shard, row), each shard one sorted partition."""
    splitters, crowded = plan(docs, target)
    rows = row_of(docs)
    rows = rows.select("row", *_keys(F.col("row.source"), F.col("row.doc_id"), F.col("row.text").cast("string")))
    if crowded.isEmpty():
        rows = rows.withColumn("k4", F.lit(0))
    else:
        known = crowded.select(*(F.col(k).alias(f"of_{k}") for k in _KEY), "parts")
        there = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in _KEY]
        rows = rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(known), there, "left")
        part = F.floor(uniform(SEED, F.col("place"), F.xxhash64("row.text")) * F.coalesce("parts", F.lit(1))).cast("int")
        rows = cut(rows.select("row", *_KEY, part.alias("k4")))  # written, as a task that runs again may number its rows otherwise
    rows = rows.withColumn("shard", splitters.column())
    return rows.repartitionById(len(splitters) + 1, "shard").sortWithinPartitions("shard", *_order()).select("shard", "row")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents in shards of TARGET_BYTES."""
    return shard(table(spark, sf_dir, "documents")).select("shard", "row.*")


QUERIES = {"op10_sampled_splitters": op10}
SQL = {
    "op10_sampled_splitters": f"""
WITH keys AS (
  SELECT row_number() OVER () AS r, source AS k1, doc_id AS k2, CASE WHEN doc_id IS NULL THEN md5(text) END AS k3,
         coalesce(strlen(text), 0) + {RECORD_BYTES} AS size, *
  FROM documents
), totals AS (
  SELECT sum(size)::BIGINT AS total, greatest(1, ceil(sum(size) / {TARGET_BYTES}.0)::BIGINT) AS shards FROM keys
), drawn AS (
  SELECT k1, k2, k3, sum(floor(size / (total / (shards * {SAMPLES_PER_SHARD})::DOUBLE)
           + ('0x' || substr(md5('{SEED}|' || coalesce(k1, '') || '|' || coalesce(k2::VARCHAR, '') || '|' || coalesce(k3, '')), 1, 13))::BIGINT / 4503599627370496.0)::BIGINT)::BIGINT AS times
  FROM keys, totals GROUP BY k1, k2, k3 HAVING times > 0
), run AS (
  SELECT *, sum(times) OVER (ORDER BY k1 NULLS FIRST, k2 NULLS FIRST, k3 NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
         (sum(times) OVER ())::BIGINT AS whole FROM drawn
), points AS (
  SELECT k1, k2, k3 FROM run, totals WHERE upto * shards // whole > (upto - times) * shards // whole AND upto < whole
), placed AS (
  SELECT 0 AS kind, NULL AS size, k1, k2, k3 FROM points
  UNION ALL SELECT DISTINCT 1, sum(size) OVER (PARTITION BY k1, k2, k3), k1, k2, k3 FROM keys
), ranged AS (
  SELECT *, coalesce(count_if(kind = 0) OVER (ORDER BY k1 NULLS FIRST, k2 NULLS FIRST, k3 NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS rng FROM placed
), inside AS (
  SELECT *, sum(size) OVER (PARTITION BY rng) AS held,
         sum(size) OVER (PARTITION BY rng ORDER BY k1 NULLS FIRST, k2 NULLS FIRST, k3 NULLS FIRST ROWS UNBOUNDED PRECEDING) AS after_it
  FROM ranged WHERE kind = 1
), pieces AS (
  SELECT *, CASE WHEN held > {LIMIT} * {TARGET_BYTES} THEN ((after_it - size) // {TARGET_BYTES})::BIGINT ELSE 0 END AS piece FROM inside
), numbered AS (
  SELECT k1, k2, k3, dense_rank() OVER (ORDER BY rng, piece) - 1 AS shard FROM pieces
)
SELECT n.shard::INTEGER AS shard, d.doc_id, d.text, d.lang, d.source, d.n_chars
FROM keys d JOIN numbered n ON d.k1 IS NOT DISTINCT FROM n.k1 AND d.k2 IS NOT DISTINCT FROM n.k2 AND d.k3 IS NOT DISTINCT FROM n.k3
""",
}

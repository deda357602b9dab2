"""Mixing of sources to target weights by Poisson replication.

A source's share of the mixture is its weight over the sum of the weights of the
sources present; its repetition rate is the share times all characters over its
own. Each document is repeated by the inverse, at a uniform number hashed from
seed and id, of the Poisson distribution with that mean, and the copies are
shuffled globally by another hash.

The distribution is tabled within ten standard deviations (and 40) of its mean;
what lies outside is less than the 52 bits of the uniform number can tell.

Defined cases: sizes are taken from n_chars, a null or negative one counting as
0. If a source has no characters its rate is 1. A null source is a source of its
own, with the default weight. A row without an id is drawn by its text's MD5.
Rows that share an id, or lack one, draw by their position as well, so that they
aren't all repeated alike; the table is then written once, positions with it. A
rate above MAX_RATE copies a document is a ValueError that names the
source: its weight asks for more than replication can give. Null, empty and long
texts pass unchanged. Equal shuffle keys are ordered by id. An empty table gives
no rows. The copies have the input's columns; ``replicate`` adds its own beside
the struct ``row``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, row_of, table, uniform, unrow

SEED = "mix-1"
#: Relative weights; sources that aren't named have DEFAULT_WEIGHT.
WEIGHTS = {"src0": 2.0}
DEFAULT_WEIGHT = 1.0
#: Most copies of a document that a weight may ask for.
MAX_RATE = 1e6
#: The rates' tables are broadcast up to so many numbers, 32 MB, else joined by shuffling; so are the keys of repeated rows.
BROADCAST_NUMBERS = 4_000_000
BROADCAST_KEYS = 500_000


def poisson_table(rate: float) -> tuple[int, np.ndarray]:
    """(k, probabilities of at most k, k + 1, k + 2… copies) around the mean; below k there is nothing that a draw can meet."""
    if not rate > 0:
        return 0, np.ones(1)
    wide = 10 * math.sqrt(rate) + 40
    low, high = max(0, math.floor(rate - wide)), math.ceil(rate + wide)
    steps = math.log(rate) - np.log(np.arange(low + 1, high + 1, dtype=np.float64))
    first = low * math.log(rate) - rate - math.lgamma(low + 1)
    return low, np.cumsum(np.exp(first + np.concatenate([[0.0], np.cumsum(steps)])))


def _tables(rates: pa.Array) -> pa.Array:
    made = [poisson_table(r) for r in rates.to_pylist()]
    return pa.array([{"low": low, "cdf": cdf} for low, cdf in made], pa.struct([("low", pa.int32()), ("cdf", pa.list_(pa.float64()))]))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT) -> DataFrame:
    """(source, rate): the mean number of copies."""
    weights = WEIGHTS if weights is None else weights
    size = F.sum(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    per = docs.groupBy(F.col("source").cast("string").alias("source")).agg(size.alias("size"))
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = per.withColumn("weight", weight)
    total = per.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("size") > 0, F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).otherwise(1.0)
    return per.crossJoin(total).select("source", rate.alias("rate"))


def _identity(doc_id: Column, text: Column) -> Column:
    """What a row is drawn by: its id, or its text's MD5."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def _drawn(docs: DataFrame, seed: str, broadcast_keys: int) -> DataFrame:
    """(row, mark): the draw's identity of each row, with a position where its id, or its lack of one, occurs again."""
    rows = row_of(docs).withColumn("mark", _identity(F.col("row.doc_id"), F.col("row.text")))
    twice = cut(docs.groupBy(F.col("doc_id").cast("string").alias("again")).agg(F.count("*").alias("c")).filter("c > 1").select("again", F.lit(True).alias("found")))
    n = twice.count()
    if not n:
        return rows
    placed = cut(rows.withColumn("place", F.monotonically_increasing_id()))  # written, as a task that runs again may number its rows otherwise
    held = placed.join(F.broadcast(twice) if n <= broadcast_keys else twice, F.col("row.doc_id").cast("string").eqNullSafe(F.col("again")), "left")
    return held.select("row", F.when(F.col("found"), F.concat_ws("#", "mark", F.col("place").cast("string"))).otherwise(F.col("mark")).alias("mark"))


def replicate(docs: DataFrame, rates: DataFrame, seed: str = SEED, broadcast_numbers: int = BROADCAST_NUMBERS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(row, rate, copy, shuffle_key), globally shuffled; ``rates`` from repetition_rates."""
    rates = cut(rates)
    known = rates.agg(F.sum(20 * F.sqrt(F.least("rate", F.lit(MAX_RATE))) + 82).alias("numbers"), F.max("rate").alias("most"), F.max_by("source", "rate").alias("source")).first()
    if known["most"] is not None and known["most"] > MAX_RATE:
        raise ValueError(f"the weights ask for {known['most']:.3g} copies of each document of source {known['source']!r}; at most {MAX_RATE:.0e} are made")
    tables = rates.select(F.col("source").alias("rated_source"), "rate", F.arrow_udf(_tables, "struct<low:int,cdf:array<double>>")("rate").alias("t")).select("rated_source", "rate", "t.low", "t.cdf")
    if (known["numbers"] or 0) <= broadcast_numbers:
        tables = F.broadcast(tables)
    drawn = _drawn(docs, seed, broadcast_keys).join(tables, F.col("row.source").cast("string").eqNullSafe(F.col("rated_source")))
    copies = F.col("low") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    drawn = drawn.withColumn("u", uniform(seed, F.col("mark"))).select("row", "mark", "rate", copies.alias("n")).filter("n > 0")
    out = drawn.select("row", "mark", "rate", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    out = out.withColumn("shuffle_key", uniform(seed, "shuffle", F.col("mark"), F.col("copy")))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "mark").select("row", "rate", "copy", "shuffle_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """The shuffled copies with the documents' columns."""
    return unrow(replicate(docs, repetition_rates(docs, weights), seed), docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, mixed to WEIGHTS and shuffled."""
    docs = table(spark, sf_dir, "documents")
    out = replicate(docs, repetition_rates(docs))
    return out.select("row.doc_id", "row.text", "row.lang", "row.source", "row.n_chars", "copy", F.round("rate", 6).alias("rate"), "shuffle_key")


QUERIES = {"op3_poisson_mixture": op3}
SQL = {
    "op3_poisson_mixture": f"""
WITH per AS (
  SELECT source, sum(greatest(coalesce(n_chars, 0), 0))::DOUBLE AS size,
         CASE WHEN source = 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM documents GROUP BY source
), rated AS (
  SELECT source, CASE WHEN size > 0 THEN weight / sum(weight) OVER () * sum(size) OVER () / size ELSE 1.0 END AS rate
  FROM per
), steps AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 40)::BIGINT + 1)) AS j FROM rated
), cdf AS (
  SELECT source, rate, j, sum(exp(j * ln(rate) - rate - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS p FROM steps
), tables AS (
  SELECT source, rate, list(p ORDER BY j) AS ps FROM cdf GROUP BY source, rate
), drawn AS (
  SELECT d.*, t.rate,
         len(list_filter(t.ps, lambda p: p <= ('0x' || substr(md5('{SEED}|' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, round(rate, 6) AS rate,
       ('0x' || substr(md5('{SEED}|shuffle|' || doc_id || '|' || copy), 1, 13))::BIGINT / 4503599627370496.0 AS shuffle_key
FROM copies
""",
}

"""First-wins rows, top rows of groups, pages and interleaved rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in the order; map-side combined, without a sort."""
    struct = F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.struct(*order))
    return df.groupBy(*keys).agg(struct.alias("_first")).select(*keys, "_first.*")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def page_slice(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """Rows offset+1 to offset+size of the order, with the total; only offset+size rows are sorted in full."""
    head = df.orderBy(*order).limit(offset + size)
    ranked = head.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    total = df.agg(F.count("*").alias("total"))
    return ranked.filter(F.col("position") > offset).crossJoin(F.broadcast(total))


def interleave(legs: list[tuple[DataFrame, list]], k: int) -> DataFrame:
    """Legs of equal columns merged by rank, then leg; the first k rows."""
    out = None
    for i, (leg, order) in enumerate(legs):
        head = leg.orderBy(*order).limit(k)
        part = head.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("leg", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("rank", "leg").limit(k)


def next_start(df: DataFrame, keys: list[str], order: list, line: str, last: Column) -> DataFrame:
    """Adds ``end``: the line before the next row's, or ``last``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("end", F.coalesce(F.lead(line).over(w) - 1, last))


def spans_distinct(df: DataFrame, path: str, line: str, last: Column) -> DataFrame:
    """Rule A: to the next distinct start; rows on one line share the span."""
    starts = df.select(path, line).distinct()
    ends = next_start(starts, [path], [F.col(line)], line, F.lit(None)).withColumnRenamed("end", "_next")
    out = df.join(ends, [path, line])
    return out.withColumn("end", F.greatest(F.coalesce("_next", last), F.col(line))).drop("_next")


def spans_bodies(df: DataFrame, path: str, line: str, order: list, last: Column) -> DataFrame:
    """Rule B: to the next element; the first of twins has an empty body, which starts after its line."""
    return next_start(df, [path], order, line, last).withColumn("body_start", F.col(line) + 1)


def spans_blocks(df: DataFrame, path: str, line: str, order: list, last: Column) -> DataFrame:
    """Rule C: to the next element, at least the line itself, from line 1 on."""
    out = next_start(df, [path], order, line, last)
    return out.withColumn("end", F.greatest("end", line)).withColumn("start", F.greatest(F.col(line), F.lit(1)))

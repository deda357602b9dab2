"""Lexical, graph and exact-first retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import ranking, vectors


def query_tokens(query: str) -> tuple[list[str], list[str]]:
    """(all tokens, those that aren't stopwords)."""
    raw = list(dict.fromkeys(t.lower() for t in re.findall(X.ASCII_WORD, query) if len(t) > 2))
    return raw, [t for t in raw if t not in X.STOPWORDS]


def base_score(raw: list[str], tokens: list[str], name: Column, words: Column, path: Column) -> Column:
    """+5 for the name, else +3 for one of its words; +1.5 for a part of the name that is neither; +1 for a part of the path."""
    score = F.lit(0.0)
    low = F.lower(name)
    for t in raw:
        score = score + F.when(low == t, 5.0).when(F.array_contains(words, t), 3.0).otherwise(0.0)
    for t in tokens:
        score = score + F.when(low.contains(t) & (low != t) & ~F.array_contains(words, t), 1.5).otherwise(0.0)
        score = score + F.when(F.lower(path).contains(t), 1.0).otherwise(0.0)
    return score


def relevant_code(query: str, symbols: DataFrame, edges: DataFrame, ops: DataFrame | None = None, k: int = 5, words: Column | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """(id, score, precision): symbols(id, name, path, importance) by score, with ops(op_name, version) and the neighbours of the best.

    An operator's id is op:name:version. With ``summaries``(id, fold, ordinal) the
    last one of a row's id is attached as ``fold``.
    """
    raw, tokens = query_tokens(query)
    spark = symbols.sparkSession
    if not raw:
        return spark.createDataFrame([], "id string, score double, precision string")
    words = X.camel_words(F.col("name")) if words is None else words
    top = symbols.agg(F.max("importance").alias("top"))
    scored = symbols.crossJoin(F.broadcast(top)).withColumn("base", base_score(raw, tokens, F.col("name"), words, F.col("path"))).filter("base > 0")
    share = F.when(F.col("top") > 0, F.col("importance") / F.col("top")).otherwise(F.col("importance"))
    lexical = scored.select("id", (F.col("base") + 2 * share).alias("score"), F.when(F.col("base") >= 5, "exact").otherwise("partial").alias("precision"))
    best = lexical.orderBy(F.desc("score"), "id").limit(3).select(F.col("id").alias("hit"))
    around = []
    for near, far in (("caller", "callee"), ("callee", "caller")):
        found = edges.join(F.broadcast(best), F.col(near) == F.col("hit")).select("hit", F.col(far).alias("id")).distinct()
        around.append(ranking.top_per_group(found, ["hit"], ["id"], 5).select("id"))
    expanded = around[0].unionByName(around[1]).distinct().select("id", F.lit(0.8).alias("score"), F.lit("expanded").alias("precision"))
    rows = lexical.unionByName(expanded)
    if ops is not None:
        low = F.lower(F.col("op_name"))
        hit = low.isin(raw)
        for t in tokens:
            hit = hit | low.contains(t)
        named = F.concat_ws(":", F.lit("op"), "op_name", "version")
        rows = rows.unionByName(ops.filter(hit).select(named.alias("id")).distinct().select("id", F.lit(4.0).alias("score"), F.lit("op").alias("precision")))
    one = rows.groupBy("id").agg(F.max_by("precision", "score").alias("precision"), F.round(F.max("score"), 6).alias("score"))
    best = one.orderBy(F.desc("score"), "id").limit(k).select("id", "score", "precision")
    if summaries is None:
        return best
    told = ranking.first_wins(summaries.filter("id is not null").select("id", "fold", "ordinal"), ["id"], [-F.col("ordinal")]).select("id", "fold")
    return best.join(told, "id", "left").orderBy(F.desc("score"), "id")


def exact_then_semantic(records: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(id, score): records(id, ticket, text) whose id or ticket is the query with score 1, if there are any; else the nearest texts."""
    q = query.strip().lower()
    exact = records.filter((F.lower("id") == q) | (F.lower("ticket") == q)).select("id", F.lit(1.0).alias("score"), F.lit(0).alias("_kind"))
    near = vectors.top_k(vectors.embed(records, "id", "text"), "id", vectors.query_vector(records, query), k).withColumn("_kind", F.lit(1))
    both = exact.unionByName(near)
    return both.withColumn("_best", F.min("_kind").over(Window.partitionBy())).filter("_kind = _best").select("id", "score")


def keyword_overlap(records: DataFrame, query: str, k: int = 3) -> DataFrame:
    """(id, score): the number of the query's words that occur in records(id, text), those with any."""
    low, score = F.lower("text"), F.lit(0)
    for w in dict.fromkeys(query.lower().split()):
        score = score + F.when(low.contains(w), 1).otherwise(0)
    return records.select("id", score.cast("double").alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def find_recipe(records: DataFrame, query: str, k: int = 3) -> DataFrame:
    """(id, score): the nearest of records(id, text); if none is near at all, those with words of the query."""
    near = vectors.top_k(vectors.embed(records, "id", "text"), "id", vectors.query_vector(records, query), k).select("id", "score", F.lit(0).alias("_kind"))
    both = near.unionByName(keyword_overlap(records, query, k).withColumn("_kind", F.lit(1)))
    return both.withColumn("_best", F.min("_kind").over(Window.partitionBy())).filter("_kind = _best").select("id", "score")


def search_semantic(legs: list[tuple[str, DataFrame, list]], k: int = 5) -> DataFrame:
    """(kind, id, score, rank, leg): (kind, rows(id, score), order) legs merged by rank, not score, as scores of different kinds don't compare."""
    named = [(rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score")), order) for kind, rows, order in legs]
    return ranking.interleave(named, k)


def hits(results: DataFrame, expect: Column) -> DataFrame:
    """Adds hit: whether id, anchor, title or name contain what is expected, whatever the case."""
    text = F.lower(F.concat_ws(" ", "id", "anchor", "title", "name"))
    return results.withColumn("hit", text.contains(F.lower(expect)))

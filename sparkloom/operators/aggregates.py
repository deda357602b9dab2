"""Reports: counts, churn, recall, coverage, votes, clusters and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def directory_counts(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(X.top_directory(F.col(path)).alias("directory")).agg(F.count("*").alias("n"))


def churn(commits: DataFrame, key: str, newest: str, author: str) -> DataFrame:
    """(key, churn, last_author, last_modified) by the newest row."""
    return commits.groupBy(key).agg(F.count("*").alias("churn"), F.max_by(author, F.struct(newest, author)).alias("last_author"), F.max(newest).alias("last_modified"))


def access_report(log: DataFrame) -> DataFrame:
    """(tool, calls, empties, empty_rate) of log(tool, empty), with a row for all tools (null)."""
    return log.groupingSets([["tool"], []], "tool").agg(
        F.count("*").alias("calls"), F.count_if("empty").alias("empties"), F.round(F.count_if("empty") / F.count("*"), 3).alias("empty_rate")
    )


def recall_report(results: DataFrame) -> DataFrame:
    """(class, n, hits, misses, rate) of results(class, id, hit), with a row for all (null)."""
    return results.groupingSets([["class"], []], "class").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.sort_array(F.collect_list(F.when(~F.col("hit"), F.col("id")))).alias("misses"), F.round(F.count_if("hit") / F.count("*"), 3).alias("rate")
    )


def lower_quantile(df: DataFrame, value: str, q: float):
    """The value of rank floor(q·(n−1)), counted from 0; None for no rows."""
    n = df.filter(F.col(value).isNotNull()).count()
    if not n:
        return None
    share = (int(q * (n - 1)) + 0.5) / n
    return df.agg(F.expr(f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY `{value}`)")).first()[0]


def coverage(symbols: DataFrame, covered_ids: DataFrame, q: float = 0.75) -> DataFrame:
    """(covered, total): symbols(id, importance) at or above the quantile, and those that are covered."""
    cutoff = lower_quantile(symbols, "importance", q)
    top = symbols.filter(F.col("importance") >= F.lit(cutoff)).select("id").join(covered_ids.select("id").distinct().withColumn("_c", F.lit(1)), "id", "left")
    return top.agg(F.count("_c").alias("covered"), F.count("*").alias("total"))


def majority(votes: DataFrame, key: str, verdict: str) -> DataFrame:
    """(key, verdict, confidence): the most frequent verdict, ties to the least."""
    counts = votes.groupBy(key, verdict).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), verdict)
    ranked = counts.withColumn("_r", F.row_number().over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(key)))
    return ranked.filter("_r = 1").select(key, verdict, F.round(F.col("n") / F.col("_all"), 6).alias("confidence"))


def faithfulness(verdicts: DataFrame, key: str = "id") -> DataFrame:
    """(key, claims, checkable, entailed, faithfulness): no-source verdicts aren't checkable."""
    checkable = F.col("verdict") != "no-source"
    return verdicts.groupBy(key).agg(F.count("verdict").alias("claims"), F.count_if(checkable).alias("checkable"), F.count_if(F.col("verdict") == "entailed").alias("entailed")).withColumn("faithfulness", F.try_divide("entailed", "checkable"))


def recurring_keywords(tokens: DataFrame, key: str, unit: str, token: str, top: int = 6, least: int = 2) -> DataFrame:
    """(key, keywords): the top tokens by number of units, those of at least ``least`` units."""
    df = tokens.select(key, unit, token).distinct().groupBy(key, token).agg(F.count("*").alias("df"))
    w = Window.partitionBy(key).orderBy(F.desc("df"), token)
    kept = df.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") <= top) & (F.col("df") >= least))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_r", token))), lambda s: s[token])
    return kept.groupBy(key).agg(ordered.alias("keywords"))


def clusters(commits: DataFrame, theme: Column, least: int = 3, files: int = 8) -> DataFrame:
    """(theme, size, evidence, files) of commits(id, file) by theme, of at least ``least``."""
    g = commits.withColumn("theme", theme).groupBy("theme").agg(F.count_distinct("id").alias("size"), F.sort_array(F.collect_set("id")).alias("evidence"), F.slice(F.sort_array(F.collect_set("file")), 1, files).alias("files"))
    return g.filter(F.col("size") >= least)


def main_theme(commits: DataFrame) -> DataFrame:
    """(id, theme): the most common two-level prefix of each commit's files, ties to the least."""
    counts = commits.select("id", F.explode("files").alias("file")).groupBy("id", X.path_prefix(F.col("file")).alias("theme")).agg(F.count("*").alias("n"))
    return counts.groupBy("id").agg(F.min_by("theme", F.struct(-F.col("n"), "theme")).alias("theme"))


def token_frequency(texts: DataFrame, column: str) -> DataFrame:
    return texts.select(F.explode(X.identifiers(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def rollup_tree(files: DataFrame, depth: int = 2) -> DataFrame:
    """(depth, key, n_files, best, best_score) of files(path, score) at every prefix length.

    Below two parts the key is (root); a file that is shorter than the depth is its own key.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    key = F.when(F.size("parts") < 2, "(root)").otherwise(F.array_join(F.slice("parts", 1, F.col("depth")), "/"))
    at = files.withColumn("parts", parts).withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn("key", key)
    return at.groupBy("depth", "key").agg(F.count("*").alias("n_files"), F.min_by("path", F.struct(-F.col("score"), "path")).alias("best"), F.max("score").alias("best_score"))

"""Joins: by two keys in order, by precedence, by enclosing interval, and what doesn't join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .ranking import first_wins


def summary_join(symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """symbols(id, path) with the fold of their own summary (the last), else of their path's (the first).

    ``summaries`` has (id, path, fold, ordinal).
    """
    own = first_wins(summaries.filter("id is not null").select(F.col("id").alias("_id"), "fold", "ordinal"), ["_id"], [-F.col("ordinal")]).select("_id", F.col("fold").alias("own_fold"))
    of_path = first_wins(summaries.filter("path is not null").select(F.col("path").alias("_path"), "fold", "ordinal"), ["_path"], [F.col("ordinal")]).select("_path", F.col("fold").alias("path_fold"))
    out = symbols.join(own, F.col("id") == F.col("_id"), "left").join(of_path, F.col("path") == F.col("_path"), "left")
    return out.withColumn("fold", F.coalesce("own_fold", "path_fold")).drop("_id", "_path", "own_fold", "path_fold")


def target_join(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """symbols(path) with the first target(name, defined_in, sources, ordinal) that lists the path."""
    sources = targets.select("name", "ordinal", "defined_in", F.explode("sources").alias("source")).filter(~F.col("source").contains("$"))
    folder = F.regexp_replace("defined_in", "[^/]*$", "")
    path = F.regexp_replace(F.regexp_replace(F.concat(folder, "source"), r"(^|/)(\./)+", "$1"), r"[^/]+/\.\./", "")
    first = first_wins(sources.select(path.alias("path"), F.col("name").alias("target"), "ordinal"), ["path"], [F.col("ordinal")]).drop("ordinal")
    return symbols.join(first, "path", "left")


def token_edges(callers: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (caller, callee): callers(id, name, body) that hold a token equal to names(id, name)."""
    tokens = callers.select(F.col("id").alias("caller"), F.col("name").alias("own"), F.explode(F.array_distinct(X.identifiers(F.col("body")))).alias("token")).filter(F.col("token") != F.coalesce("own", F.lit("")))
    hits = tokens.join(names.select(F.col("id").alias("callee"), F.col("name").alias("token")), "token")
    return hits.filter("caller <> callee").select("caller", "callee").distinct()


def innermost_enclosing(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """refs(path, line, ref) with the smallest defs(path, lo, hi, def, ordinal) around the line.

    Equal on path, then an interval condition; a map-side minimum picks the narrowest.
    """
    pairs = refs.join(defs, "path").filter("line between lo and hi and def <> ref")
    best = F.min_by("def", F.struct(F.col("hi") - F.col("lo"), "ordinal"))
    return pairs.groupBy("path", "ref", "line").agg(best.alias("def"))


def precedence_union(precise: DataFrame, heuristic: DataFrame, keys: list[str], distinct: bool = True) -> DataFrame:
    """All precise rows and the heuristic ones whose key has none; one row a key if ``distinct``."""
    if not distinct:
        return precise.unionByName(heuristic.join(precise.select(*keys).distinct(), keys, "left_anti"))
    both = precise.withColumn("_rank", F.lit(0)).unionByName(heuristic.withColumn("_rank", F.lit(1)))
    rest = [c for c in both.columns if c not in keys and c != "_rank"]
    return first_wins(both, keys, [F.col("_rank"), *[F.col(c) for c in rest]]).drop("_rank")


def dangling(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs(ref) that equal no symbol's id, name or leaf."""
    keys = symbols.select(F.explode(F.array("id", "name", X.leaf(F.col("name")))).alias("ref")).filter("ref is not null").distinct()
    return refs.join(keys, "ref", "left_anti")


def classify_files(baseline: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, status) of (path, hash) tables: fresh, stale, missing or new."""
    b, d = baseline.select("path", F.col("hash").alias("was")), disk.select("path", F.col("hash").alias("now"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "stale").otherwise("fresh")
    return b.join(d, "path", "full_outer").select("path", status.alias("status"))


def cited_changes(changed: DataFrame, cited: DataFrame) -> DataFrame:
    """(note, path): notes of cited(note, path) that cite a changed path."""
    return cited.join(changed.select("path").distinct(), "path", "left_semi").select("note", "path").distinct()


def tests_of(tests: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (name, anchor): tests(anchor, text) that mention targets(name) longer than two."""
    tokens = tests.select("anchor", F.explode(F.array_distinct(X.identifiers(F.col("text")))).alias("name"))
    hits = tokens.join(targets.filter(F.length("name") > 2).select("name"), "name", "left_semi").select("name", "anchor")
    # a token that all texts have is split among tasks only if both sides come as shuffled and its rows needn't stay together after the join
    return hits.repartition("anchor").distinct()


def merge_dependencies(targets: DataFrame, links: DataFrame) -> DataFrame:
    """targets(name, type, ordinal) with the sorted deps of links(name, dep); unknown targets are added."""
    first = Window.partitionBy("name").orderBy("ordinal")
    deps = links.groupBy("name").agg(F.sort_array(F.collect_set("dep")).alias("deps"))
    ranked = targets.withColumn("_n", F.row_number().over(first))
    out = ranked.join(deps.withColumn("_n", F.lit(1)), ["name", "_n"], "full_outer")
    return out.select("name", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))

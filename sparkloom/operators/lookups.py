"""Point and substring lookups over symbols, registrations, tests, summaries, recipes and build rows.

Missing summaries and columns give nulls; a lookup that finds nothing has no rows,
but for get_summary and recipe_steps, whose one row then says so in ``error``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .joins import target_join
from .ranking import first_wins

CODE_KINDS = ("class", "enum", "enumerator", "function", "interface", "macro", "method", "namespace", "prototype", "struct", "trait", "typedef", "union")
MAIN_FILES = ("__main__.py", "app.py", "cli.py", "main.c", "main.cc", "main.cpp", "main.py", "server.c")
#: Parts of a path that is no entry point of the project itself.
FOREIGN = ("benchmark", "deps/", "example/", "examples/", "external/", "node_modules/", "test/", "tests/", "third_party/", "vendor/")
ORDER = ("path", "line", "name")


def anchor() -> Column:
    return F.concat("path", F.lit(" → "), "name")


def held(words: DataFrame, texts: DataFrame, separator: str) -> DataFrame:
    """(word, held): whether texts(text), joined by the separator, hold each of words(word); no rows if there is no text.

    Words don't have the separator, so each lies between two of them: it is looked
    up among the pieces, of the words' lengths, of the distinct parts.
    """
    own = words.filter("word is not null").distinct()
    parts = texts.select(F.explode(F.split("text", re.escape(separator))).alias("part")).distinct()
    lengths = own.select(F.length("word").alias("n")).distinct()  # fewer than the longest word has letters
    starts = F.sequence(F.lit(1), F.length("part") - F.col("n") + 1)
    pieces = parts.join(F.broadcast(lengths), F.length("part") >= F.col("n")).select(F.explode(F.transform(starts, lambda i: F.substring("part", i, F.col("n")))).alias("word"))
    found = own.join(pieces.distinct().withColumn("found", F.lit(True)), "word", "left")
    return found.crossJoin(F.broadcast(parts.limit(1).select(F.lit(True).alias("any")))).select("word", F.coalesce("found", F.lit(False)).alias("held"))


def described(symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """symbols(id, path) with ``summary``: the last one of the id, else the first of the path; the ordinal decides."""
    kept = [c for c in summaries.columns if c != "ordinal"]
    whole = summaries.select("id", "path", "ordinal", F.struct(*kept).alias("s"))
    own = first_wins(whole.filter("id is not null").select(F.col("id").alias("_id"), "s", "ordinal"), ["_id"], [-F.col("ordinal")]).select("_id", F.col("s").alias("_own"))
    near = first_wins(whole.filter("path is not null").select(F.col("path").alias("_path"), "s", "ordinal"), ["_path"], [F.col("ordinal")]).select("_path", F.col("s").alias("_near"))
    out = symbols.join(own, F.col("id") == F.col("_id"), "left").join(near, F.col("path") == F.col("_path"), "left")
    return out.withColumn("summary", F.coalesce("_own", "_near")).drop("_id", "_path", "_own", "_near")


def find_symbol(symbols: DataFrame, query: str, detail: str = "fold", summaries: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Symbols whose name holds the query, whatever the case, the most important first; ``detail`` is fold, preview or full."""
    if detail not in ("fold", "preview", "full"):
        raise ValueError(f"detail is fold, preview or full, not {detail!r}")
    hits = symbols.filter(F.lower("name").contains(query.lower()))
    if summaries is not None:
        hits = described(hits, summaries)
    if targets is not None and detail != "fold":
        hits = target_join(hits, targets).withColumnRenamed("target", "build_target")
    hits = hits.orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), *[c for c in ORDER if c in symbols.columns])
    told = lambda c: F.col(f"summary.{c}").alias("summary" if c == "preview" else c)
    has = set(summaries.columns) if summaries is not None else set()
    target = ["build_target"] if targets is not None and detail != "fold" else []
    if detail == "fold":
        return hits.select(anchor().alias("anchor"), "kind", *([told("fold")] if has else []))
    if detail == "preview":
        return hits.select(anchor().alias("anchor"), "kind", "signature", "importance", *[told(c) for c in ("preview", "scope", "evidence_level", "confidence") if c in has], *target)
    return hits.select(*symbols.columns, *([F.struct(*[F.col(f"summary.{c}").alias(c) for c in ("full", "evidence_level", "confidence") if c in has]).alias("l2")] if has else []), *target)


def top_symbols(symbols: DataFrame, n: int = 20) -> DataFrame:
    """The most important symbols of code kinds."""
    return symbols.filter(F.col("kind").isin(*CODE_KINDS)).orderBy(F.desc("importance"), *ORDER).limit(n)


def find_op(ops: DataFrame, name: str) -> DataFrame:
    """(op, version, provider, framework, anchor) of registrations whose name holds the query."""
    place = F.concat_ws(":", "kernel_path", F.col("line").cast("string"))
    return ops.filter(F.lower("op_name").contains(name.lower())).select(F.col("op_name").alias("op"), "version", "provider", "framework", place.alias("anchor"))


def find_tests(tests: DataFrame, symbol: str) -> DataFrame:
    """(test, guards, kind) of tests of the symbol or its leaf."""
    return tests.filter(F.col("name").isin(symbol, symbol.rsplit("::", 1)[-1])).select("test", F.col("name").alias("guards"), F.coalesce("kind", F.lit("regression")).alias("kind"))


def what_changed(symbols: DataFrame, name: str) -> DataFrame:
    """(anchor, churn, last_author, last_modified) of symbols with exactly the name."""
    return symbols.filter(F.col("name") == name).select(anchor().alias("anchor"), F.coalesce("churn", F.lit(0)).alias("churn"), F.coalesce("last_author", F.lit("")).alias("last_author"), F.coalesce("last_modified", F.lit("")).alias("last_modified"))


def get_summary(summaries: DataFrame, key: str) -> DataFrame:
    """One row: the first summary of the path, else the last of the id, else nulls and an error."""
    ranked = summaries.withColumn("_by", F.when(F.col("path") == key, 0).when(F.col("id") == key, 1)).filter("_by is not null")
    rest = [c for c in summaries.columns if c != "ordinal"]
    best = ranked.agg(F.min_by(F.struct(*rest), F.struct("_by", F.when(F.col("_by") == 0, F.col("ordinal")).otherwise(-F.col("ordinal")))).alias("s"))
    return best.select("s.*", F.when(F.col("s").isNull(), F.lit(f"no summary for {key!r}")).alias("error"))


def recipe_steps(recipes: DataFrame, recipe_id: str) -> DataFrame:
    """One row: the recipe (the first file of the id), or nulls and an error."""
    best = recipes.filter(F.col("id") == recipe_id).agg(F.min_by(F.struct("id", "confidence", "data"), "file").alias("r"))
    return best.select("r.*", F.when(F.col("r").isNull(), F.lit(f"no recipe {recipe_id!r}")).alias("error"))


def build_info(rows: DataFrame, name: str) -> DataFrame:
    """Targets, options and packages whose name holds the query."""
    return rows.filter(F.lower("name").contains(name.lower()))


def build_overview(rows: DataFrame) -> DataFrame:
    """One row: (targets, options, packages, fidelity, method, target_names) of rows(kind, name, fidelity, method, ordinal)."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "target", F.struct("ordinal", "name")))), lambda s: s["name"])
    return rows.agg(of("target").alias("targets"), of("option").alias("options"), of("package").alias("packages"), F.min_by("fidelity", "ordinal").alias("fidelity"), F.min_by("method", "ordinal").alias("method"), names.alias("target_names"))


def list_drafts(summaries: DataFrame, module: str | None = None, status: str | None = "draft") -> DataFrame:
    """(id, fold, scope, evidence) of summaries of a confidence, below a path."""
    out = summaries
    if status:
        out = out.filter(F.coalesce("confidence", F.lit("draft")) == status)
    if module:
        out = out.filter(F.col("path").startswith(module))
    return out.select("id", "fold", F.coalesce("scope", F.lit("file")).alias("scope"), X.evidence_anchors(F.coalesce("path", F.lit("?")), F.col("full")).alias("evidence"))


def references(lines: DataFrame, name: str, n: int = 40) -> DataFrame:
    """The first n of lines(path, line, text) that hold the name as a word."""
    word = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in name)
    return lines.filter(F.col("text").rlike(rf"\b{word}\b")).orderBy("path", "line").limit(n)


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of files(path, text)."""
    return files.select("path", F.posexplode(X.text_lines(F.col("text"))).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def entry_points(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, why): functions called main, and files named like programs, outside foreign folders."""
    def own(path: Column) -> Column:
        foreign = F.lit(False)
        for part in FOREIGN:
            foreign = foreign | path.contains(part)
        return ~foreign

    mains = symbols.filter((F.col("name") == "main") & F.col("kind").isin("function", "method") & own(F.col("path"))).select("path", F.concat(F.lit("main "), "kind").alias("why"))
    named = files.filter(F.lower(F.substring_index("path", "/", -1)).isin(*MAIN_FILES) & own(F.col("path"))).select("path", F.lit("file name").alias("why"))
    return mains.unionByName(named)


def review_status(symbols: DataFrame, summaries: DataFrame, symbol: str) -> DataFrame:
    """(anchor, status, importance) of symbols with the name, leaf or id."""
    hits = described(symbols.filter((F.col("name") == symbol) | (X.leaf(F.col("name")) == symbol) | (F.col("id") == symbol)), summaries)
    level = F.format_string("L2 %s (%s)", F.coalesce("summary.confidence", F.lit("draft")), F.coalesce("summary.evidence_level", F.lit("None")))
    return hits.select(anchor().alias("anchor"), F.when(F.col("summary").isNull(), "mechanical (L1)").otherwise(level).alias("status"), F.coalesce("importance", F.lit(0.0)).alias("importance"))


def with_churn(symbols: DataFrame, churn: DataFrame) -> DataFrame:
    """symbols with the churn(path, churn, last_author, last_modified) of their file; 0 and empty where it has none."""
    out = symbols.join(churn, "path", "left")
    return out.withColumns({"churn": F.coalesce("churn", F.lit(0)), "last_author": F.coalesce("last_author", F.lit("")), "last_modified": F.coalesce(F.col("last_modified").cast("string"), F.lit(""))})


def best_definitions(definitions: DataFrame, frequency: DataFrame, n: int) -> DataFrame:
    """(name, score, kind, path, scope): the first definition(name, kind, path, scope, ordinal) of each name, the n most frequent ones."""
    first = first_wins(definitions.filter(F.col("kind").isin(*CODE_KINDS)), ["name"], [F.col("ordinal")])
    scored = first.join(frequency.select(F.col("token").alias("name"), F.col("n").alias("score")), "name", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return scored.orderBy(F.desc("score"), "ordinal").limit(n).select("name", "score", "kind", "path", "scope")


def index_gaps(headings: DataFrame, index: DataFrame) -> DataFrame:
    """headings(key) whose normalised key occurs nowhere in the one text of index(text)."""
    page = index.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), " ").alias("_page"))
    return headings.crossJoin(F.broadcast(page)).filter(~X.markdown_key(F.col("_page")).contains(X.markdown_key(F.col("key")))).drop("_page")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, those of least hash of key and seed: the same ones each time."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(n)


def fresh_report(classified: DataFrame) -> DataFrame:
    """(sampled, stale, missing, new_uncached, fresh_rate) of classify_files; new files aren't sampled, and no sample has no rate."""
    n = lambda s: F.count_if(F.col("status") == s)
    sampled = F.count_if(F.col("status") != "new")
    return classified.agg(sampled.alias("sampled"), n("stale").alias("stale"), n("missing").alias("missing"), n("new").alias("new_uncached"), F.round(F.try_divide(n("fresh"), sampled), 3).alias("fresh_rate"))


def canonical(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in the order that files of their kind are written in: ops, symbols, edges or tests."""
    keys = {"ops": ("framework", "provider", "op_name", "kernel_path", "line"), "symbols": ORDER, "edges": ("caller", "callee"), "tests": ("name", "test")}
    return rows.orderBy(*keys[kind])

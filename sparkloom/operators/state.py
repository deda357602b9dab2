"""Findings, their staleness, and what a change makes dirty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import graph, joins, ranking, vectors
from .ranking import first_wins

KINDS = ("dead_end", "gotcha", "observation", "root_cause_hypothesis")
MOST_CHARS = 2000
NEAR = 0.6
#: Edges of one callee beyond which they are parted, and in how many parts.
MANY, PARTS = 100_000, 256


def validate_findings(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """findings(id, text, kind, symbol_ids) with error and the dangling symbol_ids."""
    refs = findings.select("id", F.explode("symbol_ids").alias("ref"))
    loose = joins.dangling(refs, symbols).groupBy("id").agg(F.sort_array(F.collect_set("ref")).alias("dangling"))
    text = F.trim(F.coalesce("text", F.lit("")))
    error = F.when(text == "", "empty").when(F.length("text") > MOST_CHARS, "too long").when(~F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS), "bad kind")
    return findings.join(loose, "id", "left").withColumn("error", error).withColumn("dangling", F.coalesce("dangling", F.array().cast("array<string>")))


def near_findings(new: DataFrame, active: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(new_id, id, jaccard): active(id, text) that say what new(id, text) says."""
    sets = new.select(F.lit(0).alias("block"), F.concat(F.lit("0|"), "id").alias("id"), X.memory_tokens(F.col("text")).alias("tokens")).unionByName(
        active.select(F.lit(0).alias("block"), F.concat(F.lit("1|"), "id").alias("id"), X.memory_tokens(F.col("text")).alias("tokens"))
    )
    pairs = vectors.jaccard_pairs(sets, threshold).filter(F.col("a").startswith("0|") & F.col("b").startswith("1|"))
    return pairs.select(F.substring("a", 3, 1 << 30).alias("new_id"), F.substring("b", 3, 1 << 30).alias("id"), "jaccard")


def find_findings(findings: DataFrame, query: str | None = None, status: str | None = None, symbol: str | None = None, limit: int = 25) -> DataFrame:
    """Findings with a token of the query (in order of entry) or all (newest first)."""
    out = findings
    if status:
        out = out.filter(F.col("status") == status)
    if symbol:
        out = out.filter(F.array_contains("symbol_ids", symbol))
    if query:
        tokens = X.memory_tokens(F.lit(query))
        return out.filter(F.arrays_overlap(X.memory_tokens(F.col("text")), tokens)).orderBy("ordinal").limit(limit)
    return out.orderBy(F.desc("created_at"), F.desc("ordinal")).limit(limit)


def mark_stale(findings: DataFrame, hashes: DataFrame) -> DataFrame:
    """findings(id, status, symbol_span_hashes): an active one of which an anchor changed or is gone turns stale."""
    anchors = findings.filter("status = 'active'").select("id", F.explode("symbol_span_hashes").alias("symbol", "was"))
    changed = anchors.join(hashes.select("symbol", F.col("hash").alias("now")), "symbol", "left").groupBy("id").agg(F.bool_or(F.col("now").isNull() | (F.col("now") != F.col("was"))).alias("_changed"))
    return findings.join(changed, "id", "left").withColumn("status", F.when(F.col("_changed"), "stale").otherwise(F.col("status"))).drop("_changed")


def latest(log: DataFrame, key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """The newest row of each key of an append-only log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(key, "_r.*")


def transition(findings: DataFrame, to: str, case_id: Column | None = None) -> DataFrame:
    """Active findings promoted (with a case) or rejected; others get an error."""
    ok = F.col("status") == "active"
    out = findings.withColumn("error", F.when(~ok, F.concat(F.lit("not active: "), "status")))
    out = out.withColumn("promoted_case_id", F.when(ok, case_id if case_id is not None else F.lit(None).cast("string")))
    return out.withColumn("status", F.when(ok, F.lit(to)).otherwise(F.col("status")))


def changed_paths(baseline: DataFrame, disk: DataFrame) -> DataFrame:
    return joins.classify_files(baseline, disk).filter("status <> 'fresh'").select("path")


def incremental_edges(old: DataFrame, symbols: DataFrame, changed: DataFrame, derive) -> DataFrame:
    """Edges whose caller's path is unchanged and whose ends exist, and those derived from the changed symbols.

    ``derive`` makes edges from callers; symbols have (id, path). Edges of a callee
    that very many call are parted by their caller, so that no task has them all.
    """
    there = symbols.select("id", "path")
    dirty = there.join(changed.select("path"), "path", "left_semi")
    clean = there.join(changed.select("path"), "path", "left_anti").select(F.col("id").alias("caller"))
    counted = old.groupBy("callee").agg(F.count("*").alias("n"))
    many = F.col("n") > MANY
    live = counted.join(there.select(F.col("id").alias("callee")), "callee", "left_semi").select("callee", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    hot = F.broadcast(counted.filter(many).select("callee", F.lit(True).alias("hot")))  # a row for so many edges at most
    parted = old.join(clean, "caller", "left_semi").join(hot, "callee", "left")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("caller"), F.lit(PARTS)).cast("int")).otherwise(0)
    kept = parted.withColumn("part", part).join(live, ["callee", "part"], "left_semi")
    # parted before rows are made distinct, so that a task doesn't hold what it sorts and what it groups together
    return kept.select("caller", "callee").unionByName(derive(dirty)).repartition("caller", "callee").distinct()


def rebuild_plan(symbols: DataFrame, edges: DataFrame, changed: DataFrame, fold_changed: DataFrame) -> DataFrame:
    """(id, reason): symbols of changed paths, and the callers that must follow."""
    start = symbols.join(changed.select("path"), "path", "left_semi").select("id")
    dirty = graph.dirty_set(edges, start, fold_changed)
    return dirty.join(start.withColumn("reason", F.lit("changed")), "id", "left").select("id", F.coalesce("reason", F.lit("caller")).alias("reason"))


def reuse(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """inputs(id, hash) with the cached summary and status where the hash is the same (quarantined stays so)."""
    return inputs.join(cache.select("id", "hash", "summary", "status"), ["id", "hash"], "left").withColumn("cached", F.col("status").isNotNull())


def _hashed(batches):
    """(module, n, hash) of sorted batches(module, preview), each text after a zero byte; without a text there is no hash."""
    import hashlib

    import pyarrow as pa

    def done():
        return pa.RecordBatch.from_pylist([{"module": module, "n": n, "hash": sha.hexdigest() if any_text else None}], pa.schema([("module", pa.string()), ("n", pa.int64()), ("hash", pa.string())]))

    module, n, sha, any_text = None, 0, hashlib.sha256(), False
    for batch in batches:
        for own, text in zip(batch.column("module").to_pylist(), batch.column("preview").cast(pa.binary())):
            if n and own != module:
                yield done()
                n, sha, any_text = 0, hashlib.sha256(), False
            module, n = own, n + 1
            if text.is_valid:
                sha.update(b"\0")
                sha.update(text.as_buffer())
                any_text = True
    if n:
        yield done()


def synthesis_inputs(previews: DataFrame) -> DataFrame:
    """(module, n, hash): previews(path, preview) by directory, hashed in order.

    SHA-256 is a chain, so a directory's texts go through one task, as a sorted stream that is never held whole.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = previews.select(F.when(folder == "", "(root)").otherwise(folder).alias("module"), "preview")
    return rows.repartition("module").sortWithinPartitions("module", "preview").mapInArrow(_hashed, "module string, n long, hash string")


FINDING = "id string, created_at timestamp, author string, codebase string, text string, kind string, symbol_ids array<string>, symbol_span_hashes map<string,string>, confidence string, status string, promoted_case_id string, ordinal long"


def known_symbols(symbols: DataFrame) -> DataFrame:
    """(key, hash): ids, names and leaves of symbols(id, name, span_hash, ordinal); the first symbol of a key has it."""
    keys = symbols.select(F.explode(F.array_distinct(F.array("id", "name", X.leaf(F.col("name"))))).alias("key"), F.col("span_hash").alias("hash"), "ordinal").filter("key is not null")
    return first_wins(keys, ["key"], [F.col("ordinal")]).select("key", "hash")


def record_findings(new: DataFrame, symbols: DataFrame, active: DataFrame, force: bool = False, threshold: float = NEAR) -> DataFrame:
    """new(id, text, kind, symbol_ids) with outcome, error, duplicate_of, dangling and symbol_span_hashes.

    The outcome is error, skipped (an active finding says the same, unless forced)
    or recorded. Findings of one batch are compared with the active ones only.
    """
    checked = validate_findings(new, symbols).withColumn("text", F.trim("text"))
    refs = new.select("id", F.explode("symbol_ids").alias("key")).distinct().join(known_symbols(symbols), "key").filter("hash is not null")
    hashes = refs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "hash"))).alias("symbol_span_hashes"))
    out = checked.join(hashes, "id", "left").withColumn("symbol_span_hashes", F.coalesce("symbol_span_hashes", F.create_map().cast("map<string,string>")))
    if force:
        out = out.withColumn("duplicate_of", F.lit(None).cast("string"))
    else:
        near = near_findings(new.select(F.col("id").cast("string").alias("id"), "text"), active.select(F.col("id").cast("string").alias("id"), "text"), threshold)
        out = out.join(near.groupBy(F.col("new_id").alias("id")).agg(F.min("id").alias("duplicate_of")), "id", "left")
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("duplicate_of").isNotNull(), "skipped").otherwise("recorded")
    return out.withColumn("outcome", outcome)


def append_findings(recorded: DataFrame, path: str, author: str = "agent", codebase: str = "") -> None:
    """Adds the recorded rows to the log; nothing that is there is changed, and ``latest`` reads it."""
    rows = recorded.filter("outcome = 'recorded'").select(
        F.col("id").cast("string").alias("id"), F.current_timestamp().alias("created_at"), F.lit(author).alias("author"), F.lit(codebase).alias("codebase"), "text", "kind", "symbol_ids", "symbol_span_hashes",
        F.lit("speculation").alias("confidence"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("promoted_case_id"), F.unix_micros(F.current_timestamp()).alias("ordinal"),
    )
    rows.write.mode("append").parquet(path)


def append_state(changed: DataFrame, path: str) -> None:
    """Adds new states of findings (after mark_stale or transition) to the log, later than those there."""
    columns = [c.split()[0] for c in FINDING.split(", ")]
    changed.withColumn("ordinal", F.unix_micros(F.current_timestamp())).select(*columns).write.mode("append").parquet(path)


def findings(spark, path: str) -> DataFrame:
    """The newest state of each finding of the log; none if there is no log."""
    from ..sources.files import exists

    return latest(spark.read.schema(FINDING).parquet(path)) if exists(spark, path) else spark.createDataFrame([], FINDING)


def case_draft() -> Column:
    """The YAML of a case to be drafted from a promoted finding(id, text, kind, symbol_ids)."""
    field = F.when(F.col("kind") == "root_cause_hypothesis", "root_cause").otherwise("summary")
    symbols = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("symbol_ids", F.array().cast("array<string>")), lambda s: F.concat(F.lit('"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"'))), ", "), F.lit("]"))
    text = F.replace("text", F.lit("\n"), F.lit("\n  "))
    return F.concat_ws("\n", F.concat(F.lit("id: case-from-"), "id"), F.lit("title: TODO"), F.lit("status: draft"), F.concat(field, F.lit(": >\n  "), text), F.concat(F.lit("affected_symbols: "), symbols), F.lit("confidence: speculation"))


def span_hashes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, hash): the first 12 digits of the SHA-256 of each symbol's lines, by rule A, of symbols(id, path, line) in files(path, text)."""
    sized = symbols.select("id", "path", "line").join(files.select("path", X.text_lines(F.col("text")).alias("_lines")), "path")
    spans = ranking.spans_distinct(sized.select("id", "path", "line", F.size("_lines").alias("_n")), "path", "line", F.col("_n"))
    text = F.array_join(F.slice("_lines", F.greatest(F.col("line"), F.lit(1)), F.greatest(F.col("end") - F.greatest(F.col("line"), F.lit(1)) + 1, F.lit(0)).cast("int")), "\n")
    return spans.join(files.select("path", X.text_lines(F.col("text")).alias("_lines")), "path").select("id", "path", F.substring(F.sha2(text.cast("binary"), 256), 1, 12).alias("hash"))


def symbol_drift(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, reason) of symbols(id, path, line, span_hash) that were hashed: file_missing, or span_changed."""
    own = symbols.filter("coalesce(span_hash, '') <> ''")
    now = span_hashes(own, files).select("id", "hash")
    there = files.select("path").distinct().withColumn("_there", F.lit(True))
    out = own.join(there, "path", "left").join(now, "id", "left")
    reason = F.when(F.col("_there").isNull(), "file_missing").when(F.coalesce("hash", F.lit("")) != F.col("span_hash"), "span_changed")
    return out.select("id", reason.alias("reason")).filter("reason is not null")


def verify(symbols: DataFrame, files: DataFrame, cached: DataFrame, refs: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """The four checks: symbols whose text moved, files against cached(path, hash), dangling refs(ref), and findings gone stale."""
    disk = files.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    hashes = span_hashes(symbols, files).select(F.col("id").alias("symbol"), "hash")
    return {
        "symbols": symbol_drift(symbols, files), "files": joins.classify_files(cached, disk).filter("status <> 'fresh'"), "links": joins.dangling(refs, symbols),
        "findings": mark_stale(stored, hashes).filter("status = 'stale'"),
    }

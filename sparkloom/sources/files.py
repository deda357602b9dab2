"""Scans of code, logs, indexes and records, and the sinks beside them."""

from __future__ import annotations

import os
import shlex
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

CODE = tuple("." + e for e in "c cc cpp cxx go h hh hpp java js m mm py rs ts".split())
C_LIKE = (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".hxx")
COMPILERS = ("cc", "c++", "gcc", "g++", "clang", "clang++")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def code_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = CODE, only: str | None = None, max_bytes: int | None = None, limit: int | None = None) -> DataFrame:
    """(path, text, hash, n_bytes) below root, without .git; suffix and size are filters of the listing, before any content is read.

    ``limit`` keeps the first files in the order of their paths.
    """
    ends = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{{{ends}}}").load(root)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^(file:)?/*" + "".join("\\" + c if c in ".+()[]" else c for c in base.lstrip("/")), "")
    out = raw.select(path.alias("path"), "content", F.col("length").alias("n_bytes"))
    out = out.filter(F.lower("path").rlike(f"({'|'.join(s.replace('.', chr(92) + '.').replace('+', chr(92) + '+') for s in suffixes)})$")).filter(~F.concat(F.lit("/"), "path").contains("/.git/"))
    if only:
        out = out.filter(F.col("path").startswith(only))
    if limit is not None:
        out = out.join(F.broadcast(out.select("path").orderBy("path").limit(limit)), "path", "left_semi")
    return out.select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("hash"), "n_bytes")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON lines file; none if it isn't there. Blank lines are skipped."""
    reader = spark.read.schema(schema)
    return reader.json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Columns in the order of their names; those that begin with _ are left out."""
    df.select(*sorted(c for c in df.columns if not c.startswith("_"))).write.mode("overwrite").json(path)


def tags(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, line, kind, language, scope, signature) of a tag scan's JSON lines; bad and other rows are dropped."""
    rows = spark.read.text(path).select(F.from_json("value", "_type string, name string, path string, line int, kind string, language string, scope string, signature string").alias("r")).select("r.*")
    kept = rows.filter((F.col("_type") == "tag") & F.col("name").isNotNull() & F.lower("path").rlike(f"({'|'.join(s.replace('.', chr(92) + '.') for s in CODE)})$"))
    return kept.select(F.concat_ws(":", "path", "name", "line").alias("id"), "name", "path", "line", "kind", "language", "scope", "signature")


def records(spark: SparkSession, folder: str, default_confidence: str = "speculation", need_id: bool = False) -> DataFrame:
    """(id, file, confidence, data as VARIANT) of the YAML mappings of a folder; the id is the file's stem unless given.

    With ``need_id``, as for cases and features, mappings without an id are left out. No folder, no rows.
    """
    import json

    def parse(batches):
        import yaml

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    data = yaml.safe_load(content)
                except yaml.YAMLError:
                    continue
                if isinstance(data, dict) and (data.get("id") or not need_id):
                    stem = os.path.splitext(os.path.basename(path))[0]
                    rows.append((str(data.get("id") or stem), path, str(data.get("confidence") or default_confidence), json.dumps(data, default=str, sort_keys=True)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["id", "file", "confidence", "json"])

    if not exists(spark, folder):
        return spark.createDataFrame([], "id string, file string, confidence string, json string").select("id", "file", "confidence", F.parse_json("json").alias("data"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml}").load(folder).select("path", "content")
    return raw.mapInArrow(parse, "id string, file string, confidence string, json string").select("id", "file", "confidence", F.parse_json("json").alias("data"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(sha, subject, files) of log text whose records begin with the separator U+001E and have a line of sha, tab and subject."""
    rows = spark.read.option("lineSep", "\x1e").text(path).filter(F.trim("value") != "")
    lines = F.split("value", "\n")
    head = F.element_at(lines, 1)
    return rows.select(F.substring_index(head, "\t", 1).alias("sha"), F.expr("substr(element_at(split(value, '\\n'), 1), instr(element_at(split(value, '\\n'), 1), '\\t') + 1)").alias("subject"), F.filter(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x) != "").alias("files"))


def span(r: Column) -> tuple[Column, Column]:
    """First and last line of a range of four numbers, or of three on one line."""
    return F.get(r, F.lit(0)), F.when(F.size(r) >= 4, F.get(r, F.lit(2))).otherwise(F.get(r, F.lit(0)))


def precise_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, symbol, line, role, lo, hi) of an index's occurrences, with camel or snake case keys; local symbols are left out."""
    occurrence = "array<struct<symbol:string,range:array<int>,symbolRoles:int,symbol_roles:int,enclosingRange:array<int>,enclosing_range:array<int>>>"
    raw = spark.read.option("multiLine", True).schema(f"documents array<struct<relativePath:string,relative_path:string,occurrences:{occurrence}>>").json(path)
    docs = raw.select(F.explode("documents").alias("d")).select(F.coalesce("d.relativePath", "d.relative_path").alias("path"), F.explode("d.occurrences").alias("o"))
    first, last = span(F.coalesce("o.enclosingRange", "o.enclosing_range", "o.range"))
    is_def = F.coalesce("o.symbolRoles", "o.symbol_roles", F.lit(0)).bitwiseAND(1) == 1
    out = docs.select("path", F.col("o.symbol").alias("symbol"), F.col("o.range")[0].alias("line"), F.when(is_def, "def").otherwise("ref").alias("role"), first.alias("lo"), last.alias("hi"))
    return out.filter(~F.col("symbol").startswith("local "))


def build_targets(texts: DataFrame) -> DataFrame:
    """(path, command, args) of the CMake commands of texts(path, text); variables stay as they are."""
    commands = "add_library|add_executable|target_link_libraries|option|find_package"
    calls = F.regexp_extract_all("text", F.lit(rf"(?i)\b((?:{commands})\s*\([^)]*)\)"), 1)
    keywords = ["STATIC", "SHARED", "MODULE", "OBJECT", "INTERFACE", "PUBLIC", "PRIVATE", "REQUIRED", "EXCLUDE_FROM_ALL", "ALIAS", "IMPORTED"]
    one = texts.select("path", F.explode(calls).alias("call"))
    args = F.filter(F.split(F.regexp_replace("call", r"^\w+\s*\(\s*", ""), r"\s+"), lambda a: (a != "") & ~a.isin(keywords))
    return one.select("path", F.lower(F.regexp_extract("call", r"^(\w+)", 1)).alias("command"), args.alias("args"))


def make_commands(lines: DataFrame) -> DataFrame:
    """(file, arguments) of the lines(value) of make output that compile a C or C++ file."""

    def parse(batches):
        for batch in batches:
            files, arguments = [], []
            for line in batch.column("value").to_pylist():
                try:
                    words = shlex.split(line or "")
                except ValueError:
                    continue
                source = next((w for w in words if w.endswith(C_LIKE[:4])), None)
                if words and os.path.basename(words[0]) in COMPILERS and "-c" in words and source:
                    files.append(source)
                    arguments.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(arguments, pa.list_(pa.string()))], ["file", "arguments"])

    return lines.select("value").mapInArrow(parse, "file string, arguments array<string>")


SKIPPED = (".git", ".cache", "build", "node_modules", "third_party", "out")


def compile_rows(files: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(file, arguments) made up for C-like files(path): includes of the root and of every include folder; skipped folders are left out at any depth."""
    files = files.filter(~F.arrays_overlap(F.split(F.regexp_replace("path", "[^/]*$", ""), "/"), F.array(*map(F.lit, skipped))))
    includes = files.select(F.explode(F.regexp_extract_all("path", F.lit("^((?:.*/)?include)/"), 1)).alias("i"))
    flags = includes.agg(F.transform(F.sort_array(F.collect_set("i")), lambda i: F.concat(F.lit("-I"), i)).alias("flags"))
    sources = files.filter(F.col("path").rlike(r"\.(c|cc|cpp|cxx)$"))
    std = F.when(F.col("path").endswith(".c"), F.array(F.lit("cc"), F.lit("-std=c11"))).otherwise(F.array(F.lit("c++"), F.lit("-std=c++17")))
    return sources.crossJoin(F.broadcast(flags)).select(F.col("path").alias("file"), F.concat(std, F.array(F.lit("-I.")), "flags", F.array(F.lit("-c"), F.col("path"))).alias("arguments"))


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_edge_index(edges: DataFrame, folder: str, stamp: DataFrame | None = None) -> None:
    """Edges(caller, callee, xref…) in both orders, one row a pair, precise ones first, in a folder of their own.

    The new folder is written beside the others and named in the file CURRENT,
    which is replaced by one rename: a reader finds the old index or the new one.
    ``stamp`` (of ``freshness``) is kept with it.
    """
    from ..operators.joins import precedence_union

    spark = edges.sparkSession
    if "xref" in edges.columns:
        edges = precedence_union(edges.filter("xref = 'precise'"), edges.filter("xref <> 'precise' or xref is null"), ["caller", "callee"])
    version = f"v{time.time_ns()}"
    for end in ("caller", "callee"):
        edges.repartitionByRange(end).sortWithinPartitions(end).write.parquet(f"{folder}/{version}/by_{end}")
    if stamp is not None:
        stamp.write.parquet(f"{folder}/{version}/stamp")
    fs, at = _file_system(spark, f"{folder}/.CURRENT.{version}")
    out = fs.create(at, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context.rename(at, _file_system(spark, f"{folder}/CURRENT")[1], options)


def read_edge_index(spark: SparkSession, folder: str, end: str = "caller", now: DataFrame | None = None, fallback=None) -> DataFrame:
    """The index in the order of ``end``; ``fallback()`` if there is none, or its stamp isn't ``now``'s: never a stale one."""
    if exists(spark, f"{folder}/CURRENT"):
        version = spark.read.text(f"{folder}/CURRENT").first()[0].strip()
        at = f"{folder}/{version}"
        if now is None or exists(spark, f"{at}/stamp") and is_fresh(now, spark.read.parquet(f"{at}/stamp")):
            return spark.read.parquet(f"{at}/by_{end}")
    if fallback is None:
        raise FileNotFoundError(f"no fresh index in {folder}")
    return fallback()


def freshness(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified) of each source file, to compare with those at the last build."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def is_fresh(now: DataFrame, stamp: DataFrame) -> bool:
    return now.exceptAll(stamp).isEmpty() and stamp.exceptAll(now).isEmpty()


def log_access(spark: SparkSession, path: str, tool: str, arguments: dict, results: int) -> None:
    """Append one row with the arguments' names only; off if ACCESS_LOG=0. A failing log never fails the call."""
    if os.environ.get("ACCESS_LOG") == "0":
        return
    try:
        row = [(tool, sorted(arguments), int(results), not results)]
        spark.createDataFrame(row, "tool string, arg_keys array<string>, n int, empty boolean").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
    except Exception as failed:  # noqa: BLE001
        print(f"access log: {failed}")


def churn_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha, author, modified, ordinal) of log text, newest first: a line of sha, author and date parted by tabs, then the files of the commit.

    The log is one stream, so the header that a line belongs to is the last one
    above it: byte offsets order the lines, and a window over ranges of them,
    with the last header of earlier ranges, carries it down.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    head = F.when(F.size(F.split("value", "\t")) == 3, F.struct(F.split("value", "\t").alias("p"), F.col("at").alias("ordinal")))
    marked = lines.select("file", "at", "value", head.alias("head")).withColumn("part", F.shiftright("at", 33))
    within = Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = marked.groupBy("file", "part").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("at"))).alias("end"))
    before = ends.withColumn("before", F.last("end", ignorenulls=True).over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("file", "part", "before")
    held = marked.withColumn("own", F.last("head", ignorenulls=True).over(within)).join(F.broadcast(before), ["file", "part"]).filter("head is null")
    h = F.coalesce("own", "before")
    return held.select(F.trim("value").alias("path"), h["p"][0].alias("sha"), h["p"][1].alias("author"), h["p"][2].alias("modified"), h["ordinal"].alias("ordinal"))


def churn_of(log: DataFrame) -> DataFrame:
    """(path, churn, last_author, last_modified) of churn_log rows; the newest is that of the least ordinal."""
    return log.groupBy("path").agg(F.count("*").alias("churn"), F.min_by("author", "ordinal").alias("last_author"), F.min_by("modified", "ordinal").alias("last_modified"))


def file_api_targets(spark: SparkSession, build: str) -> DataFrame:
    """(kind, name, type, sources, deps, method, fidelity) of the build system's reply files: the last code model, its first configuration."""
    reply = f"{build.rstrip('/')}/.cmake/api/v1/reply"
    model = spark.read.option("multiLine", True).schema("configurations array<struct<targets:array<struct<jsonFile:string,name:string>>>>").option("pathGlobFilter", "codemodel-v2-*.json").json(reply).select("configurations", F.col("_metadata.file_name").alias("file"))
    last = model.agg(F.max_by("configurations", "file").alias("c"))
    wanted = last.select(F.posexplode(F.col("c")[0]["targets"]).alias("ordinal", "t")).select("ordinal", F.col("t.jsonFile").alias("file"))
    shape = "name string, type string, sources array<struct<path:string>>, dependencies array<struct<id:string>>"
    files = spark.read.option("multiLine", True).schema(shape).option("pathGlobFilter", "target-*.json").json(reply).select("*", F.col("_metadata.file_name").alias("file"))
    none = F.array().cast("array<string>")
    return files.join(F.broadcast(wanted), "file").select(
        F.lit("target").alias("kind"), "name", F.lower(F.regexp_replace(F.coalesce("type", F.lit("")), "_LIBRARY", "")).alias("type"), F.coalesce(F.col("sources.path"), none).alias("sources"),
        F.coalesce(F.transform("dependencies", lambda d: F.substring_index(d["id"], "::@", 1)), none).alias("deps"), F.lit("cmake-file-api").alias("method"), F.lit("exact").alias("fidelity"), "ordinal",
    )


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(data as VARIANT, ordinal) of a summary file: JSON lines, or YAML with a list, one mapping, or a mapping of mappings."""
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("json"), F.monotonically_increasing_id().alias("ordinal"))
    else:
        import json

        import yaml

        data = yaml.safe_load(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])) or []
        if isinstance(data, dict):
            data = list(data.values()) if data and all(isinstance(v, dict) for v in data.values()) else [data]
        rows = spark.createDataFrame([(json.dumps(d, default=str, sort_keys=True), i) for i, d in enumerate(data)], "json string, ordinal long")
    return rows.select(F.parse_json("json").alias("data"), "ordinal")

"""Registrations and tests from source texts, by patterns that are data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .joins import tests_of

_NAME, _SPACE, _NUMBER, _QUOTED = r"[A-Za-z_]\w*", r"[A-Za-z_:]\w*", r"\d+", r'[^"]+'
_KINDS = {"op_name": _NAME, "provider": _NAME, "type": _NAME, "domain": _SPACE, "version": _NUMBER, "end_version": _NUMBER}
_ORT = {"framework": "onnxruntime"}
_CPU = {**_ORT, "provider": "kCpuExecutionProvider", "domain": "kOnnxDomain"}


def call(macro: str, *fields: str) -> str:
    """The pattern of a macro's call with the fields as its first arguments; one in quotes begins with ``"``."""
    def one(f: str) -> str:
        return rf'"(?P<{f[1:]}>{_QUOTED})"' if f[0] == '"' else rf"(?P<{f}>{_KINDS[f]})"

    return rf"\b{macro}\s*\(\s*" + r"\s*,\s*".join(map(one, fields))


def _pattern(macro: str, defaults: dict, *fields: str) -> dict:
    return {"macro": macro, **defaults, "regex": call(macro, *fields)}


#: Macros of public runtimes; more are read from files by load_patterns.
PATTERNS = [
    _pattern("ONNX_OPERATOR_KERNEL_EX", _ORT, "op_name", "domain", "version", "provider"),
    _pattern("ONNX_OPERATOR_TYPED_KERNEL_EX", _ORT, "op_name", "domain", "version", "provider", "type"),
    _pattern("ONNX_OPERATOR_VERSIONED_KERNEL_EX", _ORT, "op_name", "domain", "version", "end_version", "provider"),
    _pattern("ONNX_OPERATOR_VERSIONED_TYPED_KERNEL_EX", _ORT, "op_name", "domain", "version", "end_version", "provider", "type"),
    _pattern("ONNX_CPU_OPERATOR_KERNEL", _CPU, "op_name", "version"),
    _pattern("ONNX_CPU_OPERATOR_TYPED_KERNEL", _CPU, "op_name", "version", "type"),
    _pattern("ONNX_CPU_OPERATOR_VERSIONED_KERNEL", _CPU, "op_name", "version", "end_version"),
    _pattern("ONNX_CPU_OPERATOR_VERSIONED_TYPED_KERNEL", _CPU, "op_name", "version", "end_version", "type"),
    _pattern("EXECUTORCH_LIBRARY", {"framework": "executorch", "provider": "executorch"}, "domain", '"op_name'),
    _pattern("TORCH_LIBRARY_IMPL", {"framework": "pytorch"}, "domain", "provider"),
    _pattern("REGISTER_DISPATCH", {"framework": "pytorch"}, "op_name"),
    _pattern("REGISTER_KERNEL_BUILDER", {"framework": "tensorflow"}, "op_name"),
]


def load_patterns(path: str | None = None) -> list[dict]:
    """The entries of a YAML file's ``patterns`` (macro, regex, and defaults); without a path, those above."""
    if path is None:
        return PATTERNS
    import yaml

    with open(path, encoding="utf-8") as f:
        return [p for p in (yaml.safe_load(f) or {}).get("patterns", []) if p.get("regex")]


def matches(files: DataFrame, pattern: str, fields: list[str], keep: list[str]) -> DataFrame:
    """(keep…, line, fields…) of every match in files(text); a field that the pattern lacks is null, one that matched nothing empty."""
    java, groups = X.java_pattern(pattern)
    own = X.anchored_matches(files, "text", java, 0, keep)
    return own.select(*keep, "line", *[(F.regexp_extract("value", java, groups[f]) if f in groups else F.lit(None).cast("string")).alias(f) for f in fields])


def extract_ops(files: DataFrame, patterns: list[dict] | None = None) -> DataFrame:
    """(op_name, provider, domain, version, macro, framework, kernel_path, line) of files(path, text): what a pattern doesn't capture is its default, else "?" or empty."""
    out = None
    for p in load_patterns() if patterns is None else patterns:
        got = matches(files, p["regex"], ["op_name", "provider", "domain", "version"], ["path"])
        filled = lambda f, none: F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit(p.get(f) or none)).alias(f)  # noqa: B023, E731
        one = got.select(filled("op_name", "?"), filled("provider", "?"), filled("domain", ""), filled("version", ""), F.lit(p.get("macro", "")).alias("macro"), F.lit(p.get("framework", "")).alias("framework"), F.col("path").alias("kernel_path"), "line")
        out = one if out is None else out.unionByName(one)
    return out


TEST_MACRO = r"\bTEST(?:_[FP])?\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)"


def test_anchor(files: DataFrame) -> DataFrame:
    """files(path, text) of tests with their anchor: the path, and the first test of the text."""
    suite, name = F.regexp_extract("text", TEST_MACRO, 1), F.regexp_extract("text", TEST_MACRO, 2)
    return files.filter(X.is_test_file(F.col("path"))).withColumn("anchor", F.when(suite == "", F.col("path")).otherwise(F.concat("path", F.lit("::"), suite, F.lit("."), name)))


def extract_tests(files: DataFrame, symbols: DataFrame, ops: DataFrame) -> DataFrame:
    """(name, test, path, kind): the test files that mention a symbol's leaf or an operator."""
    from .lookups import CODE_KINDS

    names = symbols.filter(F.col("kind").isin(*CODE_KINDS)).select(X.leaf(F.col("name")).alias("name")).unionByName(ops.select(F.col("op_name").alias("name")))
    found = tests_of(test_anchor(files), names)
    return found.select("name", F.col("anchor").alias("test"), F.split("anchor", "::")[0].alias("path"), F.lit("regression").alias("kind"))

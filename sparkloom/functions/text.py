"""Text functions as columns: anchored matches, tokens, citations, hashes and paths."""

from __future__ import annotations

import base64
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
STOPWORDS = "add and are bug fix for get how new out set the use was why code does from into that this with class using where method function".split()
ASCII_WORD = "[A-Za-z0-9]+"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{2,}"
CAMEL = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+"
CITATION = r"\[L(\d+)(?:-(\d+))?\]"


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern for the JVM's engine, whose names of groups can't have underscores: groups by number, and the numbers of the names."""
    return re.sub(r"\(\?P<\w+>", "(", pattern), dict(re.compile(pattern).groupindex)


def anchored_matches(df: DataFrame, text: str, pattern: str, group: int = 1, keep: list[str] | None = None) -> DataFrame:
    """A row (keep…, line, value) for each match; matches may span lines, ``line`` is where one begins.

    The text is parted at a mark put before every match, so that a match starts
    each part but the first; newlines are counted along the parts. Marks that the
    text already holds are dropped.
    """
    clean = F.translate(F.col(text), MARK, "")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{MARK}$1"), MARK)
    newlines = F.transform("parts", lambda p: F.length(p) - F.length(F.translate(p, "\n", "")))
    lines = F.aggregate(
        "newlines", F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
    )["all"]
    out = df.withColumn("parts", parts).filter(F.size("parts") > 1).withColumn("newlines", newlines).withColumn("lines", lines)
    out = out.select(*(keep or []), F.explode(F.slice(F.arrays_zip("parts", "lines"), 2, F.size("parts") - 1)).alias("m"))
    return out.select(*(keep or []), F.col("m.lines").cast("long").alias("line"), F.regexp_extract("m.parts", pattern, group).alias("value"))


def search_tokens(text: Column, stop: bool = True) -> Column:
    """Lower-cased ASCII words longer than two, in order, stopwords left out."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({ASCII_WORD})"), 1), F.lower)
    kept = F.filter(words, lambda w: F.length(w) > 2)
    return F.filter(kept, lambda w: ~w.isin(STOPWORDS)) if stop else kept


def memory_tokens(text: Column) -> Column:
    """The set of lower-cased Unicode words longer than two."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1), F.lower), lambda w: F.length(w) > 2))


def camel_words(name: Column) -> Column:
    return F.transform(F.filter(F.regexp_extract_all(name, F.lit(f"({CAMEL})"), 1), lambda w: F.length(w) > 2), F.lower)


def identifiers(text: Column, unicode: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({'(?U)[A-Za-z_]\\w{2,}' if unicode else IDENTIFIER})"), 1)


def leaf(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def citations(text: Column) -> Column:
    """array<struct<lo, hi>> of the line references."""
    lo = F.regexp_extract_all(text, F.lit(CITATION), 1)
    hi = F.regexp_extract_all(text, F.lit(CITATION), 2)
    return F.transform(F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda c: F.struct(c["lo"].cast("int").alias("lo"), F.when(c["hi"] == "", c["lo"]).otherwise(c["hi"]).cast("int").alias("hi")))


def evidence_anchors(path: Column, text: Column) -> Column:
    return F.transform(citations(text), lambda c: F.concat(path, F.lit(":L"), c["lo"].cast("string"), F.when(c["hi"] > c["lo"], F.concat(F.lit("-"), c["hi"].cast("string"))).otherwise("")))


def claims(text: Column) -> Column:
    """Trimmed sentences that cite a line."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]?)"), 1), lambda s: F.trim(s)), lambda s: s.rlike(CITATION))


def text_lines(text: Column) -> Column:
    """Lines without the empty one that a last newline would leave."""
    return F.split(F.regexp_replace(text, "\n$", ""), "\n")


def cited_lines(source: Column, ranges: Column) -> Column:
    """The cited lines, numbered and joined; ranges are clipped to the source."""
    all_lines = text_lines(source)
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(ranges, lambda r: F.greatest(r["lo"], F.lit(1)) <= F.least(r["hi"], F.size(all_lines))), lambda r: F.sequence(F.greatest(r["lo"], F.lit(1)), F.least(r["hi"], F.size(all_lines)))))))
    return F.array_join(F.transform(numbers, lambda n: F.concat(n.cast("string"), F.lit("| "), F.element_at(all_lines, n))), "\n")


def numbered(text: Column) -> Column:
    return F.array_join(F.transform(text_lines(text), lambda s, i: F.format_string("%4d| %s", i + 1, s)), "\n")


def composed(record: Column, kind: str) -> Column:
    """What is searched of a record (VARIANT): the title and texts of a recipe, case or feature, those that aren't there left out."""
    get = lambda path, t="string": F.try_variant_get(record, f"$.{path}", t)
    texts = lambda path: F.array_join(get(path, "array<string>"), " ")
    if kind == "case":
        parts = [get("title"), get("root_cause"), get("fix_summary"), texts("lessons")]
    elif kind == "feature":
        parts = [get("title"), F.coalesce(*[F.nullif(get(f"summary_{c}"), F.lit("")) for c in ("full", "preview", "fold")])]
    else:
        asked = F.array_join(F.transform(get("decision_points", "array<variant>"), lambda d: F.coalesce(F.try_variant_get(d, "$.q", "string"), F.lit(""))), " ")
        parts = [get("title"), get("task"), get("when"), asked, texts("pitfalls")]
    return F.concat_ws(" ", *parts)


def json_object(text: Column) -> Column:
    """From the first brace to the last one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def input_hash(source: Column, folds: Column) -> Column:
    """SHA-256 of the source and the sorted folds, each after a zero byte."""
    return F.sha2(F.aggregate(F.array_sort(folds), source, lambda a, x: F.concat(a, F.lit("\0"), x)).cast("binary"), 256)


def path_prefix(path: Column, depth: int = 2) -> Column:
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, depth), "/")


def markdown_key(text: Column) -> Column:
    return F.translate(F.lower(text), "`_*", "")


def cited_paths(text: Column) -> Column:
    """Paths in backticks, without their line anchors."""
    spans = F.regexp_extract_all(text, F.lit("`([^`\n]+)`"), 1)
    return F.array_distinct(F.filter(F.transform(spans, lambda s: F.regexp_replace(s, r"(:L?\d+(-L?\d+)?|#.*)$", "")), lambda s: s.rlike(r"^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)+$")))


def is_test_file(path: Column) -> Column:
    base = F.lower(F.substring_index(path, "/", -1))
    return base.contains("test") | F.lower(F.concat(F.lit("/"), path)).contains("/test") | base.contains("gtest")


def top_directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("(root)")


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": offset}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str | None) -> int:
    """The offset; 0 without a cursor, ValueError for a broken one."""
    if not cursor:
        return 0
    try:
        at = json.loads(base64.urlsafe_b64decode(cursor.encode()))["o"]
    except Exception as broken:
        raise ValueError("invalid cursor (-32602)") from broken
    if not isinstance(at, int) or at < 0:
        raise ValueError("invalid cursor (-32602)")
    return at


def wordpiece(vocabulary: set[str], longest: int = 100, most: int = 256):
    """Greedy longest-match pieces of lower-cased words, as an Arrow UDF."""
    def pieces(text: str) -> list[str]:
        out: list[str] = []
        for word in re.findall(r"\w+|[^\w\s]", text.lower()):
            own, start = [], 0
            while start < len(word) <= longest:
                end = len(word)
                while end > start and ("##" if start else "") + word[start:end] not in vocabulary:
                    end -= 1
                if end == start:
                    break
                own.append(("##" if start else "") + word[start:end])
                start = end
            out += own if own and start == len(word) else ["[UNK]"]
        return out[:most]

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else pieces(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run

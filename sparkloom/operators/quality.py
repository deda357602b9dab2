"""Evidence rules over summaries, and verdicts over their claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lineage import cut

LEVELS = ("code", "inferred", "speculation")
REQUIRED = ("fold", "preview", "full", "evidence_level")
LADDER = ("draft", "reviewed", "battle-tested")


def lint_errors(known: Column | None = None) -> Column:
    """array<string> of the violations of a summary row.

    Columns: fold, preview, full, evidence_level, invariants, known_pitfalls, source_lines.
    ``known`` is an array of symbol names; names in backticks in ``full`` must be
    among them, unless they have no underscore and don't begin with a small letter.
    """
    rules = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in REQUIRED]
    rules.append(F.when(F.length("fold") > 20, F.lit("fold too long")))
    rules.append(F.when((F.coalesce("evidence_level", F.lit("")) != "") & ~F.col("evidence_level").isin(*LEVELS), F.concat(F.lit("unknown evidence level "), "evidence_level")))
    blob = F.concat_ws("\n", "full", "preview", "invariants", "known_pitfalls")
    cites = X.citations(blob)
    rules.append(F.when((F.col("evidence_level") == "code") & (F.size(cites) == 0), F.lit("no line cited")))
    bad = F.filter(cites, lambda c: (c["lo"] < 1) | (c["lo"] > c["hi"]) | F.coalesce(c["hi"] > F.col("source_lines"), F.lit(False)))
    messages = F.transform(bad, lambda c: F.concat(F.lit("bad line range "), c["lo"].cast("string"), F.lit("-"), c["hi"].cast("string")))
    if known is not None:
        ticked = F.array_distinct(F.regexp_extract_all("full", F.lit("`([A-Za-z_][A-Za-z0-9_:]*)`"), 1))
        strange = F.filter(ticked, lambda t: ~F.array_contains(known, t) & (t.contains("_") | t.rlike("^[a-z]")))
        messages = F.concat(messages, F.coalesce(F.transform(strange, lambda t: F.concat(F.lit("unknown symbol "), t)), F.array().cast("array<string>")))
    return F.concat(F.filter(F.array(*rules), lambda e: e.isNotNull()), messages)


def route(summaries: DataFrame, known: Column | None = None) -> DataFrame:
    """Adds errors and status: clean, or quarantined."""
    return summaries.withColumn("errors", lint_errors(known)).withColumn("status", F.when(F.size("errors") == 0, "clean").otherwise("quarantined"))


def lint_clean_rate(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.round(F.avg((F.size(lint_errors()) == 0).cast("double")), 6).alias("lint_clean_rate"))


def promote(requests: DataFrame) -> DataFrame:
    """requests(id, confidence, to, owner, ticket) with the new confidence and error: one rung, an owner, a ticket for the last."""
    rung = lambda c: F.array_position(F.array(*map(F.lit, LADDER)), c)
    at, to = rung(F.coalesce("confidence", F.lit("draft"))), rung(F.col("to"))
    error = (
        F.when((at == 0) | F.coalesce(to == 0, F.lit(True)), "unknown rung")
        .when(to != at + 1, "one rung at a time")
        .when(F.trim(F.coalesce("owner", F.lit(""))) == "", "owner required")
        .when((to == len(LADDER)) & (F.trim(F.coalesce("ticket", F.lit(""))) == ""), "ticket required")
    )
    return requests.withColumn("error", error).withColumn("confidence", F.when(F.col("error").isNull(), F.col("to")).otherwise(F.col("confidence")))


def unsupported(claims: DataFrame, judge) -> DataFrame:
    """claims(id, claim, source) with the verdict of ``judge``, a function of two string columns."""
    cited = X.cited_lines(F.col("source"), X.citations(F.col("claim")))
    verdict = F.when(F.coalesce(F.col("source"), F.lit("")) == "", "no-source").otherwise(judge(F.col("claim"), cited))
    return claims.withColumn("verdict", F.when(verdict.isin("entailed", "contradicted", "neutral", "no-source"), verdict).otherwise("neutral"))


def generate(prompts: DataFrame, backend, attempts: int = 3, known: Column | None = None, judge=None) -> DataFrame:
    """(id, path, summary fields, errors, status, attempts): replies of ``backend``, checked and asked for again until clean, at most ``attempts`` times.

    prompts(id, path, prompt, source, source_lines); ``backend`` is a function of
    an array of prompts to an array of replies, called in Arrow batches. A reply
    that holds no JSON object, breaks a rule, or (with ``judge``) cites lines that
    don't support it is asked for again with what was wrong; at last it is
    quarantined. Each attempt is written before the next, so that it runs once.
    """
    text = "array<string>"
    fields = "id string, path string, fold string, preview string, full string, evidence_level string, scope string, invariants array<string>, known_pitfalls array<string>"
    told = F.arrow_udf(lambda asked: backend(asked), "string")
    open_rows, done = prompts.withColumn("asked", F.col("prompt")), None
    columns = ("id", "path", "fold", "preview", "full", "evidence_level", "scope", "invariants", "known_pitfalls")
    for n in range(1, attempts + 1):
        replies = cut(open_rows.withColumn("reply", told("asked")))
        parsed = replies.withColumn("s", F.from_json(X.json_object(F.col("reply")), fields))
        flat = parsed.select("id", "path", "prompt", "source", "source_lines", *[F.col(f"s.{c}").alias(c) for c in columns[2:]])
        errors = F.when(F.col("full").isNull() & F.col("fold").isNull() & F.col("preview").isNull(), F.array(F.lit("no JSON object"))).otherwise(lint_errors(known))
        if judge is not None:
            loose = F.filter(X.claims(F.coalesce("full", F.lit(""))), lambda c: judge(c, X.cited_lines(F.col("source"), X.citations(c))) != "entailed")
            errors = F.when(F.size(errors) > 0, errors).otherwise(F.transform(loose, lambda c: F.concat(F.lit("unsupported claim: "), c)))
        checked = cut(flat.withColumn("errors", errors.cast(text)).withColumn("attempts", F.lit(n)))
        clean = checked.filter("size(errors) = 0").withColumn("status", F.lit("clean"))
        bad = checked.filter("size(errors) > 0")
        if n == attempts:
            clean = clean.unionByName(bad.withColumn("status", F.lit("quarantined")))
        done = clean if done is None else done.unionByName(clean)
        if n == attempts or bad.isEmpty():
            break
        again = F.concat("prompt", F.lit("\n\nThe last reply broke these rules:\n"), F.array_join(F.transform("errors", lambda e: F.concat(F.lit("  - "), e)), "\n"), F.lit("\nReturn one JSON object that breaks none."))
        open_rows = bad.select("id", "path", "prompt", "source", "source_lines", again.alias("asked"))
    return done.select(*columns, "errors", "status", "attempts")

"""The sixteen calls over one knowledge base, each giving a DataFrame; none returns more than BUDGET rows unless its page is asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lineage import cut
from ..sources import files as sources
from . import graph, lookups, ranking, reports, retrieve, state
from .joins import precedence_union

BUDGET = 25
PAGE = 50
SYMBOLS = "id string, name string, kind string, path string, line int, language string, scope string, signature string, importance double, churn int, last_author string, last_modified string, span_hash string"
OPS = "op_name string, provider string, domain string, version string, macro string, framework string, kernel_path string, line int"
TESTS = "name string, test string, path string, kind string"
EDGES = "caller_id string, callee_id string, method string, xref string"
BUILD = "kind string, name string, type string, sources array<string>, deps array<string>, default string, defined_in string, method string, fidelity string"
SUMMARIES = "id string, path string, scope string, fold string, preview string, full string, evidence_level string, confidence string, owner string, ticket string, invariants array<string>, known_pitfalls array<string>"


class KnowledgeBase:
    """Tables of a folder: JSON lines of symbols, ops, tests, edges, build_targets and summaries, YAML folders of recipes, cases and features, a findings log. What is missing is empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        read = lambda name, schema: sources.json_lines(spark, f"{self.folder}/{name}.jsonl", schema)
        numbered = lambda df: df.withColumn("ordinal", F.monotonically_increasing_id())
        self.symbols, self.ops, self.tests = numbered(read("symbols", SYMBOLS)), read("ops", OPS), read("tests", TESTS)
        self.summaries, self.build = numbered(read("summaries", SUMMARIES)), numbered(read("build_targets", BUILD))
        both = read("edges.precise", EDGES).unionByName(read("edges", EDGES))
        self.all_edges = both.select(F.col("caller_id").alias("caller"), F.col("callee_id").alias("callee"), "xref")
        self.recipes = sources.records(spark, f"{self.folder}/recipes", "draft")
        self.cases, self.features = (sources.records(spark, f"{self.folder}/{k}", need_id=True) for k in ("cases", "features"))

    def stamp(self) -> DataFrame:
        return sources.freshness(self.spark, f"{self.folder}/edges*.jsonl")

    def build_index(self) -> None:
        sources.write_edge_index(self.all_edges, f"{self.folder}/edge_index", self.stamp())

    def edges(self, end: str = "callee") -> DataFrame:
        """Distinct edges: the index in the order of ``end`` if it is fresh, else of the files."""
        def files() -> DataFrame:
            precise = self.all_edges.filter("xref = 'precise'")
            return precedence_union(precise, self.all_edges.filter("xref <> 'precise' or xref is null"), ["caller", "callee"])

        there = any(sources.exists(self.spark, f"{self.folder}/{n}.jsonl") for n in ("edges", "edges.precise"))
        return sources.read_edge_index(self.spark, f"{self.folder}/edge_index", end, self.stamp() if there else None, files)

    def find_symbol(self, query: str, detail: str = "fold") -> DataFrame:
        return lookups.find_symbol(self.symbols.drop("ordinal"), query, detail, self.summaries, self.build.filter("kind = 'target'"))

    def page(self, rows: DataFrame, order: list, cursor: str | None = None, size: int = PAGE) -> DataFrame:
        return ranking.page_slice(rows, order, X.decode_cursor(cursor), size)

    def find_op(self, name: str) -> DataFrame:
        return lookups.find_op(self.ops, name)

    def get_summary(self, key: str) -> DataFrame:
        return lookups.get_summary(self.summaries, key)

    def find_tests(self, symbol: str) -> DataFrame:
        return lookups.find_tests(self.tests, symbol)

    def relevant_code(self, query: str, k: int = 5) -> DataFrame:
        return retrieve.relevant_code(query, self.symbols, self.edges(), self.ops, min(k, BUDGET), summaries=self.summaries)

    def trace_callers(self, symbol: str, depth: int = 1) -> DataFrame:
        seeds = self.symbols.filter((F.col("name") == symbol) | (F.col("id") == symbol)).select("id")
        return graph.callers(self.edges(), seeds, depth, BUDGET)

    def _texts(self, records: DataFrame, kind: str) -> DataFrame:
        title = F.try_variant_get("data", "$.title", "string")
        ticket = F.try_variant_get("data", "$.ticket", "string")
        return records.select("id", "confidence", title.alias("title"), ticket.alias("ticket"), X.composed(F.col("data"), kind).alias("text"))

    def _titled(self, found: DataFrame, records: DataFrame) -> DataFrame:
        return found.join(records.select("id", "title", "confidence"), "id", "left").orderBy(F.desc("score"), "id")

    def find_recipe(self, task: str) -> DataFrame:
        records = self._texts(self.recipes, "recipe")
        return self._titled(retrieve.find_recipe(records, task), records)

    def get_recipe_steps(self, recipe_id: str) -> DataFrame:
        return lookups.recipe_steps(self.recipes, recipe_id)

    def what_changed(self, symbol: str) -> DataFrame:
        return lookups.what_changed(self.symbols, symbol)

    def review_status(self, symbol: str) -> DataFrame:
        return lookups.review_status(self.symbols, self.summaries, symbol)

    def find_case(self, query: str) -> DataFrame:
        records = self._texts(self.cases, "case")
        return self._titled(retrieve.exact_then_semantic(records, query), records)

    def find_feature(self, query: str) -> DataFrame:
        records = self._texts(self.features, "feature")
        return self._titled(retrieve.exact_then_semantic(records, query), records)

    def search_semantic(self, query: str, k: int = 5) -> DataFrame:
        k = min(k, BUDGET)
        order = [F.desc("score"), "id"]
        notes = self.find_findings(query, limit=3).select("id", F.lit(None).cast("double").alias("score"))
        legs = [("symbol", self.relevant_code(query, k), order), ("recipe", self.find_recipe(query), order), ("case", self.find_case(query), order), ("feature", self.find_feature(query), order), ("finding", notes, ["id"])]
        return retrieve.search_semantic(legs, k)

    @property
    def _log(self) -> str:
        return f"{self.folder}/findings"

    def record_finding(self, text: str, symbol_ids: list[str] | None = None, kind: str = "observation", force: bool = False) -> DataFrame:
        """One row: the outcome, and what was wrong or alike; a recorded finding is in the log when this returns."""
        one = self.spark.createDataFrame([("finding-" + uuid.uuid4().hex[:8], text, kind, symbol_ids or [])], "id string, text string, kind string, symbol_ids array<string>")
        out = cut(state.record_findings(one, self.symbols, state.findings(self.spark, self._log).filter("status = 'active'"), force))
        state.append_findings(out, self._log)
        return out

    def find_findings(self, query: str = "", symbol: str = "", status: str = "active", limit: int = 10) -> DataFrame:
        return state.find_findings(state.findings(self.spark, self._log), query, status, symbol, min(limit, BUDGET))

    def build_info(self, name: str = "") -> DataFrame:
        return lookups.build_info(self.build, name) if name else lookups.build_overview(self.build)

    def instructions(self) -> DataFrame:
        return reports.banner(symbols=self.symbols, ops=self.ops, summaries=self.summaries, recipes=self.recipes, cases=self.cases, features=self.features, findings=state.findings(self.spark, self._log))

    def list_resources(self, cursor: str | None = None) -> DataFrame:
        """(uri, name, type), a page of 50: the registrations, the module map, and the summaries of paths."""
        ops = self.spark.createDataFrame([("kb://ops", "Registrations", "application/jsonl", 0), ("kb://module_map", "Module map", "text/markdown", 1)], "uri string, name string, type string, rank int")
        own = self.summaries.filter("path is not null").select(F.concat(F.lit("kb://summary/"), "id").alias("uri"), F.coalesce("fold", "id").alias("name"), F.lit("text/plain").alias("type"), F.lit(2).alias("rank"))
        return self.page(ops.unionByName(own), ["rank", "uri"], cursor).drop("rank")

    def read_resource(self, uri: str):
        """The rows of a resource: registrations, a summary, or the module map's text."""
        if uri == "kb://ops":
            return lookups.canonical(self.ops, "ops")
        if uri == "kb://module_map":
            return reports.module_map(self.folder.rsplit("/", 1)[-1], self.symbols, self.ops)
        if uri.startswith("kb://summary/"):
            return lookups.get_summary(self.summaries.filter(F.col("id") == uri.removeprefix("kb://summary/")), uri.removeprefix("kb://summary/"))
        raise KeyError(uri)


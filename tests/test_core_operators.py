"""Operators on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import aggregates, graph, joins, quality, ranking, retrieve, state, vectors
from sparkloom.sources import files
from sparkloom.streaming import access


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("v")).first()["v"]


def test_matches_span_lines_and_keep_their_anchor(spark):
    text = "a\nREGISTER(\n  Add)\n\nREGISTER(Relu)"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, text string")
    assert rows(X.anchored_matches(df, "text", r"REGISTER\(\s*(\w+)\)", 1, ["id"])) == [(1, 2, "Add"), (1, 5, "Relu")]
    assert X.java_pattern("(?P<op>a)(?P<v>b)") == ("(a)(b)", {"op": 1, "v": 2})


def test_tokens(spark):
    assert value(spark, X.search_tokens(F.col("t")), t="The add of MyKernel for 42 of 128") == ["mykernel", "128"]
    assert value(spark, X.memory_tokens(F.col("t")), t="Größe und größe ab") == ["größe", "und"]
    assert value(spark, X.camel_words(F.col("t")), t="HTTPServerName_v2x") == ["http", "server", "name", "v2x"]
    assert value(spark, X.leaf(F.col("t")), t="a::b::c") == "c"


def test_citations_and_claims(spark):
    text = "Does A [L1]. Plain sentence here. Range [L7-9] x."
    assert [tuple(c) for c in value(spark, X.citations(F.col("t")), t=text)] == [(1, 1), (7, 9)]
    assert value(spark, X.claims(F.col("t")), t=text) == ["Does A [L1].", "Range [L7-9] x."]
    assert value(spark, X.evidence_anchors(F.lit("a.cc"), F.col("t")), t="y [L3] and [L7-9]") == ["a.cc:L3", "a.cc:L7-9"]
    assert value(spark, X.cited_lines(F.col("s"), X.citations(F.col("t"))), s="a\nb\nc\n", t="[L2-9]") == "2| b\n3| c"
    assert value(spark, X.numbered(F.col("t")), t="a\nb\n") == "   1| a\n   2| b"


def test_hashes_paths_and_cursors(spark):
    h = lambda *folds: value(spark, X.input_hash(F.lit("src"), F.array(*map(F.lit, folds))))
    assert h("a", "b") == h("b", "a") != h("a")
    assert value(spark, X.path_prefix(F.col("t")), t="/onnx//core/x.cc") == "onnx/core"
    assert value(spark, X.cited_paths(F.col("t")), t="see `src/a.cc:12` and `b/c.py#x`, `word`") == ["src/a.cc", "b/c.py"]
    assert value(spark, X.json_object(F.col("t")), t='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert X.decode_cursor(X.encode_cursor(25)) == 25 and X.decode_cursor(None) == 0
    with pytest.raises(ValueError):
        X.decode_cursor("!!")
    for path, is_test in (("src/add_test.cc", True), ("tests/x.cc", True), ("src/add.cc", False), ("GTEST_main.cc", True)):
        assert value(spark, X.is_test_file(F.col("t")), t=path) is is_test


def test_wordpiece(spark):
    split = X.wordpiece({"run", "##ning", "fox", "##es"})
    assert spark.createDataFrame([("running foxes zebra",), (None,)], "t string").select(split("t").alias("v")).collect() == [(["run", "##ning", "fox", "##es", "[UNK]"],), (None,)]


def test_spans(spark):
    df = spark.createDataFrame([("f", 1, "a"), ("f", 10, "b"), ("f", 10, "c"), ("f", 20, "d")], "path string, line int, name string")
    assert rows(ranking.spans_distinct(df, "path", "line", F.lit(30)).select("line", "end", "name")) == [(1, 9, "a"), (10, 19, "b"), (10, 19, "c"), (20, 30, "d")]
    assert rows(ranking.spans_bodies(df, "path", "line", ["line", "name"], F.lit(30)).select("name", "body_start", "end")) == [("a", 2, 9), ("b", 11, 9), ("c", 11, 19), ("d", 21, 30)]
    assert rows(ranking.spans_blocks(df, "path", "line", ["line", "name"], F.lit(30)).select("name", "start", "end")) == [("a", 1, 9), ("b", 10, 10), ("c", 10, 19), ("d", 20, 30)]


def test_pages_and_interleaving(spark):
    df = spark.range(35).select(F.col("id"))
    page = ranking.page_slice(df, ["id"], 25, 25).collect()
    assert [r["id"] for r in page] == list(range(25, 35)) and {r["total"] for r in page} == {35}
    a, b = spark.createDataFrame([("a1",), ("a2",)], "x string"), spark.createDataFrame([("b1",)], "x string")
    assert [r["x"] for r in ranking.interleave([(a, ["x"]), (b, ["x"])], 3).collect()] == ["a1", "b1", "a2"]


def test_interval_and_precedence(spark):
    defs = spark.createDataFrame([("f", 0, 10, "class", 0), ("f", 2, 5, "method", 1), ("f", 20, 30, "other", 2)], "path string, lo int, hi int, def string, ordinal int")
    refs = spark.createDataFrame([("f", 3, "callee"), ("f", 25, "callee"), ("g", 3, "callee"), ("f", 3, "method")], "path string, line int, ref string")
    assert rows(joins.innermost_enclosing(refs, defs).select("line", "ref", "def")) == [(3, "callee", "method"), (3, "method", "class"), (25, "callee", "other")]
    edge = lambda x: spark.createDataFrame([("A", "B", x), ("A", "B", x)], "caller string, callee string, xref string")
    other = spark.createDataFrame([("C", "B", "partial")], "caller string, callee string, xref string")
    assert rows(joins.precedence_union(edge("precise"), edge("partial").unionByName(other), ["caller", "callee"])) == [("A", "B", "precise"), ("C", "B", "partial")]


def test_links_targets_and_dependencies(spark):
    symbols = spark.createDataFrame([("p:ns::Real:1", "ns::Real")], "id string, name string")
    refs = spark.createDataFrame([("Real",), ("ns::Real",), ("GhostSymbol",)], "ref string")
    assert rows(joins.dangling(refs, symbols)) == [("GhostSymbol",)]
    targets = spark.createDataFrame([("core", 1, "src/CMakeLists.txt", ["add.cc", "${SRCS}", "../top.cc"])], "name string, ordinal int, defined_in string, sources array<string>")
    paths = spark.createDataFrame([("src/add.cc",), ("top.cc",), ("src/${SRCS}",)], "path string")
    assert rows(joins.target_join(paths, targets)) == [("src/${SRCS}", None), ("src/add.cc", "core"), ("top.cc", "core")]
    lists = spark.createDataFrame([("core", "library", 0), ("core", "executable", 1)], "name string, type string, ordinal int")
    links = spark.createDataFrame([("core", "b"), ("core", "a"), ("app", "core")], "name string, dep string")
    assert sorted((r["name"], r["type"], tuple(r["deps"])) for r in joins.merge_dependencies(lists, links).collect()) == [("app", "unknown", ("core",)), ("core", "executable", ()), ("core", "library", ("a", "b"))]


def test_reports(spark):
    log = spark.createDataFrame([("find", True), ("find", False)], "tool string, empty boolean")
    assert {(r["tool"], r["empty_rate"]) for r in aggregates.access_report(log).collect()} == {("find", 0.5), (None, 0.5)}
    votes = spark.createDataFrame([(1, "entailed"), (1, "contradicted"), (1, "entailed"), (2, "b"), (2, "a")], "c int, v string")
    assert rows(aggregates.majority(votes, "c", "v")) == [(1, "entailed", 0.666667), (2, "a", 0.5)]
    assert aggregates.lower_quantile(spark.range(1, 8), "id", 0.75) == 5
    commits = spark.createDataFrame([(s, ["onnx/core/a.cc", "onnx/core/b.cc", "docs/x"]) for s in "abc"], "id string, files array<string>")
    themed = commits.join(aggregates.main_theme(commits), "id").select("id", "theme", F.explode("files").alias("file"))
    assert [(r["theme"], r["size"], len(r["files"])) for r in aggregates.clusters(themed, F.col("theme")).collect()] == [("onnx/core", 3, 3)]
    verdicts = spark.createDataFrame([("a", "entailed"), ("a", "no-source"), ("b", "no-source")], "id string, verdict string")
    assert rows(aggregates.faithfulness(verdicts)) == [("a", 2, 1, 1, 1.0), ("b", 1, 0, 0, None)]


def test_graph(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("e", "c")], "caller string, callee string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    ranks = graph.pagerank(ids(*"abcdef"), edges, rounds=12).collect()
    assert abs(sum(r["rank"] for r in ranks) - 1) < 1e-9 and all(r["rank"] > 0 for r in ranks)
    assert rows(graph.callers(edges, ids("d"), 2)) == [("b", 2, "c"), ("c", 1, "d"), ("e", 2, "c")]
    assert graph.callers(edges, ids("d"), 3, budget=1).count() == 1
    monkeypatch.setattr(graph, "SENT_BYTES", -1)  # every frontier is joined by shuffling
    assert rows(graph.callers(edges, ids("d"), 2)) == [("b", 2, "c"), ("c", 1, "d"), ("e", 2, "c")]
    none = spark.createDataFrame([], "id string")
    assert rows(graph.dirty_set(edges, ids("c"), none)) == [("c",)]
    assert rows(graph.dirty_set(edges, ids("c"), ids("c"))) == [("b",), ("c",), ("e",)]
    assert rows(graph.dirty_set(edges, ids("c"), ids("a", "b", "c"))) == [("a",), ("b",), ("c",), ("e",)]


def test_vectors(spark):
    texts = spark.createDataFrame([("x", "fix the clip saturation"), ("y", "add a kernel"), ("z", "")], "id string, text string")
    norms = vectors.embed(texts, "id", "text").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 2 and all(abs(r["n"] - 1) < 1e-9 for r in norms)
    assert vectors.top_k(vectors.embed(texts, "id", "text"), "id", vectors.query_vector(texts, "clip saturation"), 1).first()["id"] == "x"
    assert value(spark, vectors.mean_pool(F.array(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(100.0), F.lit(100.0))), F.array(F.lit(1), F.lit(0)))) == [0.6, 0.8]
    sets = spark.createDataFrame([(0, i, sorted(s)) for i, s in enumerate(["abcdefgh", "abcdefgx", "xyz", "abcd", "abcdefgh"])], "block int, id int, tokens array<string>")
    assert rows(vectors.jaccard_pairs(sets).select("a", "b")) == [(0, 1), (0, 4), (1, 4)]


def test_lint_and_ladder(spark):
    schema = "id int, fold string, preview string, full string, evidence_level string, invariants array<string>, known_pitfalls array<string>, source_lines int"
    data = [(1, "adds", "p", "Adds two [L1-2]. Uses `my_fn`.", "code", [], [], 10), (2, "x" * 40, "p", "no cite", "code", [], [], 10), (3, "f", "", "at [L999] `no_such`", "guess", None, None, 10)]
    out = {r["id"]: r["errors"] for r in quality.route(spark.createDataFrame(data, schema), F.array(F.lit("my_fn"))).collect()}
    assert out[1] == [] and out[2] == ["fold too long", "no line cited"]
    assert out[3] == ["missing preview", "unknown evidence level guess", "bad line range 999-999", "unknown symbol no_such"]
    requests = [("a", "draft", "reviewed", "me", None), ("b", "draft", "battle-tested", "me", "T"), ("c", "draft", "reviewed", " ", None), ("d", "reviewed", "battle-tested", "me", None)]
    got = quality.promote(spark.createDataFrame(requests, "id string, confidence string, to string, owner string, ticket string"))
    assert rows(got.select("id", "confidence", "error")) == [("a", "reviewed", None), ("b", "draft", "one rung at a time"), ("c", "draft", "owner required"), ("d", "reviewed", "ticket required")]


def test_retrieval(spark):
    symbols = spark.createDataFrame([("s1", "Add", "cpu/add.cc", 0.5), ("s2", "RunAll", "cpu/run.cc", 1.0), ("s3", "Relu", "cpu/relu.cc", 0.1)], "id string, name string, path string, importance double")
    edges = spark.createDataFrame([("s2", "s1")], "caller string, callee string")
    ops = spark.createDataFrame([("Add", "14"), ("Add", "14")], "op_name string, version string")
    got = {r["id"]: (r["score"], r["precision"]) for r in retrieve.relevant_code("how is add done", symbols, edges, ops).collect()}
    assert got == {"s1": (6.0, "exact"), "op:Add:14": (4.0, "op"), "s2": (0.8, "expanded")}
    empty = spark.createDataFrame([], symbols.schema)
    assert retrieve.relevant_code("the and for", empty, edges.limit(0), ops.limit(0)).count() == 0
    cases = spark.createDataFrame([("c1", "T-1", "clip saturates at the border"), ("c2", "T-2", "relu leaks")], "id string, ticket string, text string")
    assert rows(retrieve.exact_then_semantic(cases, "t-1")) == [("c1", 1.0)]
    assert retrieve.exact_then_semantic(cases, "why does clip saturate at border").orderBy(F.desc("score")).first()["id"] == "c1"


def test_findings(spark):
    symbols = spark.createDataFrame([("s1", "Add")], "id string, name string")
    schema = "id string, text string, kind string, symbol_ids array<string>"
    new = spark.createDataFrame([("a", "x" * 2001, "observation", []), ("b", "ok text", "nope", []), ("c", " ", "gotcha", []), ("d", "fine", "gotcha", ["Add", "Ghost"])], schema)
    assert {r["id"]: (r["error"], r["dangling"]) for r in state.validate_findings(new, symbols).collect()} == {"a": ("too long", []), "b": ("bad kind", []), "c": ("empty", []), "d": (None, ["Ghost"])}
    text = lambda *x: spark.createDataFrame([(str(i), t) for i, t in enumerate(x)], "id string, text string")
    near = state.near_findings(text("clip saturates int8 values at border"), text("clip saturates int8 values near border", "relu leaks"))
    assert [(r["new_id"], r["id"]) for r in near.collect()] == [("0", "0")]
    findings = spark.createDataFrame([("a", "active", {"s1": "h1"}), ("b", "active", {"s1": "h1", "s2": "h2"}), ("c", "rejected", {"s9": "h"})], "id string, status string, symbol_span_hashes map<string,string>")
    hashes = spark.createDataFrame([("s1", "h1"), ("s2", "other")], "symbol string, hash string")
    assert rows(state.mark_stale(findings, hashes).select("id", "status")) == [("a", "active"), ("b", "stale"), ("c", "rejected")]
    assert rows(state.transition(findings, "promoted", F.lit("case-1")).select("id", "status", "promoted_case_id")) == [("a", "promoted", "case-1"), ("b", "promoted", "case-1"), ("c", "rejected", None)]
    cache = spark.createDataFrame([("a", "h", "s", "quarantined")], "id string, hash string, summary string, status string")
    inputs = spark.createDataFrame([("a", "h"), ("b", "h")], "id string, hash string")
    assert rows(state.reuse(inputs, cache).select("id", "status", "cached")) == [("a", "quarantined", True), ("b", None, False)]


def test_sources(spark, tmp_path):
    root = tmp_path / "code"
    for path, text in {"a/x.cc": "int x;\n", "b.py": "print()", ".git/h.cc": "no", "n.txt": "no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    assert rows(files.code_files(spark, str(root)).select("path", "n_bytes")) == [("a/x.cc", 7), ("b.py", 7)]
    assert rows(files.code_files(spark, str(root), files.C_LIKE, only="a/").select("text")) == [("int x;\n",)]
    assert files.json_lines(spark, str(tmp_path / "gone.jsonl"), "a int").count() == 0
    files.write_json_lines(spark.createDataFrame([(1, 2, 3)], "b int, a int, _c int"), str(tmp_path / "out"))
    assert files.json_lines(spark, str(tmp_path / "out"), "a int, b int").collect() == [(2, 1)]
    (tmp_path / "tags").write_text('{"_type": "tag", "name": "f", "path": "a.cc", "line": 3, "kind": "function"}\nbroken\n{"_type": "ptag"}\n')
    assert [r["id"] for r in files.tags(spark, str(tmp_path / "tags")).collect()] == ["a.cc:f:3"]
    (tmp_path / "log").write_text("\x1eabc\tfix a bug\nx/y.cc\nx/z.cc\n\x1edef\tmore\n")
    assert [(r["sha"], r["subject"], r["files"]) for r in files.commits(spark, str(tmp_path / "log")).collect()] == [("abc", "fix a bug", ["x/y.cc", "x/z.cc"]), ("def", "more", [])]
    index = {"documents": [{"relativePath": "a.cc", "occurrences": [{"symbol": "A", "range": [1, 0, 4], "symbolRoles": 1, "enclosingRange": [1, 0, 9, 1]}, {"symbol": "B", "range": [3, 0, 4]}, {"symbol": "local 1", "range": [3, 0, 4]}]}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    assert rows(files.precise_index(spark, str(tmp_path / "index.json")).select("symbol", "role", "lo", "hi")) == [("A", "def", 1, 9), ("B", "ref", 3, 3)]
    cmake = spark.createDataFrame([("CMakeLists.txt", "add_library(core STATIC a.cc ${SRCS})\nTARGET_LINK_LIBRARIES(core PUBLIC z b)\n")], "path string, text string")
    assert sorted((r["command"], tuple(r["args"])) for r in files.build_targets(cmake).collect()) == [("add_library", ("core", "a.cc", "${SRCS}")), ("target_link_libraries", ("core", "z", "b"))]
    make = spark.createDataFrame([("g++ -c a.cc -o a.o",), ("ar rc x.a a.o",), ("/usr/bin/cc -c 'b c.c'",), ("echo -c a.cc",)], "value string")
    assert rows(files.make_commands(make).select("file")) == [("a.cc",), ("b c.c",)]
    made = files.compile_rows(spark.createDataFrame([("src/a.cc",), ("lib/include/a.h",)], "path string")).first()
    assert made["arguments"] == ["c++", "-std=c++17", "-I.", "-Ilib/include", "-c", "src/a.cc"]


def test_edge_index_and_freshness(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B"), ("C", "B")], "caller string, callee string")
    for _ in range(2):
        files.write_edge_index(edges, str(tmp_path / "index"))
    for end in ("caller", "callee"):
        assert rows(files.read_edge_index(spark, str(tmp_path / "index"), end)) == rows(edges)
    edges.write.parquet(str(tmp_path / "source"))
    stamp = files.freshness(spark, str(tmp_path / "source"))
    kept = spark.createDataFrame(stamp.collect(), stamp.schema)
    assert files.is_fresh(files.freshness(spark, str(tmp_path / "source")), kept)
    edges.write.parquet(str(tmp_path / "source" / "more"))
    assert not files.is_fresh(files.freshness(spark, str(tmp_path / "source")), kept)


def test_records(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "add-an-op.yaml").write_text("title: Add an op\nsteps: [one, {id: x, do: two}]\n")
    (tmp_path / "list.yaml").write_text("- a\n")
    got = files.records(spark, str(tmp_path)).selectExpr("id", "confidence", "variant_get(data, '$.steps[1].do', 'string') as step").collect()
    assert [tuple(r) for r in got] == [("add-an-op", "speculation", "two")]


def test_access_stream(spark, tmp_path):
    for n in (0, 3):
        files.log_access(spark, str(tmp_path / "log"), "find", {"q": "secret"}, n)
    assert spark.read.schema(access.SCHEMA).json(str(tmp_path / "log")).select("arg_keys").distinct().collect() == [(["q"],)]
    query = access.windowed_report(access.access_stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("access_report").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(calls), sum(empties) from access_report").first() == (2, 1)

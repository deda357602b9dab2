"""The sixteen calls, sources and reports over a small knowledge base written here."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import facade, lookups, quality, reports, state
from sparkloom.sources import files


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _lines(path, rows):
    _write(path, "".join(json.dumps(r) + "\n\n" for r in rows))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    pytest.importorskip("yaml")
    to = str(tmp_path_factory.mktemp("kb"))
    symbol = lambda name, path, line, importance, **more: {"id": f"{path}:{name}:{line}", "name": name, "path": path, "line": line, "kind": "function", "importance": importance, "signature": f"{name}()", **more}
    _lines(f"{to}/symbols.jsonl", [symbol("ns::Add", "src/add.cc", 3, 0.9, churn=4, last_author="jo", last_modified="2024-01-02", span_hash="aa"), symbol("AddAll", "src/add.cc", 9, 0.5), symbol("Relu", "src/relu.cc", 1, 0.2), *[symbol(f"Caller{i}", "src/use.cc", i, 0.01) for i in range(40)]])
    _lines(f"{to}/ops.jsonl", [{"op_name": "Add", "version": "14", "provider": "cpu", "framework": "f", "kernel_path": "src/add.cc", "line": 23}])
    _lines(f"{to}/tests.jsonl", [{"name": "Add", "test": "t/add_test.cc::S.C", "path": "t/add_test.cc"}])
    edge = lambda a, b, xref: {"caller_id": a, "callee_id": b, "method": "m", "xref": xref}
    _lines(f"{to}/edges.jsonl", [edge(f"src/use.cc:Caller{i}:{i}", "src/add.cc:ns::Add:3", "partial") for i in range(40)] + [edge("src/add.cc:AddAll:9", "src/add.cc:ns::Add:3", "partial")])
    _lines(f"{to}/edges.precise.jsonl", [edge("src/add.cc:AddAll:9", "src/add.cc:ns::Add:3", "precise")])
    _lines(f"{to}/summaries.jsonl", [{"id": "f", "path": "src/add.cc", "fold": "file fold", "full": "x [L3]", "evidence_level": "code"}, {"id": "src/add.cc:ns::Add:3", "fold": "first", "confidence": "reviewed", "evidence_level": "code"}, {"id": "src/add.cc:ns::Add:3", "fold": "last", "preview": "p", "evidence_level": "inferred", "confidence": "reviewed"}])
    _lines(f"{to}/build_targets.jsonl", [{"kind": "target", "name": "core", "sources": ["src/add.cc", "${SRCS}"], "defined_in": "CMakeLists.txt", "method": "m", "fidelity": "exact"}, {"kind": "option", "name": "USE_X"}])
    _write(f"{to}/recipes/add-an-op.yaml", "title: Add an operator\ntask: write a kernel\nwhen: new operator\ndecision_points:\n  - q: which provider registers it\nsteps: [a, {id: b, do: c}]\npitfalls: [forgotten schema]\n")
    _write(f"{to}/recipes/other.yaml", "id: other\ntitle: Build packages\n")
    _write(f"{to}/cases/c1.yaml", "id: case-1\nticket: QX-7\ntitle: Saturated clip\nroot_cause: the quantised range overflowed\nlessons: [check the bounds]\n")
    _write(f"{to}/cases/no-id.yaml", "title: nothing\n")
    _write(f"{to}/features/f1.yaml", "id: feat-1\ntitle: Elementwise kernels\nsummary_fold: fast loops over tensors\n")
    return to


@pytest.fixture(scope="module")
def kb(spark, folder):
    return facade.KnowledgeBase(spark, folder)


def test_symbols_and_ops(kb):
    rows = kb.find_symbol("add").collect()
    assert [(r["anchor"], r["fold"]) for r in rows] == [("src/add.cc → ns::Add", "last"), ("src/add.cc → AddAll", "file fold")]
    preview = kb.find_symbol("ns::add", "preview").first()
    assert preview["summary"] == "p" and preview["build_target"] == "core" and preview["evidence_level"] == "inferred"
    assert kb.find_symbol("Relu", "full").first()["build_target"] is None
    with pytest.raises(ValueError):
        kb.find_symbol("x", "all")
    assert kb.find_op("ad").first()["anchor"] == "src/add.cc:23"
    assert kb.find_tests("ns::Add").first()["test"] == "t/add_test.cc::S.C"
    assert kb.what_changed("ns::Add").first().asDict() == {"anchor": "src/add.cc → ns::Add", "churn": 4, "last_author": "jo", "last_modified": "2024-01-02"}
    assert [r["status"] for r in kb.review_status("Add").collect()] == ["L2 reviewed (inferred)"]
    assert [r["status"] for r in kb.review_status("Relu").collect()] == ["mechanical (L1)"]


def test_summaries_and_builds(kb):
    assert kb.get_summary("src/add.cc").first()["fold"] == "file fold"
    assert kb.get_summary("src/add.cc:ns::Add:3").first()["fold"] == "last"
    assert "nowhere" in kb.get_summary("nowhere").first()["error"]
    assert kb.build_info("COR").first()["name"] == "core"
    whole = kb.build_info().first()
    assert (whole["targets"], whole["options"], whole["packages"], whole["target_names"]) == (1, 1, 0, ["core"])
    drafts = lookups.list_drafts(kb.summaries, "src/").collect()
    assert [(r["id"], r["evidence"]) for r in drafts] == [("f", ["src/add.cc:L3"])]


def test_graph_and_index(spark, kb):
    assert kb.trace_callers("ns::Add").count() == facade.BUDGET
    before = sorted(map(tuple, kb.edges().select("caller", "callee", "xref").collect()))
    assert len(before) == 41 and ("src/add.cc:AddAll:9", "src/add.cc:ns::Add:3", "precise") in before
    kb.build_index()
    kb.build_index()
    assert sorted(map(tuple, kb.edges().select("caller", "callee", "xref").collect())) == before
    assert sorted(map(tuple, kb.edges("caller").select("caller", "callee", "xref").collect())) == before
    with open(f"{kb.folder}/edges.jsonl", "a") as f:
        f.write(json.dumps({"caller_id": "src/relu.cc:Relu:1", "callee_id": "src/add.cc:ns::Add:3", "method": "m", "xref": "partial"}) + "\n")
    assert facade.KnowledgeBase(spark, kb.folder).edges().count() == 42  # a stale index isn't read
    with pytest.raises(FileNotFoundError):
        files.read_edge_index(spark, f"{kb.folder}/none")


def test_retrieval(kb):
    found = {r["id"]: r for r in kb.relevant_code("add relu").collect()}
    assert found["op:Add:14"]["score"] == 4.0 and found["src/relu.cc:Relu:1"]["precision"] == "exact" and found["src/add.cc:ns::Add:3"]["fold"] == "last"
    assert kb.find_recipe("register a kernel with its provider").first()["id"] == "add-an-op"
    assert kb.find_recipe("packag").first()["id"] == "other"  # no token is shared: words within the text
    assert json.loads(kb.get_recipe_steps("add-an-op").select(F.to_json("data").alias("j")).first()["j"])["steps"] == ["a", {"do": "c", "id": "b"}]
    assert "absent" in kb.get_recipe_steps("absent").first()["error"]
    assert [(r["id"], r["score"]) for r in kb.find_case("qx-7").collect()] == [("case-1", 1.0)]
    assert kb.find_case("overflowed quantised bounds").first()["title"] == "Saturated clip"
    assert kb.find_feature("loops over tensors").first()["id"] == "feat-1"
    kinds = [r["kind"] for r in kb.search_semantic("kernel tensors bounds relu", 4).collect()]
    assert kinds == ["symbol", "recipe", "case", "feature"]


def test_findings(kb):
    bad = kb.record_finding("  ").first()
    assert bad["outcome"] == "error" and kb.find_findings().count() == 0
    first = kb.record_finding("the clip kernel saturates early on large inputs", ["ns::Add", "Ghost"]).first()
    assert first["outcome"] == "recorded" and first["dangling"] == ["Ghost"] and first["symbol_span_hashes"] == {"ns::Add": "aa"}
    again = kb.record_finding("clip kernel saturates early on the large inputs").first()
    assert again["outcome"] == "skipped" and again["duplicate_of"] == first["id"]
    assert kb.record_finding("clip kernel saturates early on the large inputs", force=True).first()["outcome"] == "recorded"
    assert kb.find_findings("saturates").count() == 2 and kb.find_findings(symbol="ns::Add").count() == 1
    stale = state.mark_stale(state.findings(kb.spark, kb._log), kb.spark.createDataFrame([("ns::Add", "bb")], "symbol string, hash string"))
    state.append_state(stale.filter("status = 'stale'"), kb._log)
    assert kb.find_findings(symbol="ns::Add").count() == 0 and kb.find_findings(symbol="ns::Add", status="stale").count() == 1
    assert kb.instructions().first().asDict() == {"symbols": 43, "ops": 1, "summaries": 3, "recipes": 2, "cases": 1, "features": 1, "findings": 1}


def test_resources_and_reports(kb):
    page = kb.list_resources().collect()
    assert [r["uri"] for r in page] == ["kb://ops", "kb://module_map", "kb://summary/f"] and page[0]["total"] == 3
    assert kb.read_resource("kb://ops").count() == 1 and kb.read_resource("kb://summary/f").first()["fold"] == "file fold"
    text = kb.read_resource("kb://module_map")
    assert "| `src` | 43 |" in text and "`src/add.cc:23`" in text
    with pytest.raises(KeyError):
        kb.read_resource("kb://none")
    paths = kb.symbols.select("path", F.col("importance").alias("score")).distinct()
    assert "`src`" in reports.summary_tree(paths) and "`src`" in reports.draft_seed(kb.symbols, paths)
    frequency = kb.spark.createDataFrame([("Relu", 9)], "token string, n long")
    assert reports.repository_map(kb.symbols, frequency, 1).count("`Relu`") == 1


def test_verify(spark, kb):
    text = "a\nb\nc\nd\ne\nf\ng\nh\ni\n"
    code = spark.createDataFrame([("src/add.cc", text)], "path string, text string")
    own = kb.symbols.filter("path = 'src/add.cc'")
    hashed = own.drop("span_hash").join(state.span_hashes(own, code).select("id", F.col("hash").alias("span_hash")), "id")
    assert state.symbol_drift(hashed, code).count() == 0
    edited = spark.createDataFrame([("src/add.cc", text.replace("e", "E"))], "path string, text string")
    cached = code.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    refs = spark.createDataFrame([("Add",), ("Ghost",)], "ref string")
    stored = hashed.filter("name = 'ns::Add'").select(F.lit("f1").alias("id"), F.lit("active").alias("status"), F.create_map("id", "span_hash").alias("symbol_span_hashes"))
    got = state.verify(hashed, edited, cached, refs, stored)
    assert [tuple(r) for r in got["symbols"].collect()] == [("src/add.cc:ns::Add:3", "span_changed")]
    assert got["files"].first()["status"] == "stale" and [r["ref"] for r in got["links"].collect()] == ["Ghost"] and got["findings"].count() == 1
    assert {r["reason"] for r in state.symbol_drift(hashed, edited.filter("false")).collect()} == {"file_missing"}


def test_generation_is_repaired_or_quarantined(spark):
    good = json.dumps({"fold": "adds", "preview": "p", "full": "It adds [L1].", "evidence_level": "code"})

    def backend(asked):
        out = []
        for p in asked.to_pylist():
            out.append(good if p.startswith("good") or "broke these rules" in p and p.startswith("later") else "Sure: " + good.replace("adds [L1]", "adds [L99]") if p.startswith("later") else "no idea")
        return pa.array(out, pa.string())

    prompts = spark.createDataFrame([(k, "a.cc", f"{k} prompt", "line one", 1) for k in ("good", "later", "never")], "id string, path string, prompt string, source string, source_lines int")
    rows = {r["id"]: r for r in quality.generate(prompts, backend).collect()}
    assert (rows["good"]["status"], rows["good"]["attempts"]) == ("clean", 1) and (rows["later"]["status"], rows["later"]["attempts"]) == ("clean", 2)
    assert rows["never"]["status"] == "quarantined" and rows["never"]["attempts"] == 3 and rows["never"]["errors"] == ["no JSON object"]
    judged = {r["id"]: r for r in quality.generate(prompts, backend, 1, judge=lambda claim, cited: F.when(cited.contains("two"), "entailed").otherwise("neutral")).collect()}
    assert judged["good"]["errors"] == ["unsupported claim: It adds [L1]."]


def test_log_and_reply_files(spark, tmp_path):
    log = "".join(f"{i:040x}\tauthor{i % 3}\t2024-01-{28 - i % 28:02}\n\nsrc/a.c\nsrc/b{i % 5}.c\n" for i in range(200))
    _write(f"{tmp_path}/log.txt", log)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got = {r["path"]: tuple(r)[1:] for r in files.churn_of(files.churn_log(spark, f"{tmp_path}/log.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["src/a.c"] == (200, "author0", "2024-01-28") and got["src/b3.c"] == (40, "author0", "2024-01-25")
    reply = f"{tmp_path}/b/.cmake/api/v1/reply"
    _write(f"{reply}/codemodel-v2-1.json", json.dumps({"configurations": []}))
    _write(f"{reply}/codemodel-v2-2.json", json.dumps({"configurations": [{"targets": [{"name": "core", "jsonFile": "target-core.json"}]}, {"targets": [{"name": "x", "jsonFile": "target-x.json"}]}]}))
    _write(f"{reply}/target-core.json", json.dumps({"name": "core", "type": "STATIC_LIBRARY", "sources": [{"path": "a.c"}], "dependencies": [{"id": "dep::@6890"}]}))
    _write(f"{reply}/target-x.json", json.dumps({"name": "x", "type": "EXECUTABLE"}))
    rows = files.file_api_targets(spark, f"{tmp_path}/b").collect()
    assert [(r["name"], r["type"], r["sources"], r["deps"], r["fidelity"]) for r in rows] == [("core", "static", ["a.c"], ["dep"], "exact")]


def test_summary_files_of_every_shape(spark, tmp_path):
    pytest.importorskip("yaml")
    for name, text in (("a.jsonl", '{"id": 1}\n\n{"id": 2}\n'), ("b.yaml", "- id: 1\n- id: 2\n"), ("c.yaml", "x: {id: 1}\ny: {id: 2}\n"), ("d.yaml", "id: 1\nfold: f\n")):
        _write(f"{tmp_path}/{name}", text)
        ids = [r["i"] for r in files.summaries(spark, f"{tmp_path}/{name}").orderBy("ordinal").select(F.try_variant_get("data", "$.id", "int").alias("i")).collect()]
        assert ids == ([1] if name == "d.yaml" else [1, 2])


def test_code_scan_reads_what_it_needs(spark, tmp_path):
    for name in ("src/a.C", "src/b.py", "src/c.txt", ".git/d.c", "src/e.cc"):
        _write(f"{tmp_path}/{name}", "x")
    assert sorted(r["path"] for r in files.code_files(spark, str(tmp_path)).collect()) == ["src/a.C", "src/b.py", "src/e.cc"]
    assert [r["path"] for r in files.code_files(spark, str(tmp_path), files.C_LIKE, limit=1).collect()] == ["src/a.C"]
    made = files.compile_rows(spark.createDataFrame([("include/x.h",), ("src/a.c",), ("third_party/z.c",), ("src/build/y.cc",)], "path string"))
    assert [r["file"] for r in made.collect()] == ["src/a.c"]

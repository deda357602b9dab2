"""Queries that grew faster than their input: the same results by brute force, in bounded memory and time."""

import hashlib
import itertools
import time

import numpy as np

from sparkloom.operators import graph, joins, lookups, state, vectors
from sparkloom.plans import catalog


def test_near_duplicates_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SETS", 16)
    monkeypatch.setattr(vectors, "CODES", 300)
    monkeypatch.setattr(vectors, "MEET", 7)
    monkeypatch.setattr(vectors, "COMMON", 20)
    rng = np.random.default_rng(5)
    sets = [set(rng.choice(60, rng.integers(0, 40), replace=False, p=np.arange(60, 0, -1) / 1830)) for _ in range(120)]
    sets += [sets[i] ^ {int(i)} for i in range(40)] + sets[:10] + [set(range(5)), set(range(3))]
    rows = [(i, [f"w{t}" for t in s]) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    own = {i: min(j for j in range(len(sets)) if sets[j] == sets[i]) if sets[i] else i for i in range(len(sets))}
    near = {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] | sets[j]}
    heads = [p for p in near if near[p] >= 0.6 and all(own[i] == i and sets[i] for i in p)]
    got = {r["id"]: (r["class_id"], r["size"], r["links"]) for r in vectors.similar_classes(table).collect()}
    assert got == {i: (c, list(own.values()).count(c), sum(c in p for p in heads)) for i, c in own.items()} and len(heads) > 50
    for least in (0.6, 0.35):
        pairs = vectors.jaccard_pairs(table.selectExpr("id % 2 as block", "id", "tokens"), least).collect()
        assert {(r["a"], r["b"]): r["jaccard"] for r in pairs} == {(i, j): v for (i, j), v in near.items() if v >= least and i % 2 == j % 2} and len(pairs) == len({(r["a"], r["b"]) for r in pairs})


def test_near_duplicates_write_no_candidates(spark):
    """Sets of the same few words all meet; what is compared stays in memory."""
    table = spark.range(1500).selectExpr("id", "transform(filter(sequence(0, 39), i -> xxhash64(id, i) % 3 <> 0), i -> concat('w', i)) as tokens")
    pairs = vectors._near(vectors._coded(table), 0.6, True)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan
    assert "Exchange hashpartitioning" not in plan and sum(r["n"] for r in pairs.collect()) > 1500


def test_modules_are_hashed_as_streams(spark):
    texts = [("a/b", i, f"{i * 7919 % 3000:05d}" + "é\0" * 2000 if i % 9 else None) for i in range(3000)] + [("c", 1, "x"), ("", 2, "y"), ("", 3, "x"), ("e", 4, None)]
    table = spark.createDataFrame([(f"{m}/{i}".lstrip("/"), t) for m, i, t in texts], "path string, preview string").repartition(5)
    began = time.time()
    got = {r["module"]: (r["n"], r["hash"]) for r in state.synthesis_inputs(table).collect()}
    assert time.time() - began < 30  # joining the texts one by one takes the square of their number
    for module in ("a/b", "c", "", "e"):
        own = sorted(t.encode() for m, _, t in texts if m == module and t is not None)
        want = hashlib.sha256(b"".join(b"\0" + t for t in own)).hexdigest() if own else None
        assert got[module or "(root)"] == (sum(m == module for m, *_ in texts), want)
    assert len(got) == 4 and "collect_list" not in state.synthesis_inputs(table)._jdf.queryExecution().optimizedPlan().toString()


def test_index_coverage_searches_each_word_once(spark, tmp_path):
    texts = ["The River runs", None, "", "foo.bar+baz  end", "émigré"]
    names = ["river x", "iver", "verrun", "bar+b q", "o.b", "o\\wb", "émi", "", "zzz", "s foo", "runsfoo", None, "end", "ends", "Th_e r"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    whole = " ".join(t for t in texts if t is not None).lower()
    keys = {i: n.lower().replace("_", "") for i, n in enumerate(names) if n is not None}
    out = catalog.QUERIES["index_coverage"](spark, str(tmp_path))
    assert {r["p_partkey"]: r["key"] for r in out.collect()} == {i: k for i, k in keys.items() if k.split(" ")[0] not in whole}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    words = spark.createDataFrame([("a",)], "word string")
    assert lookups.held(words, spark.createDataFrame([(None,)], "text string"), " ").count() == 0


def _ranks(nodes, edges, rounds):
    known = [(a, b) for a, b in edges if a in nodes and b in nodes]
    degree = {i: sum(a == i for a, _ in known) for i in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        loose = sum(rank[i] for i in nodes if not degree[i])
        rank = {i: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / degree[a] for a, b in known if b == i) + loose / len(nodes)) for i in nodes}
    return rank


def test_pagerank_goes_over_called_callers_only(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = [(f"c{i}", f"s{rng.integers(0, 4)}") for i in range(60)] + [("s0", "n0"), ("s0", "n0"), ("s1", "n0"), ("s2", "n1"), ("n0", "n1"), ("n1", "n0"), ("n1", "end"), ("c1", "elsewhere")]
    table = spark.createDataFrame(edges, "caller string, callee string")
    ends = {i for e in edges for i in e}
    joined, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: joined.append(cut(df)) or joined[-1])
    for nodes in (None, (ends - {"elsewhere"}) | {"alone"}):
        joined.clear()
        given = None if nodes is None else spark.createDataFrame([(i,) for i in nodes] * 2, "id string")
        got = {r["id"]: r["rank"] for r in graph.pagerank(given, table, rounds=7).collect()}
        want = _ranks(nodes or ends, edges, 7)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want) and abs(sum(got.values()) - 1) < 1e-9
        assert joined[-1].count() < 12  # what a round goes over: no node that nobody calls
    assert graph.pagerank(None, table.filter("false")).count() == 0


def _small_tasks(spark, rows, parts):
    """The rows and final plan of a query when partitions count as skewed and are split at a few kilobytes."""
    own = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(parts),
    }
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = rows()
        got = sorted(tuple(r) for r in out.collect())
        return got, out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tests_that_all_hold_a_word(spark):
    files = spark.range(6000).selectExpr("concat('t', id) as anchor", "concat('every_file holds Add', id % 700, ' every_file') as text").repartition(8)
    names = spark.range(500).selectExpr("concat('Add', id) as name").unionByName(spark.createDataFrame([("every_file",)], "name string"))
    got, plan = _small_tasks(spark, lambda: joins.tests_of(files, names), 24)
    assert got == sorted([("every_file", f"t{i}") for i in range(6000)] + [(f"Add{i % 700}", f"t{i}") for i in range(6000) if i % 700 < 500])
    assert "skew=true" in plan


def test_edges_of_a_callee_that_all_call_are_parted(spark, monkeypatch):
    monkeypatch.setattr(state, "MANY", 500)
    monkeypatch.setattr(state, "PARTS", 8)
    callers = spark.range(4000).selectExpr("concat('d', id) as id", "concat('p', id) as path")
    symbols = callers.unionByName(spark.createDataFrame([("all", "names"), ("few", "names"), ("few", "names2")], "id string, path string"))
    old = callers.selectExpr("id as caller", "explode(if(int(substring(id, 2)) % 50 = 0, array('all', 'few', 'gone'), array('all', 'lost'))) as callee")
    changed = spark.createDataFrame([("p7",), ("p100",)], "path string")
    out = state.incremental_edges(old, symbols, changed, lambda dirty: dirty.selectExpr("id as caller", "'new' as callee"))
    want = [(f"d{i}", "all") for i in range(4000) if i not in (7, 100)] + [(f"d{i}", "few") for i in range(0, 4000, 50) if i != 100] + [("d7", "new"), ("d100", "new")]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert "part#" in out._jdf.queryExecution().optimizedPlan().toString()  # the join by callee is by part too

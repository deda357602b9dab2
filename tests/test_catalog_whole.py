"""Cases that a shorter job would miss: one for each of the review's findings on the catalog, on small tables by brute force."""

import itertools

import numpy as np

from sparkloom.operators import vectors
from sparkloom.plans import catalog


def test_near_duplicates_cross_sources(spark, tmp_path):
    texts = ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon", "alpha beta gamma delta other", "nothing like them here", "alpha beta gamma delta epsilon zeta"]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [set(t.split()) for t in texts]
    classes = {i: min(j for j in range(len(rows)) if sets[j] == sets[i]) for i in range(len(rows))}
    near = [(i, j) for i, j in itertools.combinations(sorted(set(classes.values())), 2) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])]
    got = {r["id"]: (r["class_id"], r["size"], r["links"]) for r in catalog.QUERIES["near_dup_jaccard"](spark, str(tmp_path)).collect()}
    assert got == {i: (c, list(classes.values()).count(c), sum(c in p for p in near)) for i, c in classes.items()} and classes[1] == 0 and near


def test_recall_asks_its_whole_query_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[50:60] = v[40]  # ties go by id
    label = rng.integers(0, 10, 90)
    spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    score = np.round(v.astype(float) @ v.T.astype(float), 9)
    near = [sorted((-score[i, j], j) for j in range(90) if j != i)[:5] for i in range(90)]
    missed = [i for i in (0, 50) if not any(label[j] == label[i] for _, j in near[i])]
    got = {r["class"]: r for r in catalog.QUERIES["recall_at_k"](spark, str(tmp_path)).collect()}
    assert got[None]["n"] == 2 and got[None]["misses"] == missed
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item long, vector array<float>")
    for asked in (None, items.filter("item < 70")):
        found = {}
        for r in vectors.nearest_all(items, 5, asked).collect():
            found.setdefault(r["query"], {})[r["rank"]] = r["item"]
        assert found == {i: {k + 1: j for k, (_, j) in enumerate(near[i])} for i in range(90 if asked is None else 70)}


def test_edges_of_short_names(spark, tmp_path):
    spark.createDataFrame([(0, "the river ab longer_name")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "s", "the ab longer_name"), (8, "s", "river the the")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [("d7", "longer_name"), ("d7", "the"), ("d8", "river"), ("d8", "the")]
    for name in ("edges_by_token", "incremental_equals_full"):
        assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("caller", "callee").collect()) == want

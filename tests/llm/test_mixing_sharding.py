"""Draws of repeated rows, extreme rates, and crowded keys."""

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _count(df):
    return {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}


@pytest.mark.parametrize("doc_id,text", [(None, "t{}"), (7, "same"), (None, "same"), (7, "t{}")])
def test_repeated_rows_meet_the_weights(spark, doc_id, text):
    docs = spark.createDataFrame([(doc_id, text.format(i), "en", "src0" if i < 1000 else "b", 10) for i in range(2000)], SCHEMA)
    got = _count(mixing.mix(docs))
    assert abs(got["src0"] - 2000 * 2 / 3) < 200 and abs(got["b"] - 2000 / 3) < 140


def test_joined_rates_give_the_same_copies(spark):
    docs = spark.createDataFrame([(i % 900, f"t{i}", "en", f"s{i % 3}" if i % 7 else None, i % 50) for i in range(1000)], SCHEMA)
    rates = mixing.repetition_rates(docs, {"s0": 3.0})
    key = lambda df: sorted((r["source"] or "", r["n"]) for r in df.groupBy("row.source").agg(F.count("*").alias("n")).collect())
    once = docs.filter("doc_id >= 100")
    same = [key(mixing.replicate(once, rates, broadcast_numbers=n, broadcast_keys=n)) for n in (1 << 20, -1)]
    assert same[0] == same[1]
    assert sum(n for _, n in key(mixing.replicate(docs, rates, broadcast_numbers=-1, broadcast_keys=-1))) > 0


def test_small_sources_beside_large_ones(spark):
    docs = spark.createDataFrame([(1, "x", "en", "a", 1), (2, "y", "en", "b", 30_000)], SCHEMA)
    assert abs(_count(mixing.mix(docs, {})).get("a") - 15_000) < 700
    with pytest.raises(ValueError, match="source 'a'"):
        mixing.mix(spark.createDataFrame([(1, "x", "en", "a", 1), (2, "y", "en", "b", 10**12)], SCHEMA), {})


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 17.5, 900.0, 40_000.0])
def test_poisson_tables_are_the_distribution(rate):
    low, cdf = mixing.poisson_table(rate)
    draws = np.random.default_rng(3).random(20_000)
    copies = low + np.searchsorted(cdf, draws, "right")
    assert abs(copies.mean() - rate) <= 5 * math.sqrt(rate / 20_000) + 1e-9 and abs(copies.var() - rate) <= 0.06 * rate + 1e-9
    if rate and rate < 100:
        want = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(len(cdf))])
        assert low == 0 and np.allclose(cdf, want, atol=1e-12)


def test_crowded_keys_are_parted(spark):
    for make in (lambda i: "s" * 800, lambda i: f"{i:04}" * 200):
        rows = [(7, make(i), "en", "a", 10) for i in range(400)] + [(i, "z" * 800, "en", "a", 10) for i in range(100)] + [(None, "z" * 800, "en", None, 1) for _ in range(60)]
        docs = spark.createDataFrame(rows, SCHEMA)
        out = sharding.shard(docs, 20_000)
        assert sorted(map(str, out.select("row.*").collect())) == sorted(map(str, docs.collect()))
        sizes = [r["z"] for r in out.groupBy("shard").agg(F.sum(F.octet_length("row.text") + sharding.RECORD_BYTES).alias("z")).collect()]
        assert max(sizes) < 2 * 20_000 and len(sizes) > 16


def test_splitters_are_a_bisection():
    rng = np.random.default_rng(5)
    md5 = lambda: rng.bytes(16).hex()

    def key():
        k2 = None if rng.random() < 0.2 else int(rng.integers(-3, 4))
        return (None if rng.random() < 0.1 else rng.choice(["", "a", "ab", "b"]).item(), k2, md5() if k2 is None and rng.random() < 0.8 else None, int(rng.choice([0, 1, 255, 256, 511])))

    place = lambda k: (k[0] is not None, k[0] or "", k[1] is not None, k[1] or 0, k[2] is not None and bool(int(k[2], 16)), k[2] or "", k[3])
    points, keys = [key() for _ in range(40)], [key() for _ in range(500)]
    ordered = sorted({place(p) for p in points})
    own = sharding.Splitters(points)
    got = own.below(*(pa.array([k[i] for k in keys + points], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32()))))
    assert got.tolist() == [bisect_left(ordered, place(k)) for k in keys + points]
    assert len(sharding.Splitters([]).below(pa.array(["a"]), pa.array([1]), pa.array([None], pa.string()), pa.array([0]))) == 1

"""The register screen, crowded buckets of unlike members, and which of repeated rows stays."""

import time

import numpy as np
import pyarrow as pa

from sparkloom.llm import setsketch


def _family(rng, n, similarity, size=400):
    """Sets of about the similarity with each other: shared elements and their own."""
    shared = int(2 * similarity / (1 + similarity) * size)
    common = rng.integers(0, 1 << 63, shared).astype(np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, size - shared).astype(np.uint64)])) for _ in range(n)]


def test_screen_loses_no_pair_that_reaches_the_threshold():
    rng = np.random.default_rng(3)
    tried = lost = 0
    for similarity in (0.6, 0.65, 0.8):
        sets = _family(rng, 60, similarity)
        regs, sizes = setsketch.registers(sets), np.array([len(s) for s in sets], float)
        i, j = np.triu_indices(60, 1)
        full = setsketch.joint_estimate(regs[i], regs[j], sizes[i], sizes[j]) >= 0.5
        got = setsketch.may_reach(regs[i], regs[j], sizes[i], sizes[j], 0.5)
        tried, lost = tried + full.sum(), lost + (full & ~got).sum()
    assert lost == 0 and tried > 4000


def test_unlike_members_of_a_bucket_are_quick():
    rng = np.random.default_rng(4)
    sets = _family(rng, 1500, 0.25)
    regs = setsketch.registers(sets)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(1500, np.int64)), pa.array(np.arange(1500)), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], ["key", "uid", "size", "regs"])
    began = time.process_time()
    list(setsketch._leaders([batch], 0.5))
    assert time.process_time() - began < 8


def test_which_repeated_row_stays(spark):
    rows = [(1, "one two three four five", lang, source, 5) for lang in "cab" for source in "yx"] + [(2, "one two three four five", "a", "z", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for order in (rows, rows[::-1]):
        kept = setsketch.drop_near_duplicates(spark.createDataFrame(order, schema)).collect()
        assert [(r["doc_id"], r["lang"], r["source"]) for r in kept] == [(1, "a", "x")]

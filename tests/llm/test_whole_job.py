"""Cases that a shorter job would miss: one for each of the review's findings on the training-data operators."""

import numpy as np
import pytest

from sparkloom.llm import pii_crf, secret_novelty, setsketch


def _star(copies: int, words: int = 400, edited: float = 0.065):
    """Independently edited copies of one text, which comes amid them: like it, but mostly not like each other."""
    rng = np.random.default_rng(8)
    original = [f"w{i}" for i in range(words)]
    out = [" ".join(f"e{c}x{i}" if x else w for i, (w, x) in enumerate(zip(original, rng.random(words) < edited))) for c in range(copies)]
    return [*out[: copies // 2], " ".join(original), *out[copies // 2 :]]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_copies_of_a_late_original_are_one_group(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    texts = _star(300)
    sets = [set(s.tolist()) for s in setsketch.shingles(texts)]
    original = sets[150]
    like = [i for i, s in enumerate(sets) if len(s & original) >= setsketch.THRESHOLD * len(s | original)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    try:
        got = {r["doc_id"]: r["group_id"] for r in setsketch.near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(like) > 250 and sum(got[i] == got[150] for i in like) >= 0.99 * len(like)


@pytest.mark.parametrize("value", ["Xk9$mP2#vL8&qR5wZ7t", "tR7#kLm29xQz4Vb8Yw", "abcD9f#kLm29xQz4Vb8Yw1", "q;T%7*(Zp)2,w{K}9|m?"])
@pytest.mark.parametrize("quote", ['"', "'", "`", '"""', '\\"'])
def test_quoted_secrets_are_whole(value, quote):
    text = f"config: user = root, password = {quote}{value}{quote} and host: {quote}example.com{quote} end"
    assert [text[a:b] for a, b, _, _, _, said, _ in secret_novelty.scan(text) if said] == [value]


def test_secrets_inside_quoted_text_are_found():
    inner = "9f8c2d7b61e04a35b8f1c6d29e7a0b43"
    text = f'token: "see the example, the default password = {inner} of the server" and api_key = "it is \\"9$f#Zq2!xK7&\\" ok"'
    found = {text[a:b] for a, b, *_ in secret_novelty.candidates(text)}
    assert inner in found and 'it is \\"9$f#Zq2!xK7&\\" ok' in found


def test_messages_reach_the_last_of_many_repeats():
    L, n = pii_crf.L, 40
    rng = np.random.default_rng(5)
    f = pii_crf.Field(rng.normal(size=(pii_crf.N_FEATURES, L)) * 0.01, np.zeros((L, L)), 5.0 * np.eye(L))
    f.unary[0, 2] = 9.0  # the cue, at the first mention only
    feats = [[0]] + [[1]] * (n - 1)
    got = f.marginals([(feats, [False] * n, [(i, i + 1) for i in range(n - 1)]), ([[1]], [False], [])])
    u = [np.exp(f.unary[x].sum(0)) for x in feats]
    left, right, k = [np.ones(L)], [np.ones(L)], np.exp(f.skip)
    for i in range(n - 1):
        left.append((left[-1] * u[i]) @ k / 1e3)
        right.append(k @ (right[-1] * u[n - 1 - i]) / 1e3)
    want = np.array([a * b * c for a, b, c in zip(left, u, right[::-1])])
    assert np.allclose(got[0], want / want.sum(1, keepdims=True), atol=1e-4)
    assert got[0][-1].argmax() == 2 and got[0][-1][2] > 1.8 / L  # 0.3 of the six labels it was written for

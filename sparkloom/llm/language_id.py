"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: for each order
n the number of n-grams that both contain, weighted and summed, and divided by
the root of both texts' kernels with themselves. N-grams are those of the
lower-cased text, whatever is no letter being a blank, hashed to a fixed number of
columns an order. Nyström landmarks (training texts) approximate the kernel; one
kernel ridge regression for each language against the rest gives the scores,
which for a batch are the product of its presence matrix with the landmarks'
matrix times the coefficients.

A document is rejected when its best score leads the second by less than a least
margin, as texts of languages that no class stands for lie near none of them; the
margin asked for is less for texts of few n-grams (m / (m + FEW) of the whole).
It is calibrated on the training rows: each language in turn is left out and its
rows scored by the others, and halves of the rows are scored by the other half.
The least margin is passed by one in twenty of the foreign rows, but missed by
no more than one in two hundred of the own ones. Below three languages none can be
left out, and every margin is accepted. Texts that mix languages in equal parts
may be rejected, since no score leads. Texts are rejected, too, when fewer than
MIN_KNOWN of their distinct longest n-grams occur in the landmarks, as in other
scripts and in texts without letters.

Training reads at most PER_LANGUAGE labelled documents of each language, those of
least hash. Languages with no such document are unknown.

Defined cases: null, empty and letterless texts have lang_pred null, score null,
known 0 and are rejected. Ties of scores go to the first language in alphabetical
order. Repeated rows are scored alike, one row each. If no row is labelled,
everything is rejected. Other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, row_of, table, uniform

#: Bits of the hash, and weight, of each order.
ORDERS = ((1, 10, 1.0), (2, 13, 1.0), (3, 15, 1.0))
WIDTH = sum(1 << b for _, b, _ in ORDERS)
PER_LANGUAGE = 300
LANDMARKS = 64
RIDGE = 1e-2
MIN_KNOWN = 0.5
#: Longest n-grams of a text at which half the least margin is asked for.
FEW = 60
BATCH = 64

_A = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_CLASS = np.full(256, 32, np.uint32)
for _c in (*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)):
    _CLASS[_c] = _c
_SCALE = np.concatenate([np.full(1 << b, np.sqrt(w), np.float32) for _, b, w in ORDERS])


def _letters(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(c < 256, _CLASS[np.minimum(c, 255)], c)
    return np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)


def mark(text: str | None, row: np.ndarray) -> bool:
    """Set the text's n-grams to 1 in ``row``; False if it has no letters."""
    if not text:
        return False
    c = _letters(text)
    if not (c != 32).any():
        return False
    start = 0
    for n, bits, _ in ORDERS:
        h = np.zeros(max(0, len(c) - n + 1), np.uint32)
        for k in range(n):
            h += c[k : len(c) - n + 1 + k] * _A[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        row[start + (h >> np.uint32(32 - bits)).astype(np.intp)] = 1
        start += 1 << bits
    return True


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(texts), WIDTH), np.float32)
    return x, np.array([mark(t, x[i]) for i, t in enumerate(texts)], bool)


def _normal(x: np.ndarray) -> np.ndarray:
    x *= _SCALE
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def fit(texts: list[str], labels: list[str]) -> dict:
    """Landmark kernel ridge regression; the model holds one column of weights a language."""
    languages = sorted(set(labels))
    y = np.array(labels, object)
    lettered = np.array([bool(t) and (_letters(t) != 32).any() for t in texts], bool)
    rng, chosen = np.random.default_rng(7), []
    for lang in languages:
        chosen.append(rng.permutation(np.flatnonzero((y == lang) & lettered))[:LANDMARKS])
    unit = lambda which: _normal(presence([texts[i] for i in which])[0])
    land = unit(np.concatenate(chosen)) if chosen else np.zeros((0, WIDTH), np.float32)
    rows = np.flatnonzero(lettered)
    kernel, grams = [np.zeros((0, len(land)))], [np.zeros(0)]
    for i in range(0, len(rows), BATCH):
        x = presence([texts[k] for k in rows[i : i + BATCH]])[0]
        grams.append(x[:, -(1 << ORDERS[-1][1]) :].sum(1))
        kernel.append(_normal(x) @ land.T)
    k_nm, m = np.concatenate(kernel).astype(np.float64), np.concatenate(grams).astype(np.float64)
    k_mm = (land @ land.T).astype(np.float64)
    alpha = _ridge(k_nm, k_mm, y[rows], languages)
    spot = {r: i for i, r in enumerate(rows)}
    least = _least_margin(k_nm, k_mm, m, y[rows], np.array([spot[i] for c in chosen for i in c], int), languages)
    weights = (land.T @ alpha.astype(np.float32)) * _SCALE[:, None]
    n_last = 1 << ORDERS[-1][1]
    known = (land[:, -n_last:] > 0).any(0).astype(np.float32) if len(land) else np.zeros(n_last, np.float32)
    return {"languages": languages, "weights": weights, "known": known, "least": least}


def _ridge(k_nm: np.ndarray, k_mm: np.ndarray, y: np.ndarray, languages: list[str]) -> np.ndarray:
    """Coefficients of the landmarks for each language against the rest."""
    if not len(k_mm):
        return np.zeros((0, len(languages)))
    target = np.where(y[:, None] == np.array(languages, object)[None, :], 1.0, -1.0)
    return np.linalg.solve(k_nm.T @ k_nm + RIDGE * k_mm + 1e-6 * np.eye(len(k_mm)), k_nm.T @ target)


def margins(scores: np.ndarray) -> np.ndarray:
    """Lead of the best score over the second."""
    ordered = np.sort(scores, 1)
    return ordered[:, -1] - ordered[:, -2]


def _least_margin(k_nm: np.ndarray, k_mm: np.ndarray, m: np.ndarray, y: np.ndarray, land: np.ndarray, languages: list[str]) -> float:
    """The least margin of texts of many n-grams; ``land`` has the landmarks' rows."""
    if len(languages) < 3:
        return 0.0

    def asked(train: np.ndarray, test: np.ndarray, known: list[str]) -> np.ndarray:
        cols = np.flatnonzero(train[land])
        a, b = np.flatnonzero(train), np.flatnonzero(test)
        alpha = _ridge(k_nm[np.ix_(a, cols)], k_mm[np.ix_(cols, cols)], y[a], known)
        return margins(k_nm[np.ix_(b, cols)] @ alpha) * (m[b] + FEW) / np.maximum(m[b], 1)

    half = np.arange(len(y)) % 2 == 0
    own = np.concatenate([asked(half, ~half, languages), asked(~half, half, languages)])
    foreign = np.concatenate([asked(y != out, y == out, [v for v in languages if v != out]) for out in languages])
    return float(max(0.0, min(np.quantile(foreign, 0.95), np.quantile(own, 0.005))))


def score(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores by language, share of known longest n-grams, their number, whether there are letters)."""
    x, ok = presence(texts)
    own = np.sqrt(np.maximum(x @ (_SCALE * _SCALE), 1e-9))
    last = x[:, -len(model["known"]) :]
    many = last.sum(1)
    return (x @ model["weights"]) / own[:, None], (last @ model["known"]) / np.maximum(many, 1), many, ok


def accepts(model: dict, scores: np.ndarray, known: np.ndarray, many: np.ndarray, min_known: float = MIN_KNOWN) -> np.ndarray:
    """Whether each scored text is of one of the model's languages."""
    if len(model["languages"]) < 3:
        return known >= min_known
    return (known >= min_known) & (margins(scores) * (many + FEW) >= model["least"] * many)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """A model from labelled rows of least hash, at most ``per_language`` of each language."""
    labelled = docs.filter("lang is not null and text is not null and length(text) > 0").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in docs.filter("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.3 * per_language / n))])
    u = uniform("lang", F.col("id"))
    rows = labelled.withColumn("u", u).filter(F.col("u") < share[F.col("lang")]).collect()
    rows.sort(key=lambda r: (r["lang"], r["u"], r["id"] or "", r["text"]))
    texts, labels, taken = [], [], {}
    for r in rows:
        if taken.get(r["lang"], 0) < per_language:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            texts.append(r["text"])
            labels.append(r["lang"])
    return fit(texts, labels)


_TYPE = "struct<lang_pred:string,score:double,margin:double,known:double,accepted:boolean>"


def scorer(model: dict, min_known: float = MIN_KNOWN):
    languages = model["languages"]

    @F.arrow_udf(_TYPE)
    def identify(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        cols: list[list] = [[], [], [], [], []]
        for a in range(0, len(values), BATCH):
            f, share, many, ok = score(model, values[a : a + BATCH])
            ok = ok & bool(languages)
            told = accepts(model, f, share, many, min_known) if languages else ok
            gap = margins(f) if len(languages) > 1 else [None] * len(ok)
            for i in range(len(ok)):
                one = (languages[int(np.argmax(f[i]))], float(f[i].max()), gap[i] and float(gap[i]), float(share[i]), bool(told[i])) if ok[i] else (None, None, None, 0.0, False)
                for col, v in zip(cols, one):
                    col.append(v)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang_pred", "score", "margin", "known", "accepted"])

    return identify


def identified(model: dict, text: Column, min_known: float = MIN_KNOWN) -> Column:
    return scorer(model, min_known)(text.cast("string"))


def identify_language(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, margin, known, accepted) of each row."""
    return docs.select("doc_id", identified(model, F.col("text")).alias("r")).select("doc_id", "r.*")


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The accepted documents, their columns unchanged."""
    rows = row_of(docs).withColumn("r", identified(model, F.col("row.text")))
    return rows.filter("r.accepted").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model trained on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, train(docs))


QUERIES = {"op8_string_kernel_language": op8}
SQL: dict[str, str] = {}

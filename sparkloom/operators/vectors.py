"""Hashing vectors, cosine top-k and near duplicates by token sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.lineage import cut

BUCKETS = 256
#: Vectors of a block of the exact product, about.
BLOCK = 1024
#: Sets and their codes of a block of the exact comparison; meetings of codes that are looked at together; tokens whose order by frequency is sent to the workers.
SETS, CODES, MEET, COMMON = 4096, 1 << 20, 1 << 18, 1 << 17


def bucket(token: Column) -> Column:
    """MD5 modulo 256: the last byte of the digest."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 31, 2), 16, 10).cast("int")


def embed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, weight): counts of search tokens a bucket, of unit length; texts without tokens have no rows."""
    tokens = df.select(id_col, F.explode(X.search_tokens(F.col(text_col))).alias("token"))
    counts = tokens.groupBy(id_col, bucket(F.col("token")).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(Window.partitionBy(id_col)))
    return counts.select(id_col, "bucket", (F.col("n") / norm).alias("weight"))


def query_vector(df: DataFrame, text: str) -> DataFrame:
    one = df.sparkSession.createDataFrame([(0, text)], "q int, text string")
    return embed(one, "q", "text").select("bucket", F.col("weight").alias("q_weight"))


def top_k(vectors: DataFrame, id_col: str, query: DataFrame, k: int) -> DataFrame:
    """(id, score) of the k nearest with a positive score (4 decimals), ties by id; a query has at most 256 rows."""
    scored = vectors.join(F.broadcast(query), "bucket").groupBy(id_col).agg(F.round(F.sum(F.col("weight") * F.col("q_weight")), 4).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Unit vector of the mean of the unmasked rows of a matrix."""
    rows = F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda r: r["m"] > 0)
    zero = F.transform(F.element_at(hidden, 1), lambda x: x.cast("double") * 0)
    total = F.aggregate(rows, zero, lambda s, r: F.zip_with(s, r["h"], lambda a, b: a + b))
    size = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(total, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query, item, rank) of queries(query, vector) among items(item, vector), itself excepted; brute force."""
    pairs = queries.crossJoin(items.withColumnRenamed("vector", "other")).filter("query <> item")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return pairs.select("query", "item", F.round(dot(F.col("vector"), F.col("other")), 9).alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _block_scores(batches, k: int):
    def block(rows):
        vectors = rows.field("vector")
        return np.asarray(rows.field("item")), np.asarray(vectors.flatten()).astype(np.float64).reshape(len(rows), -1)

    for batch in batches:
        for n in range(batch.num_rows):
            asked, a = block(batch.column("asked")[n].values)
            other, b = block(batch.column("other")[n].values)
            score = a @ b.T
            score[asked[:, None] == other] = -np.inf
            m = min(k, len(other))
            least = np.partition(score, -m, axis=1)[:, -m] - 2e-9  # more than rounding to 9 decimals can bring together
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(other[j]), pa.array(score[i, j])], ["query", "item", "score"])


def nearest_all(items: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """(query, item, rank) of every one of asked(item, vector), or of items themselves, among items(item, vector); exact, by products of two blocks.

    Ids are whole numbers and unique, vectors of one length and not null.
    """
    def packed(rows: DataFrame) -> tuple[DataFrame, int]:
        blocks = max(1, -(-rows.count() // BLOCK))
        numbered = rows.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.struct(F.col("item").cast("long").alias("item"), "vector").alias("row"))
        return numbered.groupBy("block").agg(F.collect_list("row").alias("rows")), blocks

    other, n = packed(items)
    own, m = (other, n) if asked is None else packed(asked)
    # every block of the one meets every block of the other: the larger side stays where it is, the smaller is copied
    few, many = (own, other) if m <= n else (other, own)
    names = ("asked", "other") if m <= n else ("other", "asked")
    pairs = many.select(F.col("rows").alias(names[1])).repartition(max(m, n)).crossJoin(few.select(F.col("rows").alias(names[0])))
    scores = pairs.select("asked", "other").mapInArrow(lambda it: _block_scores(it, k), "query long, item long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return scores.select("query", "item", F.round("score", 9).alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def model_embedder(session, tokenize, dim: int, most: int = 256):
    """An Arrow UDF text → unit vector from a model: ``session()`` gives, once in each worker, a function of (ids, mask) matrices to hidden states.

    ``tokenize`` gives a text's token ids. Without a model, ``embed`` serves.
    """
    held: list = []

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(session())
        ids = [tokenize(t or "")[:most] or [0] for t in texts.to_pylist()]
        width = max(map(len, ids), default=1)
        rows, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
        for i, r in enumerate(ids):
            rows[i, : len(r)], mask[i, : len(r)] = r, 1
        hidden = np.asarray(held[0](rows, mask), np.float64).reshape(len(ids), width, dim)
        mean = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
        size = np.sqrt((mean * mean).sum(1, keepdims=True))
        return pa.array((mean / np.where(size > 0, size, 1)).tolist(), pa.list_(pa.float64()))

    return run


def similar_classes(sets: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, class_id, size, links) of sets(id, tokens): sets that are equal are one class, named by its least id.

    ``links`` counts the other classes that reach the threshold with it. Empty sets
    are a class of their own each, without links. Copies join nothing, however many.
    """
    mark = F.when(F.size("tokens") > 0, F.sha2(F.array_join(F.sort_array("tokens"), " "), 256)).otherwise(F.concat(F.lit("-"), F.col("id").cast("string")))
    marked = cut(_coded(sets.withColumn("mark", mark)).select("id", "mark", "codes"))
    of = marked.groupBy("mark").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    heads = marked.filter(F.size("codes") > 0).groupBy("mark").agg(F.min("id").alias("id"), F.any_value("codes").alias("codes")).select("id", "codes")
    links = _near(heads, threshold, True).groupBy("class_id").agg(F.sum("n").alias("links"))
    whole = marked.select("id", "mark").join(of, "mark").select("id", "class_id", "size")
    return whole.join(links, "class_id", "left").select("id", "class_id", "size", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def jaccard_pairs(sets: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(block, a, b, jaccard) of sets(block, id, tokens) of one block, exactly."""
    named = F.transform("tokens", lambda w: F.concat(F.col("block").cast("string"), F.lit("|"), w))
    own = _coded(sets.select("block", F.struct("block", "id").alias("id"), F.array_distinct(named).alias("tokens"))).filter(F.size("codes") > 0)
    pairs = _near(own.select("id", "codes"), threshold, False)
    return pairs.select(F.col("x.block").alias("block"), F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), "jaccard")


def _coded(sets: DataFrame) -> DataFrame:
    """sets(tokens) with codes: a number for each token, equal for equal tokens only, sorted from rare to common.

    A token's number is its hash; the vocabulary is asked whether two tokens share
    one, and another seed is taken if so. The commonest tokens are numbered by their
    frequency, above all hashes, by a table of bounded size.
    """
    for seed in range(16):
        number = lambda w: F.shiftrightunsigned(F.xxhash64(w, F.lit(seed)), 2)  # noqa: B023, E731
        words = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        words = cut(words.groupBy(number(F.col("token")).alias("code")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n")))
        if words.filter("tokens > 1").isEmpty():
            break
    else:
        raise ValueError("tokens that share their hash under every seed")
    table = words.orderBy(F.desc("n"), "code").limit(COMMON).select("code").toArrow().column("code").to_numpy()
    order = np.argsort(table)
    common, rank = table[order], (1 << 62) + len(table) - order

    @F.arrow_udf("array<long>")
    def ranked(codes: pa.Array) -> pa.Array:
        v, ends = np.asarray(codes.flatten()), np.concatenate(([0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))))
        if len(v):
            at = np.minimum(np.searchsorted(common, v), len(common) - 1)
            v = np.where(common[at] == v, rank[at], v)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int64()))

    numbers = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), number)
    return sets.withColumn("codes", F.sort_array(ranked(numbers)))


def _packed(batches):
    """Blocks of sets in order of size: of so many sets and codes at most, besides the last set."""
    from pyspark import TaskContext

    part, held, sets, codes, k = TaskContext.get().partitionId(), [], 0, 0, 0

    def block():
        rows = pa.concat_tables(pa.Table.from_batches([b]) for b in held).combine_chunks()
        lists = rows.column("codes").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ids = rows.column("id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([sizes.min()]), pa.array([sizes.max()]), one, pa.array([sizes.tobytes()]), pa.array([np.asarray(lists.flatten()).astype(np.int64).tobytes()])], ["block", "lo", "hi", "ids", "sizes", "codes"])

    for batch in batches:
        sizes = batch.column("codes").value_lengths().to_numpy(zero_copy_only=False)
        start = 0
        for n, size in enumerate(sizes):
            sets, codes = sets + 1, codes + int(size)
            if sets >= SETS or codes >= CODES:
                held.append(batch.slice(start, n + 1 - start))
                yield block()
                held, sets, codes, k, start = [], 0, 0, k + 1, n + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield block()


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … n[0] numbers, then those from start[1]."""
    return np.arange(n.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)


def _candidates(a, b, same: bool, least: float) -> np.ndarray:
    """x · |b| + y of the sets whose first shared code leaves room for enough others."""
    share = least / (1 + least)

    def heads(own, other):
        sizes, starts, codes = own
        need = np.ceil(share * (sizes + np.maximum(least * sizes, other[0].min())) - 1e-6)
        n = np.clip(sizes - need + 1, 0, sizes).astype(np.int64)
        at = _ranges(starts, n)
        order = np.argsort(codes[at], kind="stable")
        at, of = at[order], np.repeat(np.arange(len(sizes)), n)[order]
        return (of, at - starts[of], *np.unique(codes[at], return_index=True, return_counts=True))

    of_a, at_a, code_a, start_a, n_a = heads(a, b)
    of_b, at_b, code_b, start_b, n_b = heads(b, a)
    _, i, j = np.intersect1d(code_a, code_b, assume_unique=True, return_indices=True)
    # each of a's places with the code meets each of b's
    left = _ranges(start_a[i], n_a[i])
    first, n = np.repeat(start_b[j], n_a[i]), np.repeat(n_b[j], n_a[i])
    ends, found, lo = np.cumsum(n), np.zeros(len(a[0]) * len(b[0]), bool), 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MEET, side="right")))
        p, q = np.repeat(left[lo:hi], n[lo:hi]), _ranges(first[lo:hi], n[lo:hi])
        x, y = of_a[p], of_b[q]
        size_x, size_y = a[0][x], b[0][y]
        room = np.minimum(size_x - at_a[p], size_y - at_b[q])
        ok = (room >= share * (size_x + size_y) - 1e-6) & (np.minimum(size_x, size_y) >= least * np.maximum(size_x, size_y) - 1e-6)
        if same:
            ok &= x < y
        found[x[ok] * len(b[0]) + y[ok]] = True
        lo = hi
    return np.flatnonzero(found)


def _reached(a, b, same: bool, threshold: float):
    """Batches of (x, y, jaccard), numbers of sets of two blocks that reach the threshold when rounded to six decimals."""
    keys = _candidates(a, b, same, threshold - 5e-7)
    for lo in range(0, len(keys), MEET):
        yield from _verified(a, b, keys[lo : lo + MEET], threshold)


def _verified(a, b, keys: np.ndarray, threshold: float):
    xs, ys = np.divmod(keys, len(b[0]))
    used, place = np.unique(ys, return_inverse=True)
    sizes = b[0][used]
    starts = np.cumsum(sizes) - sizes
    codes, local = np.unique(b[2][_ranges(b[1][used], sizes)], return_inverse=True)
    mark = np.zeros(len(codes), bool)
    edges = np.concatenate((np.flatnonzero(np.diff(xs, prepend=-1)), [len(xs)]))
    for lo, hi in zip(edges[:-1], edges[1:]):
        x = xs[lo]
        own = a[2][a[1][x] : a[1][x] + a[0][x]]
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        at = at[codes[at] == own]
        mark[at] = True
        for k in range(lo, hi, 128):
            p = place[k : min(k + 128, hi)]
            shared = np.add.reduceat(mark[local[_ranges(starts[p], sizes[p])]], np.cumsum(sizes[p]) - sizes[p], dtype=np.int64)
            j = np.round(shared / (len(own) + sizes[p] - shared), 6)
            ok = j >= threshold
            if ok.any():
                yield np.full(ok.sum(), x), ys[k : k + len(p)][ok], j[ok]
        mark[at] = False


def _compared(batches, threshold: float, counted: bool):
    def block(batch, n, side):
        sizes = np.frombuffer(batch.column(f"{side}_sizes")[n].as_py(), np.int64)
        return sizes, np.cumsum(sizes) - sizes, np.frombuffer(batch.column(f"{side}_codes")[n].as_buffer(), np.int64)

    for batch in batches:
        for n in range(batch.num_rows):
            a, b, same = block(batch, n, "a"), block(batch, n, "b"), batch.column("a_block")[n] == batch.column("b_block")[n]
            x_ids, y_ids = batch.column("a_ids")[n].values, batch.column("b_ids")[n].values
            x_n, y_n = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
            for x, y, j in _reached(a, b, same, threshold):
                if counted:
                    x_n[x[0]] += len(x)
                    y_n[y] += 1
                else:
                    yield pa.RecordBatch.from_arrays([x_ids.take(pa.array(x)), y_ids.take(pa.array(y)), pa.array(j)], ["x", "y", "jaccard"])
            for ids, seen in ((x_ids, x_n), (y_ids, y_n)) if counted else ():
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(seen[at])], ["class_id", "n"])


def _near(sets: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """(x, y, jaccard) of sets(id, codes) that reach the threshold, or (class_id, n): parts of the number of those near a set.

    Sets are packed in blocks by size, and blocks that may hold near sets are
    compared in a worker's memory: neither candidates nor copies of the sets are
    written, only blocks are. Of two sets that reach the threshold the first shared
    code has enough codes after it in both.
    """
    kind = sets.schema["id"].dataType.simpleString()
    size = F.size("codes")
    n, total = sets.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-n // SETS), -(-total // CODES))
    ordered = sets.select("id", "codes").repartitionByRange(min(parts, 128), size, "id").sortWithinPartitions(size, "id")
    blocks = cut(ordered.mapInArrow(_packed, f"block long, lo long, hi long, ids array<{kind}>, sizes binary, codes binary"))
    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns])
    pairs = side("a").crossJoin(side("b")).filter((F.col("a_block") <= F.col("b_block")) & (F.col("a_hi") >= (threshold - 1e-6) * F.col("b_lo")))
    pairs = pairs.select(*[f"{s}_{c}" for s in "ab" for c in ("block", "ids", "sizes", "codes")])
    return pairs.mapInArrow(lambda it: _compared(it, threshold, counted), f"class_id {kind}, n long" if counted else f"x {kind}, y {kind}, jaccard double")

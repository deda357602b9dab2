"""Near-duplicate groups from SetSketch registers.

Each document is a set of word shingles. A SetSketch register holds
``floor(1 - log_b(min of exponential values))`` truncated to 16 bits: minima on
an exponentially spaced scale. Registers of a union are the maximum of the
registers (``merge``), and equal registers mark similar sets, so that bands of
them are search keys. Documents of a bucket are compared with its leaders by the
joint likelihood of their registers; pairs that may reach the threshold are
verified on the exact shingle sets, and verified pairs are joined to groups. The
members of a bucket that this leaves in different groups are then compared with
each other, so that no pair of a bucket is untried unless verified pairs join it.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters
of the lower-cased text. A document with fewer words than a shingle has one
shingle, all of its words. A null, empty or wordless text is like no other and
stays. Documents with the same shingle set (repeated rows too) are one group.
The row with the least (doc_id, position) of a group stays, a null id being the
last. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, cut, row_of, table

REGISTERS = 128
BANDS = 32
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
SHINGLE = 3
THRESHOLD = 0.6
#: Pairs whose estimate is below the threshold by this much (over two standard errors) aren't verified.
SLACK = 0.1

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, bool)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _WORD[_c] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(1, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        p, q = np.full(size, _U(_P)), np.full(size, _U(pow(_P, -1, 1 << 64)))
        p[0] = q[0] = 1
        _powers, _inverse = np.multiply.accumulate(p), np.multiply.accumulate(q)


def shingles(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted."""
    raw = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0" * (size + 1), np.uint8)
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    _grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _powers[: len(data)], out=total[1:])
    words = _mix((total[ends] - total[starts]) * _inverse[starts])
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    at = np.searchsorted(starts, bounds)
    out = []
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    gram = np.zeros(len(words), np.uint64)
    for k in range(size):
        gram = gram * _U(0xD6E8FEB86659FD93) + _mix(padded[k : k + len(words)] + _U(k))
    gram = _mix(gram)
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= size:
            out.append(np.unique(gram[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in words[a:b]:
                h = _mix(h * _U(0xD6E8FEB86659FD93) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set; zeros for an empty one."""
    regs = np.zeros((len(sets), REGISTERS), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return regs
    flat = np.concatenate([sets[i] for i in some])
    low = (flat >> _U(17)).astype(np.uint32)
    offsets = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
    most = np.empty((REGISTERS, len(some)), np.uint32)
    for r in range(REGISTERS):
        most[r] = np.maximum.reduceat(low * _MULT[r] + _ADD[r], offsets)
    least = -np.log((most.astype(np.float64) + 0.5) / 2.0**32) / RATE
    regs[some] = np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).T.astype(np.uint16)
    return regs


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of row pairs, given the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    scale, log_b = (BASE - 1) / BASE, np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = -np.log1p(-scale * np.maximum(u - v * j, 0)) / log_b
        q = -np.log1p(-scale * np.maximum(v - u * j, 0)) / log_b
        e = 1e-12
        return more * np.log(p + e) + less * np.log(q + e) + same * np.log(np.maximum(1 - p - q, e))

    lo, hi = np.zeros(len(u)), top
    g = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        better = likelihood(x) > likelihood(y)
        lo, hi = np.where(better, lo, x), np.where(better, y, hi)
    return (lo + hi) / 2


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate of each row pair reaches ``least``.

    Only pairs with about enough equal registers are estimated. A pair of the
    threshold's similarity (least + SLACK) has fewer than REGISTERS * (least - SLACK)
    of them with a probability below 1e-5, its expectation being five standard
    deviations above.
    """
    out = (a == b).sum(1) >= REGISTERS * (least - SLACK)
    some = np.flatnonzero(out)
    if len(some):
        out[some] = joint_estimate(a[some], b[some], na[some], nb[some]) >= least
    return out


def _sketch(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        marks, sizes, regs = [], [], []
        for i, j in blocks(texts):
            sets = shingles(texts[i:j])
            for s in sets:
                x = _mix(s)
                marks.append(np.array([s.sum(), np.bitwise_xor.reduce(x) if len(x) else _U(0)], np.uint64).tobytes())
                sizes.append(len(s))
            regs += [r.tobytes() for r in registers(sets)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "th", "mark", "size", "regs"])


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, th, mark, size, regs): hash of the text, mark of the shingle set, its size and registers."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_sketch, "doc_id long, th long, mark binary, size long, regs binary")


def _leaders(batches, least: float):
    """(a, b, null): pairs of leader and member, of rows sorted by bucket, that may reach ``least``; (a, null, key): members to compare.

    The first of a bucket leads it; whoever resembles none of its leaders becomes
    one, and every member of the batch's part of the bucket is compared with all.
    Of a bucket that goes on in the next batch only the leaders are kept. Members
    not yet compared with each other are two or more that don't lead, and those of
    a bucket at the end of a batch, which may go on.
    """
    open_key, open_rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("key"))
        uid = np.asarray(batch.column("uid"))
        size = np.asarray(batch.column("size")).astype(np.float64)
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(len(key), -1)
        led = []
        split = {key[-1], open_key}
        if open_key is not None and key[0] == open_key:
            u0, s0, r0 = open_rows
            key, uid, size = np.concatenate([np.full(len(u0), open_key), key]), np.concatenate([u0, uid]), np.concatenate([s0, size])
            regs, led = np.concatenate([r0, regs]), list(range(len(u0)))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        bucket = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        many = np.bincount(bucket)
        alone = np.ones(len(key), bool)  # not yet like a leader of its bucket
        leader = np.zeros(len(key), bool)
        a_out, b_out = [], []
        rounds = [np.array([x]) for x in led] or []
        while True:
            if rounds:
                heads = rounds.pop(0)
            else:
                waiting = np.flatnonzero(alone & ~leader)
                if not len(waiting):
                    break
                heads = waiting[np.unique(bucket[waiting], return_index=True)[1]]
            leader[heads] = True
            of = np.full(len(first), -1)
            of[bucket[heads]] = heads
            member = np.flatnonzero((of[bucket] >= 0) & (many[bucket] > 1))
            head = of[bucket[member]]
            member, head = member[member != head], head[member != head]
            for s in range(0, len(member), 1 << 16):
                m, h = member[s : s + (1 << 16)], head[s : s + (1 << 16)]
                like = may_reach(regs[h], regs[m], size[h], size[m], least)
                alone[m[like]] = False
                a_out.append(uid[h[like]])
                b_out.append(uid[m[like]])
        last = np.flatnonzero(leader & (bucket == bucket[-1]))
        open_key, open_rows = key[-1], (uid[last], size[last], regs[last].copy())
        loose = ~leader & (np.bincount(bucket[~leader], minlength=len(first))[bucket] > 1)
        for k in split - {None}:
            loose |= key == k
        if a_out:
            a, b = np.concatenate(a_out), np.concatenate(b_out)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])
        if loose.any():
            yield pa.RecordBatch.from_arrays([pa.array(uid[loose]), pa.nulls(int(loose.sum()), pa.int64()), pa.array(key[loose])], ["a", "b", "key"])


def _apart(batches, least: float):
    """Pairs of different roots, of rows sorted by bucket, that may reach ``least``: all pairs of each bucket are compared."""
    rest = None

    def pairs(key, uid, root, size, regs):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.repeat(np.r_[first[1:], len(key)], np.diff(np.r_[first, len(key)]))
        row, step = np.arange(len(key)), 0
        while len(row):
            step += 1
            row = row[row + step < end[row]]
            x = row[root[row] != root[row + step]]
            for s in range(0, len(x), 1 << 16):
                i = x[s : s + (1 << 16)]
                j = i + step
                like = may_reach(regs[i], regs[j], size[i], size[j], least)
                if like.any():
                    a, b = uid[i[like]], uid[j[like]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(c)) for c in ("key", "uid", "root", "size")]
        rows[3] = rows[3].astype(np.float64)
        rows.append(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(batch.num_rows, -1))
        if rest is not None:
            if rows[0][0] == rest[0][0][0] == rows[0][-1]:  # the open bucket goes on: joined when it ends
                for held, new in zip(rest, rows):
                    held.append(new)
                continue
            rows = [np.concatenate([*held, new]) for held, new in zip(rest, rows)]
        at = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
        yield from pairs(*[r[:at] for r in rows]) if at else ()
        rest = [[r[at:].copy()] for r in rows]
    if rest is not None:
        yield from pairs(*[np.concatenate(held) for held in rest])


def _sets(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        out = []
        for i, j in blocks(texts):
            out += [s.tobytes() for s in shingles(texts[i:j])]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(out, pa.binary())], ["uid", "shingles"])


def _verify(batches, threshold: float):
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(p) + len(q) - len(np.union1d(p, q))
            keep[i] = both >= threshold * (len(p) + len(q) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def components(edges: DataFrame) -> DataFrame:
    """(uid, root): the least member of each connected group, by alternating large and small stars.

    Every round sends each node's larger neighbours, then its smaller ones, to its
    least neighbour; the number of rounds grows with the logarithm of the longest path.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        w = Window.partitionBy("a")
        m = both.select("a", "b", F.least(F.min("b").over(w), F.col("a")).alias("m"))
        if large:
            new = m.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = m.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("p")).select(F.col("p.x").alias("a"), F.col("p.y").alias("b"))
        return new.filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.filter("a <> b").select("a", "b"))
    seen = state(now)
    while seen[0]:
        now = cut(star(star(now, True), False))
        then, seen = seen, state(now)
        if then == seen:
            break
    return now.groupBy(F.col("a").alias("uid")).agg(F.min("b").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, group_id, group_size, kept) of each row; group_id is the doc_id that stays."""
    units = cut(sketch(docs).withColumn("uid", F.monotonically_increasing_id()))
    same = Window.partitionBy("mark", "size")
    rep = cut(units.select("uid", "doc_id", "th", "mark", "size").withColumn("rep", F.when(F.col("size") == 0, F.col("uid")).otherwise(F.min("uid").over(same))).select("uid", "doc_id", "th", "rep"))
    sets = units.join(rep.filter("uid = rep and rep is not null").select("uid"), "uid", "left_semi").filter("size > 0")
    width = 2 * REGISTERS // BANDS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(BANDS)])
    banded = sets.select("uid", F.explode(keys).alias("key"))
    crowded = banded.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").select("uid", "key")
    least = threshold - SLACK
    pairs = (
        crowded.join(units.select("uid", "size", "regs"), "uid")
        .repartition("key").sortWithinPartitions("key", "uid")
        .select("key", "uid", "size", "regs")
        .mapInArrow(lambda it: _leaders(it, least), "a long, b long, key long")
    )
    searched = cut(pairs.distinct())
    pairs, loose = searched.filter("key is null").select("a", "b"), searched.filter("key is not null").select("key", F.col("a").alias("uid"))
    named = searched.select(F.explode(F.array("a", "b")).alias("uid")).filter("uid is not null").distinct().join(rep, "uid").select("uid", "doc_id", "th")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    wanted = named.select("uid", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("th").alias("t"))
    found = texts.join(wanted, ["d", "t"]).select("uid", "text").mapInArrow(_sets, "uid long, shingles binary")
    found = cut(found.dropDuplicates(["uid"]))

    def verified(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(found.select(F.col("uid").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(found.select(F.col("uid").alias("b"), F.col("shingles").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(lambda it: _verify(it, threshold), "a long, b long")
        )

    roots = components(verified(pairs))
    bucket = Window.partitionBy("key")
    rooted = loose.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    mixed = rooted.withColumn("least", F.min("root").over(bucket)).withColumn("most", F.max("root").over(bucket)).filter("least < most").select("key", "uid", "root")
    others = (
        mixed.join(units.select("uid", "size", "regs"), "uid")
        .repartition("key").sortWithinPartitions("key", "uid")
        .select("key", "uid", "root", "size", "regs")
        .mapInArrow(lambda it: _apart(it, least), "a long, b long")
    )
    others = cut(verified(others.distinct().join(pairs, ["a", "b"], "left_anti")))
    if not others.isEmpty():
        roots = components(others.unionByName(roots.select(F.col("uid").alias("a"), F.col("root").alias("b"))))
    roots = roots.withColumnRenamed("uid", "rep")
    grouped = rep.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    w = Window.partitionBy("root")
    first = F.row_number().over(w.orderBy(F.col("doc_id").asc_nulls_last(), "uid"))
    return grouped.select("doc_id", "th", F.min("doc_id").over(w).alias("group_id"), F.count("*").over(w).alias("group_size"), (first == 1).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, one of each group, with their columns unchanged.

    Rows that repeat a kept (doc_id, text) are cut to the number that stays, in the order of their JSON.
    """
    columns = docs.columns
    marks = near_duplicates(docs, threshold)
    kept = marks.groupBy(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("th").alias("t")).agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("there")).filter("stay > 0")
    rows = row_of(docs).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.col("row.text").cast("string")).alias("t"))
    joined = cut(kept)
    plain = rows.join(joined.filter("stay = there"), ["d", "t"], "left_semi").select("row")
    short = rows.join(joined.filter("stay < there"), ["d", "t"]).withColumn("n", F.row_number().over(Window.partitionBy("d", "t").orderBy(F.to_json("row")))).filter("n <= stay").select("row")
    return plain.unionByName(short).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates of the whole of documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "kept")


QUERIES = {"op6_setsketch_near_duplicates": op6}
SQL: dict[str, str] = {}

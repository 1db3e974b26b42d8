"""SimHash near-dedup with pigeonring candidate filtering.

A 64-bit fingerprint is cut into a ring of m = 8 segments of a byte.  If two fingerprints differ in at
most t = 3 bits, some segment starts a chain such that for every l the first l segments of the chain
differ in at most l*t/m bits together (the pigeonring principle): none in the first two segments, at most
one in the first five, at most two in the first seven.  So the pair agrees on the first two segments of
that chain and on two of the next three, which makes 8 x 3 keys of 32 bits.  Distinct fingerprints meet
under those keys; pairs whose chain then breaks a budget are pruned before the full Hamming check.

Inside a key's bucket links are found by a breadth-first walk over arrays that emits a spanning forest,
never all pairs.  A bucket of more than ``BUCKET`` fingerprints is cut into blocks, and each pair of
blocks is a bucket of its own.  Exact copies are one fingerprint throughout, so a large group of copies
costs a partial sum.  Components are found with star steps on written tables.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of one or
two words is one shingle; component_id is the smallest non-null doc_id reachable, null where there is
none; repeated rows share fingerprint and component; an empty table gives an empty table; further columns
pass through ``near_dedup`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, keeps_columns, materialise, partitions
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 8
BUCKET = 50_000
STEP = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit integer."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    stops = (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, STEP):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[k : k + STEP], stops[k : k + STEP])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _prints(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in batch.column(text_at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=[*batch.schema.names, "__fp"])

    return run


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs with __fp."""
    return bounded_batches(docs).mapInArrow(_prints(docs.columns.index("text")), T.StructType(docs.schema.fields + [T.StructField("__fp", T.LongType())]))


def _keys(prints: DataFrame) -> DataFrame:
    """(key, fp): 24 rows a fingerprint; a key's high half tells the chain's start and the segment left out."""

    def segment(i: int):
        return F.shiftrightunsigned("fp", 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))

    keys = []
    for start in range(SEGMENTS):
        for out in (2, 3, 4):
            a, b = (start + i for i in (2, 3, 4) if i != out)
            parts = [F.shiftleft(segment(i), 8 * k) for k, i in enumerate((start, start + 1, a, b))]
            value = parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])
            keys.append(value.bitwiseOR(F.lit((start * 3 + out - 2) << 32)))
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _near(x: np.ndarray, which: int) -> np.ndarray:
    """Where XORs x of fingerprints under a key of this kind (start and segment left out) are links."""
    start, out = which // 3, which % 3 + 2

    def bits(segments: range) -> np.ndarray:
        mask = np.uint64(sum(255 << 8 * ((start + i) % SEGMENTS) for i in segments))
        return np.bitwise_count(x & mask)

    ok = np.ones(len(x), dtype=bool)
    for n in (out + 1, 6, 7, 8):  # shorter chains agree by the key; budgets are n * 3 / 8
        ok &= bits(range(n)) <= n * DISTANCE // SEGMENTS
        if not ok.any():
            break
    return ok


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the buckets in a sorted stream of (key, block, fp)."""
    held: list[np.ndarray] = []
    at = None

    def walk(which: int, fps: np.ndarray) -> tuple[list, list]:
        left, a, b = np.unique(fps).view(np.uint64), [], []
        while len(left) > 1:
            front, left = [left[0]], left[1:]
            while front and len(left):
                u = front.pop()
                ok = _near(left ^ u, which)
                if ok.any():
                    new, left = left[ok], left[~ok]
                    a += [u] * len(new)
                    b += new.tolist()
                    front += list(new)
        return np.array(a, np.uint64).view(np.int64).tolist(), np.array(b, np.uint64).view(np.int64).tolist()

    def out(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        key, block, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        bounds = [0, *cut.tolist(), len(key)]
        sizes = np.diff(bounds)
        a, b = [], []
        for i in range(len(sizes)):
            lo, hi = bounds[i], bounds[i + 1]
            own = (int(key[lo]), int(block[lo]))
            if own == at:
                held.append(fp[lo:hi])
            else:
                if sum(map(len, held)) > 1:
                    x, y = walk(at[0] >> 32, np.concatenate(held))
                    a += x
                    b += y
                held, at = [fp[lo:hi]], own
        yield out(a, b)
    if sum(map(len, held)) > 1:
        yield out(*walk(at[0] >> 32, np.concatenate(held)))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints fp, enough of them to keep every component whole."""
    keys = _keys(prints)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    # block pair (i, j), i <= j, is numbered i * blocks + j
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    dealt = keys.join(sizes, "key").withColumn("blocks", blocks).select("key", F.explode(pairs).alias("block"), "fp")
    n = partitions(prints.sparkSession)
    return dealt.repartition(n, "key", "block").sortWithinPartitions("key", "block").mapInArrow(_links, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    prints = materialise(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", F.col("__fp").alias("fp")), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


@keeps_columns
def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of its smallest doc_id; the columns stay."""
    keep = classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__keep")).distinct()
    # components without any doc_id: one fingerprint's row stays
    marked = with_fingerprint(docs)
    on = marked["doc_id"].eqNullSafe(keep["__id"]) & (marked["__fp"] == keep["__keep"])
    kept = marked.join(keep, on).dropDuplicates(["doc_id", "__fp"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """The same by comparing all pairs, for tests."""
    prints = {}
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[text] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    own = {d: prints[t] for d, t in rows}
    label = {f: f for f in set(own.values())}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    known = sorted(label)
    for i, f in enumerate(known):
        for g in known[:i]:
            if (f ^ g).bit_count() <= 3:
                label[root(f)] = root(g)
    least: dict[int, int] = {}
    for d, f in own.items():
        r = root(f)
        least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least[root(f)]) for d, f in own.items()]

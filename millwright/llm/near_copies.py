"""Near-dedup by Jaccard similarity of word shingles.

Two texts are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is at least
``similarity``; one row of each connected component stays.  Candidates come first from SimHashes of the shingles:
texts whose fingerprints are equal or linked by pigeonring (``simhash.links``, 3 or fewer of 64 bits).  Those
can't propose all: at 0.8 about 10 bits differ, which leaves no keys that are selective.  So what they leave apart
are candidates if they share a band of ``ROWS`` min-hashes, with as many bands as leave a pair just at the
similarity unseen with a chance of ``MISS`` at most (22 bands at 0.8).  Either kind of candidate becomes a link
only by the exact Jaccard similarity.

Equal texts are one node throughout.  Inside the buckets that several texts share, each text is compared with
one leader of its bucket first, in ``STARS`` rounds; what lies in one component by then isn't compared any
more, so a large group of near copies costs a few comparisons a text.  Buckets that still hold several
components are walked last, whole: cut into blocks of at most about ``BLOCK`` texts and ``HASHES`` hashes, of
which every two meet in one task.  There an inverted index counts what a text shares with all others at once,
and only one link for each two components that touch is given out, never the pairs.  No bucket is cut short;
one of very many texts that resemble each other less than the similarity takes time with its square, but
neither rows nor memory beyond its blocks.  Sets are read for candidates alone.

Defined cases: case of ASCII letters and kind of white space don't count; a text of fewer words than a shingle
is one shingle; texts without words (null too) are copies of each other; the row that stays has the smallest
doc_id, null last, and of several texts with that doc_id the one with the least hash; repeated rows are one;
an empty table gives an empty table; further columns pass through untouched.  Texts and shingles are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keeps_columns, materialise, partitions
from .components import components
from .simhash import links as pigeonring

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 4
MISS = 1e-5
STARS = 2
BLOCK = 2_000
HASHES = 2_000_000
STEP = 1 << 12
SEED = 42
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = (text or "").encode().translate(_LOWER).split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[size - 1 :].tolist() if len(words) >= size else [len(joined)]
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands_for(similarity: float) -> int:
    """How many bands leave a pair at the similarity unseen with a chance of MISS at most."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS)))


def bands(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """One key a band, as signed 64-bit integers; factors are odd, one a min-hash."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), STEP):
        np.minimum(least, (factors[:, None] * hashes[k : k + STEP]).min(axis=1), out=least)
    rows = least.reshape(-1, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(len(rows))], np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of distinct shingles' hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _banded(size: int, similarity: float):
    n = bands_for(similarity) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(SEED).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            keys, prints = [], []
            for t in batch.column(2):
                hashes = shingles(t.as_py(), size)
                keys.append(bands(hashes, factors))
                prints.append(fingerprint(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())], names=["doc_id", "node", "bands", "fp"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    return run


def _compare(similarity: float):
    """From (lead, block, member, hashes) sorted so that a block's leader, of null member, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.int64)
        for batch in batches:
            a, b, ok = [], [], []
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            for i, (lead, member) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                hashes = values[offsets[i] : offsets[i + 1]]
                if member is None:
                    own = hashes.copy()
                    continue
                a.append(lead)
                b.append(member)
                low, high = sorted((len(own), len(hashes)))
                ok.append(low >= similarity * high - 1e-9 and jaccard(own, hashes) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "near"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, near) of distinct pairs (a, b), a being the leader."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("b", "a"), F.col("blocks")).cast("int")
    members = pairs.join(blocks, "a").select("a", block.alias("block"), F.col("b").alias("node")).join(sets, "node")
    leaders = blocks.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets, "node")
    rows = members.select(F.col("a").alias("lead"), "block", F.col("node").alias("member"), "hashes").union(leaders.select(F.col("node").alias("lead"), "block", F.lit(None).cast("long").alias("member"), "hashes"))
    dealt = rows.repartition(partitions(pairs.sparkSession), "lead", "block").sortWithinPartitions("lead", "block", F.col("member").asc_nulls_first())
    return materialise(dealt.mapInArrow(_compare(similarity), "a long, b long, near boolean"), "compared")


def _touching(nodes: list[int], roots: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the components (roots) of some texts as far as their similarities do: one for each two that meet."""
    labels = np.array(roots, np.int64)
    if len(np.unique(labels)) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    owners = owner[order]
    begins = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
    lengths = np.diff(np.append(begins, len(hashes)))
    slot = np.empty(len(hashes), np.int64)
    slot[order] = np.repeat(np.arange(len(begins)), lengths)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    links: list[tuple[int, int]] = []
    for u in range(len(sets)):
        slots = slot[cuts[u] : cuts[u + 1]]
        slots = slots[lengths[slots] > 1]
        if not len(slots):
            continue
        many = lengths[slots]
        places = np.repeat(begins[slots] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        both = np.bincount(owners[places], minlength=len(sets))
        near = (both / (sizes[u] + sizes - both) >= similarity - 1e-12) & (labels != labels[u])
        for other in np.unique(labels[near]):
            links.append((nodes[u], nodes[int(np.flatnonzero(near & (labels == other))[0])]))
        labels[np.isin(labels, labels[near])] = labels[u]
        if (labels == labels[0]).all():
            break
    return links


def _walk(similarity: float):
    """From (key, block, root, node, hashes) sorted by key, block and node to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, roots, sets = None, [], [], []

        def out() -> pa.RecordBatch:
            columns = list(zip(*_touching(nodes, roots, sets, similarity))) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in batches:
            lists = batch.column(4)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            for i, (key, block, root, node) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if (key, block) != at:
                    yield out()
                    at, nodes, roots, sets = (key, block), [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(values[offsets[i] : offsets[i + 1]].copy())
        yield out()

    return run


def _walked(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the components in each bucket of left (key, node, root)."""
    sized = materialise(left.join(sets.select("node", F.size("hashes").alias("size")), "node"), "apart")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / HASHES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    # block pair (i, j), i <= j, is numbered i * blocks + j
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    dealt = sized.join(blocks, "key").select("key", F.explode(pairs).alias("block"), "root", "node").join(sets, "node")
    ordered = dealt.select("key", "block", "root", "node", "hashes").repartition(partitions(left.sparkSession), "key", "block").sortWithinPartitions("key", "block", "node")
    return materialise(ordered.mapInArrow(_walk(similarity), "a long, b long"), "walked")


def _proposed(banded: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes whose fingerprints are equal or linked: each with its fingerprint's least node, and those."""
    prints = materialise(banded.select("fp", "node"), "prints")
    leads = prints.groupBy("fp").agg(F.min("node").alias("lead"))
    equal = prints.join(leads, "fp").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    near = pigeonring(leads.select("fp")).distinct()
    near = near.join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("one")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("two")), "b")
    return materialise(equal.union(near.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))).distinct(), "proposed")


def roots(banded: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes with links but the roots, from (node, bands, fp) and the (node, text) of every row."""
    keys = banded.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = materialise(keys.join(shared, "key").select("key", "node"), "buckets")
    proposed = _proposed(banded)
    candidates = buckets.select("node").union(proposed.select("a")).union(proposed.select("b")).distinct()
    sets = materialise(bounded_batches(texts).join(candidates, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(_sets(size), "node long, hashes array<long>"), "shingles")
    spark = banded.sparkSession
    found = spark.createDataFrame([], "node long, root long")
    compared = _compared(proposed, sets, similarity)
    if not compared.filter("near").isEmpty():
        found = components(compared.filter("near").select("a", "b"))
    for turn in range(STARS + 1):
        named = buckets.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        lead = named.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)), "node", "root")).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        if turn == STARS:
            links = compared.filter("near").select("a", "b").union(_walked(named.join(lead.select("key"), "key"), sets, similarity))
            return found if links.isEmpty() else components(links)
        apart = named.join(lead, "key").filter("root <> lead.root").select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
        known = compared.select("a", "b").union(compared.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = materialise(apart.distinct().join(known, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        new = _compared(pairs, sets, similarity)
        compared = compared.union(new)
        if not new.filter("near").isEmpty():
            found = components(compared.filter("near").select("a", "b"))


@keeps_columns
def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of texts at the similarity or above; the columns stay."""
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = bounded_batches(docs).select("doc_id", node.alias("node"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, bands array<long>, fp long"
    rows = materialise(marked.mapInArrow(_banded(shingle, similarity), schema), "bands")
    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    found = roots(distinct.select("node", "bands", "fp"), marked.select("node", "text"), shingle, similarity)
    named = distinct.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("kept"))
    # a row's own hash spreads a large group of equal texts over the tasks
    keep = first.select(F.col("kept.least").alias("__id"), F.col("kept.node").alias("__keep")).withColumn("__of", F.xxhash64("__id", "__keep"))
    own = docs.withColumn("__node", node).withColumn("__row", F.xxhash64("doc_id", "__node"))
    on = (own["__row"] == keep["__of"]) & (own["__node"] == keep["__keep"]) & own["doc_id"].eqNullSafe(keep["__id"])
    kept = own.join(keep, on, "left_semi").dropDuplicates(["__row", "__node"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

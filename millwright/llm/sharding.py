"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are equal texts.  A group whose share of bytes, tokens or rows is over ``1/cells`` of the whole
is an item of its own; all smaller groups are hashed into ``cells`` items.  Only a group that is over a
quarter of a shard is cut, by a hash of doc_id, into parts of about that size; all others stay together.
So there are at most 4 x cells + 12 x shards items whatever the input, and the packing itself, a loop over
items in order of size, runs on the driver over a few thousand vectors: each goes to the shard where its
dot product with the residual capacity is highest.  Where a shard's bytes are then over the mean by more than
``EVEN``, items move to the shard with the least bytes, but none that would take its tokens or rows over the
fullest shard's by more than ``SLACK`` of the mean.

Law: ``bytes`` (sizes near equal).  Slots are numbered gapless in each shard in two levels: a row number
inside sub-buckets of some ten thousand rows, plus the sub-buckets' offsets, which are summed by shard and
joined, not collected.

Defined cases: a null text has no bytes and crc32 0, and the nulls form the group of the empty text;
repeated rows are placed each; a null doc_id is placed like any other; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, materialise

SHARDS = 16
CELLS = 4096
ROWS_PER_SUB_BUCKET = 12_500
EVEN = 0.002
SLACK = 0.02


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.xxhash64(text).alias("g"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        (F.regexp_count(text, F.lit(WORD_BREAK)) + 1).cast("long").alias("tokens"),
    )


def place(unit: np.ndarray, shards: int) -> np.ndarray:
    """Largest items first, each to the shard where its dot product with the residual capacity is highest."""
    left = np.ones((shards, 3))
    at = np.zeros(len(unit), dtype=np.int64)
    for i in np.argsort(-unit.max(axis=1), kind="stable"):
        at[i] = k = int(np.argmax(left @ unit[i]))
        left[k] -= unit[i]
    return at


def even_out(unit: np.ndarray, at: np.ndarray, shards: int) -> np.ndarray:
    """Moves that even out bytes, without costing tokens or rows more than SLACK."""
    at, size = at.copy(), unit[:, 0]
    load = np.stack([np.bincount(at, weights=unit[:, k], minlength=shards) for k in range(3)], axis=1)
    most = load.max(axis=0)[1:] + SLACK
    stuck: set[int] = set()  # shards that no item can leave with a gain
    for _ in range(2 * len(unit)):
        low = int(load[:, 0].argmin())
        high = max((k for k in range(shards) if k not in stuck), key=lambda k: load[k, 0], default=low)
        gap = load[high, 0] - load[low, 0]
        if high == low or gap <= 0 or load[:, 0].max() <= 1 + EVEN:
            break
        mine = np.flatnonzero((at == high) & (size > 0) & (size < gap) & (load[low, 1:] + unit[:, 1:] <= most).all(axis=1))
        if not len(mine):
            stuck.add(high)
            continue
        i = mine[np.argmin(np.abs(size[mine] - gap / 2))]
        at[i] = low
        load[high] -= unit[i]
        load[low] += unit[i]
    return at


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; items has a row of (bytes, tokens, rows) for each."""
    total = items.sum(axis=0)
    unit = items / np.where(total > 0, total, 1) * shards  # a full shard is (1, 1, 1)
    return even_out(unit, place(unit, shards), shards)


def assign(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, one row per row of docs."""
    spark = docs.sparkSession
    rows = materialise(_measured(docs), "sharding")  # texts are read once
    sums = [F.sum(c).cast("double").alias(c) for c in ("size", "tokens")] + [F.count("*").cast("double").alias("n")]
    groups = rows.groupBy("g").agg(*sums)
    whole = rows.agg(*sums).first()
    total = [float(whole[c] or 0) for c in ("size", "tokens", "n")]
    share = F.greatest(*[F.col(c) * (cells / max(t, 1.0)) for c, t in zip(("size", "tokens", "n"), total)])
    # at most 3 x cells groups can hold over 1/cells of one of three sums
    large = {r["g"]: int(r["parts"]) for r in groups.filter(share > 1).select("g", F.ceil(share * (4.0 * shards / cells)).alias("parts")).collect()}
    listed = spark.createDataFrame(list(large.items()), "g long, parts int")
    placed = rows.join(F.broadcast(listed), "g", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "g"), F.col("parts")).cast("int"))
    ).withColumn("cell", F.when(F.col("part") < 0, F.pmod("g", F.lit(cells))).otherwise(F.col("g")))
    items = placed.groupBy("cell", "part").agg(*sums).orderBy("cell", "part").collect()
    vectors = np.array([[r["size"], r["tokens"], r["n"]] for r in items], dtype=float).reshape(-1, 3)
    at = pack(vectors, shards)
    plan = spark.createDataFrame([(r["cell"], r["part"], int(k)) for r, k in zip(items, at)], "cell long, part int, shard int")
    dealt = placed.join(F.broadcast(plan), ["cell", "part"]).select("doc_id", "size", "text_crc32", "shard")
    subs = int(total[2]) // (shards * ROWS_PER_SUB_BUCKET) + 1
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(subs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)  # a row for each sub-bucket
    base = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size")
    return dealt.withColumn("r", F.row_number().over(order)).join(base, ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("r") - 1).alias("slot")
    )


def op9(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

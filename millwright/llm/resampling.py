"""Importance resampling towards a target: array-scored weights, Gumbel keys, and a distributed radix sort.

``gains`` counts hashed words and word pairs of all documents and of the target into one array each (10,000
buckets; a task sends its own array once) and turns them into an array of scaled log ratios, which is all that
is broadcast.  ``score`` reads texts again and takes each document's mean gain by indexing that array; adding a
Gumbel variable drawn from a hash of the doc_id makes the highest scores a weighted draw without replacement.
``radix_sort`` ranks rows by least-significant-digit passes.  A pass is a stable counting sort: rows are
counted by digit and block of places, the counts' prefix sums (over digits, then over a digit's blocks) say
where each block's rows of that digit begin, and a row's place in its block and digit is added.  Places are
explicit columns of a written table, so a pass that is run again after an executor is lost gives the same
places, and no task holds more than a block's rows of one digit or a digit's counts.  What sets the number of passes is the
width of the keys, not the number of rows.

Texts are cut into pieces at word boundaries while they are read, so a task holds the words of a piece.

Defined cases: a null or empty text has no words, no features and weight 0.  A null doc_id is hashed as '' and
comes before all others; rows that agree in score and doc_id are ranked one after the other, in an arbitrary but
fixed order.  An empty table gives an empty table; an empty target has counts of 0.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

BUCKETS = 10_000
SCALE = 1000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bits in a digit at most, and places in a block.
DIGIT_BITS, BLOCK = 12, 4096
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: A-Z in lower case, ASCII letters and digits and all bytes above as they are, the rest a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _pieces(text: str) -> Iterator[list[bytes]]:
    folded, start = text.encode().translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def hashed(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of a text's words and word pairs, by pieces: (words so far, array), one entry for each occurrence."""
    n, last = 0, None
    for words in _pieces(text or ""):
        if not words:
            continue
        single = list(map(crc32, words))
        before = single[:-1] if last is None else [last, *single[:-1]]
        pairs = map(crc32, [b" " + w for w in (words[1:] if last is None else words)], before)
        n, last = n + len(words), single[-1]
        yield n, np.array([*single, *pairs], dtype=np.int64) % BUCKETS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            for _, found in hashed(text.as_py()):
                total += np.bincount(found, minlength=BUCKETS)
    some = np.nonzero(total)[0]
    yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "n": total[some]})


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket's features occur in all texts; what comes to the driver is one number for each bucket."""
    sent = bounded_batches(texts.select("text")).mapInArrow(_counted, "bucket int, n bigint")
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in sent.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, the floored thousandfold log of its smoothed share in the target over that in the documents."""
    s_all, t_all = float(documents.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    drawn = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((drawn + 0.5) / 4294967296)))


def score(docs: DataFrame, by_bucket: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words = n = total = 0
                for n_words, found in hashed(text.as_py()):
                    n, total = n + len(found), total + int(by_bucket[found].sum())
                weight = total // n if n else 0
                rows.append((doc_id, n_words, n, weight, weight + gumbel(doc_id, seed)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return bounded_batches(narrow).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    """A stable counting sort of rows (row, keys, place) by one digit: the same rows with their new places."""
    dealt = rows.withColumns({"digit": digit.cast("int"), "block": F.floor(F.col("place") / BLOCK)})
    counts = dealt.groupBy("digit", "block").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    digits = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(F.col("digit").alias("of"), before(Window.orderBy("digit")).alias("smaller"))
    blocks = counts.select("digit", "block", before(Window.partitionBy("digit").orderBy("block")).alias("earlier"))
    starts = blocks.join(F.broadcast(digits), F.col("digit") == F.col("of"))  # a digit's values: 2 ** DIGIT_BITS rows at most
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")))
    joined = ranked.join(starts.select("block", "digit", (F.col("smaller") + F.col("earlier") - 1).alias("start")), ["block", "digit"])
    return materialise(joined.select(*[c for c in rows.columns if c != "place"], (F.col("start") + F.col("rank")).alias("place")), "radix")


def _digits(name: str, lowest: int, highest: int) -> list[Column]:
    """From the least significant: the digits of a column's distance from lowest, of equal width."""
    span = highest - lowest
    value = F.col(name) - F.lit(lowest) if span < 1 << 63 else F.col(name).bitwiseXOR(F.lit(-(1 << 63)))
    bits = span.bit_length() if span < 1 << 63 else 64
    n = -(-bits // DIGIT_BITS)
    width = -(-bits // n) if n else 0
    return [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(n)]


def radix_sort(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (written, with a column place that has distinct numbers of 0 or more) with their places in ascending
    order of keys (bigint, without nulls), the first key the most significant; ties stay in the order of place."""
    spans = rows.agg(*[f(k) for k in keys for f in (F.min, F.max)]).first()
    if spans[0] is None:
        return rows
    for k, lowest, highest in reversed(list(zip(keys, spans[::2], spans[1::2]))):
        for digit in _digits(k, lowest, highest):
            rows = _pass(rows, digit)
    return rows


def rank(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with rank: 1, 2, 3... from the highest score, ties to the smaller doc_id, as far as percent of
    the rows with min_words words go; null behind that."""
    written = materialise(scored.withColumn("place", F.monotonically_increasing_id()), "scores")
    long_enough = written.filter(F.col("n_words") >= min_words)
    keyed = long_enough.select(F.col("place").alias("row"), "place", (-F.col("score")).alias("down"), F.col("doc_id").isNotNull().cast("bigint").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    drawn = keyed.count() * percent // 100
    places = radix_sort(keyed, ["down", "known", "id"])
    if drawn == 0:
        return written.drop("place").withColumn("rank", F.lit(None).cast("bigint"))
    ranks = places.filter(F.col("place") < drawn).select(F.col("row").alias("place"), (F.col("place") + 1).alias("rank"))
    return written.join(ranks, "place", "left").drop("place")


def resample(docs: DataFrame, target: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs; those with a rank are the draw."""
    by_bucket = gains(bucket_counts(docs), bucket_counts(target))
    return rank(score(docs, by_bucket, seed), min_words, percent)


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 as a fold over bytes, each of them a fold over its bits.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || hex(encode(f))[2 * i - 1:2 * i])::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
SQL = f"""
WITH texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
split_up AS (SELECT side, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts),
features AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split_up),
counted AS (SELECT side, r, f, count(*) AS n FROM features GROUP BY ALL),
buckets AS (SELECT f, {_SQL_CRC} % 10000 AS b FROM (SELECT DISTINCT f FROM counted)),
in_bucket AS (SELECT side, r, b, sum(n)::BIGINT AS n FROM counted JOIN buckets USING (f) GROUP BY ALL),
totals AS (SELECT b, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM in_bucket GROUP BY b),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM totals),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM totals, sums),
weights AS (SELECT r, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM in_bucket JOIN gain USING (b) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM split_up LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""

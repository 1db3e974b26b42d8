"""Document fingerprints by SpotSigs: chains of content words behind common words, compared as sets.

The words that stand in most documents are the anchors (``anchors``: counted over all texts, with map-side
combine; a fixed number of them comes to the driver).  Each anchor in a text is a spot: its signature is the
crc32 of the anchor and the next ``CHAIN`` words that are no anchors.  A text's fingerprint is its sorted set of
signatures, eight hexadecimal digits each.  Sets are partitioned by length, each partition's lengths spanning a
factor of 1 / ``FLOOR``: sets that are more than one partition apart can't reach that likeness and are not
compared; nor are those whose own lengths don't allow it; a Jaccard similarity below the floor counts as 0.

``compare_edits`` holds each document against its edited text and against the document behind it.  Places in
the order of doc_id come from narrow rows; a document's beginning and its signatures then go to the one document
before it, so texts are shuffled once (both joins read the same exchange) and no task sees more than its share
of ids.  DataFrame functions only.

Defined cases: a null text is empty; an empty text has no signatures, and two of those are alike by 1.  A text with
words but without a spot takes every word as its spot; a text without words is one signature of the whole
text.  Rows that repeat a doc_id are ordered by a hash of their text, and equal rows count as one document, each
with the same result; a null doc_id comes first.  The only document is its own next one.  An empty table gives
an empty table.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower
from .numbering import numbered

#: Common words, and the words of a chain.
ANCHORS, CHAIN = 100, 3
#: A likeness below this is none.
FLOOR = 0.1
WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Smaller than any doc_id: stands for null in comparisons.
LOWEST = -(2**63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), WORD_BREAK), lambda w: w != "")


def anchors(docs: DataFrame, n: int = ANCHORS) -> list[str]:
    """The n words that stand in most texts, ties in the order of their bytes."""
    found = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    return [r.word for r in found.orderBy(F.desc("docs"), "word").limit(n).collect()]


def _signature(parts: list[Column]) -> Column:
    """crc32, moved into the range of an int."""
    return (F.crc32(F.concat_ws(" ", *parts).cast("binary")) - F.lit(1 << 31)).cast("int")


def signatures(text: Column, common: list[str]) -> Column:
    """The sorted set of a text's signatures, as ints."""

    def of(w: Column) -> Column:
        every = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        is_anchor = lambda i: F.get(w, i).isin(common) if common else F.lit(False)

        def chains(content: Column) -> Column:
            """The k-th anchor, at i, has i - k content words before it."""
            spots = F.filter(every, lambda i: is_anchor(i))
            followed = lambda i, k: _signature([F.get(w, i), *[F.get(w, F.get(content, i - k + c)) for c in range(CHAIN)]])
            return F.transform(spots, lambda i, k: F.when(i - k < F.size(content), followed(i, k)))

        spotted = _let(F.filter(every, lambda i: ~is_anchor(i)), chains)
        plain = F.transform(every, lambda i: _signature([F.get(w, i + c) for c in range(CHAIN + 1)]))
        whole = F.when(F.length(text) > 0, F.array(_signature([text]))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(spotted, lambda s: s.isNotNull())
        return _let(kept, lambda s: F.when(F.size(s) > 0, s).when(F.size(w) > 0, plain).otherwise(whole))

    return F.sort_array(F.array_distinct(_let(_words(text), of)))


def fingerprint(found: Column) -> Column:
    return F.lower(F.array_join(F.transform(found, lambda s: F.lpad(F.hex(s.cast("bigint") + F.lit(1 << 31)), 8, "0")), ""))


def length_partition(found: Column, floor: float = FLOOR) -> Column:
    """Lengths in a partition differ by less than a factor of 1 / floor; 0 for an empty set."""
    return F.when(F.size(found) == 0, 0).otherwise(F.floor(F.log(F.size(found).cast("double")) / F.lit(-log(floor))).cast("int") + 1)


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Jaccard similarity of two sets, 0 where it is below floor; most of those are told by partition or length."""
    x, y = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    similar = _let(both / (x + y - both), lambda j: F.when(j >= floor, j).otherwise(0.0))
    apart = F.abs(length_partition(a, floor) - length_partition(b, floor)) > 1
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0) | apart, 0.0).when(F.least(x, y) < floor * F.greatest(x, y), 0.0).otherwise(similar)


def _next_documents(base: DataFrame) -> DataFrame:
    """For each document (d, h): the one before it (to_d, to_h), and how much of this text that one takes."""
    ids = numbered(base.select("d", "h", F.floor(F.char_length("text") / 4).cast("int").alias("quarter")).distinct(), ["d", "h"], "spot-order")
    total = max(ids.count(), 1)
    before = ids.select(F.col("d").alias("to_d"), F.col("h").alias("to_h"), "quarter", F.pmod(F.col("ordinal") + 1, F.lit(total)).alias("ordinal"))
    return ids.select("ordinal", F.col("d").alias("of_d"), F.col("h").alias("of_h")).join(before, "ordinal").drop("ordinal")


def compare_edits(docs: DataFrame, common: list[str] | None = None) -> DataFrame:
    """One row for each of docs: doc_id, n_chars, edited (the text with its last quarter replaced by the beginning of
    the next document), own and changed (both texts' signatures), near_edited, near_next and next_doc_id."""
    common = anchors(docs) if common is None else common
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    spotted = base.withColumn("own", signatures(F.col("text"), common))
    # one row of each document, by a window and not an aggregate: both joins are to read the same exchange of texts,
    # for which they also have to need the same columns
    once = spotted.withColumn("again", F.lag(F.lit(1)).over(Window.partitionBy("d", "h").orderBy("d"))).filter("again is null")
    order = _next_documents(base)
    sent = once.join(order, (F.col("d") == F.col("of_d")) & (F.col("h") == F.col("of_h"))).select(
        "to_d", "to_h", "quarter", F.substr("text", F.lit(1), F.col("quarter")).alias("beginning"), F.col("own").alias("next_own"), F.col("doc_id").alias("next_doc_id")
    )
    met = spotted.join(sent, (F.col("d") == F.col("to_d")) & (F.col("h") == F.col("to_h")))
    n = F.char_length("text")
    edited = met.withColumns({"n_chars": n.cast("bigint"), "edited": F.concat(F.substr("text", F.lit(1), n - F.col("quarter")), F.col("beginning"))})
    changed = edited.withColumn("changed", signatures(F.col("edited"), common))
    return changed.select(
        "doc_id", "n_chars", "edited", "own", "changed", "next_doc_id",
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op11(docs: DataFrame) -> DataFrame:
    found = compare_edits(docs)
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next", length_partition(F.col("own")).alias("length_partition"), "next_doc_id",
    )


#: crc32 as a fold over bytes, each of them a fold over its bits.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || hex(encode(f))[2 * i - 1:2 * i])::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
_SQL_WORDS = """list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
_SQL_NEAR = """CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) >= {floor}::DOUBLE
    THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0::DOUBLE END"""
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
placed AS (SELECT doc_id, t, length(t) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS total FROM d),
paired AS (SELECT a.*, left(a.t, a.n - a.n // 4) || left(b.t, a.n // 4) AS edited, b.doc_id AS next_id FROM placed a JOIN placed b ON (a.o + 1) % a.total = b.o),
common AS (SELECT w FROM (SELECT unnest(list_distinct({_SQL_WORDS})) AS w FROM d) GROUP BY w ORDER BY count(*) DESC, w LIMIT {ANCHORS}),
texts AS (SELECT doc_id, 'own' AS kind, t, {_SQL_WORDS} AS w FROM d UNION ALL SELECT doc_id, 'edited', t, {_SQL_WORDS} FROM (SELECT doc_id, edited AS t FROM paired)),
word_rows AS (SELECT doc_id, kind, t, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts),
flagged AS (SELECT doc_id, kind, i, x, c.w IS NOT NULL AS spot FROM word_rows r LEFT JOIN common c ON r.x = c.w),
content AS (SELECT doc_id, kind, list(x ORDER BY i) AS words FROM flagged WHERE NOT spot GROUP BY ALL),
spots AS (SELECT doc_id, kind, x, i - row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS r FROM flagged WHERE spot),
chains AS (SELECT doc_id, kind, x || ' ' || array_to_string(words[r + 1:r + {CHAIN}], ' ') AS f FROM spots JOIN content USING (doc_id, kind) WHERE r < len(words)),
spotless AS (SELECT * FROM texts WHERE (doc_id, kind) NOT IN (SELECT (doc_id, kind) FROM chains)),
every AS (SELECT doc_id, kind, f FROM chains
  UNION ALL SELECT doc_id, kind, array_to_string(w[i:i + {CHAIN}], ' ') FROM (SELECT *, generate_subscripts(w, 1) AS i FROM spotless)
  UNION ALL SELECT doc_id, kind, t FROM spotless WHERE len(w) = 0 AND t <> ''),
summed AS (SELECT f, {_SQL_CRC} AS s FROM (SELECT DISTINCT f FROM every)),
sets AS (SELECT t.doc_id, t.kind, coalesce(list(DISTINCT s ORDER BY s) FILTER (WHERE s IS NOT NULL), []) AS sigs FROM texts t LEFT JOIN every e ON t.doc_id = e.doc_id AND t.kind = e.kind LEFT JOIN summed USING (f) GROUP BY ALL),
found AS (SELECT p.doc_id, p.next_id, n, sha256(edited) AS edited_sha256, a.sigs AS own, b.sigs AS changed, c.sigs AS next_own
  FROM paired p JOIN sets a ON p.doc_id = a.doc_id AND a.kind = 'own' JOIN sets b ON p.doc_id = b.doc_id AND b.kind = 'edited' JOIN sets c ON p.next_id = c.doc_id AND c.kind = 'own')
SELECT doc_id, n AS n_chars, edited_sha256, array_to_string(list_transform(own, lambda s: printf('%08x', s)), '') AS fingerprint, array_to_string(list_transform(changed, lambda s: printf('%08x', s)), '') AS edited_fingerprint,
  {_SQL_NEAR.format(a="own", b="changed", floor=FLOOR)} AS near_edited, {_SQL_NEAR.format(a="own", b="next_own", floor=FLOOR)} AS near_next,
  CASE WHEN len(own) = 0 THEN 0 ELSE floor(ln(len(own)::DOUBLE) / {-log(FLOOR)!r}::DOUBLE)::INTEGER + 1 END AS length_partition, next_id AS next_doc_id FROM found
"""

"""Line dedup: range-partitioned line hashes with a secondary sort, answered with keep bitmaps.

Lines of at least ``min_chars`` code points found in at least ``min_docs`` documents stay only in the
largest doc_id that holds them.  DataFrame functions only.

Line hashes are written once, then range-partitioned with a salt and sorted by document and position, so
that a line that a third of all documents hold is spread over ``salts`` runs.  Each run is streamed once: the
first occurrence of a line in a document is the one whose predecessor lies in another document.  First
occurrences are counted per run with map-side combine, runs are summed per line, and a line's verdict goes
back to its own runs only, so that no join meets a hot key either.  What must go comes back as run-length
coded bitmaps (start and length of dropped runs) per document.  ``keep_bitmaps`` moves no text at all;
``dedup_lines`` sends each text through one shuffle, to meet its bitmap.

Defined cases: a null or empty text is one empty line, kept; a null doc_id counts as one document that
is smaller than all others (the least long stands for it in comparisons); repeated rows of a doc_id are one
document, each row with its own bitmap; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialise, partitions

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 64
#: Smaller than any doc_id: stands for null in comparisons.
LOWEST = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LOWEST)).alias("d"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("lines"))


def dropped_runs(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """(d, t, runs): the runs of lines that go, for each document (and text) that loses any."""
    key = F.btrim(F.col("line"), F.lit(SPACE))
    lines = (
        _keyed(docs)
        .select("d", "t", F.posexplode("lines").alias("pos", "line"))
        .filter(F.char_length(key) >= min_chars)
        .select("d", "t", "pos", ascii_lower(key).alias("k"))
        .select("d", "t", "pos", F.xxhash64("k").alias("h"), F.hash("k").alias("g"), F.pmod(F.hash("d"), F.lit(salts)).alias("s"))
    )
    lines = materialise(lines, "lines")
    ranged = lines.select("h", "g", "s", "d", "pos").repartitionByRange(partitions(docs.sparkSession), "h", "g", "s")
    run = Window.partitionBy("h", "g", "s").orderBy("d", "pos")
    firsts = ranged.withColumn("before", F.lag("d").over(run)).filter(F.col("before").isNull() | (F.col("before") != F.col("d")))
    runs = materialise(firsts.groupBy("h", "g", "s").agg(F.count("*").alias("n"), F.max("d").alias("last")), "line-runs")
    repeated = runs.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("last").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    verdicts = runs.select("h", "g", "s").join(repeated, ["h", "g"])  # at most `salts` rows a line
    gone = lines.join(verdicts, ["h", "g", "s"]).filter(F.col("d") < F.col("keeper")).select("d", "t", "pos").distinct()
    island = gone.withColumn("isle", F.col("pos") - F.row_number().over(Window.partitionBy("d", "t").orderBy("pos")))
    found = island.groupBy("d", "t", "isle").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
    return found.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))


def keep_bitmaps(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped and the dropped runs (empty: all lines stay), one row per row of docs."""
    narrow = _keyed(docs).select("doc_id", "d", "t", F.size("lines").cast("long").alias("n_lines"))
    return _with_runs(narrow, docs, **limits).select("doc_id", "n_lines", _n_dropped().alias("n_dropped"), "runs")


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text."""
    everything = F.sequence(F.lit(0), F.size("lines") - 1)
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    kept = F.transform(F.array_except(everything, gone), lambda i: F.get(F.col("lines"), i))
    text = F.when(F.size("runs") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n"))
    return _with_runs(_keyed(docs), docs, **limits).select("doc_id", F.size("lines").cast("long").alias("n_lines"), _n_dropped().alias("n_dropped"), text.alias("text"))


def _n_dropped():
    return F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["length"])


def _with_runs(keyed: DataFrame, docs: DataFrame, **limits) -> DataFrame:
    none = F.array().cast("array<struct<start:int,length:int>>")
    return keyed.join(dropped_runs(docs, **limits), ["d", "t"], "left").withColumn("runs", F.coalesce("runs", none))


def op6(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split_up AS (SELECT doc_id, string_split(t, chr(10)) AS lines FROM docs),
lines AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM split_up),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT a.doc_id, a.pos, a.line, r.k IS NOT NULL AND a.doc_id <> r.keeper AS gone FROM keyed a LEFT JOIN repeated r ON a.k = r.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""Quality rules with host verdicts: per-document rules, then failure rates by host under a beta prior.

A document fails the base rules if it has fewer than ``min_words`` words or if more than half of its
words stand in three-word windows that occur twice or more in it.  Failures are summed by host (here the
source of a document), the hosts' rates are shrunk towards a beta prior fitted to all hosts by the
method of moments, and a host whose shrunk rate is over the limit takes its other documents down with it.  The
limit follows from the prior: its mean and ``DEVIATIONS`` of its standard deviations, and no more than ``HOST_LIMIT``
(a prior as wide as that says that there are good hosts and bad ones, and no deviation is far from its mean).  DataFrame functions only.  Texts are read once: what the rules count is written, and failures are
summed from that with map-side combine, so a host with a third of all rows is no hot key.  A host's verdict
goes back to the salts that its documents have, and documents meet it by host and salt, without a broadcast
hint, for the table of hosts grows with the corpus.

Defined cases: a null text has no words and fails; a null source is the host ''; repeated rows count
each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A shrunk failure rate above this rejects a host, and one above the prior's mean by so many of its deviations.
HOST_LIMIT, DEVIATIONS = 0.6, 3.0
#: Parts a host's documents are dealt into when they meet its verdict.
SALTS = 64


def base_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """doc_id, host, the counts and base_failed; one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = F.lit(0).cast("long")
    with_words = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("host"), text.alias("t"), words(F.col("text")).alias("w"))
    counted = with_words.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", zero, lambda a, x: a + F.char_length(x)).alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.when(
            F.size("w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("tri"),
    )
    ordered = counted.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("tri")) < F.size("tri"), F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"),
    )
    last = F.size("s") - 1
    twice = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: ((i > 0) & (F.get(F.col("s"), i - 1)["h"] == F.get(F.col("s"), i)["h"])) | ((i < last) & (F.get(F.col("s"), i + 1)["h"] == F.get(F.col("s"), i)["h"])),
    )
    starts = F.transform(twice, lambda i: F.get(F.col("s"), i)["i"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    return ordered.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("s").isNull(), zero).otherwise(covered.cast("long")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")))


def host_verdicts(ruled: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failed, shrunk_rate, host_limit, host_kept: one row per host.

    Prior: the hosts' rates have mean m and variance v about it; a beta prior with that mean has strength
    m(1-m)/v - 1, kept between 1 and 1,000 pseudo-documents (1,000 where hosts don't differ at all).
    """
    hosts = ruled.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(rate).alias("v"))
    strength = F.when(F.col("v") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    shrunk = (F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    limit = F.least(F.lit(host_limit), F.col("m") + DEVIATIONS * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("strength") + 1)))
    return (
        hosts.join(F.broadcast(prior.withColumn("strength", strength)))  # one row
        .select("host", "n", "failed", shrunk.alias("shrunk_rate"), limit.alias("host_limit"), (shrunk <= limit).alias("host_kept"))
    )


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: counts, base_failed, the host's shrunk rate and kept."""
    salt = F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int")
    ruled = materialise(base_rules(docs).withColumn("salt", salt), "quality")
    verdicts = host_verdicts(ruled, host_limit).select("host", "shrunk_rate", "host_kept")
    dealt = ruled.select("host", "salt").distinct().join(verdicts, "host")  # at most SALTS rows a host, and no more than it has documents
    return ruled.join(dealt, ["host", "salt"]).drop("salt").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def op7(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM tri),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
base AS (SELECT w.doc_id, host, len(w.w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM ruled GROUP BY host),
prior AS (SELECT sum(failed) / sum(n) AS m, var_pop(failed / n) AS v FROM hosts),
strong AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM prior),
verdict AS (SELECT host, (failed + m * s) / (n + s) <= least(0.6, m + 3.0::DOUBLE * sqrt(m * (1 - m) / (s + 1))) AS ok FROM hosts, strong)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM ruled JOIN verdict ON ruled.host = verdict.host
"""

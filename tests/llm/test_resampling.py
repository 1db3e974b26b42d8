"""Importance resampling against a plain recomputation, and the radix sort against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwright.llm import resampling

SCHEMA = "doc_id long, text string, place string, digit string, block string"


def bucket_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(found), [zlib.crc32(f.encode()) % 10_000 for f in [*found, *map(" ".join, zip(found, found[1:]))]]


def brute_force(docs, target):
    hashed = [(d, *bucket_list(t)) for d, t in docs]
    s, t = Counter(b for _, _, bs in hashed for b in bs), Counter(b for x in target for b in bucket_list(x)[1])
    n_s, n_t = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(10_000)]
    rows = []
    for d, n_words, bs in hashed:
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        rows.append((d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    drawn = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    places = {r[0]: i + 1 for i, r in enumerate(drawn[: 25 * len(drawn) // 100])}
    return [(*r[:4], places.get(r[0]) if r[4] >= 20 else None) for r in rows]


def made(n, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"W{i}x" for i in range(300)] + ["Größe", "東京", "ÉTÉ", "9th"]
    yield from ((i * 37 - 500, rnd.choice([" ", "\n", ", "]).join(rnd.choices(vocabulary, k=rnd.randrange(60)))) for i in range(n))
    yield from [(10**15, None), (10**15 + 1, ""), (10**15 + 2, "?!"), (None, "word " * 30), (7_000, "a b " * 400_000)]


def test_against_brute_force(spark):
    docs, target = list(made(400)), ["W1x W2x W3x Größe", None, "", "9th 9th"]
    df = spark.createDataFrame([(d, t, "p", "d", "b") for d, t in docs], SCHEMA).repartition(6)
    found = resampling.op13(df, spark.createDataFrame([(t,) for t in target], "text string"))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_force(docs, target), key=key)


def test_empty_target_and_empty_table(spark):
    docs, none = list(made(10)), spark.createDataFrame([], "text string")
    df = spark.createDataFrame([(d, t, "p", "d", "b") for d, t in docs], SCHEMA)
    assert {tuple(r) for r in resampling.op13(df, none).collect()} == set(brute_force(docs, []))
    assert resampling.op13(df.filter("false"), none).count() == 0


def test_few_documents_of_one_id(spark):
    """Equal rows each have a place of their own."""
    df = spark.createDataFrame([(5, "word " * 25, "", "", "")] * 8, SCHEMA)
    found = resampling.op13(df, spark.createDataFrame([], "text string")).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2] and len({r.score for r in found}) == 1


@pytest.mark.parametrize("bits, block", [(12, 4096), (3, 7)])
def test_radix_sort(spark, monkeypatch, bits, block):
    monkeypatch.setattr(resampling, "DIGIT_BITS", bits)
    monkeypatch.setattr(resampling, "BLOCK", block)
    rnd = random.Random(3)
    rows = [(i * 3, rnd.choice([5, 5, 5, -40, rnd.randrange(1000)]), rnd.choice([-3, 8])) for i in range(500)]
    df = spark.createDataFrame(rows, "place long, a long, b long").withColumn("row", F.col("place"))
    found = [r.row for r in resampling.radix_sort(df, ["a", "b"]).orderBy("place").collect()]
    assert found == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[2], r[0]))]


def test_widest_keys(spark):
    keys = [-(2**63), 2**63 - 1, 0, -1, 1]
    df = spark.createDataFrame(list(enumerate(keys)), "place long, a long").withColumn("row", F.col("a"))
    assert [r.row for r in resampling.radix_sort(df, ["a"]).orderBy("place").collect()] == sorted(keys)


def test_pieces_are_one_text(monkeypatch):
    text = "one two  Three fourteen five, six\nseven"
    whole = sorted(int(b) for _, found in resampling.hashed(text) for b in found)
    monkeypatch.setattr(resampling, "PIECE", 4)
    cut = sorted(int(b) for _, found in resampling.hashed(text) for b in found)
    assert whole == cut == sorted(bucket_list(text)[1])

"""Spot signatures against a plain recomputation, and the cases that the module states."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwright.llm import spotsigs

SCHEMA = "doc_id long, text string, d string, own string, quarter string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def signatures(text, common):
    w = words(text)
    content = [i for i, x in enumerate(w) if x not in common]
    chains = []
    for i, x in enumerate(w):
        behind = [w[j] for j in content if j > i][: spotsigs.CHAIN]
        if x in common and behind:
            chains.append(" ".join([x, *behind]))
    if not chains:
        chains = [" ".join(w[i : i + spotsigs.CHAIN + 1]) for i in range(len(w))] or ([text] if text else [])
    return {zlib.crc32(c.encode()) for c in chains}


def near(a, b):
    if not a and not b:
        return 1.0
    j = len(a & b) / len(a | b)
    return j if j >= spotsigs.FLOOR else 0.0


def brute_force(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    count = Counter(x for _, t in rows for x in set(words(t)))
    common = {x for x, _ in sorted(count.items(), key=lambda p: (-p[1], p[0].encode()))[: spotsigs.ANCHORS]}
    hexed = lambda s: "".join(f"{x:08x}" for x in sorted(s))
    for k, (d, t) in enumerate(rows):
        behind = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + behind[: len(t) // 4]
        a, b, c = (signatures(x, common) for x in (t, edited, behind))
        yield d, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c)


def made(n, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}x" for i in range(2000)]
    for i in range(n):
        filler = lambda: rnd.choice(["The", "of", "und", "à", "in"]) if rnd.random() < 0.3 else rnd.choice(vocabulary)
        yield i * 3 - 30, " ".join(filler() for _ in range(rnd.randrange(120)))
    yield from [(5_000, None), (5_001, ""), (5_003, "?! ?!"), (5_004, "!!"), (5_005, "of the"), (5_006, "𝕏東京 " * 50), (None, "no id of mine"), (5_010, "the w1x of w2x " * 5_000)]


@pytest.mark.parametrize("common", [100, 4, 0])
def test_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(spotsigs, "ANCHORS", common)
    rows = [*made(60), (6_000, "a copy " * 30), (6_001, "a copy " * 30)]
    df = spark.createDataFrame([(*r, "d", "own", "q") for r in rows], SCHEMA).repartition(5)
    found = spotsigs.compare_edits(df, spotsigs.anchors(df, common))
    named = found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256), spotsigs.fingerprint(F.col("own")), spotsigs.fingerprint(F.col("changed")), "near_edited", "near_next")
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, named.collect()), key=key) == sorted(brute_force(rows), key=key)


def test_rows_that_repeat_and_lone_rows(spark):
    rows = [(1, "one of the many words"), (1, "one of the many words"), (1, "another text"), (2, None), (2, "")]
    found = spotsigs.op11(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()
    assert len(found) == 5 and len({tuple(r) for r in found if r.n_chars == 21}) == 1
    lone = spotsigs.op11(spark.createDataFrame([(7, "abcd of efgh", "", "", "")], SCHEMA)).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"abcd of eabc").hexdigest()
    assert spotsigs.op11(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_loses_nothing(spark):
    """Sets of all lengths up to some partitions: the likeness is the plain one."""
    rnd = random.Random(2)
    pairs = [(sorted(rnd.sample(range(400), rnd.choice([0, 1, 5, 12, 90, 101, 300]))), sorted(rnd.sample(range(400), rnd.choice([0, 1, 9, 10, 11, 99, 100])))) for _ in range(400)]
    pairs += [(list(range(100)), list(range(n))) for n in (9, 10, 11, 1)]
    df = spark.createDataFrame(pairs, "a array<int>, b array<int>").select("*", spotsigs.likeness(F.col("a"), F.col("b")).alias("j"))
    assert all(r.j == near(set(r.a), set(r.b)) for r in df.collect())


def test_copies_with_a_changed_end_stay_alike(spark):
    rows = [r for r in made(200, 5) if r[1] and len(r[1]) > 300 and 0 <= (r[0] or -1) < 5_000]
    found = spotsigs.op11(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()
    assert min(r.near_edited for r in found) > 0.3 and sum(r.near_next > 0.1 for r in found) <= 1

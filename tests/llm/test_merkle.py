"""The Merkle manifest against a plain recomputation: several depths, lone leaves, many languages, tampering."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millwright.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_force(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0], leaf(r, r[1])))
    trees = {x: tree([leaf(r, r[1]) for r in groups[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    for j, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            own = trees[lang][0][i]
            folded = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            siblings = ""
            for levels, k in ((trees[lang], i), (top, j)):
                for level in levels[:-1]:
                    run, at = level[k // 8 * 8 :][:8], k % 8
                    siblings += "".join(run[:at] + run[at + 1 :])
                    folded, k = h("".join([*run[:at], folded, *run[at + 1 :]])), k // 8
            yield (r[0], own, trees[lang][-1][0], top[-1][0], h(siblings), folded, folded == top[-1][0])


TABLES = {
    "one row": [(5, "A", "en", "s", 1)],
    "one language": [(i, f"Text {i}", "en", None, i) for i in range(73)],
    "many languages": [(i, f"Größe {i}", f"L{i % 19}" if i % 7 else None, "s", None) for i in range(600)] + [(9_999, "x", "", "", 0)],
    "ties and nulls": [(None, "A", None, None, None), (None, "B", None, None, None), (3, None, "", "s", 0), (3, "", "", "s", 0), (3, "Z", "", "s", 0), (3, "Z", "", "s", 0), (-3, "東京 X", "en", "s", 4), (6, "Ab " * 200_000, "en", "s", 600_000)],
}


@pytest.mark.parametrize("name", TABLES)
def test_against_brute_force(spark, name):
    rows = TABLES[name]
    found = merkle.op12(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(brute_force(rows), key=key)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 5)
    rows = TABLES["many languages"]
    assert sorted(map(tuple, merkle.op12(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(brute_force(rows))


def test_a_manifest_kept_finds_what_changed_later(spark):
    """The manifest of a table, and the rows as they are found later: one text differs."""
    docs = spark.createDataFrame(TABLES["one language"], SCHEMA)
    later = F.when(F.col("doc_id") == 40, merkle.leaf_digest(F.lit("changed")))
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert [r.doc_id for r in merkle.verify(docs, later).filter("not verified").collect()] == [40]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_nodes_are_linked_to_their_parents(spark):
    m = merkle.build(spark.createDataFrame(TABLES["many languages"], SCHEMA))
    nodes = {r.id: r for r in m.nodes.collect()}
    roots = [r for r in nodes.values() if r.parent is None]
    assert len(roots) == 1 and roots[0].digest.hex() == m.root
    for r in [*nodes.values(), *m.leaves.withColumnRenamed("leaf", "digest").collect()]:
        if r.parent is not None:
            assert nodes[r.parent].children[32 * r.pos :][:32] == r.digest

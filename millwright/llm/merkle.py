"""Merkle manifest of a table: trees of fan-out 8 by language under one root, verified by a recursive climb.

``build`` hashes each row to a leaf in one narrow pass (texts are never shuffled), numbers the leaves of a
language by doc_id, and folds runs of 8 digests level by level.  Every level is written as rows of one node
table: id, digest, the digests of the run it was folded from, and the link to its own parent (parent id and
place in the parent's run).  The languages' roots are the leaves of one more tree of the same kind.
``climb`` is a recursive common table expression over that table: each leaf enters with the digest to be
checked, joins its parent's row, emits the other digests of the run (its siblings), folds itself into the run
and goes on with the parent, until there is none.  Each step appends one row of siblings to the leaf's proof;
nothing that was appended before is carried along, so a step moves a bounded row whatever the depth.

The leaf's ids are arithmetic: languages have ranges of ids, levels have ranges in them.  A language that has
all rows is no hot key: runs are grouped by parent, and what a language's leaves must know of it comes back by
language and block of ordinals.

Defined cases: a null is hashed as ``-``, also as a doc_id; a null language is a tree of its own, before ''.
Rows that repeat a doc_id are leaves of their own, ordered by their digest; equal rows are equal leaves at
neighbouring places.  A single leaf is its language's root, and a single language's root is the root; without
siblings a proof is the hash of nothing.  An empty table gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh_path, materialise
from .numbering import numbered

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves in a block, by which leaves meet what is known of their language.
BLOCK = 65_536

_ROWS = "spark.sql.cteRecursionRowLimit"


@dataclass
class Manifest:
    """leaves: doc_id, g (place among all leaves), leaf, checked, parent, pos, subroot.  nodes: id, digest, children,
    parent, pos.  root: hex, or None of an empty table.  Digests are binary."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def _digest(hexed: Column) -> Column:
    return F.unhex(F.sha2(hexed.cast("binary"), 256))


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row of documents; with text, of the row with that text instead."""
    fields = [_field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS]
    return _digest(F.concat(*fields))


def _leaves(docs: DataFrame, checked: Column) -> DataFrame:
    """The tree's key puts null before all strings and keeps their order of bytes."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf_digest().alias("leaf"), checked.alias("checked"))


def _fold(level: DataFrame) -> DataFrame:
    """The runs over a level (rank, start, count, idx, digest), as the level above; trees of one node are left alone.

    start is the id of the first node of the level above, and of the next one's in the result.
    """
    member = F.struct((F.col("idx") % FANOUT).alias("pos"), F.col("digest").alias("digest"))
    key = ["rank", "start", "count", F.floor(F.col("idx") / FANOUT).alias("idx")]
    runs = level.filter("count > 1").groupBy(*key).agg(F.array_sort(F.collect_list(member)).alias("run"))
    count = F.ceil(F.col("count") / FANOUT)
    children = F.aggregate("run", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    nodes = runs.select("rank", (F.col("start") + F.col("idx")).alias("id"), (F.col("start") + count).alias("start"), count.alias("count"), "idx", children.alias("children"))
    return nodes.withColumn("digest", _digest(_text(F.col("children"))))


def _linked(level: DataFrame, up: Column) -> DataFrame:
    """With the parent's id and the place in its run; a tree's root is linked to up, by rank."""
    inner = F.col("count") > 1
    return level.withColumns(
        {
            "parent": F.when(inner, F.col("start") + F.floor(F.col("idx") / FANOUT)).otherwise(up),
            "pos": F.when(inner, F.col("idx") % FANOUT).otherwise(F.col("rank") % FANOUT).cast("int"),
        }
    )


def _grow(level: DataFrame, largest: int, up: Column, path: str, name: str) -> list[DataFrame]:
    """level and the written levels above it, the largest tree having so many leaves."""
    levels = [level]
    while largest > 1:
        at = f"{path}/level={name}{len(levels)}"
        _linked(_fold(levels[-1]), up).write.parquet(at)
        levels.append(level.sparkSession.read.parquet(at))
        largest = -(-largest // FANOUT)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    found = [x.filter("count = 1").select("rank", "digest") for x in levels]
    return reduce(DataFrame.union, found)


def build(docs: DataFrame, checked: Column | None = None) -> Manifest:
    """checked: the digest that a climb starts from (null, or none given: the leaf's own)."""
    spark = docs.sparkSession
    checked = F.lit(None).cast("binary") if checked is None else checked
    leaves = numbered(_leaves(docs, checked), ["tree", "doc_id", "leaf", "checked"], "merkle-leaves", "g")
    trees = numbered(leaves.groupBy("tree").agg(F.min("g").alias("start"), F.count("*").alias("count")), ["tree"], "merkle-trees", "rank")
    total, n_trees, largest = trees.agg(F.sum("count"), F.count("*"), F.max("count")).first()
    total, none = total or 0, F.lit(None).cast("bigint")
    up = none if n_trees < 2 else F.lit(total) + F.floor(F.col("rank") / FANOUT)
    block = F.floor(F.col("g") / BLOCK).alias("block")
    dealt = leaves.select("tree", block).distinct().join(trees, "tree")  # a tree's rows: as many as it has blocks
    placed = leaves.withColumn("block", block).join(dealt, ["tree", "block"])
    path = fresh_path(spark, "merkle-nodes")
    ground = materialise(_linked(placed.withColumns({"idx": F.col("g") - F.col("start"), "digest": F.col("leaf")}), up), "merkle-ground")
    levels = _grow(ground, largest or 0, up, path, "language-")
    subroots = materialise(_roots(levels), "merkle-subroots")
    top = subroots.select(F.lit(0).cast("bigint").alias("rank"), F.lit(total).cast("bigint").alias("start"), F.lit(n_trees).cast("bigint").alias("count"), F.col("rank").alias("idx"), "digest")
    levels += _grow(top, n_trees, none, path, "top-")[1:]
    columns = ["id", "digest", "children", "parent", "pos"]
    nodes = [x.select(*columns) for x in levels[1:]]
    empty = spark.createDataFrame([], "id bigint, digest binary, children binary, parent bigint, pos int")
    root = _roots(levels if n_trees == 1 else levels[-1:]).first() if n_trees else None
    by_block = dealt.select("tree", "block", "rank").join(subroots.select("rank", F.col("digest").alias("subroot")), "rank").drop("rank")
    kept = ground.select("doc_id", "tree", "block", "g", "leaf", "checked", "parent", "pos").join(by_block, ["tree", "block"]).drop("tree", "block")
    return Manifest(kept, reduce(DataFrame.union, nodes, empty), root and root["digest"].hex())


CLIMB = """
WITH RECURSIVE climb (g, at, pos, step, folded, siblings) AS (
  SELECT g, parent, pos, 0, coalesce(checked, leaf), X'' FROM {leaves}
  UNION ALL
  SELECT c.g, n.parent, n.pos, c.step + 1,
    unhex(sha2(CAST(lower(hex(concat(substring(n.children, 1, 32 * c.pos), c.folded, substring(n.children, 32 * c.pos + 33)))) AS BINARY), 256)),
    concat(substring(n.children, 1, 32 * c.pos), substring(n.children, 32 * c.pos + 33))
  FROM climb c JOIN {nodes} n ON c.at = n.id
)
SELECT g, step, folded, siblings FROM climb
"""


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """A climb's rows are leaves times levels, and Spark's own limit on them is a million."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def climb(manifest: Manifest) -> DataFrame:
    """g, folded (the root that the leaf's checked digest leads to) and proof (hex hash of all its siblings)."""
    spark = manifest.leaves.sparkSession
    with _unlimited(spark):
        steps = spark.sql(CLIMB, leaves=manifest.leaves.select("g", "parent", "pos", "checked", "leaf"), nodes=manifest.nodes)
        path = F.array_sort(F.collect_list(F.struct("step", "siblings")))
        proofs = steps.groupBy("g").agg(F.max_by("folded", "step").alias("folded"), path.alias("path"))
        siblings = F.aggregate("path", F.lit(b""), lambda a, x: F.concat(a, x["siblings"]))
        return materialise(proofs.select("g", "folded", F.sha2(_text(siblings).cast("binary"), 256).alias("proof")), "merkle-proofs")


def verify(docs: DataFrame, checked: Column | None = None) -> DataFrame:
    """One row for each of docs: its leaf, both roots, its proof's hash, the root folded from checked, and whether they agree."""
    manifest = build(docs, checked)
    root = F.lit(manifest.root).cast("string")
    return manifest.leaves.join(climb(manifest), "g").select(
        "doc_id", _text(F.col("leaf")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.col("proof").alias("proof_sha256"), _text(F.col("folded")).alias("folded_root"), (_text(F.col("folded")) == root).alias("verified"),
    )


def op12(docs: DataFrame) -> DataFrame:
    """Tampered where 3 divides the crc32 of doc_id: the text in lower case."""
    dealt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verify(docs, F.when(dealt, leaf_digest(ascii_lower(F.col("text")))))


_SQL_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in FIELDS[:-1]) + " || " + _SQL_FIELD + ")"
#: The unsigned crc32 of a decimal number, byte by byte and bit by bit.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
SQL = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {_SQL_LEAF.format("text")} AS leaf,
    CASE WHEN {_SQL_CRC} % 3 = 0 THEN {_SQL_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM hashed),
inner_levels AS (SELECT t, 0 AS k, i, n, leaf AS d FROM leaves
  UNION ALL SELECT t, k + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM inner_levels WHERE n > 1 GROUP BY t, k, i // 8, n),
subroots AS (SELECT t, k, d, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM inner_levels WHERE n = 1),
top_levels AS (SELECT '!' AS t, 0 AS k, i, n, d FROM subroots
  UNION ALL SELECT t, k + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM top_levels WHERE n > 1 GROUP BY t, k, i // 8, n),
levels AS (SELECT * FROM inner_levels UNION ALL SELECT * FROM top_levels),
runs AS (SELECT t, k, i // 8 AS p, (n + 7) // 8 AS above, list(d ORDER BY i) AS run FROM levels WHERE n > 1 GROUP BY t, k, i // 8, n),
links AS (SELECT r.t, r.k, r.p, r.run, CASE WHEN above = 1 AND r.t <> '!' THEN '!' ELSE r.t END AS t2, CASE WHEN above = 1 AND r.t <> '!' THEN 0 ELSE r.k + 1 END AS k2,
    CASE WHEN above = 1 AND r.t <> '!' THEN s.i ELSE r.p END AS i2 FROM runs r LEFT JOIN subroots s ON r.t = s.t),
climb AS (SELECT l.doc_id, l.t AS own, 0 AS step, CASE WHEN l.n = 1 THEN '!' ELSE l.t END AS t, 0 AS k, CASE WHEN l.n = 1 THEN s.i ELSE l.i END AS i, l.leaf, coalesce(l.other, l.leaf) AS fold, '' AS siblings
  FROM leaves l JOIN subroots s ON l.t = s.t
  UNION ALL SELECT c.doc_id, c.own, c.step + 1, x.t2, x.k2, x.i2, c.leaf,
    sha256(array_to_string(x.run[:c.i % 8], '') || c.fold || array_to_string(x.run[c.i % 8 + 2:], '')),
    c.siblings || array_to_string(x.run[:c.i % 8], '') || array_to_string(x.run[c.i % 8 + 2:], '')
  FROM climb c JOIN links x ON c.t = x.t AND c.k = x.k AND c.i // 8 = x.p),
root AS (SELECT d FROM top_levels WHERE n = 1)
SELECT c.doc_id, c.leaf, s.d AS subroot, root.d AS root, sha256(c.siblings) AS proof_sha256, c.fold AS folded_root, c.fold = root.d AS verified
FROM climb c JOIN (SELECT t, max(k) AS depth FROM top_levels GROUP BY t) top ON c.t = '!' AND c.k = top.depth JOIN subroots s ON c.own = s.t, root
"""

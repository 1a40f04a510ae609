"""Merkle dataset manifest: one tree over the records of each source, and one over the trees of all sources.

Levels are DataFrames. The nodes of a level have an index in their source (row_number over ranges, see numbering); an index divided by the fanout,
rounded down, is the index of the parent, whose digest is that of its children's, in order. Up to here each level reads a third of the
one before. Proofs come from the top down: a level of groups meets the proofs of its parents by index and hands
each child its siblings before what the parent has, so all joins together move about half as many rows as there are records, and
no join has a key with more than one row on a side, however large a source is.

Digests are lower-case hex SHA-256, taken over the concatenation of hex digests. Null and empty values differ: a null is `-`, a value its UTF-8 byte count, `:`
and itself. A null source is a source of its own, before all others. Rows of a source go by doc_id, null first; rows that share a doc_id by their leaf,
so repeated rows are leaves of their own with equal digests. A null doc_id is never tampered with. An empty table has no root and gives
no rows. Columns beside the five are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_text_crc
from .numbering import number_within

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in front, `-` for null: no two lists of values have the same concatenation."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: tuple[str, ...] = FIELDS, **replaced: Column) -> Column:
    """The digest of a record."""
    return digest(F.concat(*[framed(replaced.get(c, F.col(c))) for c in fields]))


def _group_key(source: Column) -> Column:
    """Source as a key that is never null and sorts null first."""
    return F.coalesce(F.concat(F.lit("+"), source), F.lit(""))


class Forest:
    """Trees over numbered leaves (key, idx, n, hash, and further columns that go with a leaf).

    groups[k] holds the nodes of level k + 1 that were made of those of level k: (key, idx, n, children), n nodes of the key at that level, and the
    children in order, at most `fanout`. tops: (key, depth, hash), one for each key.
    """

    def __init__(self, leaves: DataFrame, run: Scratch, name: str, fanout: int = FANOUT):
        self.leaves, self.run, self.name, self.fanout = leaves, run, name, fanout
        extra = [c for c in leaves.columns if c not in ("key", "idx", "n")]
        self.groups: list[DataFrame] = []
        self.tops = leaves.filter("n = 1").select("key", F.lit(0).alias("depth"), "hash")
        level = leaves
        while not (level := level.filter("n > 1")).isEmpty():
            child = F.struct("idx", *(extra if level.columns == leaves.columns else ["hash"]))
            up = level.groupBy("key", F.floor(F.col("idx") / fanout).cast("long").alias("parent"), F.ceil(F.col("n") / fanout).cast("long").alias("m")).agg(F.array_sort(F.collect_list(child)).alias("children"))
            up = up.select("key", F.col("parent").alias("idx"), F.col("m").alias("n"), "children", digest(F.array_join(F.transform("children", lambda c: c["hash"]), "")).alias("hash"))
            up = run.write(up, f"{name}-{len(self.groups)}")
            self.groups.append(up)
            self.tops = self.tops.unionByName(up.filter("n = 1").select("key", F.lit(len(self.groups)).alias("depth"), "hash"))
            level = up.select("key", "idx", "n", "hash")

    def paths(self, above: DataFrame) -> DataFrame:
        """Every leaf (key, its columns) with `path`: for each level from its own up its (left, right) siblings as text, then what `above` (key, depth, path, and columns to hand down) has for its key."""
        carried = [c for c in above.columns if c not in ("key", "depth", "path")]
        extra = [c for c in self.leaves.columns if c not in ("key", "idx", "n")]
        down = None
        for depth in range(len(self.groups), 0, -1):
            own = above.filter(F.col("depth") == depth).select("key", F.lit(0).cast("long").alias("idx"), "path", *carried)
            down = own if down is None else down.unionByName(own)
            met = self.groups[depth - 1].select("key", "idx", "children").join(down, ["key", "idx"])
            hashes = F.transform("children", lambda c: c["hash"])
            met = met.select("key", "path", *carried, hashes.alias("hashes"), F.posexplode("children").alias("at", "child"))
            left, right = F.array_join(F.slice("hashes", F.lit(1), F.col("at")), ""), F.array_join(F.slice("hashes", F.col("at") + 2, F.lit(self.fanout)), "")
            path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path")).alias("path")
            down = met.select("key", *([F.col("child.idx").alias("idx")] if depth > 1 else [F.col(f"child.{c}").alias(c) for c in extra]), path, *carried)
        lone = self.leaves.filter("n = 1").join(above.filter("depth = 0").drop("depth"), "key").select("key", *extra, "path", *carried)
        return lone if down is None else down.unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


_EMPTY_PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame, tampered_text: Column, tampered: Column, run: Scratch, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, seen_leaf, subroot, root, path) of every row: seen_leaf is the leaf of the row with `tampered_text`, where `tampered` holds."""
    changed = F.coalesce(tampered, F.lit(False)) & ~F.col("text").eqNullSafe(tampered_text)
    rows = docs.select(_group_key(F.col("source")).alias("key"), "doc_id", leaf().alias("hash"), F.when(changed, leaf(text=tampered_text)).alias("seen"))
    rows = run.write(rows, "leaves")
    sources = Forest(number_within(rows, "key", [F.col("doc_id").asc_nulls_first(), F.col("hash")], run, "ranges").select("key", "idx", "n", "hash", "doc_id", "seen"), run, "sources", fanout)
    tops = run.write(sources.tops, "tops")
    # The tree of the sources is built the same way, under one key.
    named = number_within(tops.select(F.lit("").alias("key"), F.col("key").alias("source_key"), "hash", "depth"), "key", [F.col("source_key")], run, "top-ranges")
    whole = Forest(named.withColumnRenamed("depth", "own_depth").select("key", "idx", "n", "hash", "source_key", "own_depth"), run, "whole", fanout)
    root = whole.tops.select("key", "depth", F.array().cast(_EMPTY_PATH).alias("path"), F.col("hash").alias("root"))
    above = whole.paths(root).select(F.col("source_key").alias("key"), F.col("own_depth").alias("depth"), "path", F.col("hash").alias("subroot"), "root")
    out = sources.paths(run.write(above, "above"))
    return out.select("doc_id", F.col("hash").alias("leaf"), F.coalesce("seen", "hash").alias("seen_leaf"), "subroot", "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what folding a tampered copy gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = manifest(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("")), id_text_crc(F.col("doc_id")) % 2 == 0, Scratch(spark, "op11"))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    out = m.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("seen_leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of the ASCII text x, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) + z)), 4294967295::BIGINT)"
_FRAMED = "coalesce(strlen({x}) || ':' || {x}, '-')"


def crc_sql(x: str) -> str:
    return _CRC.format(x=x)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FRAMED.format(x=c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || source, '') AS key, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS bad,
  coalesce({crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM d),
t(lvl, key, idx, n, h) AS (SELECT 0, key, idx, n, leaf FROM l
  UNION ALL SELECT lvl + 1, key, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lvl, key, idx // 3, (n + 2) // 3),
s AS (SELECT key, lvl AS depth, h, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
w(lvl, idx, n, h) AS (SELECT 0, idx, n, h FROM s
  UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM w WHERE n > 1 GROUP BY lvl, idx // 3, (n + 2) // 3),
top AS (SELECT lvl AS depth, h AS root FROM w WHERE n = 1),
steps AS (
  SELECT rid, lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < a), '') AS lft, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > a), '') AS rgt FROM
    (SELECT l.rid, t.lvl, t.idx AS i, l.idx // (3 ** t.lvl)::BIGINT AS a, t.h FROM l JOIN s ON s.key = l.key JOIN t ON t.key = l.key AND t.lvl < s.depth AND t.idx // 3 = l.idx // (3 ** (t.lvl + 1))::BIGINT) GROUP BY 1, 2
  UNION ALL
  SELECT rid, lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < a), ''), coalesce(string_agg(h, '' ORDER BY i) FILTER (i > a), '') FROM
    (SELECT l.rid, s.depth + w.lvl AS lvl, w.idx AS i, s.idx // (3 ** w.lvl)::BIGINT AS a, w.h FROM l JOIN s ON s.key = l.key JOIN w ON w.idx // 3 = s.idx // (3 ** (w.lvl + 1))::BIGINT CROSS JOIN top WHERE w.lvl < top.depth) GROUP BY 1, 2),
f(rid, lvl, h) AS (SELECT rid, 0, CASE WHEN tampered THEN bad ELSE leaf END FROM l
  UNION ALL SELECT f.rid, f.lvl + 1, sha256(x.lft || f.h || x.rgt) FROM f JOIN steps x ON x.rid = f.rid AND x.lvl = f.lvl),
proofs AS (SELECT rid, string_agg(lft || rgt, '' ORDER BY lvl) AS p FROM steps GROUP BY 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, top.root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM l JOIN s ON s.key = l.key CROSS JOIN top LEFT JOIN proofs p ON p.rid = l.rid JOIN f ON f.rid = l.rid AND f.lvl = s.depth + top.depth
"""

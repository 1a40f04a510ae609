"""Trie of conversations by prefix-doubling names.

Turns get dense numbers (equal role and text: equal number). In round k the blocks of 2**k turns that start at a multiple of
2**k get numbers from the pairs of their halves, so all blocks are named in as many rounds as the longest conversation has
binary digits. A prefix of d turns is named from the prefix without the lowest binary digit of d and the block of that digit's length behind
it, longest blocks first: again a round for each digit. Prefixes with one name are one node; no name is a hash, so no two nodes can fall
together. Every round joins by (conversation, index), which no row shares with another, and by the pair of names, where the side of the names has one
row for a pair, so Spark can split what many conversations share.

What adds up over subtrees (leaves, saved words) needs no walk either. A node belongs to its smallest member; along a conversation
the nodes that belong to it are the deepest ones. A subtree holds all nodes of its members' own, less those of its own owner above the top: sums by owner,
joined to the members of each node, less a running sum along one conversation, which is taken in two steps over CHUNK depths each.

Defined cases: turns go by turn (null first), rows of one turn by a digest of role and text; a null role or text is empty; rows without a
conv_id take no part; an empty table has no nodes; a conversation whose rebuilt form has no turns ends at the root. Columns beside the four are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, id_text_crc
from .merkle import crc_sql
from .numbering import dense_names, number_within

CHUNK = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, key, words): key is a digest of role and text, each with its length before it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))).cast("long")
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), words.alias("words"))


def rebuilt(conversations: DataFrame, run: Scratch, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns (conv, pos, key, words), conversations (conv, len)): the first h turns of conversation conv - conv % every, then conv's own after its first h; h = crc32(conv) % heads."""
    rows = run.write(number_within(turns_of(conversations), "conv", [F.col("turn").asc_nulls_first(), F.col("key")], run, "turn-ranges", "pos").drop("turn"), "own")
    first = rows.filter(F.col("pos") < heads - 1).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
    h = (id_text_crc(F.col("conv")) % heads).cast("int")
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.withColumn("base", F.col("conv") - F.col("conv") % every).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(first.schema["head"].dataType)), F.lit(1), h)
    known = run.write(known.select("conv", "n", head.alias("head"), h.alias("h")), "conversations")
    front = known.select("conv", F.explode("head").alias("t")).select("conv", "t.pos", "t.key", "t.words")
    start = known.select("conv", (F.size("head") - F.col("h")).alias("_shift"))
    own = rows.filter(F.col("pos") >= h).join(start, "conv").select("conv", (F.col("pos") + F.col("_shift")).alias("pos"), "key", "words")
    length = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return run.write(front.unionByName(own), "turns"), known.select("conv", length.cast("long").alias("len"))


def _named(rows: DataFrame, pair: list[str], run: Scratch, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """rows with the dense number of their pair in place of it, as `name`."""
    names, end = dense_names(rows.select(*pair), run, f"{name}-names", start)
    return run.write(rows.join(names, pair).drop(*pair), name), end


def prefixes(turns: DataFrame, conversations: DataFrame, run: Scratch) -> DataFrame:
    """(conv, len, d, node) for d = 0 ... len: the number of the node of each prefix, 0 for the empty one."""
    longest = conversations.agg(F.max("len")).first()[0] or 0
    blocks = [_named(turns.select("conv", F.col("pos").alias("i"), "key"), ["key"], run, "block-0")[0]]
    for k in range(1, longest.bit_length()):
        half = lambda bit: F.max(F.when(F.col("i") % 2 == bit, F.col("name")))
        pairs = blocks[-1].groupBy("conv", F.floor(F.col("i") / 2).alias("j")).agg(half(0).alias("a"), half(1).alias("b")).filter("b IS NOT NULL")
        blocks.append(_named(pairs.withColumnRenamed("j", "i"), ["a", "b"], run, f"block-{k}")[0])
    found = conversations.select("conv", "len", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("node"))
    free = 1
    for k in range(len(blocks) - 1, -1, -1):
        # All prefixes so far end at multiples of 2 ** (k + 1); the block behind such an end is the next one of 2 ** k turns.
        block = blocks[k].withColumnsRenamed({"conv": "_conv", "name": "b"})
        longer = found.join(block, (F.col("conv") == F.col("_conv")) & (F.shiftright("d", k) == F.col("i")))
        longer = longer.select("conv", "len", (F.col("d") + (1 << k)).alias("d"), F.col("node").alias("a"), "b")
        named, free = _named(longer, ["a", "b"], run, f"prefix-{k}", free)
        found = found.unionByName(named.select("conv", "len", "d", F.col("name").alias("node")))
    return found


def _ends(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, ends_sha256) of rows (node, part, ids) that come by node and part; a digest grows with each row, so none holds all ids of a node."""
    node, running = None, None
    for pdf in rows:
        out = []
        for n, ids in zip(pdf["node"], pdf["ids"]):
            if n != node:
                if node is not None:
                    out.append((node, running.hexdigest()))
                node, running = n, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"]).astype({"node": "int64"})
    if node is not None:
        yield pd.DataFrame({"node": [node], "ends_sha256": [running.hexdigest()]})


def end_digests(found: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: SHA-256 of their numbers, ascending, joined by commas.

    Numbers become texts of at most CHUNK conversations each before they meet; the digest itself can only be taken in order.
    """
    part = F.floor(F.col("conv") / CHUNK).alias("part")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    parts = found.filter("d = len").groupBy("node", part).agg(ids)
    return parts.repartition("node").sortWithinPartitions("node", "part").mapInPandas(_ends, "node long, ends_sha256 string")


def _above(nodes: DataFrame, names: list[str]) -> DataFrame:
    """nodes with `{name}_above`: what the nodes of the same owner at smaller depths have, in two running sums."""
    part = nodes.withColumn("_part", F.floor(F.col("depth") / CHUNK))
    chunk = part.groupBy(F.col("conv_id").alias("_owner"), F.col("_part").alias("_at")).agg(*[F.sum(n).alias(f"_s_{n}") for n in names])
    earlier = Window.partitionBy("_owner").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.select("_owner", "_at", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names])
    before = Window.partitionBy("conv_id", "_part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    inside = part.withColumns({f"_i_{n}": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names})
    met = inside.join(chunk, (F.col("conv_id") == F.col("_owner")) & (F.col("_part") == F.col("_at")))
    return met.withColumns({f"{n}_above": F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in names})


def trie(turns: DataFrame, conversations: DataFrame, run: Scratch) -> DataFrame:
    """The nodes of the trie of turns (conv, pos, key, words) of conversations (conv, len)."""
    found = run.write(prefixes(turns, conversations, run), "prefixes")
    none = F.lit(None).cast("long")
    rows = found.select("conv", "d", "node", none.alias("parent"), none.alias("words"))
    rows = rows.unionByName(found.filter("d < len").select("conv", (F.col("d") + 1).alias("d"), none.alias("node"), F.col("node").alias("parent"), none.alias("words")))
    rows = rows.unionByName(turns.select("conv", (F.col("pos") + 1).alias("d"), none.alias("node"), none.alias("parent"), "words"))
    members = run.write(rows.groupBy("conv", "d").agg(*[F.max(c).alias(c) for c in ("node", "parent", "words")]), "members")
    nodes = members.groupBy("node").agg(F.min("conv").alias("conv_id"), F.max("d").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("parent").alias("parent"), F.max("words").alias("words"))
    nodes = run.write(nodes, "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    own = nodes.join(children, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "leaf": F.col("n_children").isNull().cast("long"), "saved": saved})
    own = run.write(_above(own, ["leaf", "saved"]).select("node", "conv_id", "depth", "parent", "n_convs", "n_children", "leaf", "saved", "leaf_above", "saved_above"), "sums")
    owned = own.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    below = members.join(owned, "conv").groupBy("node").agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    above = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = own.join(below, "node").join(above, "parent", "left").join(end_digests(found), "node", "left")
    return out.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("_leaves") - F.col("leaf_above")).alias("n_leaves"),
        (F.col("_saved") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    run = Scratch(spark, "op13")
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"), run), run)


_H = f"({crc_sql('CAST({c} AS VARCHAR)')} % 4)"
OP13_SQL = f"""
WITH k AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, t, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) - 1 AS p FROM k),
cs AS (SELECT c, n, c - c % 20 AS b, {_H.replace("{c}", "c")} AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY 1)),
z AS (SELECT cs.*, least(h, coalesce(f.n, 0)) AS s FROM cs LEFT JOIN (SELECT c, count(*) AS n FROM o GROUP BY 1) f ON f.c = cs.b),
r AS (SELECT z.c, o.p, o.t, o.w FROM z JOIN o ON o.c = z.b AND o.p < z.h UNION ALL SELECT z.c, o.p - z.h + z.s, o.t, o.w FROM z JOIN o ON o.c = z.c AND o.p >= z.h),
x AS (SELECT c, p + 1 AS d, sha256(string_agg(t, '' ORDER BY p) OVER (PARTITION BY c ORDER BY p)) AS node, w FROM r UNION ALL SELECT c, 0, '', 0 FROM z),
m AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS last FROM x),
n AS (SELECT node, min(c) AS conv_id, max(d) AS depth, count(*) AS n_convs, max(parent) AS parent, max(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM m GROUP BY node),
ch AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * w END AS saved FROM n LEFT JOIN ch USING (node)),
sub AS (SELECT a.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved)::BIGINT AS saved_tokens FROM f JOIN m a ON a.c = f.conv_id AND a.d <= f.depth GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, sub.saved_tokens, sha256(f.ends) AS ends_sha256 FROM f JOIN sub USING (node) LEFT JOIN n p ON p.node = f.parent
"""

"""Tier counts kept up by signed changes: what the old scores of a change gave is taken away, what the new ones give is added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ambiguity import tier_windows
from .blocks import block_counts

#: What a score reads of a resource, its text aside.
READ = ("namespace", "type", "local_tokens", "line_of_business", "tags", "industry", "entity_types")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(seq) of the resources one of whose scores may differ: new, gone or changed ones, and those with an entity type that more or fewer have than before."""
    side = lambda df, c: df.select(F.col("seq"), F.struct(*READ).alias(c))
    changed = side(before, "old").join(side(after, "new"), "seq", "full").filter("NOT (old <=> new)")
    types = lambda c, sign: changed.select(F.explode(f"{c}.entity_types").alias("entity_type"), F.lit(sign).alias("n"))
    shifted = types("old", -1).unionByName(types("new", 1)).groupBy("entity_type").agg(F.sum("n").alias("n")).filter("n <> 0").select("entity_type")
    holders = after.select("seq", F.explode("entity_types").alias("entity_type")).join(shifted, "entity_type", "left_semi")
    return changed.select("seq").unionByName(holders.select("seq")).distinct()


def updated_counts(near: DataFrame, before: DataFrame, after: DataFrame, texts: DataFrame | None = None, use_text: bool = True) -> DataFrame:
    """The counts (seq, label, a column for each tier) of `after`, from those of `before` by signed changes; equal to counting `after` anew.

    before, after: scored resources; near: block_counts() of `before` by namespace. Rarities are those of each side, so a type that gains a
    resource moves all that have it; only moved resources are scored against all, under the old and the new rarities. Where more than
    half have moved, counting anew is less work, and is done. texts: the text vectors (seq, terms, weights) of both sides, which a change leaves as
    they are: they must be given if resources come or go, as the weights of all terms would shift. A null namespace is a label as any other.
    """
    windows = tier_windows()
    if texts is None and use_text and before.select("seq", "text").exceptAll(after.select("seq", "text")).union(after.select("seq", "text").exceptAll(before.select("seq", "text"))).limit(1).count():
        raise ValueError("texts must be given where texts or their number change")
    hit = written(moved(before, after), "moved")
    n = hit.count()
    if not n:
        return near
    if 2 * n > after.count():
        return block_counts(after, windows, "namespace", use_text, texts=texts)
    names = list(windows)
    part = lambda df, sign: block_counts(df, windows, "namespace", use_text, left=hit, texts=texts).select("seq", "label", *[(sign * F.col(t)).alias(t) for t in names])
    total = near.select("seq", "label", *names).unionByName(part(before, -1)).unionByName(part(after, 1)).groupBy("seq", "label").agg(*[F.sum(t).alias(t) for t in names])
    return total.filter(" OR ".join(f"{t} <> 0" for t in names))

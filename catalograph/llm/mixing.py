"""Mixing sources to target weights by entropy balancing.

Rates of documents minimise the relative entropy to a rate of 1 under one token constraint per source and a ceiling:
r_i = min(cap, exp(lambda_s * size_i / mean_s)). The dual is convex and separates by source; Newton steps find
lambda. Every step is a distributed aggregation of f(lambda) = sum of size * r and its slope over the counts of
(source, size), which hold all that the dual needs; only one pair of sums per source reaches the driver. The same
counts are rounded to whole copies, the largest sizes first with the rest carried on, so that a source misses its
target by less than its least sizes. Within one (source, size) all documents are alike; the odd copies go to the ranks
of a seeded hash of doc_id and text, found by slices of the hash, so that no class is ever sorted in one task.

Defined cases: a null or wordless text has size 0 and is taken once, at no cost; a null source is a source of its own,
ordered last; sources without words have target 0; repeated rows count each and may get different copies; an empty table
gives an empty result. What reaches the driver, one pair of sums a source, and what one rounding task holds, the
distinct sizes of a source, are bounded by the sources and the longest text. Values by source are joined, by broadcast
up to BROADCAST_SOURCES of them. A dual that does not converge is an error.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, fresh_name

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SLICES = 256
SEED = 17
STEPS, TOLERANCE = 100, 1e-9
BROADCAST_SOURCES = 10_000
Values = dict[str | None, float]


def n_words(text: str = "text") -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def targets_by_weight(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Targets that share the sum of sizes by weight, none above cap times its source's size; the excess is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = list(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            free.remove(s)
            left -= out[s]
    return out


def _with(df: DataFrame, **values: Values) -> DataFrame:
    """df with a column of each of `values` by its source; only rows whose source all of them have."""
    first, *others = values.values()
    sources = [x for x in first if all(x in v for v in others)]
    table = df.sparkSession.createDataFrame([(x, *(float(v[x]) for v in values.values())) for x in sources], "_of string, " + ", ".join(f"{c} double" for c in values))
    if len(sources) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    return df.join(table, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def dual_newton(counts: DataFrame, totals: dict[str | None, tuple[int, int]], targets: dict[str | None, float], cap: float = CAP) -> dict[str | None, float]:
    """lambda of every source, by safeguarded Newton steps; inf where all documents stand at the cap, -inf where the target is 0."""
    out: dict[str | None, float] = {}
    low: dict[str | None, float] = {}
    high: dict[str | None, float] = {}
    for s, (tokens, _) in totals.items():
        if tokens == 0 or targets[s] >= cap * tokens * (1 - 1e-12):
            out[s] = math.inf
        elif targets[s] <= 0:
            out[s] = -math.inf
        else:
            low[s], high[s] = -math.inf, math.inf
    now = {s: 0.0 for s in low}
    mean = {s: totals[s][0] / totals[s][1] for s in low}
    for _ in range(STEPS):
        if not now:
            break
        z = F.col("size") / F.col("_mean")
        free = F.exp(F.col("_lambda") * z)
        rows = (
            _with(counts, _mean=mean, _lambda=now)
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("size") * F.least(free, F.lit(cap))).alias("f"), F.sum(F.when(free < cap, F.col("n") * F.col("size") * z * free).otherwise(0.0)).alias("g"))
            .collect()
        )
        for r in rows:
            s, miss = r.source, r.f - targets[r.source]
            if abs(miss) <= TOLERANCE * targets[s]:
                out[s] = now.pop(s)
                continue
            low[s], high[s] = (now[s], high[s]) if miss < 0 else (low[s], now[s])
            step = now[s] - miss / r.g if r.g > 0 else math.nan
            step = max(now[s] - 4.0, min(now[s] + 4.0, step)) if step == step else step
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else now[s] + (4.0 if miss < 0 else -4.0)
            now[s] = step
    if now:
        raise RuntimeError(f"the dual of {len(now)} sources did not converge in {STEPS} steps")
    return out


def _copies(cap: float):
    """Whole copies of each size of one source: the largest first, what rounding leaves is carried on in tokens."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, kind="stable")
        left, out = 0.0, []
        for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
            want = n * rate * size + left
            k = int(min(cap * n, max(0, math.floor(want / size + 0.5)))) if size else n
            left = want - k * size
            out.append(k)
        return rows.assign(copies=out)[["source", "size", "n", "rate", "copies"]]

    return run


def _sized(docs: DataFrame, keep: list[str], names: dict[str, str], text: str, seed: int) -> DataFrame:
    """The columns `keep` of docs with its source, size, slice and a hash that orders its rows, under `names`."""
    row = [F.col("doc_id").cast("long"), F.xxhash64(text)]
    return docs.select(
        *keep,
        F.col("source").alias(names["source"]),
        n_words(text).alias(names["size"]),
        F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(SLICES)).cast("int").alias(names["slice"]),
        F.xxhash64(F.lit(seed + 1), *row).alias(names["order"]),
    )


def _rates(run: Scratch, sized: DataFrame, weights: tuple[float, ...], cap: float) -> tuple[DataFrame, Values, Values]:
    """((source, size, slice, before, n, copies, rate) of every cell of sized, sizes and targets by source). before: rows of the class in the slices before."""
    cells = run.write(sized.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "cells")
    counts = run.write(cells.groupBy("source", "size").agg(F.sum("n").alias("n")), "counts")
    totals = {r.source: (r.tokens, r.docs) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum("n").alias("docs")).collect()}
    sizes = {s: t for s, (t, _) in totals.items()}
    targets = targets_by_weight(sizes, weights, cap)
    dual = dual_newton(counts, totals, targets, cap)
    known = _with(counts, _mean={s: max(t, 1) / n for s, (t, n) in totals.items()}, _lambda={s: max(-1e9, min(1e9, x)) for s, x in dual.items()})
    exponent = F.least(F.lit(700.0), F.greatest(F.lit(-700.0), F.col("_lambda") * F.col("size") / F.col("_mean")))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(cap), F.exp(exponent)))
    classes = known.select("source", "size", "n", rate.alias("rate")).groupBy("source").applyInPandas(_copies(cap), "source string, size long, n long, rate double, copies long")
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    classes = classes.withColumnsRenamed({"source": "_s", "size": "_z"})
    return cells.join(classes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z"), sizes, targets


def _taken(rows: DataFrame, cells: DataFrame, names: dict[str, str], into: str) -> DataFrame:
    """rows with the copies of each, and beside others the columns `into`_rate, `into`_n of its cell."""
    cells = cells.withColumnsRenamed({c: f"{into}_{c}" for c in cells.columns})
    of = lambda c: F.col(f"{into}_{c}")
    rank = F.row_number().over(Window.partitionBy(names["source"], names["size"], names["slice"]).orderBy(names["order"]))
    same = F.col(names["source"]).eqNullSafe(of("source")) & (F.col(names["size"]) == of("size")) & (F.col(names["slice"]) == of("slice"))
    ranked = rows.withColumn(f"{into}_rank", rank).join(cells, same)
    whole = F.floor(of("copies") / of("n"))
    odd = F.when(of("before") + of("rank") <= of("copies") - whole * of("n"), 1).otherwise(0)
    return ranked.withColumn(into, (whole + odd).cast("long"))


_PLAIN = {c: c for c in ("source", "size", "slice", "order")}


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) of every row of docs."""
    run = Scratch(docs.sparkSession, "op1")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(text).alias("text"))
    sized = run.write(_sized(narrow, ["doc_id"], _PLAIN, "text", seed), "sized")
    cells, sizes, targets = _rates(run, sized, weights, cap)
    out = _with(_taken(sized, cells, _PLAIN, "copies"), source_size=sizes, target=targets)
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("copies_rate").alias("rate"), "copies")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, text: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; its columns as they are."""
    names = {c: fresh_name(docs.columns, f"_mix_{c}") for c in _PLAIN}
    copies = "_copies"
    while any(c.lower().startswith(copies) for c in docs.columns):
        copies = f"_{copies}"
    run = Scratch(docs.sparkSession, "op1")
    cells, _, _ = _rates(run, _sized(docs, [], _PLAIN, text, seed), weights, cap)
    rows = _taken(_sized(docs, docs.columns, names, text, seed), cells, names, copies).filter(F.col(copies) > 0)
    return rows.withColumn(names["order"], F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")

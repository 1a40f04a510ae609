"""Inverted multi-index: nearest neighbours by inner product.

The two halves of a vector are quantised separately; a cell is a pair of centroids, one of each half, and every vector lies in one cell. The
score of a query with the vectors of a cell is about the sum of two numbers, one for each half, so the cells come in
falling order of that sum by a heap over two sorted lists (multi-sequence traversal), without a look at most of them.

What a half adds for a centroid is its inner product with the query plus SLACK standard deviations of what the vectors of the centroid differ from it, so that
the order is one of plausible best scores. A query first visits cells until they hold FIRST vectors; the k-th best score among these is a
floor. Then it visits, in the same order, every further cell whose sum reaches the floor: no cap on cells, entries or partners, and no number that
depends on the size of the table. All vectors of a visited cell are reranked by their exact scores. SLACK None takes the greatest
difference instead of deviations (Cauchy-Schwarz): the result is then exact and more cells are visited.

Centroids are fitted on a sample of about SAMPLE vectors on the driver (numpy); every vector is indexed. The driver and each task hold the centroids and the sizes of
the cells that are not empty, at most MOST_CENTROIDS ** 2. Entries of one first centroid meet its queries in blocks of BLOCK entries and QUERIES queries, so a
cell that holds a third of all vectors is many groups; a group gives k rows for each of its queries at most.

Recall against brute force: README. Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; rows that share a vec_id are rows of their own, and a query passes over its own row only; null
vec_ids are no queries, and last among equal scores; a query finds all others where there are fewer than k; an empty table gives no rows. Columns beside
the two are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 20
SAMPLE, ROUNDS = 16_384, 12
#: Vectors that a cell should hold on average, and bounds of the centroids of a half.
PER_CELL, FEWEST_CENTROIDS, MOST_CENTROIDS = 64, 2, 256
FIRST, SLACK = 1024, 2.25
BLOCK, QUERIES = 2048, 1024


@dataclass(frozen=True)
class Codebook:
    """Centroids of both halves; spread[h][c] is the deviation of one component of half h around centroid c, reach[h][c] the greatest distance from it."""

    centroids: tuple[np.ndarray, np.ndarray]
    spread: tuple[np.ndarray, np.ndarray] = ()
    reach: tuple[np.ndarray, np.ndarray] = ()

    @property
    def cut(self) -> int:
        return self.centroids[0].shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def assign(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half (nearest centroid, squared distance)."""
        out = []
        for half, c in zip(self.halves(x), self.centroids):
            near = ((c**2).sum(1) - 2 * half @ c.T).argmin(1)
            out.append((near, ((half - c[near]) ** 2).sum(1)))
        return out

    def plausible(self, q: np.ndarray, slack: float | None) -> list[np.ndarray]:
        """For each half and centroid the greatest plausible part of a score with q."""
        out = []
        for h, half in enumerate(self.halves(q[None])):
            norm = float(np.sqrt((half**2).sum()))
            out.append(self.centroids[h] @ half[0] + norm * (self.reach[h] * (1 + 1e-9) + 1e-12 if slack is None else slack * self.spread[h]))
        return out


def fit(sample: np.ndarray, n_centroids: int, rounds: int = ROUNDS) -> Codebook:
    """Lloyd's k-means on each half, from distinct sample vectors in seeded order."""
    cut = sample.shape[1] // 2
    out = []
    for half in (sample[:, :cut], sample[:, cut:]):
        start = np.unique(half, axis=0)
        c = start[np.random.default_rng(0).permutation(len(start))[:n_centroids]]
        for _ in range(rounds):
            near = ((c**2).sum(1) - 2 * half @ c.T).argmin(1)
            order = np.argsort(near, kind="stable")
            found, first, n = np.unique(near[order], return_index=True, return_counts=True)
            c = c.copy()
            c[found] = np.add.reduceat(half[order], first, axis=0) / n[:, None] if half.shape[1] else c[found]
        out.append(c)
    return Codebook((out[0], out[1]))


def traverse(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs of centroids in falling order of first[i] + second[j], by a heap that holds the border of what has been visited."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, done = [(-(first[a[0]] + second[b[0]]), 0, 0)], np.zeros(len(a), np.int64)
    while heap:
        minus, i, j = heapq.heappop(heap)
        yield -minus, int(a[i]), int(b[j])
        done[i] = j + 1
        # A pair is open when the pairs before it in its row and column are done; done[i] counts those of row i.
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[j]]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: v as doubles, all of the most frequent length (the greater on a tie)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("size").desc()).first()
    return rows.filter(F.size("v") == (size.size if size else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), float).reshape(len(column), -1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, component by component: equal vectors get equal scores wherever they lie."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


class MultiIndex:
    """An index of vectors (vec_id, v): a table of entries (row, vec_id, v, c1, c2), the codebook and the sizes of the cells."""

    def __init__(self, vectors: DataFrame, run: Scratch, sample: int = SAMPLE, centroids: int | None = None):
        self.run = run
        rows = run.write(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
        self.n = rows.count()
        if not self.n:
            self.entries, self.sizes = rows, {}
            return
        # A hash of the row takes about `sample` of all; the limit is a bound, not a choice.
        share = min(1.0, sample / self.n)
        taken = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20) + 1)).select("v").limit(2 * sample).toPandas()
        taken = taken if len(taken) else rows.select("v").limit(sample).toPandas()
        k = centroids or min(MOST_CENTROIDS, max(FEWEST_CENTROIDS, round((self.n / PER_CELL) ** 0.5)))
        book = fit(_matrix(taken["v"]), k)

        def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                (a, da), (b, db) = book.assign(_matrix(pdf["v"]))
                yield pdf.assign(c1=a.astype(np.int32), c2=b.astype(np.int32), d1=da, d2=db)

        id_type = rows.schema["vec_id"].dataType.simpleString()
        self.entries = run.write(rows.mapInPandas(assign, f"vec_id {id_type}, v array<double>, row long, c1 int, c2 int, d1 double, d2 double"), "entries")
        # At most MOST_CENTROIDS ** 2 cells.
        cells = self.entries.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), *[f(f"d{h}").alias(f"{f.__name__}{h}") for h in (1, 2) for f in (F.sum, F.max)]).toPandas()
        self.sizes = dict(zip(zip(cells["c1"].tolist(), cells["c2"].tolist()), cells["n"].tolist()))
        spread, reach = [], []
        for h in (1, 2):
            by = cells.groupby(f"c{h}")
            n, total, most = (np.zeros(len(book.centroids[h - 1])) for _ in range(3))
            n[by["n"].sum().index], total[by["n"].sum().index], most[by["n"].sum().index] = by["n"].sum(), by[f"sum{h}"].sum(), by[f"max{h}"].max()
            spread.append(np.sqrt(total / np.maximum(n, 1) / max(1, book.centroids[h - 1].shape[1])))
            reach.append(np.sqrt(most))
        self.book = Codebook(book.centroids, tuple(spread), tuple(reach))
        self.held = cells.groupby("c1")["n"].sum().to_dict()

    def search(self, queries: Column, k: int = K, first: int = FIRST, slack: float | None = SLACK) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best found for each entry that `queries` holds for."""
        id_type = self.entries.schema["vec_id"].dataType.simpleString()
        if not self.n:
            return self.entries.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
        asked = self.entries.filter(queries).select(F.col("row").alias("q"), "v")
        near = self.run.write(self._scored(asked.withColumn("floor", F.lit(None).cast("double")), k, first, slack, "first"), "near")
        floor = near.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(float("-inf")).alias("floor"))
        # A query that has found nothing yet has no floor either.
        rest = asked.join(floor, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = near.unionByName(self._scored(rest, k, first, slack, "rest"))
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
        best = found.withColumn("rank", nth).filter(F.col("rank") <= k)
        ids = self.entries.filter(queries).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"))
        return best.join(ids, "q").select("query_id", "rank", "vec_id", "score")

    def _scored(self, asked: DataFrame, k: int, first: int, slack: float | None, name: str) -> DataFrame:
        """(q, vec_id, row, score): the k best at most of each query and group of entries, of the first cells of a query (floor null) or the further ones that reach its floor."""
        book, sizes = self.book, self.sizes

        def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                q_out, c_out, cells_out = [], [], []
                for q, v, floor in zip(pdf["q"], _matrix(pdf["v"]), pdf["floor"].astype(float)):
                    seen, cells = 0, {}
                    for total, i, j in traverse(*book.plausible(v, slack)):
                        early = seen < first
                        if not early and (np.isnan(floor) or total < floor):
                            break
                        n = sizes.get((i, j), 0)
                        seen += n
                        if n and early == np.isnan(floor):
                            cells.setdefault(i, []).append(j)
                    q_out += [q] * len(cells)
                    c_out += list(cells)
                    cells_out += list(cells.values())
                yield pd.DataFrame({"q": pd.Series(q_out, dtype="int64"), "c1": pd.Series(c_out, dtype="int32"), "cells": pd.Series(cells_out, dtype=object)})

        visits = self.run.write(asked.select("q", "v", "floor").mapInPandas(visit, "q long, c1 int, cells array<int>"), f"visits-{name}")
        asking = {r.c1: r.n for r in visits.groupBy("c1").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each first centroid
        of = lambda counts, size: F.get(F.array(*[F.lit(-(-counts.get(c, 0) // size)) for c in range(len(book.centroids[0]))]), F.col("c1"))
        blocks, sides = of(self.held, BLOCK), of(asking, QUERIES)
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = visits.join(asked.select("q", F.transform("v", lambda x: x).alias("asked")), "q").select("q", "asked", "c1", "cells", every(blocks).alias("block"), F.pmod(F.xxhash64("q"), sides).cast("int").alias("side"))
        right = self.entries.withColumn("_sides", sides).filter("_sides > 0").select("row", "vec_id", "v", "c1", "c2", F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block"), every(F.col("_sides")).alias("side"))

        def best(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"q": [], "at": [], "score": []})
            if not len(queries) or not len(entries):
                return _with_ids(empty, entries)
            # By row, so that ids and nulls need no order here: ties keep every row until the ranks are given.
            entries = entries.sort_values("c2", kind="stable", ignore_index=True)
            q, x, c2 = _matrix(queries["asked"]), _matrix(entries["v"]), entries["c2"].to_numpy()
            rough = np.full((len(q), len(x)), -np.inf)
            wanted: dict[int, list[int]] = {}
            for i, cells in enumerate(queries["cells"]):
                for c in cells:
                    wanted.setdefault(int(c), []).append(i)
            for c, who in wanted.items():
                lo, hi = np.searchsorted(c2, [c, c + 1])
                if lo < hi:
                    rough[who, lo:hi] = q[who] @ x[lo:hi].T
            rough[queries["q"].to_numpy()[:, None] == entries["row"].to_numpy()[None, :]] = -np.inf
            kth = -np.partition(-rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            margin = 1e-11 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1)).max()
            i, at = np.nonzero((rough >= (kth - margin)[:, None]) & (rough > -np.inf))
            found = pd.DataFrame({"i": i, "at": at, "score": exact_scores(q[i], x[at])})
            ids = entries["vec_id"]
            found["no_id"], found["id"], found["row"] = ids.isna().to_numpy()[at], ids.fillna(0).to_numpy()[at], entries["row"].to_numpy()[at]
            found = found.sort_values(["i", "score", "no_id", "id", "row"], ascending=[True, False, True, True, True]).groupby("i").head(k)
            return _with_ids(pd.DataFrame({"q": queries["q"].to_numpy()[found["i"]], "at": found["at"], "score": found["score"]}), entries)

        def _with_ids(found: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
            at = found["at"].to_numpy().astype(int)
            return pd.DataFrame({"q": found["q"].to_numpy().astype("int64"), "vec_id": entries["vec_id"].iloc[at].array, "row": entries["row"].to_numpy()[at].astype("int64"), "score": found["score"].to_numpy().astype(float)})

        id_type = self.entries.schema["vec_id"].dataType.simpleString()
        group = ["c1", "block", "side"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(best, f"q long, vec_id {id_type}, row long, score double")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id 20 divides, by inner product."""
    index = MultiIndex(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), Scratch(spark, "op12"))
    return index.search(F.col("vec_id") % 20 == 0).select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")

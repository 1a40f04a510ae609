"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed; the hashes that LEAST_DOCS documents of the sample hold have an embedding, all others share that of
padding (a word never seen must not borrow the meaning of another). Filters of widths 1, 2 and 3 slide over the whole text, each keeps its greatest
response, and a logistic layer weighs those. One channel of the embeddings starts at the log-odds of a word in one half of the
sample, the rest at random; all are trained by gradient steps through the max pooling on documents of the other half. Thresholds
are calibrated by language on a fifth of the sample that neither sees: the language is guessed from the words of the text itself
by a table learned on the same sample, so no label, lang, source or doc_id enters a score.

Training reads the whole texts of at most `most` labelled documents, the least by a hash of doc_id of those with at most LONGEST
characters: a documented bound, which is also what makes the list of their ids safe to broadcast, and the words that
reach the driver at most `most` * LONGEST / 2. Scoring reads every whole text, in slices of bounded bytes.

Defined cases: null and empty texts score as a text without words does; labels for unknown documents are ignored, a
document labelled twice counts as toxic if one label says so; of rows that share a doc_id one is learned from; null labels
are ignored; without labels all scores are 0; columns beside doc_id and text are not read when scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text_crc
from .wordgrams import U, Words, lean, text_slices

#: Documents to learn from, and the characters beyond which one is passed over.
SAMPLE_DOCS, LONGEST = 12_000, 20_000
CHANNELS, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
#: Documents of the sample that must hold a word; weight of the base rate in its log-odds.
LEAST_DOCS, PRIOR = 4, 4.0
EPOCHS, BATCH, SEED = 8, 32, 5
#: Bytes of words: digits, lower-case letters, all beyond ASCII (after lower-casing).
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the hash of every word, words first[i] to first[i + 1] are text i's."""
    words = Words(column, lower=True, word_bytes=WORD_BYTES)
    return words.hashes(), words.first


class Lexicon:
    """Embedding rows of hashes: 1 and up for the known ones (sorted), 0 for all others."""

    BITS = 22

    def __init__(self, known: np.ndarray):
        self.known = known
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(known & U((1 << self.BITS) - 1)).astype(np.int64)] = True

    def __reduce__(self):
        return Lexicon, (self.known,)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int32)
        at = np.flatnonzero(self.maybe[(hashes & U((1 << self.BITS) - 1)).astype(np.int64)])
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
            out[at] = np.where(self.known[place] == hashes[at], place + 1, 0)
        return out


def _padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with padding behind each text, and the place of each word in them."""
    pad = max(WIDTHS) - 1
    at = np.arange(len(ids)) + pad * np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros(len(ids) + pad * (len(first) - 1), np.int32)
    out[at] = ids
    return out, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class ToxicityModel:
    """Embeddings, filters by width (width, channels, filters), output layer, and the calibration by language."""

    lexicon: Lexicon
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str] = field(default_factory=list)
    words_by_language: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @staticmethod
    def start(lexicon: Lexicon, log_odds: np.ndarray, rng: np.random.Generator) -> ToxicityModel:
        embed = rng.normal(0, 0.05, (len(log_odds), CHANNELS)).astype(np.float32)
        embed[:, 0] = np.clip(log_odds, -3, 6)
        embed[0] = 0
        filters = [rng.normal(0, 0.1, (k, CHANNELS, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in filters:
            w[:, 0, : FILTERS // 2] = 1 / len(w)
        return ToxicityModel(lexicon, embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -2.0)

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset, the responses of all embeddings: a convolution is then a sum of rows."""
        return [[self.embed @ w[j] for j in range(len(w))] for w in self.filters]

    def pooled(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """The greatest response of every filter in each text (not below 0; 0 without words)."""
        padded, at = _padded(ids, first)
        out = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            for i, (rows, b) in enumerate(zip(tables or self.tables(), self.bias)):
                z = rows[0][padded[at]]
                for j in range(1, len(rows)):
                    z = z + rows[j][padded[at + j]]
                out[some, i * FILTERS : (i + 1) * FILTERS] = np.maximum(0, np.maximum.reduceat(z, first[some], axis=0) + b)
        return out

    def logits(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        return self.pooled(ids, first, tables) @ self.out + self.out_bias

    def guessed(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each text by its words; -1 without words or languages."""
        out = np.full(len(first) - 1, -1)
        some = np.flatnonzero(np.diff(first))
        if len(some) and self.languages:
            out[some] = np.add.reduceat(self.words_by_language[ids], first[some], axis=0).argmax(axis=1)
        return out

    def scores(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """Calibrated scores: 0.5 is the threshold of the text's language."""
        return _sigmoid(self.logits(ids, first, tables) - self.thresholds[self.guessed(ids, first)])


def _fit_steps(model: ToxicityModel, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad on the embeddings touched by the pooling, Adam on the rest."""
    dense = [*model.filters, *model.bias, model.out]
    first_moment, second_moment = [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense]
    touched = np.full(len(model.embed), 0.1, np.float32)
    bias_moments, step = [0.0, 0.0], 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            ids = np.concatenate([texts[i] for i in pick])
            padded, at = _padded(ids, first)
            feats, where = [], []
            for w, b in zip(model.filters, model.bias):
                z = model.embed[padded[at]] @ w[0]
                for j in range(1, len(w)):
                    z += model.embed[padded[at + j]] @ w[j]
                best = np.array([first[d] + z[first[d] : first[d + 1]].argmax(axis=0) if first[d + 1] > first[d] else np.full(FILTERS, -1) for d in range(len(pick))])
                feats.append(np.where(best >= 0, np.maximum(0, z[best, np.arange(FILTERS)] + b), 0) if len(z) else np.zeros((len(pick), FILTERS), np.float32))
                where.append(best)
            x = np.concatenate(feats, axis=1)
            error = ((_sigmoid(x @ model.out + model.out_bias) - labels[pick]) / len(pick)).astype(np.float32)
            back = (error[:, None] * model.out[None, :]) * (x > 0)
            grads_w, grads_b = [], []
            grad_e: list[tuple[np.ndarray, np.ndarray]] = []
            for i, w in enumerate(model.filters):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                d, f = np.nonzero(g)
                v, gw = g[d, f][:, None], np.zeros_like(w)
                for j in range(len(w)):
                    rows = padded[at[where[i][d, f]] + j]
                    np.add.at(gw[j].T, f, v * model.embed[rows])
                    grad_e.append((rows, v * w[j].T[f]))
                grads_w.append(gw + 1e-4 * w)
                grads_b.append(g.sum(axis=0))
            step += 1
            for k, g in enumerate([*grads_w, *grads_b, x.T @ error + 1e-4 * model.out]):
                first_moment[k] += 0.1 * (g - first_moment[k])
                second_moment[k] += 0.001 * (g * g - second_moment[k])
                dense[k] -= rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
            g = float(error.sum())
            bias_moments = [bias_moments[0] + 0.1 * (g - bias_moments[0]), bias_moments[1] + 0.001 * (g * g - bias_moments[1])]
            model.out_bias -= rate * (bias_moments[0] / (1 - 0.9**step)) / ((bias_moments[1] / (1 - 0.999**step)) ** 0.5 + 1e-8)
            rows, g = np.concatenate([r for r, _ in grad_e]), np.concatenate([x for _, x in grad_e])
            live = rows > 0
            if live.any():
                own, back_to = np.unique(rows[live], return_inverse=True)
                total = np.zeros((len(own), CHANNELS), np.float32)
                np.add.at(total, back_to, g[live])
                touched[own] += (total * total).mean(axis=1) * 1e4
                model.embed[own] -= 0.5 * rate * total * 100 / np.sqrt(touched[own])[:, None]


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the labels with the best F1; midway between the two texts there."""
    order = np.argsort(-logits, kind="stable")
    x, y = logits[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][x[:-1] == x[1:]] = -1
    k = int(f1.argmax())
    return float((x[k] + x[k + 1]) / 2) if k + 1 < len(x) else float(x[k] - 1)


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = SEED) -> ToxicityModel:
    """Log-odds from two fifths of the sample, steps on two fifths, calibration on one."""
    rng = np.random.default_rng(seed)
    turn = np.arange(len(texts)) % 5
    known, docs = np.unique(np.concatenate([np.unique(x) for x in texts]), return_counts=True)
    lexicon = Lexicon(known[docs >= LEAST_DOCS])
    texts = [lexicon.rows(x) for x in texts]
    n_rows = len(lexicon.known) + 1
    counted, part = np.isin(turn, (0, 2)), turn == 4
    seen = np.zeros((2, n_rows))
    for i in np.flatnonzero(counted):
        seen[int(labels[i]), np.unique(texts[i])] += 1
    base = (labels[counted].sum() + 0.5) / (counted.sum() + 1)
    share = (seen[1] + PRIOR * base) / (seen.sum(axis=0) + PRIOR)
    log_odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
    log_odds[0] = 0
    model = ToxicityModel.start(lexicon, log_odds, rng)
    train = np.flatnonzero(~counted & ~part)
    _fit_steps(model, [texts[i] for i in train], labels[train].astype(np.float32), rng)
    model.languages = sorted({x for x in langs if x is not None})
    if model.languages:
        by = np.full((n_rows, len(model.languages)), 0.1)
        for ids, lang in zip(texts, langs):
            if lang is not None:
                by[:, model.languages.index(lang)] += np.bincount(ids, minlength=n_rows)
        model.words_by_language = np.log(by / by.sum(axis=0)).astype(np.float32)
        model.words_by_language[0] = 0
    use = np.flatnonzero(part) if part.any() and labels[part].sum() >= 5 else np.arange(len(texts))
    first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in use])])
    ids = np.concatenate([texts[i] for i in use]) if len(use) else np.zeros(0, np.int32)
    logits, guess = model.logits(ids, first), model.guessed(ids, first)
    general = best_threshold(logits, labels[use]) if labels[use].any() else 0.0
    # The last entry serves texts without a guess (index -1).
    model.thresholds = np.full(len(model.languages) + 1, general)
    for k in range(len(model.languages)):
        own = guess == k
        if labels[use][own].sum() >= 15 and (labels[use][own] == 0).sum() >= 15:
            model.thresholds[k] = best_threshold(logits[own], labels[use][own])
    return model


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each document, once in a task."""
    seen: set[int] = set()
    for batch in text_slices(batches):
        docs = batch.column("doc_id").to_pylist()
        new = [i for i, d in enumerate(docs) if not (d in seen or seen.add(d))]
        ids, first = word_hashes(batch.column("text"))
        own = [ids[first[i] : first[i + 1]].tobytes() for i in new]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(new, pa.int64())) for c in ("doc_id", "lang", "toxic")), pa.array(own, pa.binary())], ["doc_id", "lang", "toxic", "ids"])


def train(docs: DataFrame, labels: DataFrame, fold: Column, most: int = SAMPLE_DOCS, longest: int = LONGEST) -> ToxicityModel | None:
    """A model from at most `most` labelled documents for which `fold` holds; None without any."""
    marks = labels.filter(fold & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    short = docs.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= longest)
    # One row of each doc_id, the least by a hash of its text.
    known = short.select("doc_id", F.xxhash64("text").alias("_crc")).join(marks, "doc_id").groupBy("doc_id").agg(F.min("_crc").alias("_crc"), F.first("toxic").alias("toxic"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "_id"))
    rows = short.select("doc_id", "lang", "text").join(sample, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_crc")))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "toxic", "text").mapInArrow(lean(_ids), "doc_id long, lang string, toxic int, ids binary").collect()
    if not rows:
        return None
    by_id = {r.doc_id: r for r in sorted(rows, key=lambda r: (r.doc_id, r.lang or "", bytes(r.ids)), reverse=True)}
    rows = [by_id[i] for i in sorted(by_id)]
    return fit([np.frombuffer(bytes(r.ids), np.uint64) for r in rows], np.array([r.toxic for r in rows]), [r.lang for r in rows])


def _score(model: ToxicityModel | None, keep: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in text_slices(batches):
            hashes, first = word_hashes(batch.column("text"))
            scores = model.scores(model.lexicon.rows(hashes), first, tables) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores.astype(np.float64))], [*keep, "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with the score of each whole text."""
    used = docs.select(*dict.fromkeys((*keep, "text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", score double"
    return used.mapInArrow(lean(_score(model, keep)), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = id_text_crc(F.col("doc_id")) % 5 == 0
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))

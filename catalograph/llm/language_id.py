"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of labelled text. A text is parsed greedily against every
automaton: each phrase is the longest match from its start. The language that needs the fewest phrases, normalised by the
length of the text, wins. Texts are lower-cased letters with one space for everything between them.

Training reads whole texts of at most `most` labelled rows a language: the least by a hash of doc_id of those with at most LONGEST
characters (of the longer ones one, where a language has no other), a documented bound. Prediction reads whole
texts. To parse with numpy, a batch of texts steps through the automata at once, long ones as streams of STREAM letters. A
stream starts as if a phrase began there; then the parse of the stream before is carried on into it, beside its own, until both
are in one state, from where on they agree, and the phrases up to there are put right. So the result is that of one parse from the first letter to
the last, whatever STREAM is.

Defined cases: null text, or one without a letter: `und` with score 0; U+0000 is no letter like any other; ties go to the
smaller language name; without any training text all languages are `und`; languages are bounded by the labels that
occur; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text_crc
from .wordgrams import give_back, lean, text_slices

#: Rows a language to learn from, and the characters beyond which a row is passed over.
SAMPLE_DOCS, LONGEST = 24, 2_000
STREAM = 4096
NONE = "und"


def _letter_table() -> np.ndarray:
    """True for the letters of the basic plane."""
    return np.array([chr(c).isalpha() for c in range(0xD800)] + [False] * 0x800 + [chr(c).isalpha() for c in range(0xE000, 0x10000)])


_LETTERS: list[np.ndarray] = []


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds): lower-cased letters, one 32 between words; text i is code points bounds[i] to bounds[i + 1]."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    lower = [x.lower() for x in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lower], dtype=np.int64)])
    low = codes < 0x10000
    letter = _LETTERS[0][np.where(low, codes, 0)]
    for c in np.unique(codes[~low]):
        if chr(c).isalpha():
            letter |= codes == c
    # A space stands behind a letter, for the first of what is between two words of one text.
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & letter[:-1]
    begins = ends[:-1][ends[:-1] < len(codes)]
    keep[begins] = letter[begins]
    marks = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, codes, 32).astype(np.uint32)[keep], marks[ends]


class SuffixAutomaton:
    """The automaton of all substrings of a sequence of small symbols."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for s in symbols:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][s]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def table(self, n_symbols: int) -> np.ndarray:
        """Transitions, -1 for none."""
        out = np.full((len(self.next), n_symbols), -1, np.int32)
        for state, edges in enumerate(self.next):
            for s, to in edges.items():
                out[state, s] = to
        return out


class LanguageModel:
    """Automata of all languages over one alphabet. Symbols: 0 pads, 1 is any letter that no sample has, then the letters."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        codes = [normalise([samples[x]])[0] for x in self.languages]
        self.alphabet = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint32)
        k = len(self.alphabet) + 2
        # Transitions hold 2 * next + (1 if this symbol starts a phrase); one flat table, languages behind each other.
        tables, base = [], 0
        self.roots = []
        for c in codes:
            t = SuffixAutomaton((np.searchsorted(self.alphabet, c) + 2).tolist()).table(k)
            root = np.where(t[0] >= 0, t[0], 0)
            miss = t < 0
            miss[0] = True
            t = (np.where(t < 0, root[None, :], t) + base) * 2 + miss
            t[:, 0] = (np.arange(len(t)) + base) * 2
            tables.append(t.astype(np.int32))
            self.roots.append(base)
            base += len(t)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)
        self.width = k

    def phrases(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.diff(bounds)
        n_streams = -(-sizes // STREAM)
        owner = np.repeat(np.arange(len(sizes)), n_streams)
        out = np.zeros((len(sizes), len(self.languages)), np.int64)
        if not len(owner):
            return out
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_streams) - n_streams, n_streams)
        start = bounds[:-1][owner] + nth * STREAM
        length = np.minimum(STREAM, bounds[1:][owner] - start)
        at = np.searchsorted(self.alphabet, codes)
        at[at == len(self.alphabet)] = 0
        symbol = np.where(self.alphabet[at] == codes, at + 2, 1).astype(np.int32)
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(STREAM), "left")  # streams longer than t
        for k, root in enumerate(self.roots):
            state = np.full(len(owner), root, np.int32)
            count = np.zeros(len(owner), np.int32)
            first = start[order]
            for t in range(int(length.max())):
                n = active[t]
                got = self.table[state[:n] * self.width + symbol[first[:n] + t]]
                count[:n] += got & 1
                state[:n] = got >> 1
            ends, total = np.empty_like(state), np.empty_like(count)
            ends[order], total[order] = state, count
            later = np.flatnonzero(nth > 0)
            if len(later):
                total[later] += self._carried(symbol, start, length, owner, later, ends, root)
            out[:, k] = np.bincount(owner, total, minlength=len(sizes)).astype(np.int64)
        return out

    def _carried(self, symbol: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, later: np.ndarray, ends: np.ndarray, root: int) -> np.ndarray:
        """What carrying the parse over the cut adds to the phrases of each of the streams `later`, which all have one of their text before them."""

        def walk(streams: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(more phrases, whether the parses met, state at the end) of streams entered in `state` instead of the root."""
            more, own, state = np.zeros(len(streams), np.int64), np.full(len(streams), root, np.int32), state.copy()
            going, t = np.flatnonzero(state != own), 0
            while len(going := going[length[streams[going]] > t]):
                s = symbol[start[streams[going]] + t]
                a, b = self.table[state[going] * self.width + s], self.table[own[going] * self.width + s]
                more[going] += (a & 1) - (b & 1)
                state[going], own[going] = a >> 1, b >> 1
                going, t = going[state[going] != own[going]], t + 1
            return more, state == own, state

        more, met, left = walk(later, ends[later - 1])
        # Where a whole stream goes by without a meeting, the next one was entered in the wrong state: again, in order.
        place = {int(x): i for i, x in enumerate(later)}
        for x in later[~met].tolist():
            i = place[x]
            while not met[i] and x + 1 < len(owner) and owner[x + 1] == owner[x]:
                j = place[x + 1]
                (more[j],), (again,), (state,) = walk(later[j : j + 1], left[i : i + 1])
                # A stream that meets now may have been in the list; one that does not goes on from here.
                met[j], left[j] = again, state
                x, i = x + 1, j
        return more

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        codes, bounds = normalise(texts)
        sizes = np.diff(bounds)
        if not self.languages:
            return [NONE] * len(texts), [0.0] * len(texts)
        counts = self.phrases(codes, bounds)
        best = counts.argmin(axis=1)
        least = counts[np.arange(len(texts)), best].astype(float)
        others = counts.copy()
        others[np.arange(len(texts)), best] = np.iinfo(np.int64).max
        # The share of phrases saved against the next best language; near 0 for a tie.
        second = others.min(axis=1) if counts.shape[1] > 1 else np.maximum(sizes, 1)
        score = np.where(sizes > 0, np.clip(0.5 + 0.5 * (1 - least / np.maximum(1, second)), 0, 1), 0.0)
        return [self.languages[b] if s else NONE for b, s in zip(best.tolist(), sizes.tolist())], score.tolist()


def train(docs: DataFrame, fold: Column, most: int = SAMPLE_DOCS, longest: int = LONGEST) -> LanguageModel:
    """A model from the rows of docs for which `fold` holds: at most `most` rows a language reach the driver."""
    labelled = docs.filter(fold & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", "text", (F.char_length("text") > longest).alias("_long"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_long", F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    ranked = labelled.select("lang", "_long", "text", rank.alias("_rank"))
    rows = ranked.filter((F.col("_rank") <= F.lit(most)) & (~F.col("_long") | (F.col("_rank") == 1))).orderBy("lang", "_rank").select("lang", "text").collect()
    samples: dict[str, str] = {}
    for r in rows:
        samples[r.lang] = samples.get(r.lang, "") + r.text + " "
    return LanguageModel({k: v for k, v in samples.items() if normalise([v])[1][1]})


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in slices of bounded bytes; a null is empty."""
    for part in text_slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), limit=4 << 20):
        yield [x or "" for x in part.column("text").to_pylist()]


def _predict(model: LanguageModel, keep: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for texts in _texts(batch.column("text")):
                lang, score = model.predict(texts)
                langs += lang
                scores += score
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score. Columns sent along go through Python: for rows with texts use predicted_language()."""
    used = docs.select(*dict.fromkeys((*keep, "text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", lang_pred string, score double"
    return used.mapInArrow(lean(_predict(model, keep)), schema)


def predicted_language(model: LanguageModel, text: Column) -> Column:
    """The predicted language as a column: only texts go to Python, and only languages come back."""

    @F.arrow_udf("string")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                yield pa.array([x for texts in _texts(column) for x in model.predict(texts)[0]], pa.string())
        finally:
            give_back()

    return predict(text)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = id_text_crc(F.col("doc_id")) % 4 == 2
    model = train(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

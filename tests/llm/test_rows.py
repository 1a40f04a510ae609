"""Rows that share a doc_id or have none: every operator decides by the row, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from catalograph.llm import language_id, line_dedup, mixing, ngram_join, sharding, substring_dedup

from catalograph.llm.common import LOWER, UPPER

from .helpers import random_texts, rows_of, write


def _text(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline as p

    item = "this benchmark item has more than ten words in one row for sure"
    near = _text("near")
    texts = [(7, near), (None, near + " end"), (None, _text("clean")), (None, _text("other")), (None, _text("copy")), (None, _text("copy")), (None, _text("copy") + " end")]
    texts += [(8, _text("same")), (8, _text("same") + " end"), (9, _text("twice")), (9, _text("twice")), (8, _text("apart")), (10, _text("dirty") + " " + item), (10, _text("beside")), (None, item + " " + _text("nameless"))]
    texts += [(11, None), (11, None), (None, "")]
    folder = write(tmp_path, [(i, t, "en", "s", 1) for i, t in texts], [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(p.STAGES)
    out = stages["ngram_join"](spark, docs, folder)
    key = lambda rows: sorted(rows, key=str)
    of = lambda name, rows: [(i, t) for i, t in rows if (t or "").startswith(name)]
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and of("near", left) == [(7, near)]
    assert [len(of(n, left)) for n in ("copy", "same", "twice")] == [1, 1, 1]
    single = ("clean", "other", "apart", "dirty", "beside", "this")
    assert [len(of(n, left)) for n in single] == [1] * len(single) and len(left) == 4 + len(single) + 3
    clean = [(r.doc_id, r.text) for r in stages["decontamination"](spark, out, folder).collect()]
    assert key(clean) == key(x for x in left if item not in (x[1] or ""))


@pytest.fixture
def shared_ids(spark, tmp_path):
    """Random texts under few ids, a third of them null: ids that stand for several texts, texts that stand under several ids."""
    rng = random.Random(7)
    texts = random_texts(160, 12, vocabulary=25)
    rows = [(rng.choice([None, *range(24)]) if i % 3 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (2, "one only line that B has\nshared line of all", "en", "s", 1), (2, "another text\nshared line of all", "en", "s", 1), (1, "shared line of all", "en", "s", 1)]
    folder = write(tmp_path, rows)
    return [(i, t) for i, t, *_ in rows], spark.read.parquet(f"{folder}/documents.parquet")


LAST = 1 << 62


def _removed(rows, window):
    """For each row (id, kept words, removed words) by looking every window up in all smaller ids."""
    words = [(t or "").split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (LAST if i is None else i):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window", [13, 6])
def test_substrings(shared_ids, window):
    rows, docs = shared_ids
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs, window).collect()]
    assert sorted(got, key=str) == sorted(_removed(rows, window), key=str) and any(x[2] for x in got)


def test_factors_are_the_greedy_parse(shared_ids):
    """Disjoint, in order, starting at the first window that the index has behind the last factor; spans are what is removed."""
    rows, docs = shared_ids
    n = 0
    for r in substring_dedup.substring_dedup(docs, 6).collect():
        end, gone = 0, set()
        for f in r.factors:
            assert f.start >= end and f.words >= 6 and f.ref_doc < (LAST if r.doc_id is None else r.doc_id)
            end, n = f.start + f.words, n + 1
        for f in [*r.factors, *r.straddling]:
            gone |= set(range(f.start, f.start + f.words))
        assert len(gone) == r.n_removed
    assert n > 20


def test_factorize():
    # Windows 0-4 go on in document 1, 5-6 in document 2, 20 alone; 13 words a window.
    factors, straddling = substring_dedup.factorize([(5, 2, 2, 50), (0, 3, 1, 10), (3, 2, 1, 13), (20, 1, 3, 0), (20, 1, 3, 0)])
    assert factors == [(0, 17, 1, 10), (20, 13, 3, 0)] and straddling == [(5, 14, 2, 50)]


def test_lines(shared_ids):
    rows, docs = shared_ids
    key = lambda x: x.strip(line_dedup.TRIM).translate(str.maketrans(UPPER, LOWER))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(LAST if i is None else i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (LAST if i is None else i)]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("percent", [80, 50])
def test_links(shared_ids, monkeypatch, percent):
    """Components of texts, whose names may be shared; blocks of few sets."""
    for name, size in (("GROUP_BLOCK", 8), ("CLUSTER_BLOCK", 4)):
        monkeypatch.setattr(ngram_join, name, size)
    rows, docs = shared_ids
    sets = []
    for _, t in rows:
        w = [x.translate(str.maketrans(UPPER, LOWER)) for x in (t or "").split()]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    want = [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(docs, percent).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mixed_rows(spark, tmp_path):
    """Repeated rows get their own copies: what the rows take is what the mix takes."""
    rows = [(5, "a b c d e", "en", "x", k) for k in range(40)] + [(None, f"one two {k}", "en", "x" if k % 2 else None, k) for k in range(30)] + [(9, None, None, None, 1)] * 3
    folder = write(tmp_path, rows, extra={"copies": pa.int64(), "_copies_n": pa.int64(), "size": pa.int64(), "source_size": pa.int64()})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    size = lambda t: len((t or "").split())
    n, taken = {}, {}
    for r in out.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        n[(r.source, size(r.text))] = n.get((r.source, size(r.text)), 0) + 1
    want, want_n = {}, {}
    for r in mixing.mix_sources(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.copies * r["size"]
        want_n[(r.source, r["size"])] = want_n.get((r.source, r["size"]), 0) + r.copies
    assert taken == want and n == want_n


def test_shards_of_rows_without_ids(spark, tmp_path):
    """Null ids are dealt by their texts, and reruns agree."""
    rows = [(None, f"text {k}", "en", "s", 1) for k in range(300)] + [(3, f"same id {k}", "en", "s", 1) for k in range(20)] + [(None, None, None, None, None)] * 2
    folder = write(tmp_path, rows)
    got, again = rows_of(sharding.op2_sharding(spark, folder)), rows_of(sharding.op2_sharding(spark, folder))
    assert got == again and len({r["virtual_slot"] for r in got if r["doc_id"] is None}) > 200
    for shard in range(16):
        own = [r["slot"] for r in got if r["shard"] == shard]
        assert sorted(own) == list(range(len(own)))


def test_slot_map_store(spark, tmp_path):
    """Each run loads the last version and edits it; a stored version stays."""
    store = sharding.SlotMapStore(spark, str(tmp_path / "maps"))
    rng = np.random.default_rng(4)
    weights = {i: int(x) for i, x in enumerate(rng.integers(1, 100, 128))}
    first = store.current(weights, 4, 128)
    assert store.current(weights, 4, 128) == first and store.versions() == [0]
    grown = store.current({k: v * (1 + k % 7) for k, v in weights.items()}, 5, 128)
    assert store.versions() == [0, 1] and store.load(1) == grown and store.load(0) == first and grown.n_shards == 5
    assert 0 < sum(a != b for a, b in zip(first.shards, grown.shards)) < 100


def test_language_of_texts_with_code_zero(spark):
    model = language_id.LanguageModel({"en": "the dog and the house of the man with the hat", "fr": "le chien et la maison de l'homme avec le chapeau"})
    assert model.predict(["the dog\0 and the house", "12345", "\0", "", "le chien et la maison"])[0] == ["en", "und", "und", "und", "fr"]
    df = spark.createDataFrame([(1, "the dog\0 and the house"), (2, "12345"), (3, None), (4, "le chien et la maison")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()} == {1: "en", 2: "und", 3: "und", 4: "fr"}
    assert {r.doc_id: r.p for r in df.select("doc_id", language_id.predicted_language(model, df.text).alias("p")).collect()} == {1: "en", 2: "und", 3: "und", 4: "fr"}


def test_long_texts_are_streams(monkeypatch):
    """A text over STREAM letters has the phrases of one greedy parse from its first letter, wherever its streams are cut."""
    monkeypatch.setattr(language_id, "STREAM", 16)
    sample = "abracadabra abcabd"
    model = language_id.LanguageModel({"x": sample})

    def phrases(text):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
        return n

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd r") for _ in range(n)) for n in (300, 16, 17, 5, 0, 1000)]
    codes, bounds = language_id.normalise(texts)
    plain = ["".join(map(chr, codes[a:b])) for a, b in zip(bounds, bounds[1:])]
    assert model.phrases(codes, bounds)[:, 0].tolist() == [phrases(t) for t in plain]


def test_very_long_texts(spark, tmp_path):
    """Two texts of 3 MB: whole texts count."""
    long_ = " ".join(f"w{i % 9973}x{i // 7}" for i in range(250_000))
    folder = write(tmp_path, [(1, long_, "en", "s", 1), (2, "start " + long_ + " end", "en", "s", 1), (3, "short", "en", "s", 1)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert (got[2].n_removed, got[2].kept, got[1].n_removed) == (250_000, "start end", 0)
    assert hashlib.sha256(got[1].kept.encode()).hexdigest() == hashlib.sha256(long_.encode()).hexdigest()
    assert {r.doc_id: r.component_id for r in ngram_join.similarity_components(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_groups_below_80_percent_keep_links(monkeypatch):
    """Texts that are heads of one text: their Jaccard is the ratio of their sizes. Blocks of two sets."""
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 2)
    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words[:n]) for n in range(44, 105, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], ["doc_id", "crc", "text"])
    table = pa.Table.from_batches(ngram_join._prefixes(np.zeros(16, np.uint8), 4, 50)(iter([batch])))
    rows = table.filter(pa.compute.is_valid(table["bucket"])).select(["bucket", "entries", "sids", "at", "sizes"]).sort_by("bucket")
    met = {}
    for out in ngram_join._groups(50)(iter(rows.combine_chunks().to_batches())):
        for g, s in zip(out.column("grp").to_pylist(), out.column("sid").to_pylist()):
            met.setdefault(g, set()).add(s)
    sets = [set(x.tolist()) for x in ngram_join.shingle_sets(pa.array(texts))]
    ids = [ngram_join.set_id(x) for x in ngram_join.shingle_sets(pa.array(texts))]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])]
    assert linked and all(any({ids[i], ids[j]} <= m for m in met.values()) for i, j in linked)


@pytest.mark.parametrize("stream", [1, 3, 7, 50])
def test_streams_that_do_not_meet_are_carried_further(monkeypatch, stream):
    """Periodic texts keep two parses apart for long; streams of any length give the same phrases."""
    rng = random.Random(stream)
    model = language_id.LanguageModel({"a": "abababab abaab ababa " * 3, "b": "ba" * 40 + " aab", "c": "b" * 30 + "a"})
    texts = ["ab" * 60, "aab" * 41, "b" * 200, "a", "", "zab zzab", *["".join(rng.choice("aab z") for _ in range(rng.randrange(300))) for _ in range(30)]]
    codes, bounds = language_id.normalise(texts)
    whole = model.phrases(codes, bounds).tolist()
    monkeypatch.setattr(language_id, "STREAM", stream)
    assert model.phrases(codes, bounds).tolist() == whole

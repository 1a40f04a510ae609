"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A term of weight 1 or more is strict, one below is soft. A hit counts only between boundaries (the characters beside it are not
ASCII letters or digits). A url is rejected where the weights of its distinct terms add up to 1: by one strict term or
several distinct soft ones. The vocabulary is VOCABULARY or a table (term, weight), bounded by MOST_TERMS as every task holds it.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is judged by the vocabulary
alone (null: allowed); page_id may be null; repeated rows are judged alike; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of the contract (host, path, verdict), and the vocabulary.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
STRICT = ("porn", "xxx", "hentai", "escort", "casino", "viagra", "spam", "malware", "warez", "phishing", "adult")
SOFT = ("bet", "bets", "poker", "loan", "pills", "free", "win", "farm", "download", "click", "cheap", "sex", "hot", "dating", "crack", "torrent", "ads", "track")
VOCABULARY = {**dict.fromkeys(STRICT, 1.0), **dict.fromkeys(SOFT, 0.5)}
MOST_TERMS = 1_000_000

_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def vocabulary_of(table: DataFrame) -> dict[str, float]:
    """The vocabulary of a table (term, weight): terms lower-cased, the greatest weight of each; nulls and empty terms are left out."""
    rows = table.selectExpr("lower(term) AS term", "cast(weight AS double) AS weight").filter("term <> '' AND weight > 0").groupBy("term").agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return {r.term: r.weight for r in rows}


def automaton_of(vocabulary: dict[str, float]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        out.add_word(term, (term, weight))
    if vocabulary:
        out.make_automaton()
    return out


def hits(automaton: ahocorasick.Automaton, url: str) -> tuple[int, int, float]:
    """(strict hits, distinct soft terms, weight of the distinct terms) of a url."""
    url = url.translate(_UPPER)
    strict, found = 0, {}
    for end, (term, weight) in automaton.iter(url) if len(automaton) else ():
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in _INNER) and (end + 1 == len(url) or url[end + 1] not in _INNER):
            strict += weight >= 1
            found[term] = weight
    return strict, sum(w < 1 for w in found.values()), sum(found.values())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first `://` up to `/`, `?` or `#`, lower-cased; then up to `?` or `#`."""
    m = _URL.match(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def find_rule(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits. rules: by host, (path, verdict) with the longest path first."""
    best: tuple[str, str] | None = None
    labels = host.split(".")
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        for prefix, verdict in rules.get(suffix, ()):
            if path.startswith(prefix):
                if best is None or len(suffix + prefix) > len(best[0]):
                    best = (suffix + prefix, verdict)
                break
    return best


def _judge(rules: tuple, vocabulary: dict[str, float]) -> Callable:
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    for paths in by_host.values():
        paths.sort(key=lambda x: -len(x[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(vocabulary)
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule = find_rule(by_host, host, path)
                strict, soft, weight = hits(automaton, url or "")
                verdict = rule[1] if rule else "block" if weight >= 1 - 1e-9 else "allow"
                out.append((host, path, rule[0] if rule else None, verdict, strict, soft, weight))
            columns = list(zip(*out)) or [()] * 7
            types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"])

    return run


def judge_urls(pages: DataFrame, rules: tuple = RULES, vocabulary: dict[str, float] = VOCABULARY) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, weight) of every row."""
    pages = pages.selectExpr("cast(page_id AS long) AS page_id", "url")
    return pages.mapInArrow(_judge(rules, vocabulary), "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight double")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over all pages."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"
    times = lambda term: f"len(regexp_extract_all(regexp_replace(low, '[^a-z0-9]', '  ', 'g'), '(?:^| ){term}(?:$| )'))"
    fits = "\n".join(f"  UNION ALL SELECT page_id, '{h}{p}', '{v}' FROM u WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in RULES)
    return f"""
WITH u AS (SELECT page_id, {low} AS low,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT NULL AS page_id, NULL AS rule, NULL AS v WHERE false
{fits}),
b AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM f GROUP BY page_id),
h AS (SELECT *, ({" + ".join(times(t) for t in STRICT)})::INT AS strict_hits, ({" + ".join(hit(t) + "::INT" for t in SOFT)})::INT AS soft_hits,
  ({" + ".join(f"{hit(t)}::INT * {w}" for t, w in VOCABULARY.items())})::DOUBLE AS weight FROM u)
SELECT h.page_id, host, path, rule, coalesce(v, CASE WHEN weight >= 1 THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits, weight
FROM h LEFT JOIN b ON b.page_id = h.page_id
"""


OP7_SQL = _sql()

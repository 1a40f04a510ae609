"""Hand-made frames, and the metric in plain Python as an oracle of its own."""

import math
import re

from catalograph.schema import STOP_WORDS

SCHEMA = "seq long, id string, namespace string, type string, text string, local_id string, entity_types array<string>, line_of_business array<string>, tags array<string>, industry array<string>, capabilities array<string>, groups array<string>, use_case_text string, enriched boolean, title string, process_next array<string>"


def resource(seq, ns="a", kind="agent", text="", local="", et=(), lob=(), tags=(), industry=(), caps=(), groups=(), uses=""):
    return (seq, f"{ns}:{kind}:R{seq}:v1", ns, kind, text, local, list(et), list(lob), list(tags), list(industry), list(caps), list(groups), uses, bool(caps or groups or uses), f"R{seq}", [])


def tokens(text):
    return [t for t in re.split("[^a-zA-Z0-9]+", text.lower()) if len(t) > 2 and t not in STOP_WORDS]


def _vectors(texts):
    docs = [tokens(t) for t in texts]
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    return [{t: d.count(t) / len(d) * math.log((len(docs) + 1) / (df[t] + 1)) for t in set(d)} for d in docs]


def _cosine(a, b):
    size = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return sum(a[t] * b[t] for t in a if t in b) / size if size else 0.0


def _jaccard(a, b):
    a, b = set(a or ()), set(b or ())
    return len(a & b) / len(a | b) if a | b else 0.0


def oracle(rows, extended=False):
    """{(seq_a, seq_b): similarity rounded to 4 digits} of all pairs."""
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    rs = [dict(zip(cols, r)) for r in rows]
    rs = [r for r in rs if r["type"] != "entityType"]
    texts, uses = _vectors([r["text"] or "" for r in rs]), _vectors([r["use_case_text"] or "" for r in rs])
    n = {}
    for r in rs:
        for e in set(r["entity_types"] or ()):
            n[e] = n.get(e, 0) + 1
    w = lambda s: sum(1 / math.log(1 + n[e]) for e in s)
    local = [set(tokens(re.sub("([A-Z])", r" \1", r["local_id"] or r["id"].split(":")[2]))) for r in rs]
    out = {}
    for i, a in enumerate(rs):
        for j in range(i + 1, len(rs)):
            b = rs[j]
            x, y = set(a["entity_types"] or ()), set(b["entity_types"] or ())
            total = _cosine(texts[i], texts[j]) + _jaccard(local[i], local[j]) + (w(x & y) / w(x | y) if x | y else 0)
            total += sum(_jaccard(a[c], b[c]) for c in ("line_of_business", "tags", "industry"))
            parts = 6
            if extended:
                for c in ("capabilities", "groups"):
                    if a[c] and b[c]:
                        total, parts = total + _jaccard(a[c], b[c]), parts + 1
                if any(uses[i].values()) and any(uses[j].values()):
                    total, parts = total + _cosine(uses[i], uses[j]), parts + 1
            total = (total + (0.5 if a["namespace"] != b["namespace"] else 0)) / parts * (1 if a["type"] == b["type"] else 0.5)
            out[(a["seq"], b["seq"])] = math.floor((total + 1e-10) * 1e4 + 0.5) / 1e4
    return out


def scores(rows, corpus, use_text=True):
    """{(seq, seq): similarity} both ways, with texts (by seq) and rarities of `corpus`; rows and corpus are dicts."""
    corpus = [r for r in corpus if r["type"] != "entityType"]
    vectors = dict(zip((r["seq"] for r in corpus), _vectors([r["text"] or "" for r in corpus])))
    n = {}
    for r in corpus:
        for e in set(r["entity_types"] or ()):
            n[e] = n.get(e, 0) + 1
    w = lambda s: sum(1 / math.log(1 + n[e]) for e in s if e in n)
    local = lambda r: set(tokens(re.sub("([A-Z])", r" \1", r["local_id"] or r["id"].split(":")[2])))
    out = {}
    for a in rows:
        for b in rows:
            if a["seq"] == b["seq"]:
                continue
            x, y = set(a["entity_types"] or ()), set(b["entity_types"] or ())
            total = _jaccard(local(a), local(b)) + (w(x & y) / w(x | y) if w(x | y) else 0) + sum(_jaccard(a[c], b[c]) for c in ("line_of_business", "tags", "industry"))
            total += _cosine(vectors.get(a["seq"], {}), vectors.get(b["seq"], {})) if use_text else 0
            total = (total + (0.5 if a["namespace"] != b["namespace"] else 0)) / 6 * (1 if a["type"] == b["type"] else 0.5)
            out[(a["seq"], b["seq"])] = math.floor((total + 1e-10) * 1e4 + 0.5) / 1e4
    return out


def as_dicts(rows):
    return [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows]

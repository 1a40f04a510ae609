"""Scalar functions over text, ids and scores: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DIFFICULTY_BANDS, STOP_WORDS, TIER_MINIMUM, TIERS


def non_empty(*parts: Column) -> Column:
    """The parts that are neither null nor empty, in order."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, longer than two, without stop words; order and repeats stay."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9]+")
    return F.filter(parts, lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS))


def id_segment(ord_id: Column, i: int) -> Column:
    """Segment i of a composite id; null if there is none."""
    return F.get(F.split(ord_id, ":"), F.lit(i))


def local_id_tokens(local_id: Column, ord_id: Column) -> Column:
    """Distinct tokens of the local id (else the third id segment), cut before each capital."""
    name = F.coalesce(F.when(local_id != "", local_id), id_segment(ord_id, 2), F.lit(""))
    return F.array_distinct(tokenize(F.regexp_replace(name, "([A-Z])", " $1")))


def resource_text(title: Column, short: Column, description: Column, capabilities: Column | None = None) -> Column:
    """Title, short description and description by space; with capabilities for embeddings."""
    parts = non_empty(title, short, description)
    if capabilities is not None:
        parts = F.concat(parts, F.filter(F.coalesce(capabilities, F.array().cast("array<string>")), lambda x: x != ""))
    return F.array_join(parts, " ")


def clean_text(title: Column, short: Column, description: Column) -> Column:
    """The same parts by ` | `."""
    return F.array_join(non_empty(title, short, description), " | ")


def labelled(label: str, values: Column) -> Column:
    """`label: a, b`, or null for no values."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))


def enriched_text(title: Column, short: Column, description: Column, groups: Column, process_next: Column | None, capabilities: Column, use_cases: Column) -> Column:
    """The clean text with labelled groups, successors, capabilities and use cases; without successors if process_next is None."""
    parts = [title, short, description, labelled("Groups", groups)]
    parts += [labelled("Next", process_next)] if process_next is not None else []
    return F.array_join(non_empty(*parts, labelled("Capabilities", capabilities), labelled("Use cases", use_cases)), " | ")


def difficulty_band(score: Column) -> Column:
    """Band of an ambiguity score; outside all bands: the last."""
    out = F.lit(DIFFICULTY_BANDS[-1][0])
    for name, low, high in reversed(DIFFICULTY_BANDS):
        out = F.when((score >= low) & (score < high), name).otherwise(out)
    return out


def tier(sim: Column, none: str | None = None) -> Column:
    """Tier of a rounded similarity; below the lowest: `none`."""
    out = F.lit(none).cast("string")
    for name, least in reversed(TIERS):
        out = F.when(sim >= least, name).otherwise(out)
    return out


def needs(have: Column, name: str) -> Column:
    """How many neighbours of a tier are missing."""
    return F.greatest(F.lit(0), F.lit(TIER_MINIMUM[name]) - have)


def problem_labels(cross_namespace: Column, entity_types: Column, tags: Column, text: Column) -> Column:
    """P1 across namespaces, P2 shared entity types or tags, P3 unlike text with shared entity types; none of them: P2."""
    found = F.array_compact(F.array(F.when(cross_namespace, "P1"), F.when((entity_types > 0) | (tags > 0), "P2"), F.when((text < 0.2) & (entity_types > 0), "P3")))
    return F.when(F.size(found) == 0, F.array(F.lit("P2"))).otherwise(found)


def distractor_label(gt_namespace: Column, gt_types: Column, other_namespace: Column, other_types: Column) -> Column:
    """P3 without a distractor, P1 in another namespace, P2 with a shared entity type, else P1."""
    return F.when(other_namespace.isNull(), "P3").when(gt_namespace != other_namespace, "P1").when(F.arrays_overlap(gt_types, other_types), "P2").otherwise("P1")


def unicode_words(text: Column) -> Column:
    """Distinct lower-cased Unicode words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)))


def ord_slug(ord_id: Column) -> Column:
    return F.regexp_replace(ord_id, "[:.]", "-")


def case_slug(case_id: Column) -> Column:
    return F.regexp_replace(case_id, "[^a-zA-Z0-9_-]", "-")


def round4(x: Column, digits: int = 4) -> Column:
    """Half-up rounding with a guard far below the digit, so that sums in another order round alike."""
    return F.round(x + F.lit(1e-10), digits)


def picked_id(answer: Column) -> Column:
    """The ordId of the first `{... "ordId": "x"` in free text; null without one."""
    return F.nullif(F.trim(F.regexp_extract(answer, r'\{[^{}]*"ordId"\s*:\s*"([^"]+)"', 1)), F.lit(""))


def run_ordinal(nonce: Column) -> Column:
    """The number behind the last underscore."""
    return F.element_at(F.split(nonce, "_"), -1).try_cast("int")


def format_breakdown(parts: dict[str, Column]) -> Column:
    """`name=0.123 ...` of the parts above 0."""
    return F.concat_ws(" ", *[F.when(c > 0, F.concat(F.lit(f"{n}="), F.format_string("%.3f", c.cast("double")))) for n, c in parts.items()])


def prompt_constant(source: Column, name: str) -> Column:
    """The triple-quoted value of a constant in source text."""
    return F.regexp_extract(source, rf'(?s){name}\s*=\s*"""(.*?)"""', 1)


def front_matter_value(text: Column, key: str, nested: bool = True) -> Column:
    """A value of YAML front matter; nested: also under an indented key. Folded markers and quotes are stripped."""
    indent = r"[ \t]*" if nested else ""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    value = F.regexp_extract(head, rf"(?m)^{indent}{key}:[ \t]*>?[ \t]*((?:[^\n]*)(?:\n[ \t]+(?![\w-]+:)[^\n]+)*)", 1)
    value = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def skill_steps(text: Column) -> Column:
    """Numbered steps with their confirmed ids: array of (step, text, ids)."""
    items = F.regexp_extract_all(text, F.lit(r"(?ms)^(\d+\..*?)(?=^\d+\.|\z)"), F.lit(1))
    return F.transform(
        items,
        lambda s, i: F.struct(
            (i + 1).alias("step"),
            F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", ""), r"^\d+\.\s*|\s+\z", "").alias("text"),
            F.filter(F.transform(F.split(F.regexp_extract(s, r"ord_confirmed:\s*([^\n>]*?)\s*(?:-->|\n|$)", 1), ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"),
        ),
    )


def confirmed_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"ord_confirmed:\s*([^\s\-\*\n]+)"), F.lit(1))


#: What a step of a process says, as attributes of its tag.
STEP = ("id", "label", "description", "ordId")


def process_step_tags(xml: Column) -> Column:
    """Every <step> at any depth, in order, as a struct of STEP; an attribute that is missing or empty is null.

    Each tag is read by the XML parser, so quotes, order and entities are those of XML; comments and CDATA hold no steps. The tags are found
    first, so that a document that is broken elsewhere keeps its steps. A tag that is no XML itself (a bare ampersand) is read as it stands.
    """
    body = F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    tags = F.regexp_extract_all(body, F.lit(r"""(<step\b(?:[^>"']|"[^"]*"|'[^']*')*>)"""), F.lit(1))
    schema = ", ".join(f"_{n} string" for n in STEP) + ", _corrupt_record string"
    closed = lambda t: F.regexp_replace(t, r"\s*/?>\z", "/>")
    raw = lambda t, n: F.coalesce(F.nullif(F.regexp_extract(t, rf'(?s)\s{n}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(t, rf"(?s)\s{n}\s*=\s*'([^']*)'", 1))
    read = F.transform(tags, lambda t: F.struct(t.alias("tag"), F.from_xml(closed(t), schema, {"ignoreSurroundingSpaces": "false"}).alias("x")))
    value = lambda e, n: F.nullif(F.when(e["x"]["_corrupt_record"].isNull(), e["x"][f"_{n}"]).otherwise(raw(e["tag"], n)), F.lit(""))
    return F.transform(read, lambda e: F.struct(*[value(e, n).alias(n) for n in STEP]))


def step_attribute(xml: Column, name: str) -> Column:
    """One attribute of every <step>."""
    return F.transform(process_step_tags(xml), lambda s: s[name])


def generator_enrichment(answer: Column, allowed: Column) -> Column:
    """The last JSON object of an answer, as a map from id to JSON text, restricted to allowed ids with a colon."""
    body = F.regexp_extract(answer, r"(?s).*```json\s*(\{.*?\})\s*```", 1)
    return F.map_filter(F.from_json(F.nullif(body, F.lit("")), "map<string,string>"), lambda k, v: k.contains(":") & F.array_contains(allowed, k))


def process_title(xml: Column) -> Column:
    """Title from the process id: prefix and version cut, underscores to spaces."""
    name = F.regexp_extract(xml, r'<process[^>]+id="([^"]+)"', 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^proc_", ""), r"_v\d+$", ""), "_", " "))


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)

"""Functions over arrays: sets, vectors, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_STRINGS = F.array


def strings(values: Column) -> Column:
    """Null as an empty array."""
    return F.coalesce(values, F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|; both empty: 0."""
    union = F.size(F.array_union(strings(a), strings(b)))
    return F.when(union > 0, F.size(F.array_intersect(strings(a), strings(b))) / union).otherwise(0.0)


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard of word sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), jaccard(a, b)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of dense vectors; a zero vector: 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_normalise(v: Column) -> Column:
    """v / |v|; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def sorted_overlap(a: Column, b: Column) -> Column:
    """Sorted distinct intersection."""
    return F.array_sort(F.array_intersect(strings(a), strings(b)))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(strings(a))) == F.array_sort(F.array_distinct(strings(b)))


def covers(have: Column, wanted: Column) -> Column:
    """All wanted are among have."""
    return F.size(F.array_except(strings(wanted), strings(have))) == 0


def is_enriched(capabilities: Column, groups: Column, use_cases: Column, process_next: Column | None = None) -> Column:
    """Any semantic field is filled; process_next counts only if given."""
    fields = [capabilities, groups, use_cases] + ([process_next] if process_next is not None else [])
    return F.greatest(*[F.coalesce(F.size(x), F.lit(0)) for x in fields]) > 0


def _items(json_text: Column) -> Column:
    """The items of a JSON list as variants; null for other text."""
    return F.try_variant_get(F.try_parse_json(json_text), "$", "array<variant>")


def _is_object(item: Column) -> Column:
    return F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))


def _filled(ids: Column) -> Column:
    return strings(F.filter(ids, lambda x: x.isNotNull() & (x != "")))


def mixed_references(json_text: Column) -> Column:
    """Ids of a JSON list whose items are strings or objects with ordId, in order. An item's own type decides, not what its text looks like."""
    return _filled(F.transform(_items(json_text), lambda x: F.when(_is_object(x), F.try_variant_get(x, "$.ordId", "string")).otherwise(F.try_variant_get(x, "$", "string"))))


def entity_types_for_metric(related: Column, exposed: Column, plain: Column) -> Column:
    """Ordered distinct ids: related, exposed, plain lists (JSON text), each of strings or objects."""
    return F.array_distinct(F.concat(mixed_references(related), mixed_references(exposed), mixed_references(plain)))


def only_objects(json_text: Column) -> Column:
    return _filled(F.transform(_items(json_text), lambda x: F.when(_is_object(x), F.try_variant_get(x, "$.ordId", "string"))))


def only_strings(json_text: Column) -> Column:
    return _filled(F.transform(_items(json_text), lambda x: F.when(~_is_object(x), F.try_variant_get(x, "$", "string"))))


def entity_types_for_loading(mappings: Column, exposed: Column, related: Column, plain: Column) -> Column:
    """Ordered distinct ids: mapping targets, exposed (objects only), related (both), plain (strings only)."""
    targets = F.flatten(F.transform(mappings, lambda m: F.transform(m["entityTypeTargets"], lambda t: t["ordId"])))
    targets = F.filter(strings(targets), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.concat(targets, only_objects(exposed), mixed_references(related), only_strings(plain)))


def short_entity_types(ids: Column) -> Column:
    """The third segment of each id."""
    return F.transform(ids, lambda x: F.coalesce(F.get(F.split(x, ":"), F.lit(2)), x))


def group_ids(groups: Column) -> Column:
    return F.filter(F.transform(groups, lambda g: g["groupId"]), lambda x: x.isNotNull())

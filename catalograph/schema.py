"""Relations of a catalogue, and the constants of its metric."""

from __future__ import annotations

from pyspark.sql import types as T

# Weights, thresholds, bands, types and words of the metric.
WEIGHTS = {"text": 1.0, "localId": 1.0, "entityTypes": 1.0, "lineOfBusiness": 1.0, "tags": 1.0, "industry": 1.0}
TYPE_PENALTY = 0.5
CROSS_NAMESPACE_BONUS = 0.5
DIFFICULTY_BANDS = (("easy", 0.0, 0.20), ("medium", 0.20, 0.40), ("hard", 0.40, 0.60), ("very_hard", 0.60, 1.01))
TIERS = (("high", 0.50), ("medium", 0.25), ("low", 0.10))
TIER_MINIMUM = {"high": 3, "medium": 5, "low": 5}
NEAR_DUPLICATE = 0.75
COVERAGE_GAP = 0.25
TOP_K = 5
GROUND_TRUTH_TYPES = ("agent", "apiResource", "dataProduct")
TYPE_SHARES = {"apiResource": 0.50, "agent": 0.25, "dataProduct": 0.25}
DOMAIN_CLUSTERS = (
    ("hr", ("sap.sf", "workday.hcm")),
    ("procurement", ("sap.ariba", "sap.s4")),
    ("sales", ("sap.crm", "emarsys.cx")),
    ("manufacturing", ("my.mes", "sap.s4", "siemens.plm")),
    ("ehs", ("sap.ehs", "sap.s4")),
    ("itsm", ("corp.itsm", "sap.sf")),
    ("plm", ("siemens.plm", "sap.s4")),
    ("cx", ("emarsys.cx", "sap.crm")),
)
TAXONOMY_NAMESPACE = "sap.odm"
STOP_WORDS = (
    "a", "an", "the", "for", "to", "of", "in", "is", "with", "and", "or",
    "at", "on", "by", "from", "be", "are", "has", "have", "do", "does",
    "their", "this", "that", "it", "its", "as", "after", "before", "when",
    "where", "how", "what", "who", "all", "any", "each", "per", "new",
    "get", "set", "run", "use", "add", "into", "out", "up", "not", "no",
    "if", "else", "then", "than", "so", "but", "also", "more",
    "been", "was", "were", "will", "can", "may", "should", "would",
)

STRINGS = T.ArrayType(T.StringType())

#: The resource relation that all operators take. seq is the load order and breaks every tie.
RESOURCE = T.StructType(
    [T.StructField(n, T.LongType() if n == "seq" else T.StringType()) for n in ("seq", "id", "namespace", "type", "state", "title", "short_description", "description", "local_id", "part_of_package", "package_title", "api_protocol", "responsible")]
    + [T.StructField(n, STRINGS) for n in ("entity_types", "line_of_business", "part_of_products", "tags", "industry", "capabilities", "use_cases", "groups", "process_next")]
)

_REF = T.StructType([T.StructField("ordId", T.StringType())])
_GROUP = T.StructType([T.StructField("groupId", T.StringType()), T.StructField("groupTypeId", T.StringType())])
_MAPPING = T.StructType([T.StructField("entityTypeTargets", T.ArrayType(_REF))])
#: One entry of a typed array of a catalogue document. Lists of mixed strings and objects are kept as JSON text.
ENTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("ordId", "localId", "title", "shortDescription", "description", "partOfPackage", "apiProtocol", "responsible", "visibility", "releaseStatus", "level", "type", "category", "relatedEntityTypes", "exposedEntityTypes", "entityTypes")]
    + [T.StructField(n, STRINGS) for n in ("lineOfBusiness", "partOfProducts", "tags", "industry", "capabilities", "useCases", "processNext")]
    + [T.StructField("partOfGroups", T.ArrayType(_GROUP)), T.StructField("entityTypeMappings", T.ArrayType(_MAPPING)), T.StructField("resourceDefinitions", T.ArrayType(T.MapType(T.StringType(), T.StringType())))]
)
PACKAGE = T.StructType([T.StructField("ordId", T.StringType()), T.StructField("title", T.StringType()), T.StructField("shortDescription", T.StringType()), T.StructField("vendor", T.StringType()), T.StructField("lineOfBusiness", STRINGS), T.StructField("tags", STRINGS)])
_TARGETS = T.ArrayType(_REF)
DEPENDENCY = T.StructType([T.StructField("ordId", T.StringType()), T.StructField("title", T.StringType()), T.StructField("aspects", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("apiResources", _TARGETS), T.StructField("eventResources", _TARGETS), T.StructField("dataProducts", _TARGETS)])))])
#: A catalogue document: typed arrays in the order in which they are loaded.
TYPED_ARRAYS = (("apiResources", "apiResource"), ("agents", "agent"), ("dataProducts", "dataProduct"), ("entityTypes", "entityType"), ("eventResources", "event"))
DOCUMENT = T.StructType([T.StructField(n, T.ArrayType(ENTRY)) for n, _ in TYPED_ARRAYS] + [T.StructField("packages", T.ArrayType(PACKAGE)), T.StructField("integrationDependencies", T.ArrayType(DEPENDENCY))])

VERDICT = T.MapType(T.StringType(), T.BooleanType())
LOG_EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("timestamp", "phase", "action", "outcome", "ordId", "target_resource", "tier_target")]
    + [T.StructField("round", T.IntegerType()), T.StructField("achieved_sim", T.DoubleType()), T.StructField("judge_verdict", VERDICT), T.StructField("tokens", T.LongType())]
)
CERT_RUN = T.StructType(
    [T.StructField("nonce", T.StringType()), T.StructField("output", T.StructType([T.StructField("raw_text", T.StringType()), T.StructField("picked_ordId", T.StringType())])), T.StructField("expected_ordIds", STRINGS), T.StructField("solved", T.BooleanType()), T.StructField("tokens", T.LongType()), T.StructField("latency_s", T.DoubleType()), T.StructField("wall_s", T.DoubleType()), T.StructField("cached", T.BooleanType())]
)
PAIR_CSV = "ordId_A string, ordId_B string, structural_sim double, embedding_cos double"

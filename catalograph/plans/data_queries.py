"""Registered queries of the other operators, over stand-in tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import ambiguity as M
from ..operators import blocks as B
from ..operators import certification as C
from ..operators import embedding as V
from ..operators import enrichment as N
from ..operators import graph as G
from ..operators import logs as L
from ..operators import reduction as R
from ..operators import solvability as S
from ..operators import stats as T
from ..operators import threshold as J
from ..operators import validate as Q
from ..operators.rounds import reduce_in_rounds
from ..operators.features import entity_idf
from ..sources import records, sinks
from ..sources.fixtures import ASSETS_SQL, assets, table
from .core_queries import ALL, BASE, TIERED, _block_pairs, _r4, _scored, _with

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


# Embeddings.


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x))))"
CP = f"""
un AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings),
cp AS MATERIALIZED (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label AS la, b.label AS lb, list_dot_product(a.v, b.v) AS cos FROM un a JOIN un b ON a.vec_id < b.vec_id)
"""
COS = _with(CP)


@query(COS + f"SELECT id_a, id_b, {_r4('cos')} AS cos FROM cp WHERE cos >= 0.3")
def cosine_pairs(spark, sf_dir):
    return V.pairs_from(_items(spark, sf_dir), 0.3).select("id_a", "id_b", X.round4(F.col("cos")).alias("cos"))


@query(COS + f"SELECT id_a, id_b, {_r4('cos')} AS cos FROM cp WHERE cos >= 0.3")
def block_cosine(spark, sf_dir):
    return V.block_cosine(_items(spark, sf_dir), 0.3).select("id_a", "id_b", X.round4(F.col("cos")).alias("cos"))


@query(COS + f"SELECT id, {_r4('max(cos)')} AS cos FROM (SELECT id_a AS id, cos FROM cp UNION ALL SELECT id_b, cos FROM cp) GROUP BY 1")
def nearest_neighbour(spark, sf_dir):
    return V.nearest(V.block_cosine(_items(spark, sf_dir))).select("id", X.round4(F.col("cos")).alias("cos"))


@query(COS + f"SELECT scope, count(*) AS n, {_r4('avg(cos)')} AS mean, {_r4('stddev_pop(cos)')} AS sd FROM (SELECT CASE WHEN la = lb THEN 'within' ELSE 'between' END AS scope, cos FROM cp UNION ALL SELECT 'within:' || la, cos FROM cp WHERE la = lb) GROUP BY 1")
def within_between(spark, sf_dir):
    return V.label_cohesion(_items(spark, sf_dir))


@query(
    COS.rstrip()
    + f""", both_ AS (SELECT id_a AS id, la AS own, lb AS other, 1 - cos AS d FROM cp UNION ALL SELECT id_b, lb, la, 1 - cos FROM cp),
ml AS (SELECT id, own, other, avg(d) AS m FROM both_ GROUP BY 1, 2, 3), ab AS (SELECT id, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM ml GROUP BY 1)
SELECT count(*) AS n, {_r4("avg(coalesce((b - a) / greatest(a, b), 0))")} AS silhouette FROM ab"""
)
def silhouette(spark, sf_dir):
    return V.silhouette(_items(spark, sf_dir))


def _two_views(spark, sf_dir) -> DataFrame:
    """Cosines under all dimensions, weighted down by their position (clean), and as they are (enriched)."""
    return V.two_views(_items(spark, sf_dir))


TWO = f"""
wv AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE / i) AS w FROM embeddings),
uw AS MATERIALIZED (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS v FROM wv),
tv AS MATERIALIZED (SELECT cp.id_a, cp.id_b, cp.cos, list_dot_product(a.v, b.v) AS cos_clean FROM cp JOIN uw a ON a.vec_id = id_a JOIN uw b ON b.vec_id = id_b)
"""
VIEWS = _with(CP, TWO)


@query(VIEWS + f"SELECT count(*) AS n, {_r4('corr(cos_clean, cos)')} AS r FROM tv")
def pearson(spark, sf_dir):
    return V.view_correlation(_items(spark, sf_dir))


@query(
    VIEWS.rstrip()
    + f""", q AS (SELECT round(cos_clean, 2) AS x, round(cos, 2) AS y FROM tv), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM q)
SELECT count(*) AS n, round(corr(rx, ry), 3) AS rho FROM k"""
)
def spearman(spark, sf_dir):
    """Over cosines rounded to two digits, so that there are many ties."""
    return T.spearman_of_counts(V.two_view_bins(_items(spark, sf_dir))).withColumn("rho", F.round("rho", 3))


_TIER_OF = "CASE WHEN {c} >= 0.5 THEN 'high' WHEN {c} >= 0.25 THEN 'medium' WHEN {c} >= 0.1 THEN 'low' ELSE 'NONE' END"


@query(VIEWS + f"SELECT {_TIER_OF.format(c=_r4('cos_clean'))} AS tier, count(*) AS n, {_r4('median(cos)')} AS median FROM tv GROUP BY 1")
def tier_median(spark, sf_dir):
    return V.tier_quantiles(_items(spark, sf_dir), (0.5,)).select("tier", "n", X.round4(F.col("q")[0]).alias("median"))


@query(VIEWS + f"SELECT tier, count(*) AS n, {_r4('min(cos)')} AS low, {_r4('quantile_cont(cos, 0.25)')} AS q1, {_r4('quantile_cont(cos, 0.5)')} AS median, {_r4('quantile_cont(cos, 0.75)')} AS q3, {_r4('max(cos)')} AS high FROM (SELECT *, {_TIER_OF.format(c=_r4('cos_clean'))} AS tier FROM tv) GROUP BY 1")
def tier_five_numbers(spark, sf_dir):
    return T.five_of(V.tier_quantiles(_items(spark, sf_dir), T.FIVE), "tier")


@query(COS + f"SELECT count(*) AS n, {_r4('avg(cos)')} AS mean, {_r4('stddev_pop(cos)')} AS sd, {_r4('min(cos)')} AS low, {_r4('max(cos)')} AS high, {_r4('avg(cos) FILTER (cos >= 0.5)')} AS mean_from_50, {_r4('avg(cos) FILTER (cos >= 0.7)')} AS mean_from_70 FROM cp")
def cosine_spread(spark, sf_dir):
    return T.spread(V.block_cosine(_items(spark, sf_dir)), "cos")


def _profile_cases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every tenth vector is a prompt whose correct item is the next vector."""
    items = _items(spark, sf_dir)
    cases = items.filter("id % 10 = 0").select(F.col("id").alias("case_id"), F.col("vector").alias("prompt"), (F.col("id") + 1).alias("correct_id"))
    return cases, items


SC = """
sc0 AS MATERIALIZED (SELECT p.vec_id AS case_id, p.vec_id + 1 AS correct_id, p.v AS pv, list_dot_product(p.v, c.v) AS sim_correct FROM un p JOIN un c ON c.vec_id = p.vec_id + 1 WHERE p.vec_id % 10 = 0),
sc AS MATERIALIZED (SELECT case_id, correct_id, u.vec_id AS id, sim_correct, CASE WHEN sim_correct > 0 THEN least(1.0, list_dot_product(pv, u.v) / sim_correct) ELSE 0.0 END AS score FROM sc0 JOIN un u ON u.vec_id <> correct_id)
"""
PROFILE = _with(CP, SC)


@query(PROFILE + f"SELECT case_id, id, {_r4('score')} AS score FROM sc WHERE {_r4('score')} >= 0.3")
def distractor_scores(spark, sf_dir):
    return V.scores_from(*_profile_cases(spark, sf_dir), least=0.3)


@query(PROFILE.rstrip() + f", b AS (SELECT case_id, id, score, row_number() OVER (PARTITION BY case_id ORDER BY {_r4('score')} DESC, id) AS k FROM sc WHERE {_r4('score')} > 0) SELECT c.case_id, b.id, {_r4('b.score')} AS score FROM sc0 c LEFT JOIN b ON b.case_id = c.case_id AND b.k = 1")
def best_distractor(spark, sf_dir):
    return V.best_of_cases(*_profile_cases(spark, sf_dir))


@query(PROFILE.rstrip() + f", k AS (SELECT *, {_r4('score')} AS s, row_number() OVER (PARTITION BY case_id ORDER BY {_r4('score')} DESC, id) AS k FROM sc) SELECT case_id, count(*) FILTER (s >= 0.3) AS n_above, {_r4('coalesce(avg(s) FILTER (s >= 0.3), 0)')} AS mean_score, coalesce(list(id ORDER BY k) FILTER (s >= 0.3 AND k <= 3), []) AS top, {_r4('any_value(sim_correct)')} AS sim_correct FROM k GROUP BY 1")
def ambiguity_profile(spark, sf_dir):
    return V.case_profiles(*_profile_cases(spark, sf_dir))


@query("SELECT label, round(avg(embedding[1]), 6) AS x, round(avg(embedding[2]), 6) AS y FROM embeddings GROUP BY 1")
def group_centroids(spark, sf_dir):
    p = _items(spark, sf_dir).select("label", F.get("vector", F.lit(0)).cast("double").alias("x"), F.get("vector", F.lit(1)).cast("double").alias("y"))
    return V.group_centroids(p).select("label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def cosine_kmeans(spark, sf_dir):
    return V.cosine_kmeans(_items(spark, sf_dir), 5)


@query()
def principal_axes(spark, sf_dir):
    return V.principal_axes(_items(spark, sf_dir))[0]


# The generation log.

_OUTCOME = {"purchase": "accepted", "error": "rejected_judge", "click": "wrong_tier", "view": "no_profile", "signup": "rejected_c1"}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.create_map(*[F.lit(x) for kv in _OUTCOME.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    verdict = F.create_map(F.lit("c2_coherent"), k % 2 == 0, F.lit("c3_not_duplicate"), k % 3 == 0, F.lit("c4_et_justified"), k % 5 == 0)
    return e.select("event_id", "ts", "user_id", F.lit("iterative").alias("phase"), (1 + F.col("user_id") % 13).cast("int").alias("round"), outcome.alias("outcome"), F.when(F.col("event_type") == "view", "skip").otherwise("create").alias("action"), verdict.alias("judge_verdict"))


LOG = _with("""
lg AS (SELECT *, (1 + user_id % 13)::INT AS round, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected_judge' WHEN 'click' THEN 'wrong_tier' WHEN 'view' THEN 'no_profile' WHEN 'signup' THEN 'rejected_c1' END AS outcome,
  CASE WHEN event_type = 'view' THEN 'skip' ELSE 'create' END AS action, json_extract(props, '$.k')::INT AS k FROM events)
""")


@query(LOG + "SELECT round, count(*) AS generated, count(*) FILTER (outcome = 'accepted') AS accepted FROM lg WHERE action = 'create' GROUP BY 1 UNION ALL SELECT 0, 30, 30")
def generation_rounds(spark, sf_dir):
    return L.generation_rounds(_log(spark, sf_dir), 30)


@query(LOG.rstrip() + ", r AS (SELECT round, count(*) AS generated, count(*) FILTER (outcome = 'accepted') AS accepted FROM lg WHERE action = 'create' GROUP BY 1 UNION ALL SELECT 0, 30, 30) SELECT *, sum(accepted) OVER (ORDER BY round)::BIGINT AS cumulative FROM r")
def cumulative_accepted(spark, sf_dir):
    return L.cumulative(L.generation_rounds(_log(spark, sf_dir), 30))


@query(LOG + "SELECT round, count(*) FILTER (action = 'create') AS created, count(*) FILTER (action = 'skip') AS skipped, round(100.0 * count(*) FILTER (action = 'create') / count(*), 1) AS reach_pct FROM lg GROUP BY 1")
def gap_reach(spark, sf_dir):
    return L.gap_reach(_log(spark, sf_dir))


@query(LOG + "SELECT count(*) FILTER (action = 'create') AS created, count(*) FILTER (outcome IN ('accepted', 'rejected_judge')) AS reached_judge, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected_judge') AS rejected_judge, round(100.0 * count(*) FILTER (outcome = 'accepted') / count(*) FILTER (outcome IN ('accepted', 'rejected_judge')), 1) AS acceptance_rate, count(*) FILTER (outcome = 'rejected_judge' AND k % 2 <> 0) AS incoherent, count(*) FILTER (outcome = 'rejected_judge' AND k % 3 <> 0) AS duplicate, count(*) FILTER (outcome = 'rejected_judge' AND k % 5 <> 0) AS entity_types, count(*) FILTER (outcome = 'wrong_tier') AS wrong_tier, count(*) FILTER (outcome = 'rejected_c1') AS rejected_c1 FROM lg")
def gate_stats(spark, sf_dir):
    return L.gate_stats(_log(spark, sf_dir))


@query(LOG + "SELECT round, outcome, count(*) AS n FROM lg GROUP BY 1, 2")
def outcome_counts(spark, sf_dir):
    return L.outcome_counts(_log(spark, sf_dir), "round")


@query("WITH p AS (SELECT user_id, count(*) AS k FROM events GROUP BY 1) SELECT count(*) AS processes, sum(k)::BIGINT AS attempts, count(*) FILTER (k > 1) AS multi_attempt, max(k) AS most FROM p")
def attempts(spark, sf_dir):
    return L.attempts(_log(spark, sf_dir).withColumnRenamed("user_id", "process_id"))


@query(LOG.rstrip() + ", a AS (SELECT event_id, round, row_number() OVER (PARTITION BY round ORDER BY event_id) AS nth FROM lg WHERE outcome = 'accepted' AND event_id % 3 = 0) SELECT event_id AS id, round, event_id AS position, nth FROM a")
def survivors_by_round(spark, sf_dir):
    """Events divisible by three stand for resources that are still in the catalogue."""
    a = _log(spark, sf_dir).filter("outcome = 'accepted'").select(F.col("event_id").alias("id"), "round", F.col("event_id").alias("position"))
    return L.survivors_by_round(a, a.filter("id % 3 = 0"))


@query("SELECT user_id AS case_id, count(*) AS attempts, max_by(event_type, CASE WHEN event_type <> 'view' THEN event_id END) AS prompt FROM events GROUP BY 1")
def last_prompts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("attempt"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("prompt"))
    return L.last_prompts(e)


# Certification: cases are orders, runs are their line items.


def _runs(spark, sf_dir) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("mode"), ((F.col("l_returnflag") == "A") & (F.col("l_discount") < 0.02)).alias("solved"))


CERT = _with("""
cr AS (SELECT o_orderkey AS case_id, o_orderpriority AS mode, count(*) AS n_runs, count(*) FILTER (l_returnflag = 'A' AND l_discount < 0.02) AS n_solved FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cv AS (SELECT *, n_runs - n_solved AS n_failed, round((n_runs - n_solved) / n_runs + 1e-10, 4) AS difficulty, CASE WHEN n_solved = 0 THEN 'robust' WHEN n_solved <= n_runs // 5 THEN 'borderline' ELSE 'too_easy' END AS verdict FROM cr)
""")
_SUM = "count(*) AS cases, count(*) FILTER (verdict = 'robust') AS robust, count(*) FILTER (verdict = 'borderline') AS borderline, count(*) FILTER (verdict = 'too_easy') AS too_easy, round(100.0 * count(*) FILTER (verdict = 'robust') / count(*), 1) AS robust_pct, round(avg(difficulty) + 1e-10, 4) AS mean_difficulty"


@query(CERT + "SELECT * FROM cv")
def certification_cases(spark, sf_dir):
    return C.certify(_runs(spark, sf_dir), "mode")


@query(CERT + f"SELECT {_SUM} FROM cv")
def certification_summary(spark, sf_dir):
    return C.summary(C.certify(_runs(spark, sf_dir), "mode"))


@query(CERT + f"SELECT mode, {_SUM} FROM cv GROUP BY 1")
def certification_by_mode(spark, sf_dir):
    return C.summary(C.certify(_runs(spark, sf_dir), "mode"), "mode")


@query(CERT + "SELECT verdict, list(case_id ORDER BY case_id) AS case_ids FROM cv GROUP BY 1")
def certification_id_lists(spark, sf_dir):
    return C.ids_by_verdict(C.certify(_runs(spark, sf_dir), "mode"))


@query("WITH c AS (SELECT o_orderkey AS case_id, unnest(range(1, 6)) AS run FROM orders) SELECT c.case_id, c.run::INT AS run FROM c WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c.case_id AND l_linenumber = c.run)")
def missing_runs(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("int").alias("run"))
    return C.missing_runs(cases, done, 5)


@query(
    _with("""
rk AS (SELECT l_orderkey AS case_id, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank FROM lineitem),
ex AS (SELECT l_orderkey AS case_id, min(l_partkey) AS item, any_value(o_orderpriority) AS mode FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
h AS (SELECT ex.case_id, any_value(mode) AS mode, min(rank) AS first, count(rank) FILTER (rank <= 5) AS in5 FROM ex LEFT JOIN rk ON rk.case_id = ex.case_id AND rk.item = ex.item GROUP BY 1)
""")
    + "SELECT mode, count(*) AS cases, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END) + 1e-10, 4) AS p_at_1, round(avg(least(1.0, in5)) + 1e-10, 4) AS r_at_5, round(avg(coalesce(1.0 / first, 0)) + 1e-10, 4) AS mrr FROM h GROUP BY 1"
)
def retrieval_metrics(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_partkey", "l_linenumber"))
    ranked = l.select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("item"), rank.alias("rank"))
    expected = l.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.min("l_partkey").alias("item"))
    expected = expected.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("mode")), "case_id")
    return C.retrieval_metrics(ranked, expected, "mode")


@query(CERT.rstrip() + f", m AS (SELECT mode, {_SUM} FROM cv GROUP BY 1) SELECT mode, robust_pct, mean_difficulty, robust_pct = max(robust_pct) OVER () AS robust_pct_best, mean_difficulty = max(mean_difficulty) OVER () AS mean_difficulty_best FROM m")
def best_modes(spark, sf_dir):
    s = C.summary(C.certify(_runs(spark, sf_dir), "mode"), "mode").select("mode", "robust_pct", "mean_difficulty")
    return C.mark_best(s, "robust_pct", "mean_difficulty")


# Graph, entities, enrichment, solvability, over the asset view.


def _graph(spark, sf_dir):
    a = assets(spark, sf_dir).withColumn("title", F.col("local_id"))
    return G.landscape_graph(a)


GRAPH = _with(
    ASSETS_SQL,
    """
rs AS (SELECT * FROM asset WHERE type <> 'entityType'),
nd AS MATERIALIZED (SELECT DISTINCT 'sys:' || namespace AS id, namespace AS label, 'system' AS kind, namespace FROM rs UNION ALL SELECT 'res:' || id, local_id, type, namespace FROM rs UNION ALL SELECT DISTINCT 'et:' || e, e, 'entityType', NULL FROM (SELECT unnest(entity_types) AS e FROM rs)),
e0 AS (SELECT 'sys:' || namespace AS source, 'res:' || id AS target, 'hosts' AS kind FROM rs UNION ALL SELECT 'res:' || id, 'et:' || unnest(entity_types), 'entities' FROM rs UNION ALL SELECT 'res:' || id, 'res:' || unnest(process_next), 'processNext' FROM rs),
ed AS MATERIALIZED (SELECT * FROM e0 WHERE source IN (SELECT id FROM nd) AND target IN (SELECT id FROM nd)),
dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ed UNION ALL SELECT target FROM ed) GROUP BY 1)
""",
)


@query(GRAPH + "SELECT nd.*, coalesce(degree, 0) AS degree FROM nd LEFT JOIN dg ON dg.id = nd.id")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query(GRAPH + "SELECT * FROM ed")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(GRAPH + "SELECT 'node' AS what, kind, count(*) AS n FROM nd GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM ed GROUP BY 2")
def graph_totals(spark, sf_dir):
    return G.kind_totals(*_graph(spark, sf_dir))


@query(GRAPH + "SELECT id, kind FROM nd WHERE kind IN ('system', 'entityType', 'process') OR id IN (SELECT source FROM ed WHERE kind = 'processNext' UNION SELECT target FROM ed WHERE kind = 'processNext')")
def graph_visible(spark, sf_dir):
    return G.visible(*_graph(spark, sf_dir), ("processNext",))[0].select("id", "kind")


@query(GRAPH + "SELECT DISTINCT CASE WHEN source = 'et:E1' THEN target ELSE source END AS id FROM ed WHERE source = 'et:E1' OR target = 'et:E1'")
def graph_neighbourhood(spark, sf_dir):
    return G.neighbourhood(_graph(spark, sf_dir)[1], "et:E1")


@query(_with(ASSETS_SQL) + "SELECT entity_type, count(*) AS n, count(DISTINCT namespace) AS namespaces FROM (SELECT id, namespace, unnest(entity_types) AS entity_type FROM asset) GROUP BY 1")
def entity_usage(spark, sf_dir):
    return G.entity_usage(assets(spark, sf_dir))


@query(_with(ASSETS_SQL) + "SELECT b.id, list(DISTINCT a.id ORDER BY a.id) AS incoming FROM (SELECT id, unnest(process_next) AS r FROM asset) a JOIN asset b ON b.id = a.r AND a.id <> b.id GROUP BY 1")
def incoming_relations(spark, sf_dir):
    return G.incoming_relations(assets(spark, sf_dir).select("id", F.col("process_next").alias("related")))


@query(_with(ASSETS_SQL) + "SELECT r AS ref, coalesce(b.local_id, r) AS title, b.type AS type, coalesce(b.namespace, r) AS namespace, b.id IS NOT NULL AS known FROM (SELECT unnest(process_next) AS r FROM asset) LEFT JOIN asset b ON b.id = r")
def resolve_targets(spark, sf_dir):
    a = assets(spark, sf_dir).withColumn("title", F.col("local_id"))
    return G.resolve_targets(a.select(F.explode("process_next").alias("ref")), a)


@query(_with(ASSETS_SQL) + "SELECT r AS ref FROM (SELECT unnest(process_next) AS r FROM asset) WHERE r NOT IN (SELECT id FROM asset)")
def dangling_references(spark, sf_dir):
    a = assets(spark, sf_dir)
    return Q.dangling(a.select(F.explode("process_next").alias("ref")), a)


@query(
    _with(ASSETS_SQL).rstrip()
    + ", v AS (SELECT seq, 'capabilities' AS field, unnest(capabilities) AS value FROM asset UNION ALL SELECT seq, 'entityTypes', unnest(entity_types) FROM asset UNION ALL SELECT seq, 'partOfGroups', unnest(groups) FROM asset UNION ALL SELECT seq, 'lineOfBusiness', unnest(line_of_business) FROM asset),"
    + " o AS (SELECT DISTINCT a.seq, a.field, b.seq AS other FROM v a JOIN v b ON a.field = b.field AND a.value = b.value AND a.seq <> b.seq), k AS (SELECT *, row_number() OVER (PARTITION BY seq, field ORDER BY other) AS n FROM o)"
    + " SELECT a.seq, f.field, count(k.other) AS n_sharing, coalesce(list(k.other ORDER BY k.other) FILTER (k.n <= 3), []) AS sharing FROM asset a CROSS JOIN (SELECT unnest(['capabilities', 'entityTypes', 'partOfGroups', 'lineOfBusiness']) AS field) f LEFT JOIN k ON k.seq = a.seq AND k.field = f.field GROUP BY 1, 2"
)
def structural_solvability(spark, sf_dir):
    return S.structural_solvability(assets(spark, sf_dir))


@query(_with(ASSETS_SQL) + "SELECT seq, len(entity_types) > 0 AS method_b, len(entity_types) > 0 OR len(groups) > 0 AS method_c, len(capabilities) > 0 AS method_d, len(capabilities) > 0 OR len(entity_types) > 0 OR len(groups) > 0 AS solvable FROM asset")
def method_paths(spark, sf_dir):
    return S.method_paths(assets(spark, sf_dir))


@query(ALL + "SELECT seq_a, seq_b, list_sort(list_intersect(a.capabilities, b.capabilities)) AS capability_overlap, list_sort(list_intersect(a.line_of_business, b.line_of_business)) AS domain_overlap FROM p JOIN s a ON a.seq = seq_a JOIN s b ON b.seq = seq_b WHERE sim >= 0.5")
def shared_fields(spark, sf_dir):
    s, p = _block_pairs(spark, sf_dir, least=0.5)
    return S.overlaps(p, s)


def _enrichment_rows(spark, sf_dir) -> DataFrame:
    """Customers stand for resources, their orders for processes that enrich them."""
    o = table(spark, sf_dir, "orders")
    one = lambda c: F.array(c)
    return o.select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("process_id"), one(F.concat(F.lit("C"), F.col("o_orderkey") % 4)).alias("capabilities"), one(F.col("o_orderpriority")).alias("use_cases"), one(F.concat(F.lit("G"), F.col("o_orderkey") % 3)).alias("groups"), F.when(F.col("o_orderkey") % 2 == 0, one(F.col("o_orderkey").cast("string"))).alias("process_next"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, list_sort(list(DISTINCT 'C' || (o_orderkey % 4))) AS capabilities, list_sort(list(DISTINCT o_orderpriority)) AS use_cases, list('G' || (o_orderkey % 3) ORDER BY o_orderkey) AS groups, CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) > 0 THEN [CAST(min(o_orderkey) FILTER (o_orderkey % 2 = 0) AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS process_next FROM orders GROUP BY o_custkey")
def merged_enrichment(spark, sf_dir):
    return N.merge_enrichment(_enrichment_rows(spark, sf_dir))


@query(_with(ASSETS_SQL).rstrip() + ", m AS (SELECT CAST(o_custkey AS VARCHAR) AS id, list_sort(list(DISTINCT 'C' || (o_orderkey % 4))) AS c FROM orders GROUP BY o_custkey) SELECT a.seq, coalesce(m.c, a.capabilities) AS capabilities FROM asset a LEFT JOIN m ON m.id = a.id")
def applied_enrichment(spark, sf_dir):
    a = assets(spark, sf_dir).withColumn("use_cases", F.array().cast("array<string>"))
    return N.apply_enrichment(a, N.merge_enrichment(_enrichment_rows(spark, sf_dir))).select("seq", "capabilities")


# Reduction and growth.


@query(ALL.rstrip() + ", hh AS (SELECT seq_a, count(*) AS h FROM m WHERE sim >= 0.5 AND sim < 0.75 GROUP BY 1) SELECT p.seq_a, p.seq_b, p.sim, coalesce(x.h, 0) AS high_a, coalesce(y.h, 0) AS high_b, CASE WHEN coalesce(y.h, 0) >= 3 THEN 'drop_b' WHEN coalesce(x.h, 0) >= 3 THEN 'drop_a' ELSE 'rewrite_b' END AS action FROM p LEFT JOIN hh x ON x.seq_a = p.seq_a LEFT JOIN hh y ON y.seq_a = p.seq_b WHERE p.sim >= 0.75")
def near_duplicate_decisions(spark, sf_dir):
    p = _block_pairs(spark, sf_dir, least=0.5)[1]
    near = p.filter("sim >= 0.75").select("seq_a", "seq_b", "sim")
    return R.high_without(p, near).withColumn("action", R.decide(F.col("high_a"), F.col("high_b")))


@query(
    ALL.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """, np AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sim DESC, seq_a, seq_b) AS i, seq_a, seq_b, sim FROM p WHERE sim >= 0.75),
hi AS MATERIALIZED (SELECT seq_a AS e, seq_b AS o FROM m WHERE sim >= 0.5 AND sim < 0.75),
st(i, gone, dropped) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT
  UNION ALL SELECT i, CASE WHEN d IS NULL THEN gone ELSE list_append(gone, d) END, d FROM (SELECT np.i, st.gone, CASE WHEN list_contains(st.gone, np.seq_a) OR list_contains(st.gone, np.seq_b) THEN NULL
    WHEN (SELECT count(*) FROM hi WHERE hi.e = np.seq_b AND NOT list_contains(st.gone, hi.o)) < 3 AND (SELECT count(*) FROM hi WHERE hi.e = np.seq_a AND NOT list_contains(st.gone, hi.o)) >= 3 THEN np.seq_a ELSE np.seq_b END AS d
    FROM st JOIN np ON np.i = st.i + 1))
SELECT np.seq_a, np.seq_b, np.sim, CASE WHEN st.dropped = np.seq_a THEN 'drop_a' ELSE 'drop_b' END AS action FROM st JOIN np USING (i) WHERE st.dropped IS NOT NULL"""
)
def near_duplicate_reduction(spark, sf_dir):
    """All pairs decided in their order, many a round, on the scores of the whole catalogue; what would be rewritten goes."""
    return reduce_in_rounds(B.block_pairs(_scored(spark, sf_dir), least=R.HIGH))[0].drop("round")


@query(TIERED + "SELECT seq, CASE WHEN high_needed > 0 THEN 'high' ELSE 'medium' END AS tier, CASE WHEN high_needed > 0 THEN high_needed ELSE medium_needed END AS missing FROM tcs WHERE high_needed > 0 OR medium_needed > 0")
def gap_list(spark, sf_dir):
    return R.gaps(M.settled_tiers(_scored(spark, sf_dir), ("high", "medium")))


@query(_with(ASSETS_SQL).rstrip() + ", c AS (SELECT count(*) FILTER (type = 'apiResource') AS a, count(*) FILTER (type = 'agent') AS g, count(*) FILTER (type = 'dataProduct') AS d FROM asset), t AS (SELECT 'apiResource' AS type, 0.5 - a / (a + g + d) AS deficit, 0 AS o FROM c UNION ALL SELECT 'agent', 0.25 - g / (a + g + d), 1 FROM c UNION ALL SELECT 'dataProduct', 0.25 - d / (a + g + d), 2 FROM c) SELECT type, round(deficit, 6) AS deficit FROM t ORDER BY deficit DESC, o LIMIT 1")
def next_type(spark, sf_dir):
    return R.next_type(assets(spark, sf_dir))


@query(_with(ASSETS_SQL) + "SELECT namespace, n FROM (SELECT namespace, count(*) AS n, ceil(sum(count(*)) OVER () / count(*) OVER ()) AS cap FROM asset GROUP BY 1) WHERE n < cap")
def namespaces_below_cap(spark, sf_dir):
    a = assets(spark, sf_dir)
    return R.namespaces_below_cap(a, a.count())


@query(ALL.rstrip() + ", k AS (SELECT 'k' || (seq % 9) AS skill, seq FROM s WHERE seq % 3 = 0) SELECT k.skill, m.seq_b AS seq, max(m.sim) AS sim FROM m JOIN k ON k.seq = m.seq_a WHERE m.sim >= 0.1 AND NOT EXISTS (SELECT 1 FROM k x WHERE x.skill = k.skill AND x.seq = m.seq_b) GROUP BY 1, 2")
def similarity_to_skills(spark, sf_dir):
    s, p = _block_pairs(spark, sf_dir, least=0.1)
    skills = s.filter("seq % 3 = 0").groupBy(F.concat(F.lit("k"), (F.col("seq") % 9).cast("string")).alias("skill")).agg(F.collect_list("seq").alias("ids"))
    return R.max_to_skill(p.filter("sim >= 0.1"), skills)


@query(
    TIERED.rstrip()
    + f""", mt AS (SELECT s.* FROM s JOIN tcs USING (seq) WHERE tcs.medium_needed > 0),
f0 AS (SELECT seq, {_r4("(x.idf / (x.idf + y.idf) + 1) / 6")} AS one FROM mt JOIN ei x ON x.entity_type = list_sort(entity_types)[1] JOIN ei y ON y.entity_type = list_sort(entity_types)[2])
SELECT seq, CASE WHEN namespace <> 'sys0' THEN 0 WHEN one >= 0.25 THEN 7 ELSE 8 END AS strategy_no, CASE WHEN namespace <> 'sys0' THEN 0.25 WHEN one >= 0.25 THEN one ELSE 0.3333 END AS sim FROM mt JOIN f0 USING (seq)"""
)
def fitting_profiles(spark, sf_dir):
    """For the resources with missing MEDIUM neighbours: the first attribute profile in the tier, by the text-free metric."""
    s = _scored(spark, sf_dir)
    missing = M.settled_tiers(s, ("medium",)).filter("medium_needed > 0").select("seq")
    target = s.join(missing, "seq", "left_semi").withColumns({"new_type": F.col("type"), "new_namespace": F.lit("sys0")})
    scored = R.profile_scores(R.candidate_profiles(target, "medium"), target, entity_idf(s))
    return R.first_fitting(scored, "medium")


# Validators.

_RULES = {
    "apiResource": {"required": ["local_id", "industry"], "semantic_fields": ["capabilities"]},
    "agent": {"required": ["industry"], "semantic_fields": ["groups"]},
    "ordId_patterns": {"apiResource": "[0-9]{1,3}$", "agent": "[1-9]"},
    "enum_values": {"level": ["L1"]},
}


@query(
    _with(ASSETS_SQL)
    + """SELECT id, type, len(e) = 0 AS passed, e AS errors, w AS warnings FROM (SELECT id, type,
  list_filter([CASE WHEN type = 'apiResource' AND coalesce(local_id, '') = '' THEN 'MISSING required field ''local_id''' END, CASE WHEN type IN ('apiResource', 'agent') AND len(industry) = 0 THEN 'MISSING required field ''industry''' END,
    CASE WHEN type = 'apiResource' AND NOT regexp_matches(id, '^(?:[0-9]{1,3}$)') THEN 'INVALID ordId format ''' || id || ''' for type ''apiResource''' END, CASE WHEN type = 'agent' AND NOT regexp_matches(id, '^(?:[1-9])') THEN 'INVALID ordId format ''' || id || ''' for type ''agent''' END], lambda x: x IS NOT NULL) AS e,
  list_filter([CASE WHEN type = 'apiResource' AND len(capabilities) = 0 THEN 'EMPTY semantic field ''capabilities'' (used in ambiguity scoring)' END, CASE WHEN type = 'agent' AND len(groups) = 0 THEN 'EMPTY semantic field ''groups'' (used in ambiguity scoring)' END], lambda x: x IS NOT NULL) AS w FROM asset)"""
)
def validate_resources(spark, sf_dir):
    return Q.validate_resources(assets(spark, sf_dir), _RULES)


@query(
    _with(ASSETS_SQL)
    + "SELECT type, count(*) AS n, count(*) FILTER (len(industry) > 0 AND (type <> 'apiResource' OR length(id) <= 3) AND (type <> 'agent' OR id[1] <> '0')  OR type NOT IN ('apiResource', 'agent')) AS passed, sum(CASE WHEN type IN ('apiResource', 'agent') AND len(industry) = 0 THEN 1 ELSE 0 END + CASE WHEN type = 'apiResource' AND length(id) > 3 THEN 1 ELSE 0 END + CASE WHEN type = 'agent' AND id[1] = '0' THEN 1 ELSE 0 END)::BIGINT AS errors, sum(CASE WHEN type = 'apiResource' AND len(capabilities) = 0 THEN 1 WHEN type = 'agent' AND len(groups) = 0 THEN 1 ELSE 0 END)::BIGINT AS warnings FROM asset GROUP BY 1"
)
def validation_totals(spark, sf_dir):
    return Q.validation_totals(Q.validate_resources(assets(spark, sf_dir), _RULES))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS id, 'Duplicate ordId: ' || c_nationkey AS error FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k > 1 UNION ALL SELECT CAST(c_nationkey AS VARCHAR), c_nationkey || ': references unknown entity type ''' || (c_custkey % 40) || '''' FROM customer WHERE c_custkey % 40 NOT IN (SELECT c_nationkey FROM customer)")
def validate_taxonomy(spark, sf_dir):
    """Nations of customers stand for ids, c_custkey mod 40 for references."""
    c = table(spark, sf_dir, "customer")
    return Q.validate_taxonomy(c.select(F.col("c_nationkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.array((F.col("c_custkey") % 40).cast("string")).alias("related")))


PROC = """
st AS (SELECT l_orderkey AS process_id, list(CAST(l_partkey % 300 AS VARCHAR) ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem GROUP BY 1),
fx AS (SELECT process_id, steps, (SELECT count(*) FROM unnest(steps) u(x) WHERE x NOT IN (SELECT id FROM asset)) AS unknown, len(list_distinct(steps)) AS d, len(list_filter(steps, lambda x: x::INT % 2 = 0)) AS g, (SELECT count(DISTINCT namespace) FROM asset WHERE list_contains(steps, id)) AS nss, (SELECT list(DISTINCT type) FROM asset WHERE list_contains(steps, id)) AS types FROM st),
fl AS (SELECT process_id, unknown = 0 AS v1, len(steps) = d AS v2, g = 2 AND len(steps) - g = 2 AS v3, nss >= 3 AS v4, coalesce(list_contains(types, 'agent') AND list_contains(types, 'apiResource'), false) AS v5, len(steps) = 4 AS v6 FROM fx)
"""


@query(
    _with(ASSETS_SQL, PROC)
    + """SELECT process_id, v1::VARCHAR AS "V1", CASE WHEN v1 THEN v2::VARCHAR ELSE 'skipped' END AS "V2", CASE WHEN v1 AND v2 THEN v3::VARCHAR ELSE 'skipped' END AS "V3", CASE WHEN v1 AND v2 AND v3 THEN v4::VARCHAR ELSE 'skipped' END AS "V4", CASE WHEN v1 AND v2 AND v3 AND v4 THEN v5::VARCHAR ELSE 'skipped' END AS "V5", CASE WHEN v1 AND v2 AND v3 AND v4 AND v5 THEN v6::VARCHAR ELSE 'skipped' END AS "V6",
v1 AND v2 AND v3 AND v4 AND v5 AND v6 AS passed, CASE WHEN NOT v1 THEN 'V1' WHEN NOT v2 THEN 'V2' WHEN NOT v3 THEN 'V3' WHEN NOT v4 THEN 'V4' WHEN NOT v5 THEN 'V5' WHEN NOT v6 THEN 'V6' END AS first_failed FROM fl"""
)
def validate_processes(spark, sf_dir):
    """Orders stand for processes, parts mod 300 for the ids of their steps; even ids are ground truth; 2 of 4 steps are asked for."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("process_id"), (F.col("l_partkey") % 300).cast("string").alias("id"), "l_linenumber", "l_partkey")
    p = steps.groupBy("process_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "id"))), lambda x: x["id"]).alias("steps"))
    p = p.withColumns({"gt": F.filter("steps", lambda x: x.cast("int") % 2 == 0), "non_gt": F.filter("steps", lambda x: x.cast("int") % 2 != 0)})
    return Q.validate_process(p, assets(spark, sf_dir), 2, 4)


WORDS = r"""
wd AS (SELECT doc_id AS seq, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS words FROM documents),
rq AS (SELECT item_id AS request_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM benchmark UNION ALL SELECT 100000 + seq, words FROM wd),
rw AS (SELECT request_id, len(words) AS k, unnest(words) AS w FROM rq), dw AS (SELECT seq, len(words) AS m, unnest(words) AS w FROM wd),
met AS (SELECT request_id, seq, count(*) AS i FROM rw JOIN dw USING (w) WHERE m >= 0.85 * k AND k >= 0.85 * m GROUP BY request_id, seq, k, m HAVING count(*) / (k + m - count(*)) > 0.85)
"""


@query(_with(WORDS) + "SELECT request_id, offender FROM rq LEFT JOIN (SELECT request_id, min(seq) AS offender FROM met GROUP BY 1) USING (request_id)")
def absent_requests(spark, sf_dir):
    """Benchmark items and all documents against all documents, by whole texts."""
    plain = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    whole = plain(F.coalesce("text", F.lit("")))
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = b.select(F.col("item_id").alias("request_id"), F.lit(None).cast("long").alias("seq"), plain(F.col("text")).alias("words"))
    # Every document is a request and a resource.
    return Q.absent_everywhere(items.unionByName(d.select((100000 + F.col("doc_id")).alias("request_id"), F.col("doc_id").alias("seq"), whole.alias("words"))))


# Texts, references and records.


@query("SELECT doc_id, regexp_replace(source || ':' || lang || '.' || doc_id, '[:.]', '-', 'g') AS slug, regexp_replace(source || ' ' || lang || '/' || doc_id, '[^a-zA-Z0-9_-]', '-', 'g') AS case_slug, substr(text, 1, 80) AS head, round(CASE WHEN doc_id % 10 < 2 THEN doc_id % 10 / 20 ELSE doc_id % 10 / 10 END, 2) AS score, CASE WHEN doc_id % 10 IN (0, 1) THEN 'easy' WHEN doc_id % 10 IN (2, 3) THEN 'medium' WHEN doc_id % 10 IN (4, 5) THEN 'hard' ELSE 'very_hard' END AS band FROM documents")
def scalar_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id") % 10
    score = F.round(F.when(i < 2, i / 20).otherwise(i / 10), 2)
    return d.select("doc_id", X.ord_slug(F.concat("source", F.lit(":"), "lang", F.lit("."), F.col("doc_id").cast("string"))).alias("slug"), X.case_slug(F.concat("source", F.lit(" "), "lang", F.lit("/"), F.col("doc_id").cast("string"))).alias("case_slug"), X.first_chars(F.col("text"), 80).alias("head"), score.alias("score"), X.difficulty_band(score).alias("band"))


@query(_with(ASSETS_SQL) + "SELECT seq, local_id || ' | ' || text || CASE WHEN len(groups) > 0 THEN ' | Groups: ' || array_to_string(groups, ', ') ELSE '' END || CASE WHEN len(process_next) > 0 THEN ' | Next: ' || array_to_string(process_next, ', ') ELSE '' END || CASE WHEN len(capabilities) > 0 THEN ' | Capabilities: ' || array_to_string(capabilities, ', ') ELSE '' END || CASE WHEN use_case_text <> '' THEN ' | Use cases: ' || use_case_text ELSE '' END AS enriched_text, local_id || ' ' || text AS plain_text FROM asset WHERE text <> ''")
def resource_texts(spark, sf_dir):
    a = assets(spark, sf_dir).filter("text <> ''")
    uses = F.filter(F.array("use_case_text"), lambda x: x != "")
    rich = X.enriched_text(F.col("local_id"), F.lit(""), F.col("text"), F.col("groups"), F.col("process_next"), F.col("capabilities"), uses)
    return a.select("seq", rich.alias("enriched_text"), X.resource_text(F.col("local_id"), F.lit(None).cast("string"), F.col("text")).alias("plain_text"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages""")
def markup_attributes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"))


@query("SELECT format('{}_s{:02d}', conv_id, turn + 1) AS case_id, CAST(conv_id AS VARCHAR) AS process_id, (turn + 1)::INT AS step_index, role AS step_id, role || ' — ' || text AS input, role AS \"expected_ordId\", role = 'user' AS is_gt FROM conversations")
def design_cases(spark, sf_dir):
    """Conversations stand for processes, turns for steps."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("process_id"), (F.col("turn") + 1).cast("int").alias("step_index"), F.col("role").alias("step_id"), F.col("role").alias("label"), F.col("text").alias("description"), F.col("role").alias("id"))
    gt = c.select("process_id", F.array(F.lit("user")).alias("gt_ids")).distinct()
    return records.design_cases(c, gt)


@query("SELECT role, count(*) AS cases, count(*) FILTER (turn = 0) AS first_turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def case_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("turn") == 0).alias("first_turns"), F.count_distinct("conv_id").alias("conversations"))


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 <> 2 UNION ALL SELECT -1, 'new', 0, 0.0, 'X'")
def snapshot_changes(spark, sf_dir):
    """Upsert of every third customer and a new one, then delete: each gives a new snapshot."""
    c = table(spark, sf_dir, "customer")
    rows = c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    rows = rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit("X").alias("c_mktsegment")))
    return sinks.delete(sinks.upsert(c, rows, "c_custkey"), c.filter("c_custkey % 7 = 2"), "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'kept' WHEN o_orderkey % 2 = 0 THEN 'new' END AS block FROM orders")
def idempotent_annotation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "kept").alias("block"))
    blocks = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("block"))
    return sinks.annotate_missing(sinks.annotate_missing(o, blocks, "o_orderkey", "block"), blocks, "o_orderkey", "block")


@query(ALL + "SELECT CAST(seq_a AS VARCHAR) AS id_a, CAST(seq_b AS VARCHAR) AS id_b, round(sim, 3) AS full_sim FROM p WHERE sim >= 0.75")
def near_duplicate_list(spark, sf_dir):
    p = J.threshold_pairs(_scored(spark, sf_dir), 0.75)
    return sinks.near_duplicate_list(p.select(F.col("seq_a").cast("string").alias("id_a"), F.col("seq_b").cast("string").alias("id_b"), "sim"))


@query(BASE + "SELECT a.seq AS seq_a, b.seq AS seq_b, round(len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))), 6) AS tag_jaccard, len(list_filter(b.tags, lambda x: NOT list_contains(a.tags, x))) = 0 AS covers FROM s a JOIN s b ON b.seq = a.seq + 10")
def array_functions(spark, sf_dir):
    s = _scored(spark, sf_dir).select("seq", "tags")
    b = s.select(F.col("seq").alias("seq_b"), F.col("tags").alias("tags_b"))
    return s.join(b, F.col("seq_b") == F.col("seq") + 10).select(F.col("seq").alias("seq_a"), "seq_b", F.round(A.jaccard(F.col("tags"), F.col("tags_b")), 6).alias("tag_jaccard"), A.covers(F.col("tags"), F.col("tags_b")).alias("covers"))

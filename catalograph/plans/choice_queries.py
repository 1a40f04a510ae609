"""Registered queries of text functions, seeded choices, candidate profiles and page tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.compat import cache_key, python_round
from ..operators import ambiguity as M
from ..operators import casegen as G
from ..operators import embedding as V
from ..operators import pairs as P
from ..operators import reduction as R
from ..schema import DOMAIN_CLUSTERS
from ..sources.fixtures import ASSETS_SQL, assets, table
from .core_queries import ALL, BASE, DENSE, ETIDF, REPORT, SCORED, TFIDF, TIERED, TIERS, _block_pairs, _J, _r4, _report, _scored, _with
from .data_queries import VIEWS, _items

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


# Functions over free text.


@query("SELECT s_suppkey, sha256('{\"model\": \"m\", \"text\": \"' || s_name || '\"}') AS key, CASE WHEN s_suppkey % 2 = 0 THEN [s_suppkey / 2.0] END AS vector FROM supplier")
def embedding_cache(spark, sf_dir):
    """The vectors of every second text are cached; the others miss."""
    texts = table(spark, sf_dir, "supplier").select("s_suppkey", cache_key(F.lit("m"), F.col("s_name")).alias("key"))
    cache = texts.filter("s_suppkey % 2 = 0").select("key", F.array(F.col("s_suppkey") / 2.0).alias("vector"))
    return V.cached_vectors(texts, cache).select("s_suppkey", "key", "vector")


_ANSWER = "CASE p_partkey % 3 WHEN 0 THEN 'I pick {\"why\": \"x\", \"ordId\": \" a:b:P' || p_partkey || ':v1 \"} because' WHEN 1 THEN 'none' ELSE 'so {\"ordId\":\"q' || p_partkey || '\"}' END"


@query(f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a:b:P' || p_partkey || ':v1' WHEN 2 THEN 'q' || p_partkey END AS picked, 'You are ' || p_name AS prompt, p_partkey % 97 AS ordinal,
CASE WHEN p_size % 5 = 0 THEN '' ELSE 'text=' || printf('%.3f', (p_size % 5) / 7.0) END || CASE WHEN p_size % 5 > 0 AND p_size % 3 > 0 THEN ' ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'tags=' || printf('%.3f', (p_size % 3) / 9.0) END AS breakdown,
CAST(printf('%.4f', p_size / 32.0) AS DOUBLE) AS rounded, substr(p_name || ' ' || p_brand, 1, 12) AS head, CASE WHEN p_partkey % 4 = 0 THEN 'P3' WHEN p_partkey % 4 = 1 THEN 'P1' WHEN p_partkey % 4 = 2 THEN 'P2' ELSE 'P1' END AS label FROM part""")
def answer_functions(spark, sf_dir):
    """Picked ids, prompt constants, ordinals of nonces, breakdowns, half-even rounding, heads, distractor labels."""
    p, i, n = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    answer = F.when(i % 3 == 0, F.concat(F.lit('I pick {"why": "x", "ordId": " a:b:P'), i, F.lit(':v1 "} because'))).when(i % 3 == 1, "none").otherwise(F.concat(F.lit('so {"ordId":"q'), i, F.lit('"}')))
    source = F.concat(F.lit('import x\nSYSTEM = """You are '), "p_name", F.lit('"""\nOTHER = """no"""\n'))
    types = lambda *x: F.array(*map(F.lit, x))
    other = F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, "else").otherwise("own")
    return p.select(
        "p_partkey",
        X.picked_id(answer).alias("picked"),
        X.prompt_constant(source, "SYSTEM").alias("prompt"),
        X.run_ordinal(F.concat(F.lit("case_x_"), i % 97)).cast("long").alias("ordinal"),
        X.format_breakdown({"text": (n % 5) / 7.0, "tags": (n % 3) / 9.0}).alias("breakdown"),
        python_round(n / 32.0).alias("rounded"),
        X.first_chars(F.concat_ws(" ", "p_name", "p_brand"), 12).alias("head"),
        X.distractor_label(F.lit("own"), types("e", "f"), other, F.when(i % 4 == 2, types("f")).otherwise(types("g"))).alias("label"),
    )


@query("SELECT n_nationkey, ['a:' || n_nationkey, 'b:1'] AS ids, ['{\"x\":' || n_nationkey || '}', '\"text\"'] AS entries FROM nation")
def generator_answers(spark, sf_dir):
    """The last JSON block of an answer; ids that are not allowed or have no colon go."""
    k = F.col("n_nationkey")
    answer = F.concat(F.lit('<process/>\n```json\n{"old:1": {}}\n```\nand\n```json\n{"a:'), k, F.lit('": {"x":'), k, F.lit('}, "b:1": "text", "c:9": {}, "plain": 1}\n```\n'))
    found = X.generator_enrichment(answer, F.array(F.concat(F.lit("a:"), k), F.lit("b:1"), F.lit("plain")))
    ids = F.array_sort(F.map_keys("found"))
    value = F.transform(ids, lambda x: F.try_element_at("found", x))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", found.alias("found"))
    return rows.select("n_nationkey", ids.alias("ids"), F.transform(value, lambda v: F.when(F.startswith(v, F.lit("{")), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))).alias("entries"))


_SYSTEMS = sorted({s for _, systems in DOMAIN_CLUSTERS for s in systems}) + ["other.one", "other.two"]
_CLUSTERS = ", ".join(f"({i}, '{c}', '{s}')" for i, (c, systems) in enumerate(DOMAIN_CLUSTERS) for s in systems)
CLUSTERS = f"""WITH dc(o, cluster, system) AS (VALUES {_CLUSTERS}), names(i, namespace) AS (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(_SYSTEMS))}),
ns AS (SELECT DISTINCT namespace FROM nation JOIN names ON i = n_nationkey % {len(_SYSTEMS)}),
own AS (SELECT namespace, (SELECT min_by(cluster, o) FROM dc WHERE system = namespace) AS cluster FROM ns),
mine AS (SELECT a.namespace, any_value(a.cluster) AS cluster, list(b.namespace ORDER BY b.namespace) AS others, coalesce(list(b.namespace ORDER BY b.namespace) FILTER (EXISTS (SELECT 1 FROM dc WHERE dc.cluster = a.cluster AND dc.system = b.namespace)), []) AS near,
  coalesce(list(b.namespace ORDER BY b.namespace) FILTER (NOT EXISTS (SELECT 1 FROM dc WHERE dc.cluster = a.cluster AND dc.system = b.namespace)), []) AS far FROM own a JOIN ns b ON b.namespace <> a.namespace GROUP BY 1)
"""


@query(CLUSTERS + "SELECT namespace, cluster, CASE WHEN len(near) > 0 THEN near ELSE others END AS related, CASE WHEN len(far) > 0 THEN far ELSE others END AS different FROM mine")
def domain_clusters(spark, sf_dir):
    """Nations stand for systems of the domain map and two outside it."""
    name = F.element_at(F.array(*map(F.lit, _SYSTEMS)), (F.col("n_nationkey") % len(_SYSTEMS) + 1).cast("int"))
    ns = table(spark, sf_dir, "nation").select(name.alias("namespace")).distinct()
    related, different = R.related_systems(ns), R.related_systems(ns, inside=False)
    return R.cluster_of(ns).join(related.select("namespace", F.array_sort("others").alias("related")), "namespace").join(different.select("namespace", F.array_sort("others").alias("different")), "namespace")


@query("SELECT r_regionkey, true AS is_iso FROM region")
def iso_clock(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", X.now_iso().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}(Z|[+-]\d\d:\d\d)$").alias("is_iso"))


# Seeded choices: md5 of seed and id gives the order.


@query(BASE + "SELECT seq, namespace FROM (SELECT seq, namespace, row_number() OVER (PARTITION BY namespace ORDER BY md5('11:' || seq), seq) AS n FROM s) WHERE n = 1 ORDER BY md5('11:' || seq), seq LIMIT 5")
def distinct_namespace_sample(spark, sf_dir):
    return R.from_distinct_namespaces(_scored(spark, sf_dir), 5, 11).select("seq", "namespace")


@query(
    _with(ASSETS_SQL).rstrip()
    + """, dr AS (SELECT d AS draw, seq, namespace, type, type IN ('apiResource', 'agent', 'dataProduct') AS gt FROM asset, range(50) t(d)),
rk AS (SELECT *, row_number() OVER (PARTITION BY draw, gt ORDER BY md5('7:' || draw || ':' || seq), seq) AS n FROM dr),
st AS (SELECT draw, list(seq ORDER BY seq) AS ids, count(DISTINCT namespace) AS k, bool_or(type = 'agent') AS a, bool_or(type = 'apiResource') AS b, count(*) AS m FROM rk WHERE n <= 4 GROUP BY 1)
SELECT draw::INT AS draw, ids FROM st WHERE k >= 3 AND a AND b AND m = 8 ORDER BY draw LIMIT 1"""
)
def seeded_model_draw(spark, sf_dir):
    return R.draw_model(assets(spark, sf_dir), 7)


@query("SELECT vec_id AS seq FROM embeddings ORDER BY md5('4:' || vec_id), vec_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return R.sample(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq")), 100, 4)


@query(TIERED + "SELECT seq FROM (SELECT * FROM tcs ORDER BY high DESC, seq LIMIT 30) ORDER BY md5('3:' || seq), seq LIMIT 10")
def gap_resources(spark, sf_dir):
    """Ten of the thirty resources with most HIGH neighbours."""
    return R.sample(M.counted_tiers(_scored(spark, sf_dir)), 10, 3, by=F.col("high")).select("seq")


@query(ALL.rstrip() + ", fd AS (SELECT seq_a, seq_b, sim, row_number() OVER (PARTITION BY seq_a ORDER BY md5('5:' || seq_a || ':' || seq_b), seq_b) AS n FROM m WHERE sim >= 0.5 AND sim <= 0.75 AND seq_b % 3 <> 0) SELECT seq_a, seq_b, sim FROM fd WHERE n = 1")
def first_distractors(spark, sf_dir):
    """Resources divisible by three are in the skill."""
    s, p = _block_pairs(spark, sf_dir, least=0.5)
    return R.first_distractor(p, s.filter("seq % 3 = 0").select("seq"), 5)


@query(ALL.rstrip() + ", nn AS (SELECT seq_a, seq_b, sim, row_number() OVER (PARTITION BY seq_a ORDER BY sim DESC, seq_b) AS n FROM m WHERE sim >= 0.1) SELECT seq_a, seq_b, sim FROM nn WHERE n = 2")
def second_candidates(spark, sf_dir):
    """The candidate of the second attempt for each target."""
    p = P.mirror(_block_pairs(spark, sf_dir, least=0.1)[1].select("seq_a", "seq_b", "sim")).filter("sim >= 0.1")
    return R.nth_candidate(p, 2, "seq_a", "seq_b")


@query(BASE + "SELECT a.seq, b.seq AS target_seq, b.entity_types, b.line_of_business, list_sort(list_distinct(list_concat(a.tags, b.tags))) AS tags FROM s a JOIN s b ON b.seq = a.seq + 7")
def aligned_candidates(spark, sf_dir):
    """Each resource as if aligned to the one seven places on."""
    s = _scored(spark, sf_dir).select("seq", "entity_types", "line_of_business", "tags")
    a = R.aligned(s.withColumn("target_seq", F.col("seq") + 7), s)
    return a.select("seq", "target_seq", "entity_types", "line_of_business", F.array_sort("tags").alias("tags"))


@query(
    BASE
    + """SELECT seq, 'high' AS tier, i::INT AS strategy_no, 'agent' AS type, 'sysX' AS namespace, list_sort(entity_types) AS entity_types, line_of_business, CASE i WHEN 0 THEN tags ELSE CAST([] AS VARCHAR[]) END AS tags FROM s, range(2) t(i)
UNION ALL SELECT seq, 'low', i::INT, 'apiResource', 'sysX', [list_sort(entity_types)[i + 1]], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM s, range(3) t(i) WHERE i < len(entity_types)"""
)
def candidate_profiles(spark, sf_dir):
    """What to try for HIGH and LOW neighbours, as agents of another system."""
    target = _scored(spark, sf_dir).withColumns({"new_type": F.lit("agent"), "new_namespace": F.lit("sysX")})
    tries = [R.candidate_profiles(target, tier).withColumn("tier", F.lit(tier)) for tier in ("high", "low")]
    return tries[0].unionByName(tries[1]).select("seq", "tier", "strategy_no", "type", "namespace", "entity_types", "line_of_business", "tags")


# Cases: gates by arithmetic stand for the solver and the judge.

_TRIES = """
t AS (SELECT s_suppkey AS k, a, CASE WHEN (s_suppkey + a) % 5 = 0 THEN 'VALIDATOR_FAIL' WHEN (s_suppkey + a) % 3 = 0 THEN 'TOO_EASY' WHEN (s_suppkey * a) % 4 = 1 THEN 'JUDGE_FAIL' ELSE 'ACCEPTED' END AS outcome FROM supplier, range(1, 4) r(a)),
f AS (SELECT k, min(a) FILTER (outcome = 'ACCEPTED') AS won, max(a) FILTER (outcome <> 'VALIDATOR_FAIL') AS last FROM t GROUP BY 1),
o AS (SELECT f.*, CASE WHEN won IS NOT NULL THEN 'accepted' WHEN last IS NOT NULL AND k % 2 = 0 THEN 'distractor_certified' ELSE 'gave_up' END AS outcome, md5('9:' || 'n:agent:R' || k || ':v1') AS h FROM f)
"""


def _cases(spark, sf_dir):
    i = F.col("s_suppkey")
    rid = F.concat(F.lit("n:agent:R"), i, F.lit(":v1"))
    s = table(spark, sf_dir, "supplier")
    eligible = s.select(rid.alias("id"), F.array(F.lit("E")).alias("entity_types"))
    near = s.filter(i % 2 == 0).select(rid.alias("id"), F.concat(F.lit("m:agent:D"), i, F.lit(":v1")).alias("distractor"), F.array(F.lit("E")).alias("distractor_types"))
    k = F.regexp_extract("seed", "R([0-9]+)", 1).cast("long")
    write = lambda rows, attempt: rows.withColumns({"prompt": F.concat(F.lit("ask "), k, F.lit(f" in way {attempt}")), "a": F.lit(attempt)})
    check = lambda rows: rows.withColumn("failure", F.when((k + F.col("a")) % 5 == 0, "V2: prompt too short"))
    solve = lambda rows: rows.withColumn("predicted", F.when((k + F.col("a")) % 3 == 0, F.col("seed")).otherwise("other"))
    judge = lambda rows: rows.withColumn("judged", (k * F.col("a")) % 4 != 1)
    return G.generate_cases(G.single_seeds(eligible, near, 9), "dy", write, check, judge, solve, attempts=3, target=20, fallback=True)


@query("WITH " + _TRIES.strip() + ", n AS (SELECT *, row_number() OVER (ORDER BY h, k) AS n FROM o WHERE outcome <> 'gave_up') SELECT 'dy-' || lpad(n::VARCHAR, 2, '0') AS case_id, 'n:agent:R' || k || ':v1' AS seed, 'ask ' || k || ' in way ' || coalesce(won, last) AS prompt, outcome = 'accepted' AS measured FROM n WHERE n <= 20")
def generated_cases(spark, sf_dir):
    """Suppliers are seeds, every second one has a distractor; three attempts each, the first twenty in seeded order."""
    return _cases(spark, sf_dir)[0]


@query("WITH " + _TRIES.strip() + " SELECT 'n:agent:R' || o.k || ':v1' AS seed, any_value(o.outcome) AS outcome, list(t.outcome ORDER BY a) AS steps FROM o JOIN t ON t.k = o.k AND t.a <= coalesce(won, 3) GROUP BY 1")
def case_provenance(spark, sf_dir):
    return _cases(spark, sf_dir)[1].select("seed", "outcome", F.transform("evolution_log", lambda e: e["outcome"]).alias("steps"))


@query("WITH r AS (SELECT s_suppkey AS id, s_nationkey AS ns, md5('6:' || s_suppkey) AS h FROM supplier), n AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY h, id::VARCHAR) AS nth FROM r), p AS (SELECT *, (row_number() OVER (PARTITION BY nth ORDER BY h, id::VARCHAR) - 1) // 2 AS two FROM n) SELECT list(id::VARCHAR ORDER BY h, id::VARCHAR) AS expected FROM p GROUP BY nth, two HAVING count(*) = 2")
def multi_intent_seeds(spark, sf_dir):
    """Suppliers of different nations, two by two."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").alias("namespace"))
    return G.multi_seeds(e, 6).select("expected")


_NEAR = "nb AS (SELECT p_size % 10 AS skill, p_partkey AS id, max(p_size / 50.0) AS sim FROM part GROUP BY 1, 2)"


@query(f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY sim DESC, id::VARCHAR) AS k FROM nb WHERE sim >= 0.25 AND id % 2 = 0), g AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY md5('2:k' || skill || ':' || id), id::VARCHAR) AS n FROM r WHERE k <= 6) SELECT 'k' || skill AS seed, list(id::VARCHAR ORDER BY n) AS expected FROM g WHERE n <= 2 GROUP BY 1")
def gap_case_seeds(spark, sf_dir):
    """Sizes mod 10 are skills, even parts are eligible."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_size") % 10).alias("skill"), F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") / 50.0).alias("sim"), (F.col("p_partkey") % 2 == 0).alias("even"))
    skills = p.select(F.col("skill").alias("skill_id")).distinct()
    return G.gap_seeds(skills, p, p.filter("even"), 2).select("seed", "expected")


# Pages.

PAGE = _with(ASSETS_SQL, SCORED, TFIDF, ETIDF, DENSE, REPORT, TIERS)


@query(PAGE + "SELECT count(*) AS total, count(*) FILTER (done) AS eligible, count(*) FILTER (high >= 3) AS with_high, count(*) FILTER (difficulty_band IN ('hard', 'very_hard')) AS hard_or_more, count(*) FILTER (rp.coverage_gap) AS coverage_gaps, max(ambiguity_score) AS max_score FROM rp JOIN tcs USING (seq) WHERE can_be_ground_truth")
def page_counters(spark, sf_dir):
    return M.page_counters(_report(spark, sf_dir)[1], M.counted_tiers(_scored(spark, sf_dir)))


@query(PAGE + "SELECT rp.seq, rp.type, ambiguity_score FROM rp JOIN tcs USING (seq) WHERE done AND rp.type IN ('agent', 'dataProduct')")
def shown_rows(spark, sf_dir):
    report = _report(spark, sf_dir)[1].join(M.counted_tiers(_scored(spark, sf_dir)).select("seq", F.col("done").alias("eligible")), "seq")
    return M.shown_rows(report, True, ("agent", "dataProduct")).select("seq", "type", "ambiguity_score")


@query(ALL + "SELECT seq_a, seq_b, sim, CASE WHEN sim >= 0.5 THEN 'high' ELSE 'medium' END AS tier, row_number() OVER (PARTITION BY seq_a ORDER BY sim DESC, seq_b) AS position FROM m WHERE sim >= 0.25")
def neighbour_table(spark, sf_dir):
    """The HIGH and MEDIUM neighbours of every resource, by similarity."""
    p = P.mirror(_block_pairs(spark, sf_dir, least=0.25)[1].select("seq_a", "seq_b", "sim"))
    return M.neighbour_table(p, ("high", "medium")).select("seq_a", "seq_b", "sim", "tier", F.col("position").cast("long").alias("position"))


@query(VIEWS + f"SELECT id_a, id_b, {_r4('cos_clean')} AS cos_clean, {_r4('cos')} AS cos FROM tv WHERE {_r4('cos')} >= 0.3")
def two_views(spark, sf_dir):
    # A margin below the bound, which holds for rounded cosines.
    v = V.two_views(_items(spark, sf_dir), 0.3 - 1e-4).select("id_a", "id_b", X.round4(F.col("cos_clean")).alias("cos_clean"), X.round4(F.col("cos")).alias("cos"))
    return v.filter("cos >= 0.3")


def _round_sql(r: int) -> str:
    """The text-free ambiguity of the resources with seq mod 3 <= r, by brute force."""
    return f"""(WITH q AS (SELECT * FROM s WHERE seq % 3 <= {r}),
i AS (SELECT entity_type, 1 / ln(1 + count(*)) AS idf FROM (SELECT unnest(list_distinct(entity_types)) AS entity_type FROM q) GROUP BY 1),
u AS (SELECT seq, unnest(entity_types) AS e FROM q), t AS (SELECT seq, sum(idf) AS ew FROM u JOIN i ON entity_type = e GROUP BY 1),
d AS (SELECT a.seq AS sa, b.seq AS sb, sum(idf) AS d FROM u a JOIN u b ON a.e = b.e AND a.seq <> b.seq JOIN i ON i.entity_type = a.e GROUP BY 1, 2),
x AS (SELECT a.seq AS seq_a, b.seq AS seq_b, {_r4(f'''({_J("local_tokens")} + coalesce(d.d / (ta.ew + tb.ew - d.d), 0) + {_J("line_of_business")} + {_J("tags")} + {_J("industry")} + CASE WHEN a.namespace <> b.namespace THEN 0.5 ELSE 0 END) / 6 * CASE WHEN a.type = b.type THEN 1 ELSE 0.5 END''')} AS sim
  FROM q a JOIN q b ON a.seq <> b.seq LEFT JOIN d ON sa = a.seq AND sb = b.seq LEFT JOIN t ta ON ta.seq = a.seq LEFT JOIN t tb ON tb.seq = b.seq)
SELECT {r} AS round, {_r4('avg(m)')} AS mean_ambiguity, count(*) AS n FROM (SELECT seq_a, avg(sim) AS m FROM (SELECT *, row_number() OVER (PARTITION BY seq_a ORDER BY sim DESC, seq_b) AS k FROM x) WHERE k <= 5 GROUP BY 1))"""


@query(BASE + " UNION ALL ".join(f"SELECT * FROM {_round_sql(r)}" for r in range(3)))
def convergence_curve(spark, sf_dir):
    """seq mod 3 stands for the round of a resource."""
    return R.convergence(_scored(spark, sf_dir).withColumn("round", (F.col("seq") % 3).cast("int")), [0, 1, 2])

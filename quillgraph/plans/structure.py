"""Queries over the graph: census, traversal, folds, resolution, predicates, integrity, quality, ledger, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import udfs
from quillgraph.functions import vocabulary as V
from quillgraph.operators import detect, graph, integrity, ledger, predicates, quality, resolve, retrieve
from quillgraph.operators.components import connected_components
from quillgraph.plans.registry import ORACLE, query
from quillgraph.sources.tables import CLAIMS_SQL, EDGES_SQL, NODES_SQL, claims, edges, nodes, table

KEY = "regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
NEAR = "near AS (SELECT DISTINCT * FROM (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges) WHERE id <> other)"
DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"
WORDS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"


@query(f"WITH {NODES_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of nodes of each type."""
    return nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_type_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of edges of each type, no edge twice."""
    return edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {NODES_SQL}, f AS (SELECT type, content = '' AS structural FROM nodes) SELECT coalesce(type, '*') AS type, coalesce(CAST(structural AS VARCHAR), '*') AS structural, count(*) AS n, grouping(type, structural) AS level FROM f GROUP BY GROUPING SETS ((type, structural), (type), (structural), ())")
def graph_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type and flag with all totals."""
    rows = graph.census(nodes(spark, sf_dir).withColumn("structural", F.col("content") == ""))
    return rows.select(F.coalesce("type", F.lit("*")).alias("type"), F.coalesce(F.col("structural").cast("string"), F.lit("*")).alias("structural"), "n", "level")


@query(f"WITH {EDGES_SQL}, {DEG} SELECT id, degree FROM deg")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in and out of each node that has any; a loop counts twice."""
    return retrieve.degrees(edges(spark, sf_dir))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, {DEG}, top AS (SELECT id FROM nodes LEFT JOIN deg USING (id) ORDER BY coalesce(degree, 0) DESC, id LIMIT 200)
SELECT src, type, dst FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)""")
def top_degree_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the 200 nodes of the highest degree (the view's own limit)."""
    return graph.top_subgraph(nodes(spark, sf_dir), edges(spark, sf_dir), 200)[1].select("src", "type", "dst")


@query(f"""WITH RECURSIVE {EDGES_SQL}, {NEAR}, walk AS (SELECT 'region:' || r_regionkey AS seed, 'region:' || r_regionkey AS id, 0 AS hop FROM region UNION SELECT seed, other, hop + 1 FROM walk JOIN near USING (id) WHERE hop < 2)
SELECT seed, id, min(hop) AS hop FROM walk GROUP BY ALL""")
def khop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within two steps of each region."""
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("seed"))
    return graph.k_hop(seeds, edges(spark, sf_dir), 2)


@query(f"""WITH RECURSIVE {EDGES_SQL}, {NEAR}, walk AS (SELECT 'nation:' || n_nationkey AS seed, 'nation:' || n_nationkey AS id, 0 AS hop FROM nation UNION SELECT seed, other, hop + 1 FROM walk JOIN near USING (id) WHERE hop < 2),
best AS (SELECT seed, id, min(hop) AS hop FROM walk GROUP BY ALL) SELECT seed, id, hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, id) AS n FROM best) WHERE n <= 50""")
def capped_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest 50 nodes of each nation (the endpoint's own limit)."""
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("seed"))
    return graph.capped_neighbourhood(seeds, edges(spark, sf_dir), 2, 50)


@query(f"""WITH {EDGES_SQL}, {DEG}, {NEAR}, f AS (SELECT c_nationkey AS query_id, 'customer:' || c_custkey AS id, 1.0 / (60 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) AS score FROM customer),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM f) WHERE r <= 10),
l AS (SELECT query_id, other AS id, score * 0.5 / degree AS score FROM t JOIN near USING (id) JOIN deg ON deg.id = other)
SELECT query_id, id, round(sum(score), 9) AS score FROM (SELECT query_id, id, score FROM f UNION ALL SELECT * FROM l) GROUP BY ALL""")
def one_hop_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten customers of each nation lend to their neighbours."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    fused = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), (1 / (60 + rank)).alias("score"))
    return retrieve.one_hop(fused, edges(spark, sf_dir)).select("query_id", "id", F.round("score", 9).alias("score"))


EGO_SQL = f"""
seeds AS (SELECT 'customer:' || c_custkey AS seed FROM customer), terms AS (SELECT seed, unnest(['placed', 'building']) AS term FROM seeds),
live AS (SELECT * FROM claims WHERE id >= '1' AND id < 'f'),
ends AS (SELECT DISTINCT * FROM (SELECT c.*, s AS seed FROM live c UNION ALL SELECT c.*, o_id FROM live c WHERE o_id IS NOT NULL)),
bpool AS (SELECT e.*, count(*) OVER (PARTITION BY seed) AS n FROM ends e JOIN seeds USING (seed)),
cov AS (SELECT p.seed, p.id, n, term, count(*) OVER (PARTITION BY p.seed, term) AS df FROM bpool p JOIN terms t ON t.seed = p.seed AND list_contains({WORDS.format(x="concat_ws(' ', trim(lower(replace(p, '_', ' '))), coalesce(o_literal, ''))")}, term)),
sc AS (SELECT seed, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))), 9) AS coverage FROM cov GROUP BY ALL),
bridge AS (SELECT * FROM (SELECT p.seed, p.id, s, p, o_id, o_literal, coalesce(coverage, 0) AS coverage, confidence, row_number() OVER (PARTITION BY p.seed ORDER BY coalesce(coverage, 0) DESC, confidence DESC, p.id) AS rank FROM bpool p LEFT JOIN sc USING (seed, id)) WHERE rank <= 8)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of which some, by their ids, are superseded (those that start with 0) or of low salience (with f)."""
    return claims(spark, sf_dir).withColumn("superseded", F.col("id") < "1").withColumn("salience", F.when(F.col("id") >= "f", "low"))


def _customer_seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("seed"))
    return seeds, seeds.select("seed", F.explode(F.array(F.lit("placed"), F.lit("building"))).alias("term"))


@query(f"WITH {CLAIMS_SQL}, {EGO_SQL} SELECT seed, id, round(coverage, 6) AS coverage, confidence, rank FROM bridge")
def ego_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight claims about each customer that answer best."""
    seeds, terms = _customer_seeds(spark, sf_dir)
    return graph.bridge_claims(_gated(spark, sf_dir), seeds, terms, 8).select("seed", "id", F.round("coverage", 6).alias("coverage"), "confidence", F.col("rank").cast("long").alias("rank"))


@query()
def ego_graph_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's ego graph over two hops, four claims an entity: level by level, so brute force stands for SQL."""
    seeds, terms = _customer_seeds(spark, sf_dir)
    return graph.ego_graph(_gated(spark, sf_dir), seeds, terms, 4, 2).select("seed", "hop", "id", "s", "p", "o_id", "o_literal")


@query(f"""WITH {CLAIMS_SQL}, {EGO_SQL}, c AS (SELECT *, CAST(floor(length('- ' || s || ' ' || trim(lower(replace(p, '_', ' '))) || ' ' || coalesce(o_id, o_literal)) / 4 * 1.117) AS INT) AS cost FROM bridge)
SELECT seed, id, spent FROM (SELECT seed, id, sum(cost) OVER (PARTITION BY seed ORDER BY coverage DESC, confidence DESC, id ROWS UNBOUNDED PRECEDING) AS spent FROM c) WHERE spent <= 60""")
def token_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of each ego graph that fit a budget of 60 tokens."""
    seeds, terms = _customer_seeds(spark, sf_dir)
    rows = graph.bridge_claims(_gated(spark, sf_dir), seeds, terms, 8)
    line = F.concat(F.lit("- "), F.col("s"), F.lit(" "), C.verbalized(F.col("p")), F.lit(" "), F.coalesce("o_id", "o_literal"))
    kept = graph.within_budget(rows.withColumn("cost", C.estimated_tokens(line)), "seed", [F.col("coverage").desc(), F.col("confidence").desc(), "id"], F.col("cost"), 60)
    return kept.select("seed", "id", "spent")


@query(f"""WITH {CLAIMS_SQL}, {EGO_SQL} SELECT seed, string_agg('- ' || s || ' ' || trim(lower(replace(p, '_', ' '))) || ' ' || coalesce(o_id, o_literal) || '. [' || id[1:8] || ']', chr(10) ORDER BY coverage DESC, confidence DESC, id) AS text FROM bridge GROUP BY seed""")
def render_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ego graph as text."""
    seeds, terms = _customer_seeds(spark, sf_dir)
    return graph.rendered(graph.bridge_claims(_gated(spark, sf_dir), seeds, terms, 8), "seed")


# Every tenth customer is the canonical of its nine followers.
EQUIV_SQL = "equiv AS (SELECT 'customer:' || c_custkey AS member_id, 'customer:' || (c_custkey // 10 * 10) AS canonical_id FROM customer WHERE c_custkey % 10 <> 0)"


def _equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("customer:"), c.cast("long").cast("string"))
    return table(spark, sf_dir, "customer").where(key % 10 != 0).select(name(key).alias("member_id"), name(F.floor(key / 10) * 10).alias("canonical_id"))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, {EQUIV_SQL}, live AS (SELECT * FROM equiv WHERE canonical_id IN (SELECT id FROM nodes))
SELECT DISTINCT coalesce(a.canonical_id, src) AS src, type, coalesce(b.canonical_id, dst) AS dst FROM edges LEFT JOIN live a ON a.member_id = src LEFT JOIN live b ON b.member_id = dst WHERE coalesce(a.canonical_id, src) <> coalesce(b.canonical_id, dst)""")
def fold_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's view with customers folded by tens."""
    return graph.fold_graph(edges(spark, sf_dir), _equivalence(spark, sf_dir), nodes(spark, sf_dir))


@query(f"""WITH {NODES_SQL}, {EQUIV_SQL}, live AS (SELECT * FROM equiv WHERE canonical_id IN (SELECT id FROM nodes))
SELECT coalesce(canonical_id, id) AS id, count(*) - 1 AS variant_count FROM nodes LEFT JOIN live ON member_id = id GROUP BY 1""")
def fold_node_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without the variants whose canonical is among them, and how many each stands for."""
    return graph.fold_nodes(nodes(spark, sf_dir), _equivalence(spark, sf_dir))


ALIAS_SQL = "aliases AS (SELECT * FROM (VALUES ('Brand', 'brand'), ('label', 'brand'), ('has status', 'status')) t(predicate, canonical))"
_ALIASES = [("Brand", "brand"), ("label", "brand"), ("has status", "status")]


@query(f"""WITH {CLAIMS_SQL}, {EQUIV_SQL}, {ALIAS_SQL}, m AS (SELECT coalesce(a.canonical_id, s) AS s, coalesce(canonical, p) AS p, coalesce(b.canonical_id, o_id) AS o_id, o_literal, confidence
  FROM claims LEFT JOIN equiv a ON a.member_id = s LEFT JOIN equiv b ON b.member_id = o_id LEFT JOIN aliases ON predicate = p)
SELECT sha256('claim' || chr(31) || s || chr(31) || p || chr(31) || coalesce(o_id, o_literal)) AS id, s, p, o_id, o_literal, count(*) AS corroboration, max(confidence) AS confidence FROM m WHERE o_id IS NULL OR s <> o_id GROUP BY ALL""")
def canonical_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims on canonical subjects, objects and predicates, keyed anew."""
    aliases = spark.createDataFrame(_ALIASES, "predicate string, canonical string")
    return graph.canonical_copy(claims(spark, sf_dir), _equivalence(spark, sf_dir), aliases)


@query(f"WITH {CLAIMS_SQL}, {ALIAS_SQL} SELECT id, coalesce(canonical, p) AS p FROM claims LEFT JOIN aliases ON predicate = p")
def fold_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim under its canonical predicate."""
    aliases = spark.createDataFrame(_ALIASES, "predicate string, canonical string")
    return retrieve.fold_predicates(claims(spark, sf_dir).select("id", "p"), aliases)


@query(f"WITH {NODES_SQL} SELECT id, type, title FROM (SELECT *, row_number() OVER (ORDER BY type, id) AS n FROM nodes WHERE contains(lower(title), 'a')) WHERE n > 20 AND n <= 70")
def node_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a filtered list (a page is the feature)."""
    return nodes(spark, sf_dir).where(F.lower("title").contains("a")).orderBy("type", "id").offset(20).limit(50).select("id", "type", "title")


# Integrity: a damaged copy of the graph. Edges of supplier 1 point nowhere, ids of one type are wrong.
BAD_SQL = "bad AS (SELECT CASE WHEN type = 'in_region' THEN sha256(id) ELSE id END AS id, type, src, CASE WHEN dst = 'supplier:1' THEN 'supplier:none' ELSE dst END AS dst FROM edges)"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select(F.when(F.col("type") == "in_region", F.sha2("id", 256)).otherwise(F.col("id")).alias("id"), "type", "src", F.when(F.col("dst") == "supplier:1", "supplier:none").otherwise(F.col("dst")).alias("dst"))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, {BAD_SQL}, e AS (SELECT id, 'src' AS side, src AS node FROM bad UNION ALL SELECT id, 'dst', dst FROM bad)
SELECT 'missing_edge_endpoint' AS code, id AS artifact_id, side AS reference, node AS expected, 'missing' AS observed FROM e WHERE node NOT IN (SELECT id FROM nodes)""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a damaged graph that lack an end."""
    return integrity.missing_endpoints(_damaged(spark, sf_dir), nodes(spark, sf_dir))


@query(f"""WITH {EDGES_SQL}, {BAD_SQL}, h AS (SELECT *, sha256('edge' || chr(31) || src || chr(31) || type || chr(31) || dst) AS identity FROM bad)
SELECT 'content_addressed_id_mismatch' AS code, id AS artifact_id, 'id' AS reference, identity AS expected, id AS observed FROM h WHERE id <> identity""")
def edge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a damaged graph whose id isn't the digest of what they say."""
    return integrity.wrong_edge_ids(_damaged(spark, sf_dir)).where("code = 'content_addressed_id_mismatch'")


@query(f"""WITH {NODES_SQL}, {CLAIMS_SQL}, r AS (SELECT id, unnest(['O_id', 'S_id', 'block_id']) AS name, unnest([o_id, s, block_id]) AS ref FROM claims)
SELECT reference, count(*) AS n FROM (SELECT name AS reference FROM r WHERE ref IS NOT NULL AND ref <> '' AND ref NOT IN (SELECT id FROM nodes)) GROUP BY reference""")
def facet_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of claims that resolve to no node, by facet."""
    lost = integrity.missing_references(claims(spark, sf_dir), nodes(spark, sf_dir), {"O_id": "o_id", "S_id": "s", "block_id": "block_id"})
    return lost.groupBy("reference").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES_SQL}, {BAD_SQL}, j AS (SELECT e.id AS i, b.id AS k, e.src AS s1, b.src AS s2, e.dst AS d1, b.dst AS d2 FROM edges e FULL JOIN bad b ON e.id = b.id)
SELECT code, count(*) AS n FROM (SELECT 'missing_adjacency_observation' AS code FROM j WHERE k IS NULL UNION ALL SELECT 'unlisted_physical_edge' FROM j WHERE i IS NULL UNION ALL SELECT 'adjacency_property_mismatch' FROM j WHERE s1 <> s2 UNION ALL SELECT 'adjacency_property_mismatch' FROM j WHERE d1 <> d2) GROUP BY code""")
def adjacency_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues between the edges and a damaged view of them, counted by code."""
    return integrity.audit(integrity.adjacency_issues(edges(spark, sf_dir), _damaged(spark, sf_dir)))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, {BAD_SQL}, k AS (SELECT 'missing_edge_endpoint' AS code FROM (SELECT src AS n FROM bad UNION ALL SELECT dst FROM bad) WHERE n NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'content_addressed_id_mismatch' FROM bad WHERE id <> sha256('edge' || chr(31) || src || chr(31) || type || chr(31) || dst) UNION ALL SELECT 'closed_type_set' FROM nodes WHERE type NOT IN ('Agent', 'Activity', 'Place'))
SELECT code, count(*) AS n FROM k GROUP BY code""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of the damaged graph by code."""
    n, e = nodes(spark, sf_dir), _damaged(spark, sf_dir)
    return integrity.audit(integrity.missing_endpoints(e, n), integrity.wrong_edge_ids(e), integrity.duplicate_ids(n, "duplicate_node_id"), integrity.unwritable_types(n, ("Agent", "Activity", "Place")))


# Resolution over part names and people's names.
@query(f"""WITH {NODES_SQL}, c AS (SELECT 'cand:' || id AS id, type, upper(title) || ' ' AS title FROM nodes WHERE type = 'Agent')
SELECT c.id AS candidate_id, min(n.id) AS node_id FROM c JOIN nodes n ON n.type = c.type AND trim(lower(n.title)) = trim(lower(c.title)) GROUP BY 1""")
def tier0_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates spelled in capitals against the stored agents."""
    stored = nodes(spark, sf_dir)
    candidates = stored.where("type = 'Agent'").select(F.concat(F.lit("cand:"), F.col("id")).alias("id"), "type", F.concat(F.upper("title"), F.lit(" ")).alias("title"))
    return resolve.exact_matches(candidates, stored)


@query(f"WITH {NODES_SQL} SELECT type, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS key, count(*) AS n, min(id) AS first FROM nodes GROUP BY ALL")
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type and surface key, with the first of each group."""
    return resolve.exact_groups(nodes(spark, sf_dir))


# Titles of two to four words out of documents: short names against longer ones.
TITLES_SQL = """titles AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'Concept' AS type, array_to_string(string_split(split_part(coalesce(text, ''), chr(10), 1), ' ')[1:2 + doc_id % 3], ' ') AS title FROM documents
), tt AS (SELECT min(id) AS id, title FROM titles GROUP BY type, title)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split(F.substring_index(C.text_or_empty(F.col("text")), "\n", 1), " ")
    title = F.array_join(F.slice(first, F.lit(1), F.lit(2) + (F.col("doc_id") % 3).cast("int")), " ")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("Concept").alias("type"), title.alias("title"))


_GENERIC = ", ".join(f"'{w}'" for w in V.GENERIC_TOKENS)


@query(f"""WITH {TITLES_SQL}, w AS (SELECT id, title, {WORDS.format(x="title")} AS t, list_distinct({WORDS.format(x="title")}) AS s, regexp_replace(split_part(trim(lower(title)), '@', 1), '[._]+', ' ', 'g') AS h, regexp_matches(split_part(trim(lower(title)), '@', 1), '^[a-z0-9]+([._][a-z0-9]+)+$') AS hm FROM tt),
k AS (SELECT id, t, s, CASE WHEN len(t) >= 2 AND regexp_matches(t[-1], '[a-z]') THEN t[-1] END AS surname, CASE WHEN hm THEN h ELSE array_to_string(t, ' ') END AS handle, list_filter(s, lambda x: len(x) >= 4 AND x NOT IN ({_GENERIC})) AS dis FROM w),
pr AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.surname = b.surname THEN 1
  WHEN a.t[1] = b.t[1] AND len(a.s) <> len(b.s) AND len(list_intersect(a.s, b.s)) = least(len(a.s), len(b.s)) THEN 2
  WHEN len(a.s) <> len(b.s) AND len(list_intersect(a.s, b.s)) = least(len(a.s), len(b.s)) AND len(list_intersect(a.dis, b.dis)) > 0 THEN 3
  WHEN a.handle = b.handle AND a.handle <> '' THEN 4 END AS lane FROM k a JOIN k b ON a.id < b.id)
SELECT a, b, ['surname', 'subset', 'subset_unordered', 'handle'][lane] AS lane FROM pr WHERE lane IS NOT NULL""")
def lane_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles that a token lane proposes."""
    return resolve.lane_pairs(_titles(spark, sf_dir))


@query()
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles with a high Jaro-Winkler; a Python similarity, so a test against all pairs stands for SQL."""
    return resolve.fuzzy_pairs(_titles(spark, sf_dir))


@query(f"""WITH lp AS ({ORACLE["lane_pairs"]}), {TITLES_SQL}, l AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM lp UNION ALL SELECT b FROM lp) GROUP BY id),
h AS (SELECT type, title, min(id) AS representative, count(*) AS n_members FROM titles GROUP BY type, title)
SELECT titles.id, representative, n_members, coalesce(l.n, 0) AS n_links FROM titles JOIN h USING (type, title) LEFT JOIN l ON l.id = representative""")
def lane_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stands for its title in ``lane_pairs``, and that one's number of pairs."""
    return resolve.lane_members(_titles(spark, sf_dir))


@query()
def fuzzy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stands for its key in ``fuzzy_pairs``, and that one's number of pairs; a test stands for SQL."""
    return resolve.fuzzy_members(_titles(spark, sf_dir))


@query("SELECT a.n_name AS a, b.n_name AS b, round(jaro_similarity(a.n_name, b.n_name), 6) AS score FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def jaro_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaro of all pairs of the 25 nations' names."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    left, right = n.toDF("i", "a"), n.toDF("j", "b")
    return F.broadcast(left).join(right, F.col("i") < F.col("j")).select("a", "b", F.round(udfs.jaro_similarity("a", "b"), 6).alias("score"))


@query(f"WITH {CLAIMS_SQL}, c AS (SELECT replace(s, 'orders:', 'o') AS s, p, coalesce(o_id, o_literal) AS o, b FROM (SELECT *, block_id AS b FROM claims)) SELECT b AS s, {KEY.format(x='p')} AS p, count(DISTINCT o) AS n_objects, count(*) AS n_claims FROM c GROUP BY ALL HAVING count(DISTINCT o) > 1")
def find_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose claims say different things under one predicate."""
    return resolve.contradictions(claims(spark, sf_dir).withColumn("s", F.col("block_id")))


@query(f"""WITH {EDGES_SQL}, {NEAR}, pr AS (SELECT 'supplier:' || a.s_suppkey AS a, 'supplier:' || b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
sh AS (SELECT a, b, count(*) AS n FROM pr JOIN near x ON x.id = a JOIN near y ON y.id = b AND y.other = x.other GROUP BY ALL), sz AS (SELECT id, count(*) AS n FROM near GROUP BY id)
SELECT pr.a, pr.b, CASE WHEN coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(sh.n, 0) > 0 THEN round(coalesce(sh.n, 0) / (coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(sh.n, 0)), 6) ELSE 0 END AS jaccard
FROM pr LEFT JOIN sh USING (a, b) LEFT JOIN sz u ON u.id = pr.a LEFT JOIN sz v ON v.id = pr.b""")
def relational_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared neighbours of suppliers of neighbouring numbers."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    name = lambda c: F.concat(F.lit("supplier:"), F.col(c).cast("string"))
    pairs = s.toDF("x").join(s.toDF("y"), F.col("y") == F.col("x") + 1).select(name("x").alias("a"), name("y").alias("b"))
    return resolve.relational_jaccard(pairs, retrieve.neighbours(edges(spark, sf_dir)))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, {DEG}, m AS (SELECT 'customer:' || (c_custkey // 10 * 10) AS cluster_id, 'customer:' || c_custkey AS id FROM customer)
SELECT cluster_id, id AS canonical_id FROM (SELECT cluster_id, m.id, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(degree, 0) DESC, length(title) DESC, m.id) AS n FROM m JOIN nodes ON nodes.id = m.id LEFT JOIN deg ON deg.id = m.id) WHERE n = 1""")
def select_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical of each ten customers."""
    name = lambda c: F.concat(F.lit("customer:"), c.cast("long").cast("string"))
    members = table(spark, sf_dir, "customer").select(name(F.floor(F.col("c_custkey") / 10) * 10).alias("cluster_id"), name(F.col("c_custkey")).alias("id"))
    return resolve.canonical_of(members, nodes(spark, sf_dir), edges(spark, sf_dir))


@query("""WITH RECURSIVE pr AS (SELECT c_custkey AS a, c_custkey + 7 AS b FROM customer WHERE c_custkey % 5 <> 0), both_ AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
walk AS (SELECT DISTINCT a AS id, a AS root FROM both_ UNION SELECT b, root FROM walk JOIN both_ ON a = id) SELECT id, min(root) AS component FROM walk GROUP BY id""")
def equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that pairs of customers close to."""
    return connected_components(table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b")))


@query()
def capped_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs of customers packed to clusters of at most eight; greedy, so a brute-force test stands for SQL."""
    name = lambda c: F.concat(F.lit("customer:"), c.cast("string"))
    k = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(name(k).alias("a"), name(k + 3).alias("b"), F.round(F.pmod(k * 37, F.lit(100)) / 100, 6).alias("score")).where("score >= 0.3")
    return resolve.clusters(pairs)


# Predicates.
@query(f"WITH {EDGES_SQL}, {CLAIMS_SQL} SELECT predicate, count(*) AS n FROM (SELECT type AS predicate FROM edges UNION ALL SELECT p FROM claims) GROUP BY 1")
def predicate_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each type of edge and predicate of a claim occurs."""
    return predicates.vocabulary(edges(spark, sf_dir), claims(spark, sf_dir))


ARGS_SQL = """args AS (SELECT l_returnflag || l_linestatus AS p, CAST(l_partkey AS VARCHAR) AS s, CAST(l_suppkey AS VARCHAR) AS o, count(*) AS n FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {ARGS_SQL}, x AS (SELECT a.p AS a, b.p AS b, sum(least(a.n, b.n)) AS n FROM args a JOIN args b ON a.s = b.s AND a.o = b.o AND a.p < b.p GROUP BY ALL),
y AS (SELECT a.p AS a, b.p AS b, sum(least(a.n, b.n)) AS n FROM args a JOIN args b ON a.s = b.o AND a.o = b.s AND a.p < b.p GROUP BY ALL)
SELECT a, b, CAST(coalesce(x.n, 0) AS BIGINT) AS same_order, CAST(coalesce(y.n, 0) AS BIGINT) AS swapped FROM x FULL JOIN y USING (a, b)""")
def shared_argument_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line states as predicates between parts and suppliers: what arguments they share."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("p"), F.col("l_partkey").cast("string").alias("s"), F.col("l_suppkey").cast("string").alias("o_id"), F.lit(None).cast("string").alias("o_literal"))
    return predicates.shared_arguments(predicates.argument_pairs(lines))


@query(f"WITH {NODES_SQL}, {CLAIMS_SQL} SELECT p, coalesce(a.type, 'unknown') AS subject_type, CASE WHEN o_id IS NULL THEN 'literal' ELSE coalesce(b.type, 'unknown') END AS object_type, count(*) AS n FROM claims LEFT JOIN nodes a ON a.id = s LEFT JOIN nodes b ON b.id = o_id GROUP BY ALL")
def predicate_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of subject and object of each predicate, counted; an end that isn't a node is unknown."""
    return predicates.signatures(claims(spark, sf_dir), nodes(spark, sf_dir))


_CASES = "CASE doc_id % 12 WHEN 0 THEN 'Uses Tool' WHEN 1 THEN 'unknown' WHEN 2 THEN 'the' WHEN 3 THEN 'écrit' WHEN 4 THEN 'describes' WHEN 5 THEN 'has   phase' WHEN 6 THEN 'a_b_c_d_e_f_g' WHEN 7 THEN 'lives-in' WHEN 8 THEN 'says that it may be seen there' WHEN 9 THEN 'writes' WHEN 10 THEN 'N/A' ELSE 'Has Value' END"
_LABEL = "CASE WHEN regexp_matches(raw, '[^\\x00-\\x7F]') THEN '' ELSE regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END"


@query(f"""WITH r AS (SELECT doc_id, {_CASES} AS raw, doc_id % 2 = 0 AS lit FROM documents), l AS (SELECT *, {_LABEL} AS label FROM r),
m AS (SELECT *, CASE label WHEN 'uses_tool' THEN 'uses' WHEN 'has_phase' THEN 'includes' WHEN 'writes' THEN 'author_of' ELSE label END AS target FROM l)
SELECT doc_id, CASE WHEN lower(raw) IN ('', 'n/a', 'na', 'none', 'null', 'undefined', 'unknown') THEN 'reject_placeholder' WHEN label = '' THEN 'reject_malformed'
  WHEN label IN ('the') OR len(string_split(raw, ' ')) > 6 THEN 'reject_structural_noise'
  WHEN target IN ('uses', 'includes', 'describes', 'has_value', 'author_of') THEN CASE WHEN lit THEN 'literal' WHEN target <> label THEN 'exact_mapping' ELSE 'canonical' END
  WHEN target = 'lives_in' THEN CASE WHEN lit THEN 'literal' ELSE 'provisional' END
  WHEN len(string_split(target, '_')) > 6 THEN 'queue_verbose_label' ELSE 'queue_unregistered' END AS reason FROM m""")
def predicate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve spellings of predicates, by the documents' numbers, through admission."""
    raw = F.expr(_CASES)
    registered = dict.fromkeys(V.CORE_PREDICATES, "canonical") | {"lives_in": "provisional"}
    verdict = predicates.admission(F.col("raw"), F.col("lit"), registered, {"writes": "author_of"})
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), (F.col("doc_id") % 2 == 0).alias("lit")).select("doc_id", verdict["reason"].alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'reject_placeholder' WHEN l_quantity > 49 THEN 'reject_structural_noise' WHEN l_discount >= 0.1 THEN 'reject_unsupported_inference'
  WHEN l_tax = 0 THEN 'reject_dead_endpoint' WHEN l_linenumber > 6 THEN 'reject_redundant' WHEN l_quantity < 2 THEN 'queue_type_conflict' WHEN l_returnflag = 'N' THEN 'queue_predicate' WHEN l_linestatus = 'O' THEN 'queue_grounding' ELSE 'commit' END AS reason FROM lineitem""")
def relation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line through the ordered gate."""
    c = F.col
    status = F.when((c("l_returnflag") == "R") & (c("l_linestatus") == "O"), "placeholder").otherwise("canonical")
    reason = predicates.relation_gate(status, c("l_quantity") > 49, c("l_discount") >= 0.1, c("l_tax") != 0, c("l_linenumber") > 6, c("l_quantity") >= 2, c("l_returnflag") != "N", c("l_linestatus") != "O")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query(f"SELECT p_type AS raw, {KEY.format(x='p_type')} AS key, count(*) AS n FROM part GROUP BY ALL")
def predicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types under the predicate key."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("raw"), C.predicate_key(F.col("p_type")).alias("key")).agg(F.count("*").alias("n"))


# Quality.
@query(f"""WITH {NODES_SQL}, k AS (SELECT type, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS key, trim(title) = '' OR regexp_matches(trim(title), '(?i)^v\\d+(\\.\\d+)*$') OR regexp_matches(trim(title), '^\\d+$') OR regexp_matches(trim(title), '^[^\\w\\s]$') AS low, lower(trim(title)) IN ('doc', 'file', 'image', 'link', 'pdf', 'url') AS gen FROM nodes),
t AS (SELECT key, type, count(*) AS n, sum(low::INT) AS low, sum(gen::INT) AS gen FROM k GROUP BY ALL), y AS (SELECT key, sum(n) AS n, sum((n > 1)::INT) AS same, count(*) AS types, sum(low) AS low, sum(gen) AS gen FROM t GROUP BY key)
SELECT CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(same) AS BIGINT) AS duplicate_groups, CAST(sum((types > 1)::INT) AS BIGINT) AS conflict_groups, CAST(sum(low) AS BIGINT) AS low_value, CAST(sum(gen) AS BIGINT) AS generic FROM y""")
def surface_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on titles: same keys within and across types, low-value and generic ones."""
    return quality.surface_layer(nodes(spark, sf_dir))


@query(f"""WITH {CLAIMS_SQL}, b AS (SELECT {KEY.format(x='p')} AS p, count(*) AS n FROM claims GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_claims, count(*) AS n_predicates, CAST(sum((n = 1)::INT) AS BIGINT) AS singletons, CAST(sum(CASE WHEN p IN ('', 'n_a', 'na', 'none', 'null', 'undefined', 'unknown') THEN n ELSE 0 END) AS BIGINT) AS placeholders, round(1000 * count(*) / sum(n), 6) AS per_thousand, round(sum(CASE WHEN p IN ({", ".join(f"'{w}'" for w in V.CORE_PREDICATES)}) THEN n ELSE 0 END) / sum(n), 6) AS registered_share FROM b""")
def predicate_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on predicates: claims, labels, singletons, placeholders and registered ones."""
    return quality.predicate_layer(claims(spark, sf_dir))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, {CLAIMS_SQL}, said AS (SELECT s AS src, p AS type, o_id AS dst, id < '1' AS old FROM claims WHERE o_id IS NOT NULL), t AS (SELECT src, type, dst FROM said WHERE NOT old)
SELECT (SELECT count(*) FROM t) AS relation_claims, (SELECT count(*) FROM t ANTI JOIN edges USING (src, type, dst)) AS claims_without_edge, (SELECT count(*) FROM edges WHERE type IN (SELECT type FROM said) AND (src, type, dst) NOT IN (SELECT src, type, dst FROM said)) AS edges_without_claim,
(SELECT count(*) FROM (SELECT src AS i FROM t UNION ALL SELECT dst FROM t) WHERE i NOT IN (SELECT id FROM nodes)) AS dead_ends, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS isolated""")
def relation_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation claims against edges; some claims are superseded."""
    return quality.relation_layer(_gated(spark, sf_dir), edges(spark, sf_dir), nodes(spark, sf_dir))


@query("""WITH b AS (SELECT 'identities' AS dimension, CAST(o_custkey AS VARCHAR) AS member FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'relations', o_custkey || ':' || o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
a AS (SELECT 'identities' AS dimension, CAST(o_custkey AS VARCHAR) AS member FROM orders WHERE o_orderstatus = 'O' UNION SELECT 'relations', o_custkey || ':' || o_orderpriority FROM orders WHERE o_orderstatus = 'O'),
j AS (SELECT coalesce(b.dimension, a.dimension) AS dimension, b.member AS x, a.member AS y FROM b FULL JOIN a ON a.dimension = b.dimension AND a.member = b.member)
SELECT dimension, count(x) AS before_count, count(y) AS after_count, CAST(sum((x IS NULL)::INT) AS BIGINT) AS added, CAST(sum((y IS NULL)::INT) AS BIGINT) AS removed, count(*) AS union_count, round((sum((x IS NULL)::INT) + sum((y IS NULL)::INT)) / count(*), 6) AS churn_share FROM j GROUP BY 1""")
def semantic_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their priorities of finished and of open orders as two snapshots."""
    orders = table(spark, sf_dir, "orders")

    def snapshot(status: str) -> DataFrame:
        rows = orders.where(F.col("o_orderstatus") == status)
        ids = rows.select(F.lit("identities").alias("dimension"), F.col("o_custkey").cast("string").alias("member"))
        return ids.unionByName(rows.select(F.lit("relations").alias("dimension"), F.concat(F.col("o_custkey").cast("string"), F.lit(":"), F.col("o_orderpriority")).alias("member")))

    return quality.churn(snapshot("F"), snapshot("O"))


ITEMS_SQL = "items AS (SELECT l_suppkey % 40 AS gold, l_partkey % 50 AS predicted FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("gold"), (F.col("l_partkey") % 50).alias("predicted"))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT gold, predicted, count(*) AS n FROM items GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY gold) AS g, sum(n) OVER (PARTITION BY predicted) AS q FROM c),
s AS (SELECT sum(n * n / q) / sum(n) AS p, sum(n * n / g) / sum(n) AS r FROM w) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""")
def adjudication_b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-cubed precision, recall and F1 of predicted against gold clusters, from counts of cells."""
    return quality.b_cubed(_items(spark, sf_dir))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT gold, predicted, count(*) AS n FROM items GROUP BY ALL), b AS (SELECT sum(n * (n - 1) / 2) AS x FROM c), g AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM items GROUP BY gold)), p AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM items GROUP BY predicted))
SELECT CAST(p.x - b.x AS BIGINT) AS false_merges, CAST(g.x - b.x AS BIGINT) AS missed_merges, CAST(b.x AS BIGINT) AS right_merges FROM b, g, p""")
def pairwise_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False and missed merges between gold and predicted clusters, counted without pairs."""
    return quality.pairwise_clusters(_items(spark, sf_dir))


@query("""WITH r AS (SELECT CAST(quality AS VARCHAR) AS e, CASE WHEN length(text) > 1000 THEN '1' ELSE '0' END AS a FROM labels JOIN documents USING (doc_id)), k AS (SELECT DISTINCT e AS class FROM r UNION SELECT a FROM r),
c AS (SELECT class, (SELECT count(*) FROM r WHERE e = class) AS support, (SELECT count(*) FROM r WHERE a = class) AS said, (SELECT count(*) FROM r WHERE a = class AND e = class) AS tp FROM k),
q AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM c)
SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q""")
def adjudication_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a rule by length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").cast("string").alias("expected"), F.when(F.length("text") > 1000, "1").otherwise("0").alias("actual"))
    return quality.classification(rows)


@query("""WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), g AS (SELECT o_custkey AS query_id, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
p AS (SELECT h.query_id, min(CASE WHEN g.id IS NOT NULL THEN rank END) AS f, count(g.id) AS hits FROM h LEFT JOIN g USING (query_id, id) WHERE rank <= 5 GROUP BY ALL), w AS (SELECT query_id, count(*) AS n FROM g GROUP BY ALL)
SELECT query_id, coalesce(f, 0) AS first_rank, round(coalesce(1.0 / f, 0), 6) AS rr, round(coalesce(hits, 0) / 5, 6) AS precision, round(coalesce(hits, 0) / n, 6) AS recall FROM w LEFT JOIN p USING (query_id)""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders among each customer's five dearest."""
    orders = table(spark, sf_dir, "orders")
    hits = retrieve.ranked(orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")))
    gold = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"))
    return quality.ranking(hits, gold, 5).fillna(0, ["first_rank"])


@query("""WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS calls, round(sum(v), 3) AS total, round(max(CASE WHEN i = n // 2 THEN v END), 3) AS p50, round(max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) THEN v END), 3) AS p90, round(max(v), 3) AS max FROM r GROUP BY event_type""")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, total and nearest-rank quantiles of the events' values, by type."""
    return quality.timing(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT count(n_chars) AS n, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents")
def nearest_rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of the documents' lengths."""
    return quality.distribution(table(spark, sf_dir, "documents"), F.col("n_chars"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7' || chr(0) || source || chr(0) || doc_id)) AS n FROM documents) WHERE n <= 5""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source by seeded hash (a sample is the feature)."""
    return quality.stratified(table(spark, sf_dir, "documents"), "source", "doc_id", 5, "7").select("source", "doc_id")


@query("""WITH r AS (SELECT l_orderkey AS q, bool_or(l_returnflag = 'R') AS x, bool_or(l_quantity > 40) AS y FROM lineitem GROUP BY 1)
SELECT CAST(sum((x AND y)::INT) AS BIGINT) AS both, CAST(sum((x AND NOT y)::INT) AS BIGINT) AS only_a, CAST(sum((NOT x AND y)::INT) AS BIGINT) AS only_b, CAST(sum((NOT x AND NOT y)::INT) AS BIGINT) AS neither FROM r""")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions that two arms answer: agreements and disagreements of the arms."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"))
    return quality.paired(lines.agg(F.max(F.col("l_returnflag") == "R").alias("correct")), lines.agg(F.max(F.col("l_quantity") > 40).alias("correct")))


# Ledger: events of a user are a run's.
LEDGER_SQL = """led AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS run_id, ts, event_type, CASE event_id % 5 WHEN 0 THEN 'ingest_run' WHEN 1 THEN 'candidate' WHEN 2 THEN 'comparison' WHEN 3 THEN 'commit_plan' ELSE 'commit_record' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN CASE WHEN value > 50 THEN 'started' ELSE 'completed' END END AS state, CAST(event_id % 97 AS VARCHAR) AS candidate_id, CAST(event_id // 5 AS VARCHAR) AS plan_id FROM events)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("ingest_run", "candidate", "comparison", "commit_plan", "commit_record"))), (n % 5 + 1).cast("int"))
    state = F.when(n % 5 == 0, F.when(F.col("value") > 50, "started").otherwise("completed"))
    return table(spark, sf_dir, "events").select(n.alias("seq"), F.col("user_id").cast("string").alias("run_id"), "ts", kind.alias("kind"), state.alias("state"), (n % 97).cast("string").alias("candidate_id"), F.floor(n / 5).cast("string").alias("plan_id"))


@query(f"""WITH {LEDGER_SQL} SELECT run_id, arg_max(state, seq) FILTER (WHERE kind = 'ingest_run') AS state, min(ts) FILTER (WHERE state = 'started') AS started_at, max(ts) FILTER (WHERE kind = 'ingest_run' AND state <> 'started') AS completed_at,
count(DISTINCT candidate_id) FILTER (WHERE kind = 'candidate') AS candidates, count(*) FILTER (WHERE kind = 'comparison') AS comparisons, count(*) FILTER (WHERE kind = 'commit_plan') AS commit_plans, count(*) FILTER (WHERE kind = 'commit_record') AS commit_records FROM led GROUP BY run_id""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run of the ledger: its last state, candidates and records by kind."""
    return ledger.run_summary(_ledger(spark, sf_dir))


@query(f"WITH {LEDGER_SQL}, s AS (SELECT run_id, arg_max(state, seq) FILTER (WHERE kind = 'ingest_run') AS state, min(ts) FILTER (WHERE state = 'started') AS started_at FROM led GROUP BY run_id) SELECT run_id, started_at FROM s WHERE state = 'started'")
def open_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the ledger that started and haven't ended."""
    return ledger.open_runs(_ledger(spark, sf_dir))


@query(f"WITH {LEDGER_SQL} SELECT run_id, candidate_id, max(seq) AS seq, arg_max(kind, seq) AS kind FROM led GROUP BY ALL")
def resume_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each candidate of a run."""
    return ledger.latest(_ledger(spark, sf_dir), ["run_id", "candidate_id"]).select("run_id", "candidate_id", "seq", "kind")


@query(f"WITH {LEDGER_SQL} SELECT seq, plan_id FROM led WHERE kind = 'commit_plan' AND plan_id NOT IN (SELECT plan_id FROM led WHERE kind = 'commit_record' AND seq % 10 = 4)")
def open_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit plans without an outcome; every second outcome is lost for it."""
    events = _ledger(spark, sf_dir).where("kind <> 'commit_record' OR seq % 10 = 4")
    return ledger.plans_without_outcome(events).select("seq", "plan_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, k""")
def debounce_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user without a quiet hour between them."""
    return ledger.bursts(table(spark, sf_dir, "events"), "user_id", F.col("ts"), 3600)


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY 1")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, with a sum out of their JSON."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("""WITH o AS (SELECT o_orderkey AS path, o_orderdate AS mtime, sha256(o_orderpriority) AS digest FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS mtime, sha256(CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderpriority END) AS digest FROM orders WHERE o_orderkey % 6 <> 0)
SELECT path, change FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.digest <> n.digest THEN 'changed' WHEN o.mtime <> n.mtime THEN 'touched' END AS change FROM o FULL JOIN n ON o.path = n.path) WHERE change IS NOT NULL""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the orders as file manifests."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = orders.where(k % 5 != 0).select(k.alias("path"), F.col("o_orderdate").alias("mtime"), F.sha2("o_orderpriority", 256).alias("digest"))
    mtime = F.when(k % 7 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate"))
    new = orders.where(k % 6 != 0).select(k.alias("path"), mtime.alias("mtime"), F.sha2(F.when(k % 11 == 0, "x").otherwise(F.col("o_orderpriority")), 256).alias("digest"))
    return ledger.manifest_diff(old, new)


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'b' || l_orderkey AS block_id, l_returnflag AS src, l_linestatus AS p, l_returnflag || '-' || l_linestatus || '!' AS literal FROM lineitem)
SELECT seq, min(seq) OVER (PARTITION BY block_id, src, lower(p), trim(regexp_replace(lower(literal), '[^0-9a-z]+', ' ', 'g'))) AS kept_seq FROM c""")
def near_dup_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal literals of an order's lines, each with the first of them."""
    lines = table(spark, sf_dir, "lineitem")
    literal = F.concat("l_returnflag", F.lit("-"), "l_linestatus", F.lit("!"))
    rows = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("b"), F.col("l_orderkey").cast("string")).alias("block_id"), F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("p"), literal.alias("literal"))
    return ledger.collapse_literals(rows).select("seq", "kept_seq")


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS n FROM orders WHERE (o_orderpriority, o_orderkey) > ('3-MEDIUM', 100)) WHERE n <= 100")
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a cursor (a page is the feature)."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return ledger.page_after(rows, ["o_orderpriority", "o_orderkey"], ("3-MEDIUM", 100), 100)


# Detectors: orders are commitments, due on their date; finished lines close them.
@query("""WITH d AS (SELECT 'order-' || o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F'))
SELECT 'f_' || sha256('commitment_temporal_shacl' || chr(31) || id)[1:16] AS finding_id, 'commitment_temporal_shacl' AS kind, 'warn' AS severity, 'open' AS status, id AS document_id, 'Commitment is overdue with no closure evidence: ' || id AS message FROM d""")
def drift_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commitments that are past their date without a closure."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    docs = table(spark, sf_dir, "orders").select(name("order-", "o_orderkey").alias("id"), F.lit("commitment").alias("type"), F.col("o_orderdate").alias("due"), F.array(F.col("o_orderkey").cast("string")).alias("tokens"))
    closures = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.lit("lines").alias("id"), F.col("l_orderkey").cast("string").alias("value"))
    return detect.overdue_commitments(docs, closures, "1996-01-01")


@query("""WITH d AS (SELECT 'd' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 3 END AS prev, o_orderkey % 2 = 0 AS head FROM orders)
SELECT 'f_' || sha256('supersedence_stale_head' || chr(31) || id)[1:16] AS finding_id, 'supersedence_stale_head' AS kind, 'warn' AS severity, 'open' AS status, id AS document_id, 'Decision ' || k || ' is stale and superseded by a later head' AS message
FROM d WHERE prev IS NOT NULL AND NOT head AND k IN (SELECT CAST(prev AS VARCHAR) FROM d WHERE prev IS NOT NULL)""")
def drift_stale_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions; every third supersedes the third before it."""
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), k.cast("string")).alias("id"), k.cast("string").alias("decision_id"), F.when(k % 3 == 0, F.array((k - 3).cast("string"))).otherwise(F.array().cast("array<string>")).alias("supersedes"), (k % 2 == 0).alias("head"))
    return detect.stale_heads(docs)


@query("""WITH d AS (SELECT 'a' || c_custkey AS id, 'agent-' || (c_custkey % 199) AS agent, CASE WHEN c_custkey % 4 = 0 THEN 'other' END AS alias_of FROM customer)
SELECT 'f_' || sha256('authority_alias_collision' || chr(31) || id)[1:16] AS finding_id, 'authority_alias_collision' AS kind, 'warn' AS severity, 'open' AS status, id AS document_id, 'Authority alias collides with primary authority: ' || agent AS message
FROM d WHERE alias_of IS NOT NULL AND agent IN (SELECT agent FROM d WHERE alias_of IS NULL)""")
def drift_alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as authorities: agents that several of them claim without an alias between them."""
    k = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("a"), k.cast("string")).alias("id"), F.lit("authority").alias("type"), F.concat(F.lit("agent-"), (k % 199).cast("string")).alias("agent"), F.when(k % 4 == 0, "other").alias("alias_of"))
    return detect.alias_collisions(docs)


@query("""WITH i AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d FROM part), s AS (SELECT p_partkey, d, list_sum(list_transform(range(1, 10), lambda i: CAST(d[i] AS INT) * (11 - i))) AS t FROM i),
c AS (SELECT p_partkey, d || CASE WHEN p_partkey % 3 = 0 THEN '0' WHEN (11 - t % 11) % 11 = 10 THEN 'X' ELSE CAST((11 - t % 11) % 11 AS VARCHAR) END AS isbn, (11 - t % 11) % 11 AS check_digit FROM s)
SELECT p_partkey, isbn, p_partkey % 3 <> 0 OR check_digit = 0 AS valid FROM c""")
def identifier_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISBN-10 built from part numbers; every third with 0 for a check digit."""
    d = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    total = sum((F.substring("d", i, 1).cast("int") * (11 - i) for i in range(1, 10)), F.lit(0))
    check = (11 - total % 11) % 11
    isbn = F.concat("d", F.when(F.col("p_partkey") % 3 == 0, "0").when(check == 10, "X").otherwise(check.cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", d.alias("d")).select("p_partkey", isbn.alias("isbn"))
    return rows.select("p_partkey", "isbn", C.valid_identifier(F.lit("ISBN"), F.col("isbn")).alias("valid"))

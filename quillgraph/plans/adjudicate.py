"""Queries of verdicts, spellings, snapshots and a run's types and predicates, over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import adjudicate
from quillgraph.plans.registry import query
from quillgraph.sources.tables import CLAIMS_SQL, claims, table


@query("""WITH m AS (SELECT c_custkey // 6 AS cluster_id, c_custkey AS id, c_custkey % 6 AS i, c_nationkey FROM customer), j AS (SELECT *, CASE WHEN i IN (0, 3) THEN 0 WHEN c_nationkey % 5 = 0 THEN 0.5 WHEN c_nationkey % 2 = 0 THEN 0.9 ELSE 0.85 END AS confidence FROM m),
k AS (SELECT *, i = 2 AND EXISTS (SELECT 1 FROM j o WHERE o.cluster_id = j.cluster_id AND o.i = 1 AND o.confidence > 0.8) AS clash FROM j WHERE confidence > 0.8),
g AS (SELECT cluster_id, min(confidence) AS confidence, string_agg(id, ',' ORDER BY id) AS names FROM k WHERE NOT clash GROUP BY cluster_id), w AS (SELECT cluster_id, string_agg(id, ',' ORDER BY id) AS whole, min(id) AS canonical FROM m GROUP BY cluster_id)
SELECT cluster_id, names IS NOT NULL AS same, coalesce(g.confidence, 0.0)::DOUBLE AS confidence, CASE WHEN names IS NOT NULL THEN canonical END AS canonical, CASE WHEN names IS NOT NULL THEN canonical || ',' || names ELSE whole END AS member_ids FROM w LEFT JOIN g USING (cluster_id)""")
def cluster_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in clusters of six, judged against the first; the fourth is held apart from it, the third from the second."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.floor(k / 6).alias("cluster_id"), k.alias("id"), (k % 6).alias("i"), F.col("c_nationkey").alias("n"))
    heads = rows.groupBy("cluster_id").agg(F.min("id").alias("canonical"))
    judged = rows.select("cluster_id", "id", F.lit(True).alias("same"), F.when(F.col("n") % 5 == 0, 0.5).when(F.col("n") % 2 == 0, 0.9).otherwise(0.85).alias("confidence"))
    apart = rows.where("i = 3").select(F.col("id").alias("a"), (F.col("id") - 3).alias("b")).unionByName(rows.where("i = 1").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    return adjudicate.cluster_verdicts(rows, heads, judged, apart).withColumn("member_ids", F.array_join("member_ids", ","))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity < 4) SELECT dst AS id, NOT bool_or(coalesce(p_size % 3 <> 0 AND p_size % 7 <> 0, false)) AS stale FROM e LEFT JOIN part ON p_partkey = src AND p_partkey % 11 <> 0 GROUP BY dst""")
def stale_superseders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that supersede suppliers; some are gone, superseded or detached."""
    size = F.col("p_size")
    kept = table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("id"), (size % 3 == 0).alias("superseded"), F.when(size % 7 == 0, True).alias("detached"))
    return adjudicate.superseders_stale(table(spark, sf_dir, "lineitem").where("l_quantity < 4").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), kept)


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN ' ' ELSE source END AS block, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 50 - 2 END AS s, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 60 END AS e, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 8 = 0 THEN upper(sha256(source)) || 'A' ELSE sha256(source) END AS h FROM documents)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'absent' WHEN trim(block) <> '' AND s >= 0 AND s <= e AND regexp_full_match(h, '[0-9a-f]{64}') THEN 'valid' ELSE 'invalid' END AS status FROM a""")
def anchor_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates with places: none, well formed or not."""
    k = F.col("doc_id")
    some, digest = k % 10 != 0, F.sha2(F.col("source"), 256)
    status = adjudicate.anchor_status(F.when(some, F.when(k % 9 == 0, " ").otherwise(F.col("source"))), F.when(some, k % 50 - 2), F.when(some, k % 60), F.when(some, F.when(k % 8 == 0, F.concat(F.upper(digest), F.lit("A"))).otherwise(digest)))
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"))


SURFACE_SQL = r"""r AS (SELECT p_partkey AS id, p_brand AS survivor, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_name || '  ' WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN p_name || '’s' ELSE p_name || ' Ã©' END AS surface, p_name AS title FROM part),
f AS (SELECT *, regexp_matches(surface, '\s\s|^\s|\s$') AS f1, contains(surface, '_') AS f2, contains(surface, '’') AS f3, contains(surface, 'Ã©') AS f4, trim(surface) AS bare FROM r), a AS (SELECT *, CASE WHEN bare <> '' AND bare <> title AND NOT f4 THEN bare END AS alias FROM f)"""


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey")
    surface = F.when(k % 4 == 0, F.concat(F.lit(" "), name, F.lit("  "))).when(k % 4 == 1, F.replace(name, F.lit(" "), F.lit("_"))).when(k % 4 == 2, F.concat(name, F.lit("’s"))).otherwise(F.concat(name, F.lit(" Ã©")))
    return adjudicate.surface_records(table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("survivor"), surface.alias("surface"), name.alias("title")))


@query(f"""WITH {SURFACE_SQL} SELECT id, concat_ws(',', CASE WHEN f1 THEN 'whitespace_normalized' END, CASE WHEN f2 THEN 'underscore_separator' END, CASE WHEN f3 THEN 'apostrophe_variant' END, CASE WHEN f4 THEN 'suspected_mojibake' END) AS flags, coalesce(alias, '') AS alias FROM a""")
def surface_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of parts with what sets them off from their titles."""
    return _surfaces(spark, sf_dir).select("id", F.array_join("flags", ",").alias("flags"), F.coalesce("alias", F.lit("")).alias("alias"))


@query(f"""WITH {SURFACE_SQL}, t AS (SELECT survivor, min(title) AS title FROM r GROUP BY survivor), s AS (SELECT survivor, string_agg(alias, ';' ORDER BY alias) AS aliases FROM (SELECT DISTINCT survivor, alias FROM a JOIN t USING (survivor) WHERE alias IS NOT NULL AND alias <> t.title) GROUP BY survivor),
g AS (SELECT survivor, concat_ws(',', CASE WHEN bool_or(f3) THEN 'apostrophe_variant' END, CASE WHEN bool_or(f4) THEN 'suspected_mojibake' END, CASE WHEN bool_or(f2) THEN 'underscore_separator' END, CASE WHEN bool_or(f1) THEN 'whitespace_normalized' END) AS flags FROM f GROUP BY survivor)
SELECT survivor, title, coalesce(aliases, '') AS aliases, coalesce(flags, '') AS flags FROM t LEFT JOIN s USING (survivor) LEFT JOIN g USING (survivor)""")
def merged_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of all parts that fold into their brand, which is called by the first title."""
    rows = _surfaces(spark, sf_dir)
    out = adjudicate.merged_surfaces(rows, rows.groupBy("survivor").agg(F.min("title").alias("title")))
    return out.select("survivor", "title", F.array_join("aliases", ";").alias("aliases"), F.array_join("flags", ",").alias("flags"))


@query("""SELECT o_orderkey, coalesce(1000 + o_custkey > coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN 900 + o_orderkey % 200 END, 0) AND 1200 - (1000 + o_custkey) >= 60 AND 1200 - coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN 900 + o_orderkey % 200 END, 0) >= 150 AND o_orderstatus <> 'P' AND o_orderkey % 7 <> 0, false) AS due FROM orders""")
def due_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as states of a scheduler: whether a sweep is due."""
    k = F.col("o_orderkey")
    due = adjudicate.sweep_due(F.lit(1200), F.when(k % 7 != 0, 1000 + F.col("o_custkey")), F.when(k % 3 != 0, 900 + k % 200), F.when(F.col("o_orderstatus") == "P", True), quiet=60, interval=150)
    return table(spark, sf_dir, "orders").select("o_orderkey", due.alias("due"))


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus END AS digest FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 3 <> 0 ELSE o_orderkey % 4 <> 0 END""")
def persistable_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of two manifests; pending ones keep their old entries."""
    rows = table(spark, sf_dir, "orders")
    old = rows.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("digest"))
    new = rows.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("digest"))
    return adjudicate.persistable_manifest(old, new, rows.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path")))


@query("""WITH r AS (SELECT p_partkey AS k, 'part ' || p_partkey AS label, p_size % 10 = 0 AS fixed, count(l_partkey) AS support, p_type FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY (NOT fixed)::INT, support DESC, label) AS place, greatest(40, count(*) FILTER (fixed) OVER ()) AS room, count(*) OVER () AS n FROM r)
SELECT place, label || ' | out | support=' || support || ' | ' || p_type AS line, greatest(n - room, 0) AS dropped FROM n WHERE place <= room""")
def registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as predicates: the lines of a prompt with room for 40 (the cap is the feature)."""
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").join(uses, F.col("l_partkey") == F.col("p_partkey"), "left")
    rows = rows.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("label"), F.when(F.col("p_size") % 10 == 0, "canonical").otherwise("provisional").alias("lifecycle"), F.lit("out").alias("direction"), F.coalesce("n", F.lit(0)).alias("support"), F.col("p_type").alias("definition"))
    return adjudicate.registry_lines(rows, 40)


ANSWERS = ("The sources do not clearly STATE this.", "Unsupported.", "It is stated plainly.", "They don't know, and didn't ever\nreally mention it.", "He does not walk or mention it.")


@query(f"""WITH v(i, t) AS (VALUES {", ".join(f"({i}, '{a.replace(chr(39), chr(39) * 2)}')" for i, a in enumerate(ANSWERS))}), d AS (SELECT doc_id, coalesce(text, '') || ' ' || t AS t FROM documents JOIN v ON i = doc_id % 5)
SELECT doc_id, {" OR ".join(f"contains(lower(t), '{m}')" for m in adjudicate.ABSTENTIONS)} OR regexp_matches(lower(t), '\\b(do(es)?\\s+not|don''t|doesn''t|did\\s+not|didn''t)\\s+(\\w+\\s+){{0,2}}?({"|".join(adjudicate.ABSTENTION_VERBS)})') AS abstains FROM d""")
def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each with one of five endings, as answers."""
    ending = F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", adjudicate.abstains(F.concat_ws(" ", F.coalesce("text", F.lit("")), ending)).alias("abstains"))


@query(f"""WITH {CLAIMS_SQL} SELECT block_id AS source_path, CAST(json_object('O_id', o_id, 'O_literal', o_literal, 'P', p, 'S_id', s, 'claim_id', id, 'reason', 'source-line-removed', 'source_path', block_id, 'valid_as_of', '2026-01-01') AS VARCHAR) AS line FROM claims WHERE id < '3'""")
def detachment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of record for the claims whose sources lost them."""
    c = claims(spark, sf_dir)
    gone = c.where("id < '3'").select("id", F.col("block_id").alias("source_path"))
    unknown = gone.limit(1).select(F.lit("none").alias("id"), "source_path")
    return adjudicate.detachment_lines(c, gone.unionByName(unknown), "2026-01-01")


PLAN_SQL = """pr AS (SELECT CASE p_size % 5 WHEN 0 THEN 'Agent' WHEN 1 THEN 'Concept' WHEN 2 THEN 'Place' WHEN 3 THEN NULL ELSE 'Thing' END AS type FROM part), pl AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'create_node' ELSE 'merge_node' END AS operation, CASE WHEN l_linenumber % 2 = 0 THEN 'Agent' ELSE l_linestatus END AS type FROM lineitem)"""


@query(f"""WITH {PLAN_SQL} SELECT stage, operation, type, count(*) AS n, type IN ('Activity', 'Agent', 'Concept', 'InformationObject', 'Place') AS valid FROM (SELECT 'proposed' AS stage, '' AS operation, coalesce(type, '') AS type FROM pr UNION ALL SELECT 'planned', operation, type FROM pl) GROUP BY ALL""")
def ledger_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as proposed nodes and lines as planned operations, by type."""
    size = F.col("p_size") % 5
    proposed = table(spark, sf_dir, "part").select(F.when(size == 0, "Agent").when(size == 1, "Concept").when(size == 2, "Place").when(size == 4, "Thing").alias("type"))
    planned = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "create_node").otherwise("merge_node").alias("operation"), F.when(F.col("l_linenumber") % 2 == 0, "Agent").otherwise(F.col("l_linestatus")).alias("type"))
    return adjudicate.ledger_types(proposed, planned)


@query("""WITH s AS (SELECT p_name AS t, p_size % 3 = 0 AS derived FROM part), r AS (SELECT 'proposed' AS stage, t FROM s UNION ALL SELECT 'raw', t FROM s WHERE NOT derived UNION ALL SELECT 'planned', p_type FROM part WHERE p_size % 2 = 0),
c AS (SELECT stage, t, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT DISTINCT p_name AS t FROM part WHERE p_size > 25 UNION SELECT p_type FROM part WHERE p_size > 45),
o AS (SELECT stage, sum(n)::BIGINT AS assertions, count(*) AS vocabulary, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (t NOT IN (SELECT t FROM k)) AS unregistered FROM c GROUP BY stage) SELECT *, round(vocabulary / (SELECT vocabulary FROM o WHERE stage = 'raw'), 6) AS to_raw FROM o""")
def ledger_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as proposed predicates and types as planned ones, against a registry of some."""
    parts, size = table(spark, sf_dir, "part"), F.col("p_size")
    proposed = parts.select(F.concat(F.lit(" "), "p_name").alias("type"), (size % 3 == 0).alias("derived"))
    planned = parts.select(F.when(size % 2 == 0, "create_edge_or_claim").otherwise("queue_review").alias("operation"), F.col("p_type").alias("type"))
    registered = parts.where("p_size > 25").select(F.col("p_name").alias("type")).unionByName(parts.where("p_size > 45").select(F.col("p_type").alias("type")))
    return adjudicate.ledger_predicates(proposed, planned, registered)

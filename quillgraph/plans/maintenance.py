"""Queries of consolidation, incremental maintenance and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.operators import consolidate, extraction, incremental, ingest, resolve
from quillgraph.plans.registry import query
from quillgraph.sources import markdown
from quillgraph.sources.tables import CLAIMS_SQL, NODES_SQL, claims, nodes, table


@query("SELECT trim(regexp_replace(lower(p_type), '[^0-9a-z]+', ' ', 'g')) AS key, count(*) AS n FROM part GROUP BY 1 HAVING key <> ''")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each type of part is named, by its near-duplicate key; an empty key counts for nothing."""
    return consolidate.mention_counts(table(spark, sf_dir, "part").select(F.col("p_type").alias("title")))


@query("""SELECT l_orderkey * 10 + l_linenumber AS seq, 'o' || l_orderkey || '#' || ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3) AS batch FROM lineitem""")
def curation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order in batches of three."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("block_id"))
    return consolidate.batches(rows, 3).select("seq", "batch")


@query("SELECT p_partkey, sha256('claim' || chr(31) || 'part:' || p_partkey || chr(31) || 'size' || chr(31) || 'literal:int:' || p_size) AS id FROM part")
def semantic_claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the claim of each part's size."""
    key = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", C.semantic_claim_id(key, F.lit("size"), F.lit(None).cast("string"), F.lit("int"), F.col("p_size").cast("string")).alias("id"))


@query("""WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS s, o_orderstatus AS o FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), n AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS s, o_orderstatus AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT c.id, coalesce(min(n.id), '') AS superseded_by FROM c LEFT JOIN n ON n.s = c.s AND n.o <> c.o GROUP BY c.id""")
def supersedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of a customer's old orders that newer orders contradict."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o"), "o_orderdate")
    day = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    old = o.where(day).drop("o_orderdate").withColumn("valid_until", F.lit(None).cast("date"))
    return incremental.superseded(old, o.where(~day).drop("o_orderdate"), "1997-01-01").select("id", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1996-06-01' AND CAST(l_shipdate AS DATE) + 30 > DATE '1996-06-01'""")
def valid_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as claims that hold for thirty days."""
    ship = F.col("l_shipdate").cast("date")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ship.alias("valid_as_of"), F.date_add(ship, 30).alias("valid_until"))
    return incremental.valid_at(rows, F.lit("1996-06-01").cast("date")).select("l_orderkey", "l_linenumber")


@query("""WITH n AS (SELECT DISTINCT source AS path, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 5 <> 0), o AS (SELECT DISTINCT source AS path, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(n.path, o.path) AS path, coalesce(n.h, o.h) AS content_hash, CASE WHEN o.h IS NULL THEN 'extract' WHEN n.h IS NULL THEN 'orphan' ELSE 'skip' END AS action FROM n FULL JOIN o ON n.path = o.path AND n.h = o.h""")
def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of their source, in two versions."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.sha2(C.text_or_empty(F.col("text")), 256).alias("content_hash"))
    return ingest.extraction_plan(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 7 <> 0"))


@query("SELECT event_id AS reply_id, 0 AS pos, props AS object FROM events")
def embedded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects within text around each event's properties."""
    text = F.concat(F.lit("Here: {no "), F.col("props"), F.lit(" end } {"))
    return extraction.embedded_objects(table(spark, sf_dir, "events").select(F.col("event_id").alias("reply_id"), text.alias("text")))


@query(f"""WITH {NODES_SQL}, {CLAIMS_SQL}, e AS (SELECT id AS src, unnest(['prov:wasDerivedFrom', 'prov:wasGeneratedBy', 'prov:wasAttributedTo']) AS type, unnest([block_id, 'act', 'agent']) AS dst FROM claims
  UNION SELECT id, 'rdf:subject', s FROM claims WHERE s IN (SELECT id FROM nodes) UNION SELECT id, 'rdf:object', o_id FROM claims WHERE o_id IN (SELECT id FROM nodes))
SELECT sha256('edge' || chr(31) || src || chr(31) || type || chr(31) || dst) AS id, type, src, dst FROM e""")
def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from every claim to its block, activity, agent and ends."""
    return markdown.provenance_edges(claims(spark, sf_dir), nodes(spark, sf_dir), "act", "agent")


@query("""SELECT event_id, CASE WHEN value >= 90 AND event_id % 5 >= 2 AND event_type <> 'view' THEN 'merge' WHEN event_type <> 'view' THEN 'queue' ELSE 'skip' END AS route, round(least(1.0, greatest(0.0, 0.7 - CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0 END - CASE WHEN event_id % 4 = 0 THEN 0.1 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 0.2 ELSE 0 END)), 6) AS confidence FROM events""")
def merge_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verdicts: which merge, which queue, and the confidence of a resolution."""
    n = F.col("event_id")
    route = consolidate.merge_route(F.col("value") / 100, n % 5, F.when(F.col("event_type") != "view", "same").otherwise("distinct"))
    return table(spark, sf_dir, "events").select("event_id", route.alias("route"), F.round(resolve.confidence(n % 3 == 0, n % 4 == 0, n % 7 == 0), 6).alias("confidence"))


@query("""WITH l AS (SELECT user_id AS id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'Agent' WHEN 1 THEN 'Place' ELSE 'Concept' END AS corrected FROM events), b AS (SELECT *, lag(corrected, 1, 'Agent') OVER (PARTITION BY id ORDER BY seq) AS before FROM l),
w AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'Agent' ELSE 'Place' END AS type, arg_max(corrected, seq) AS last, arg_min(before, seq) AS first FROM b GROUP BY id) SELECT id, CASE WHEN type <> first THEN type ELSE last END AS type, type <> first AS broken FROM w""")
def type_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as corrections of their user's type; every second user starts at another type than the chain."""
    from pyspark.sql import Window

    kind = F.element_at(F.array(F.lit("Agent"), F.lit("Place"), F.lit("Concept")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("corrected"))
    chains = rows.withColumn("previous", F.coalesce(F.lag("corrected").over(Window.partitionBy("id").orderBy("seq")), F.lit("Agent")))
    current = rows.select("id").distinct().withColumn("type", F.when(F.col("id") % 2 == 0, "Agent").otherwise("Place"))
    return consolidate.corrected_types(chains, current)


@query()
def collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and customers' segments as candidates: those of one title fold, but never two that an edge joins; a test stands for SQL."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    rows = c.select(k.alias("seq"), name(k).alias("id"), F.lit("Agent").alias("type"), F.concat_ws(" ", "c_mktsegment", (k % 100).cast("string")).alias("title"), F.lit(0).alias("score"))
    edges = c.where(k % 50 == 0).select(name(k).alias("id"), F.lit("knows").alias("type"), name(k).alias("src"), name(k + 100).alias("dst"), F.lit("b").alias("block_id"))
    return consolidate.collapse_duplicates(rows, edges)[0]


@query()
def sentence_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document, and whether its source still says them after each document has lost its first line; look-behind isn't in DuckDB's expressions, so a test stands for SQL."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("block_id"), F.col("source").alias("path"), "text")
    return incremental.orphan_diffs(docs, docs.select("path", F.regexp_replace("text", r"^[^\n]*\n?", "").alias("text")))

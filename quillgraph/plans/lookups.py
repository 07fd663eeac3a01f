"""Queries around a node and its claims, and small verdicts, over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V
from quillgraph.operators import consolidate, gates, graph, incremental, ingest, integrity, ledger, lookups, predicates, retrieve
from quillgraph.plans.registry import query
from quillgraph.plans.retrieval import BM25_SQL, CORPUS_SQL, DOCS_SQL, META, QUERIES_SQL, _asks, _corpus, _docs
from quillgraph.plans.structure import EGO_SQL, EQUIV_SQL, _customer_seeds, _equivalence, _gated
from quillgraph.sources.tables import CLAIMS_SQL, EDGES_SQL, NODES_SQL, claims, edges, nodes, table

TYPES = (*V.PRIMITIVE_TYPES, "Claim", "Document", "Block")
KINDS = ", ".join(f"'{t}'" for t in TYPES)
PRIMITIVES = ", ".join(f"'{t}'" for t in V.PRIMITIVE_TYPES)
GATED_SQL = "gated AS (SELECT *, coalesce(id >= 'e' AND id < 'f', false) AS infra, id < '1' AS superseded, id >= 'f' AS low FROM claims)"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).withColumn("infra", (F.col("id") >= "e") & (F.col("id") < "f"))


@query(f"WITH {CLAIMS_SQL}, {GATED_SQL} SELECT id, infra, superseded, low AS low_salience, NOT (infra OR superseded OR low) AS passes FROM gated")
def gate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with its gates."""
    c = _marked(spark, sf_dir)
    return c.select("id", gates.is_infra(c).alias("infra"), gates.is_superseded(c).alias("superseded"), gates.is_low_salience(c).alias("low_salience"), gates.passes(c).alias("passes"))


@query(f"WITH {CLAIMS_SQL}, {EGO_SQL.replace('live AS (SELECT * FROM claims WHERE ', "live AS (SELECT * FROM claims WHERE p IN ('placed_by', 'has status') AND ")} SELECT seed, id, round(coverage, 6) AS coverage, rank FROM bridge")
def ego_relationships_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims about each customer under two relationship types, as they stand or as they are spoken."""
    seeds, terms = _customer_seeds(spark, sf_dir)
    found = graph.bridge_claims(_gated(spark, sf_dir), seeds, terms, 8, allowed=["Placed By ", "has_status"])
    return found.select("seed", "id", F.round("coverage", 6).alias("coverage"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {CORPUS_SQL} SELECT id, type FROM corpus WHERE NOT infra AND NOT (type = 'Claim' AND (coalesce(p, '') IN ({META}) OR coalesce(p, '') IN ('has_heading', 'has_tag', 'links_to') OR regexp_matches(lower(trim(title)), '^(heading:|tag:|wikilink:)')))""")
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes that the browser shows."""
    return lookups.visible_nodes(_corpus(spark, sf_dir), TYPES).select("id", "type")


@query(f"""WITH {NODES_SQL}, {CLAIMS_SQL}, b AS (SELECT id, CASE WHEN id < '2' THEN 'customer:none' ELSE o_id END AS dst FROM claims WHERE o_id IS NOT NULL AND id < '8'),
r AS (SELECT c.id, coalesce(b.dst, o_id) AS object_id FROM claims c LEFT JOIN b USING (id)) SELECT id, object_id FROM r WHERE object_id IN (SELECT id FROM nodes)""")
def object_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of claims, half of which have an edge, some of these to nothing."""
    c = claims(spark, sf_dir)
    bridges = c.where("o_id IS NOT NULL AND id < '8'").select(F.lit("rdf:object").alias("type"), F.col("id").alias("src"), F.when(F.col("id") < "2", "customer:none").otherwise(F.col("o_id")).alias("dst"))
    return lookups.object_nodes(c, bridges, nodes(spark, sf_dir)).select("id", "object_id")


@query(f"""WITH {NODES_SQL}, {CLAIMS_SQL}, {GATED_SQL}, n AS (SELECT id, id LIKE '%7' AS infra FROM nodes), live AS (SELECT * FROM gated WHERE NOT infra AND NOT superseded AND NOT low AND confidence >= 0.75),
r AS (SELECT c.*, CASE WHEN o_id IS NOT NULL AND NOT a.infra AND NOT b.infra THEN 'relationship' WHEN o_id IS NULL AND o_literal IS NOT NULL THEN 'claim' END AS section FROM live c LEFT JOIN n a ON a.id = s LEFT JOIN n b ON b.id = o_id)
SELECT min(id) AS id, section FROM r WHERE section IS NOT NULL GROUP BY section, s, p, coalesce(o_id, o_literal)""")
def routed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of claims; nodes whose key ends in 7 are plumbing."""
    shown = nodes(spark, sf_dir).withColumn("infra", F.col("id").endswith("7"))
    return lookups.routed_claims(_marked(spark, sf_dir), shown, 0.75)


ANCHORS_SQL = """
raw AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
anchors AS (SELECT id, CASE WHEN doc_id % 3 = 0 AND doc_id % 15 <> 0 THEN source || '/' || doc_id || '.md' WHEN doc_id % 2 = 0 THEN 'blocks/' || doc_id ELSE '' END AS path, CASE WHEN doc_id % 3 = 0 AND doc_id % 15 <> 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS byte_start,
  CASE WHEN (doc_id % 3 = 0 AND doc_id % 15 <> 0) OR doc_id % 2 = 0 THEN size ELSE 0 END AS byte_end, 'sha256:' || CASE WHEN doc_id % 3 = 0 AND doc_id % 15 <> 0 THEN sha256(text) WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256(id) END AS content_hash, 'b' || doc_id AS block_id FROM raw)"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = C.text_or_empty(F.col("text")), F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", n.cast("string").alias("id"), F.concat(F.lit("b"), n.cast("string")).alias("block_id"), C.text_or_empty(F.col("source")).alias("source"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("digest"))
    path = F.when(n % 15 == 0, F.concat(F.lit("../"), "id")).otherwise(F.concat("source", F.lit("/"), "id", F.lit(".md")))
    span = F.when(n % 3 == 0, F.struct(path.alias("source_path"), F.lit(0).cast("long").alias("byte_start"), F.col("size").alias("byte_end"), F.col("digest").alias("content_hash")))
    blocks = docs.where(n % 2 == 0).select(F.col("block_id").alias("id"), F.concat(F.lit("blocks/"), F.col("id")).alias("path"), F.lit(1).cast("long").alias("byte_start"), F.col("size").alias("byte_end"), F.concat(F.lit("sha256:"), "digest").alias("content_hash"))
    return lookups.provenance(docs.select("id", "block_id", span.alias("span")), blocks)


@query(f"WITH {ANCHORS_SQL} SELECT * FROM anchors")
def claim_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims: a third have spans, of which some leave the root; half have a block."""
    return _anchors(spark, sf_dir)


@query(f"WITH {DOCS_SQL}, {QUERIES_SQL}, {BM25_SQL}, {ANCHORS_SQL}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM bmr WHERE rank <= 5) SELECT query_id, t.id, round(score / best, 6) AS score, path, byte_end, content_hash FROM t JOIN anchors USING (id)")
def query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lexical hits of each question with scores over the best and their anchors."""
    found = retrieve.bm25(_docs(spark, sf_dir), F.col("text"), _asks(spark, sf_dir), F.col("text"), 5)
    return lookups.query_hits(found, _anchors(spark, sf_dir), 5).select("query_id", "id", F.round("score", 6).alias("score"), "path", "byte_end", "content_hash")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, {EQUIV_SQL}, e AS (SELECT src AS id, type, 'out' AS direction FROM edges UNION ALL SELECT dst, type, 'in' FROM edges), c AS (SELECT id, type, direction, count(*) AS n FROM e GROUP BY ALL)
SELECT nodes.id, c.type AS edge_type, direction, coalesce(n, 0) AS n, coalesce(canonical_id, nodes.id) AS canonical_id FROM nodes LEFT JOIN c USING (id) LEFT JOIN equiv ON member_id = nodes.id WHERE nodes.type IN ({KINDS})""")
def node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's edges by type and direction."""
    return lookups.node_detail(nodes(spark, sf_dir), edges(spark, sf_dir), _equivalence(spark, sf_dir), TYPES)


LINES_SQL = f"""WITH {NODES_SQL}, {EDGES_SQL}, k AS (SELECT CASE WHEN type = 'in_nation' AND src LIKE 'customer:%3' THEN 'alias_of' ELSE type END AS type, src, dst FROM edges),
e AS (SELECT src AS id, type, dst AS other, 0 AS incoming FROM k UNION ALL SELECT dst, type, src, 1 FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN type = 'alias_of' THEN 0 ELSE 1 END, incoming, type, other) AS rank FROM e WHERE id LIKE 'nation:%' OR id LIKE 'customer:%')
SELECT r.id, rank, CASE WHEN incoming = 0 THEN coalesce(a.title, r.id) || ' --' || r.type || '--> ' || coalesce(b.title, other) ELSE coalesce(b.title, other) || ' --' || r.type || '--> ' || coalesce(a.title, r.id) END AS line
FROM r LEFT JOIN nodes a ON a.id = r.id LEFT JOIN nodes b ON b.id = other WHERE rank <= 5"""


@query(LINES_SQL)
def relationship_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five relationships of each nation and customer (the judge's own limit); some edges keep look-alikes apart."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    kind = F.when((F.col("type") == "in_nation") & F.col("src").like("customer:%3"), "alias_of").otherwise(F.col("type"))
    subjects = n.where(F.col("id").startswith("nation:") | F.col("id").startswith("customer:"))
    return lookups.relationship_lines(subjects, e.select(kind.alias("type"), "src", "dst"), n).select("id", F.col("rank").cast("long").alias("rank"), "line")


@query(f"""WITH d AS (SELECT sha256('document' || chr(31) || 'corpus/' || doc_id) AS id FROM documents WHERE doc_id % 2 = 0), n AS (SELECT 'customer:' || c_custkey AS dst, sha256('document' || chr(31) || 'corpus/' || c_custkey) AS src, c_custkey FROM customer WHERE c_custkey % 10 <> 3),
m AS (SELECT sha256('edge' || chr(31) || src || chr(31) || 'schema:mentions' || chr(31) || dst) AS id, 'schema:mentions' AS type, src, dst, c_custkey FROM n WHERE src IN (SELECT id FROM d)) SELECT id, type, src, dst FROM m WHERE c_custkey % 7 <> 0""")
def source_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of customers by the documents of their numbers, a seventh of which exist already."""
    k = F.col("c_custkey")
    path = F.when(k % 10 != 3, F.concat(F.lit("corpus/"), k.cast("string"))).otherwise("")
    entities = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), k.cast("string")).alias("id"), F.lit("Agent").alias("type"), path.alias("source_path"), "c_custkey")
    documents = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(C.sha256_id(F.lit("document"), F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"))).alias("id"))
    old = entities.where("c_custkey % 7 = 0").select(C.edge_id(C.sha256_id(F.lit("document"), F.col("source_path")), F.lit("schema:mentions"), F.col("id")).alias("id"))
    return lookups.source_mentions(entities, documents, old)


@query("SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE 'b' || i END AS evidence_id FROM documents, LATERAL (SELECT unnest(CASE WHEN doc_id % 3 = 0 THEN [0] ELSE [doc_id, doc_id + 1000000] END) AS i)")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents; every third has none and stands for itself."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), n.cast("string")).alias("id"), F.concat(F.lit("p"), n.cast("string")).alias("path"))
    blocks = docs.where(n % 3 != 0).select("path", F.explode(F.array(n, n + 1_000_000)).alias("b")).select("path", F.concat(F.lit("b"), F.col("b").cast("string")).alias("id"))
    return lookups.evidence_blocks(docs.select("id", "path"), blocks)


DERIVED_SQL = "derived AS (SELECT DISTINCT 'c' || l_partkey AS id, 'b' || l_suppkey AS block_id, l_partkey FROM lineitem)"


def _derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    made = lines.select(F.lit("prov:wasDerivedFrom").alias("type"), name("c", "l_partkey").alias("src"), name("b", "l_suppkey").alias("dst"))
    kept = table(spark, sf_dir, "part").select(name("c", "p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, "m").alias("model_id"), (F.col("p_partkey") % 9 == 0).alias("infra"))
    return made, kept


@query(f"WITH {DERIVED_SQL} SELECT block_id, id FROM derived WHERE l_partkey % 4 <> 0 AND l_partkey % 9 <> 0 AND l_partkey IN (SELECT p_partkey FROM part)")
def model_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as claims of suppliers as blocks."""
    return lookups.model_claims(*_derived(spark, sf_dir)).select("block_id", "id")


@query(f"""WITH {DERIVED_SQL}, m AS (SELECT * FROM derived WHERE l_partkey % 4 <> 0 AND l_partkey % 9 <> 0 AND l_partkey IN (SELECT p_partkey FROM part)), o AS (SELECT 'b' || s_suppkey AS b FROM supplier WHERE s_suppkey % 3 = 0), c AS (SELECT 'b' || s_suppkey AS b FROM supplier WHERE s_suppkey % 10 = 1)
SELECT DISTINCT id FROM m WHERE block_id IN (SELECT b FROM o) AND id NOT IN (SELECT id FROM m WHERE block_id IN (SELECT b FROM c))""")
def correction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that an edit may have corrected: a third of the blocks are orphans, a tenth current."""
    blocks = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("block_id"))
    return lookups.correction_candidates(*_derived(spark, sf_dir), blocks.where("s_suppkey % 3 = 0").select("block_id"), blocks.where("s_suppkey % 10 = 1").select("block_id"))


@query("SELECT o_orderkey, o_custkey AS ref, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN 'internal' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 1) THEN 'observed_unplanned' ELSE 'external' END AS kind FROM orders")
def ledger_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers as references: a third are planned, a third only candidates."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("ref"))
    return lookups.ledger_references(refs, c.where("id % 3 < 2"), c.where("id % 3 = 0")).select("o_orderkey", "ref", "kind")


@query("""WITH m AS (SELECT p_brand AS type, lower(p_type) AS key FROM part), c AS (SELECT key, type, count(*) AS n FROM m GROUP BY ALL)
SELECT 'same_type' AS kind, key, type, n FROM c WHERE n > 1 UNION ALL SELECT 'cross_type', key, NULL, CAST(sum(n) AS BIGINT) FROM c GROUP BY key HAVING count(*) > 1""")
def collision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as surfaces that several parts share, within a brand and across."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.lower("p_type").alias("surface"))
    return lookups.collision_groups(rows, "surface")


@query("SELECT g, k, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, k) AS rank FROM (SELECT o_orderpriority AS g, CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY ALL)) WHERE rank <= 3")
def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three customers with the most orders of each priority (a report's own limit)."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_custkey").cast("string").alias("k")).agg(F.count("*").alias("n"))
    return lookups.top_counts(counts, "g", "k", 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {NODES_SQL}, x AS (SELECT CASE WHEN id LIKE 'supplier:%' THEN 'Vendor' WHEN id LIKE 'orders:%' THEN 'Document' ELSE type END AS type FROM nodes) SELECT type, count(*) AS n, CASE WHEN type IN ({PRIMITIVES}) THEN 'primitive' WHEN type = 'Document' THEN 'support' ELSE 'invalid' END AS kind FROM x GROUP BY type")
def type_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type, with suppliers under a type that isn't known."""
    kind = F.when(F.col("id").startswith("supplier:"), "Vendor").when(F.col("id").startswith("orders:"), "Document").otherwise(F.col("type"))
    return lookups.type_layer(nodes(spark, sf_dir).withColumn("type", kind), ("Claim", "Document", "Block"))


@query("SELECT conv_id, CASE WHEN bool_and(turn % 5 <> 4) THEN 'measured' ELSE 'partial' END AS status, CAST(sum(turn + 1) AS BIGINT) AS calls, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def construction_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cost rows of their conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 5 != 4, "measured").otherwise("partial").alias("status"), (F.col("turn") + 1).alias("calls"), F.length(C.text_or_empty(F.col("text"))).cast("long").alias("tokens"))
    return lookups.combined_costs(rows, "conv_id", ("calls", "tokens"))


@query("SELECT o_orderpriority AS g, count(*) AS count, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS correct, CAST(sum((o_orderstatus <> 'F')::INT) AS BIGINT) AS incorrect, round(avg((o_orderstatus = 'F')::INT), 6) AS accuracy FROM orders GROUP BY 1")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as right answers, by priority."""
    return lookups.accuracy(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_orderstatus") == "F").alias("correct")), "g")


@query("SELECT run_id, began FROM (SELECT event_id AS run_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN ts END, CASE WHEN event_id % 2 = 0 THEN ts END) AS began FROM events) ORDER BY began DESC NULLS LAST, run_id LIMIT 50")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 of events as runs (the list's own limit); some lack a start, some both times."""
    n = F.col("event_id")
    runs = table(spark, sf_dir, "events").select(n.alias("run_id"), F.when(n % 3 != 0, F.col("ts")).alias("started_at"), F.when(n % 2 == 0, F.col("ts")).alias("completed_at"))
    return lookups.recent_runs(runs, 50).select("run_id", "began")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'contradiction' WHEN (o_orderkey % 100) / 100 >= 0.75 THEN NULL ELSE 'low_confidence' END AS review FROM orders")
def commit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates: why they are reviewed, null if they are committed."""
    return table(spark, sf_dir, "orders").select("o_orderkey", lookups.commit_decision((F.col("o_orderkey") % 100) / 100, F.col("o_orderstatus") == "P").alias("review"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'same' ELSE 'distinct' END = 'same' AND o_orderpriority <> 'p' || o_orderstatus AND o_orderpriority <> '5-LOW' AND (o_orderkey % 20) / 20 >= 0.85 AND (o_orderkey % 2 = 0 OR o_orderpriority = '1-URGENT') AS folds FROM orders""")
def incumbent_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as resolutions of a label."""
    k = F.col("o_orderkey")
    verdict, proposed = F.when(k % 3 < 2, "same").otherwise("distinct"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("5-LOW")).otherwise(F.concat(F.lit("p"), "o_orderstatus"))
    canonical = F.when(k % 2 == 0, "").otherwise("1-URGENT")
    return table(spark, sf_dir, "orders").select("o_orderkey", lookups.folds_onto_incumbent(verdict, F.col("o_orderpriority"), proposed, (k % 20) / 20, canonical).alias("folds"))


@query("""SELECT event_id, event_id % 3 = 0 AS superseded, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS valid_until, event_id % 4 = 0 AS detached, CASE WHEN event_id % 4 = 0 THEN CAST(ts AS DATE) END AS valid_as_of FROM events""")
def validity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims of which some are superseded or detached."""
    n, day = F.col("event_id"), F.col("ts").cast("date")
    return table(spark, sf_dir, "events").select("event_id", lookups.validity(n % 3 == 0, day, n % 4 == 0, day).alias("v")).select("event_id", "v.*")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 6000 WHEN doc_id % 3 = 1 THEN 12000 END, 12000) = 12000 AND coalesce(CASE WHEN doc_id % 2 = 0 THEN 200 END, 0) = 0 AS legacy FROM documents")
def chunking_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks: which were cut under the old policy."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", lookups.uses_chunking(F.when(n % 3 == 0, 6000).when(n % 3 == 1, 12_000), F.when(n % 2 == 0, 200), 12_000, 0).alias("legacy"))


@query("SELECT c_custkey, sha256('Agent' || chr(31) || lower(c_name) || chr(31) || c_mktsegment) AS id FROM customer")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates, spelled in odd ways."""
    title = F.concat(F.lit(" "), F.upper("c_name"), F.lit("  "))
    return table(spark, sf_dir, "customer").select("c_custkey", lookups.candidate_id(F.lit("Agent"), title, F.col("c_mktsegment")).alias("id"))


@query("""SELECT l_orderkey, l_linenumber, sha256('{"block_id":"b' || l_suppkey || '","content_hash":"h","dst_literal":' || CASE WHEN l_linenumber % 2 = 0 THEN '"' || l_shipmode_ || '"' ELSE 'null' END || ',"dst_ref":' || CASE WHEN l_linenumber % 2 = 0 THEN 'null' ELSE '"p' || l_partkey || '"' END || ',"model_id":null,"prompt_hash":null,"src_ref":"o' || l_orderkey || '","type":"contains"}') AS edge_id,
sha256('{"block_id":"b' || l_suppkey || '","byte_end":' || (l_linenumber * 100 + 50) || ',"byte_start":' || (l_linenumber * 100) || ',"content_hash":"h","extraction_fingerprint":"f"}') AS unit_id FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)""")
def ledger_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of lines as edge candidates and as extraction units."""
    name, even, line = (lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))), F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")
    none = F.lit(None).cast("string")
    edge = lookups.json_id(type=F.lit("contains"), src_ref=name("o", "l_orderkey"), dst_ref=F.when(~even, name("p", "l_partkey")), dst_literal=F.when(even, F.col("l_returnflag")), block_id=name("b", "l_suppkey"), content_hash=F.lit("h"), model_id=none, prompt_hash=none)
    unit = lookups.json_id(block_id=name("b", "l_suppkey"), byte_start=line * 100, byte_end=line * 100 + 50, content_hash=F.lit("h"), extraction_fingerprint=F.lit("f"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", edge.alias("edge_id"), unit.alias("unit_id"))


@query("""WITH r AS (SELECT DISTINCT 'v/' || c_nationkey || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '/' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '/' || c_custkey ELSE '' END END AS root FROM customer)
SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE starts_with(r.root, o.root || '/'))""")
def outer_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched folders made of customers: those that lie in no other."""
    k = F.col("c_custkey")
    deep = F.when(k % 3 == 0, F.concat(F.lit("/"), k.cast("string"))).otherwise("")
    tail = F.when(k % 5 == 0, "/").otherwise(F.concat(F.lit("/"), "c_mktsegment", deep))
    return lookups.outer_roots(table(spark, sf_dir, "customer").select(F.concat(F.lit("v/"), F.col("c_nationkey").cast("string"), tail).alias("root")))


# Operators of other modules that had no query yet.
@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'uses' WHEN 1 THEN 'authored_by' WHEN 2 THEN 'own_label' WHEN 3 THEN 'includes' WHEN 4 THEN 'n_a' ELSE 'lives_in' END AS predicate, doc_id % 6 = 4 AS noisy FROM documents")
def normalized_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six spellings of predicates under the core aliases and one of a vault's own."""
    raw = F.element_at(F.array(*(F.lit(x) for x in ("Uses Tool", "written-by", "my label", "has   phase", "N/A", "lives-in"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", C.normalized_predicate(raw, {"my_label": "own_label", "uses_tool": "never"}).alias("predicate"), C.is_noisy_predicate(raw).alias("noisy"))


@query("""SELECT page_id, regexp_matches(trim(t), '(?i)\\.(md|markdown|txt|pdf|html?)$') AS filename, lower(trim(t)) IN ('doc', 'file', 'image', 'link', 'pdf', 'url') AS generic FROM (SELECT page_id, regexp_extract(coalesce(url, ''), '([^/?#]*)$', 1) AS t FROM pages)""")
def title_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last parts of the pages' addresses as titles: file names and generic words."""
    last = F.regexp_extract(C.text_or_empty(F.col("url")), "([^/?#]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", C.is_filename(last).alias("filename"), C.is_generic_title(last).alias("generic"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pt-Latn-BR' WHEN 1 THEN 'en' WHEN 2 THEN NULL WHEN 3 THEN 'es-419' ELSE NULL END AS tag, doc_id % 5 IN (0, 2, 3) AS safe FROM documents""")
def tags_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five spellings of language tags and of paths."""
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", C.bcp47(pick("PT-latn-br", "EN", "english", "es-419", "")).alias("tag"), C.safe_path(pick("a/b.md", "../a", "a", "a/..b", "/etc")).alias("safe"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'supplier ' || s_suppkey WHEN 1 THEN 'supplier ' || s_suppkey ELSE 'inc' END AS base FROM supplier""")
def alias_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with company suffixes, of which a title may be nothing but."""
    k = F.col("s_suppkey")
    title = F.when(k % 3 == 0, F.concat(F.lit("Supplier "), k.cast("string"), F.lit(" Co. Ltd"))).when(k % 3 == 1, F.concat(F.lit("Supplier "), k.cast("string"))).otherwise("Inc Corp Press")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(C.alias_base(title), " ").alias("base"))


@query("""SELECT n_regionkey, substr(sha256(string_agg(n_name, chr(31) ORDER BY n_name)), 1, 16) AS cluster_id FROM nation GROUP BY 1""")
def cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as clusters of nations."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(C.cluster_id(F.collect_list("n_name")).alias("cluster_id"))


@query("""SELECT conv_id, turn, turn % 3 < 2 AND length(trim(x)) <= 200 AND len(list_filter(regexp_split_to_array(trim(x), '[.!?]+'), lambda s: trim(s) <> '')) <= 1 AS trivial, trim(regexp_replace(lower(x), '[^0-9a-z]+', ' ', 'g')) IN ('', trim(regexp_replace(lower(split_part(x, '.', 1)), '[^0-9a-z]+', ' ', 'g'))) AS mention FROM (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations)""")
def prefilters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as candidates: seldom mentioned and short, or saying no more than their first sentence."""
    text = C.text_or_empty(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", consolidate.is_trivial(text, F.col("turn") % 3, 2, 200).alias("trivial"), consolidate.is_re_mention(text, [F.split_part(text, F.lit("."), F.lit(1))]).alias("mention"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'raw' WHEN o_orderpriority = '1-URGENT' THEN 'canonical' END AS demoted FROM orders""")
def demoted_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predicates under a list of two that are demoted."""
    return table(spark, sf_dir, "orders").select("o_orderkey", consolidate.demoted(F.col("o_orderstatus"), F.col("o_orderpriority"), (" f ", "1-Urgent")).alias("demoted"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_brand), lower(p_name)) THEN 50 ELSE 0 END + 5 * len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'))) + len(list_intersect(list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')), regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'))) AS score FROM part""")
def grounding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against a source of their name and brand."""
    return table(spark, sf_dir, "part").select("p_partkey", consolidate.grounding_score(F.col("p_name"), F.col("p_type"), F.concat_ws(" ", "p_name", "p_brand")).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber * 10 >= 15 AND l_linenumber * 10 + l_quantity <= 90 AND l_quantity > 5 AS inside, contains(lower(l_returnflag || l_linestatus), 'n') AND contains(lower(l_returnflag || l_linestatus), 'o') AS answered FROM lineitem""")
def span_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as annotations of a span, and as answers that need two tokens."""
    start, end = F.col("l_linenumber") * 10, F.col("l_linenumber") * 10 + F.col("l_quantity")
    inside = C.within_span(start, end, F.lit(15), F.lit(90)) & (F.col("l_quantity") > 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", inside.alias("inside"), C.contains_all(F.concat("l_returnflag", "l_linestatus"), F.array(F.lit("N"), F.lit("o"))).alias("answered"))


@query("""SELECT plan_id, seq FROM (SELECT o_custkey AS plan_id, o_orderkey AS seq, o_orderstatus, min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS planned FROM orders) WHERE o_orderstatus = 'F' AND (planned IS NULL OR seq < planned)""")
def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as plans and finished ones as receipts: those that come too early."""
    kind = F.when(F.col("o_orderstatus") == "O", "commit_plan").when(F.col("o_orderstatus") == "F", "operation_receipt").otherwise("other")
    return ledger.order_issues(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("seq"), kind.alias("kind")))


@query("""SELECT doc_id, doc_id % 4 <> 1 AND octet_length(encode(coalesce(text, ''))) >= 40 AS current FROM documents""")
def current_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 bytes of each document as its block; a quarter of the files have changed."""
    raw = F.encode(C.text_or_empty(F.col("text")), "utf-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), raw.alias("content"))
    blocks = docs.select("doc_id", "path", F.lit(0).alias("byte_start"), F.lit(40).alias("byte_end"), F.sha2(F.substring("content", 1, 40), 256).alias("content_hash"))
    files = docs.select("path", F.when(F.col("doc_id") % 4 == 1, F.concat(F.encode(F.lit("\x01"), "utf-8"), "content")).otherwise(F.col("content")).alias("content"))
    return ingest.current_blocks(blocks, files).select("doc_id", "current")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND o_orderstatus <> 'O' THEN DATE '2026-01-01' END AS valid_until FROM orders""")
def retired_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims of customers as documents, whose new versions mint the open ones."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.lit(None).cast("date").alias("valid_until"), "o_orderstatus")
    return incremental.retired(rows, rows.where("o_orderstatus = 'O'").select("id", "document_id"), "2026-01-01").select("id", "valid_until")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND contains(lower(c_mktsegment || ' 1-urgent'), lower(o_orderpriority))) THEN DATE '2026-01-01' END AS valid_until FROM orders""")
def resurrected_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended claims that a customer's line says again."""
    ended = F.when(F.col("o_orderstatus") == "P", F.lit("2026-01-01").cast("date"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("o_literal"), ended.alias("valid_until"))
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.concat("c_mktsegment", F.lit(" 1-URGENT")).alias("unit"))
    return incremental.resurrected(rows, units).select("id", "valid_until")


@query("""WITH RECURSIVE pr AS (SELECT 'p' || p_partkey AS a, 'p' || (p_partkey + 5) AS b FROM part WHERE p_partkey % 3 = 0), both_ AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), walk AS (SELECT DISTINCT a AS id, a AS root FROM both_ UNION SELECT b, root FROM walk JOIN both_ ON a = id),
c AS (SELECT id, min(root) AS component FROM walk GROUP BY id), n AS (SELECT 'p' || l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT id AS predicate, first_value(id) OVER (PARTITION BY component ORDER BY coalesce(n, 0) DESC, id) AS canonical FROM c LEFT JOIN n USING (id)""")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as predicates that match exactly in pairs, named by the most frequent."""
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    pairs = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(name(F.col("p_partkey")).alias("a"), name(F.col("p_partkey") + 5).alias("b"))
    counts = table(spark, sf_dir, "lineitem").groupBy(name(F.col("l_partkey")).alias("predicate")).agg(F.count("*").alias("n"))
    return predicates.alias_map(pairs, counts)


@query("""WITH p AS (SELECT CAST(s_suppkey AS VARCHAR) AS a, CAST(s_suppkey + 2 AS VARCHAR) AS b FROM supplier WHERE s_suppkey % 4 < 3), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p) SELECT a AS predicate, min(b) AS inverse, count(*) > 1 AS conflict FROM u GROUP BY a""")
def inverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as predicates with confirmed inverses, some with two."""
    k = F.col("s_suppkey")
    return predicates.inverse_map(table(spark, sf_dir, "supplier").where(k % 4 < 3).select(k.cast("string").alias("a"), (k + 2).cast("string").alias("b")))


@query("""SELECT CASE WHEN b.s_suppkey IS NULL THEN 'missing_artifact' WHEN a.s_suppkey IS NULL THEN 'unexpected_artifact' ELSE 'artifact_mismatch' END AS code, coalesce(a.s_suppkey, b.s_suppkey) AS artifact_id
FROM (SELECT s_suppkey, s_name AS d FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE s_name END AS d FROM supplier WHERE s_suppkey % 4 <> 0) b ON a.s_suppkey = b.s_suppkey WHERE a.d IS DISTINCT FROM b.d""")
def artifact_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as artifacts of a manifest: lost, unknown and changed ones."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    want = rows.where(k % 3 != 0).select(k.alias("id"), F.col("s_name").alias("digest"))
    have = rows.where(k % 4 != 0).select(k.alias("id"), F.when(k % 5 == 0, "x").otherwise(F.col("s_name")).alias("digest"))
    return integrity.manifest_issues(want, have).select("code", "artifact_id")


@query("""SELECT 'c' || (c_custkey // 5 * 5) AS survivor, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS tags FROM customer GROUP BY 1""")
def folded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of five customers on one survivor, put in order for comparison."""
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("c"), c.cast("long").cast("string"))
    rows = table(spark, sf_dir, "customer").select(k.alias("seq"), name(k).alias("id"), F.array("c_mktsegment").alias("tags"))
    into = rows.select("id", name(F.floor(F.col("seq") / 5) * 5).alias("survivor"))
    return consolidate.folded_tags(rows, into).select("survivor", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query()
def node_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document as a node; its bytes aren't in DuckDB's reach, so a test stands for SQL."""
    tagged = _corpus(spark, sf_dir).withColumn("tags", F.array(F.lit("t")))
    return lookups.node_digests(tagged)


@query()
def graph_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of the documents as a graph; made of digests, so a test stands for SQL."""
    return lookups.generation(lookups.node_digests(_corpus(spark, sf_dir).withColumn("tags", F.array(F.lit("t")))))


@query("""WITH n AS (SELECT s_suppkey AS seq, 's' || s_suppkey AS id FROM supplier) SELECT id, CASE WHEN seq % 5 = 0 OR seq % 5 = 2 THEN coalesce((SELECT 's' || min(m.seq) FROM n m WHERE m.seq // 5 = n.seq // 5 AND m.seq % 5 IN (0, 2)), id) ELSE id END AS survivor FROM n""")
def within_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates: of five neighbours two are judged the same, others not surely enough."""
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    rows = table(spark, sf_dir, "supplier").select(k, name(k).alias("id"), k.alias("seq"))
    known = rows.select(F.col("id").alias("b"))
    pairs = rows.where(k % 5 < 2).select(name(k).alias("a"), name(k + 2).alias("b"), F.lit(True).alias("same"), F.when(k % 5 == 0, 0.9).otherwise(0.8).alias("confidence")).join(known, "b", "left_semi")
    return lookups.within_batch(pairs, rows.select("id", "seq"))


@query()
def alias_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names against variants of them; Jaro-Winkler is in Python, so a test stands for SQL."""
    k, title = F.col("s_suppkey"), F.col("s_name")
    variant = F.when(k % 4 == 0, F.concat(title, F.lit(" Ltd"))).when(k % 4 == 1, F.upper(title)).when(k % 4 == 2, F.regexp_replace(title, "u", "uu")).otherwise("Someone Else")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(lookups.alias_score(title, variant), 6).alias("score"))

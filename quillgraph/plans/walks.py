"""Queries that open claims and packs, and that take in edited texts and new vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import embedding
from quillgraph.operators import graph, incremental, ingest, lookups
from quillgraph.plans.registry import query
from quillgraph.runtime import materialise, spread
from quillgraph.sources import packs
from quillgraph.sources.tables import CLAIMS_SQL, EDGES_SQL, NODES_SQL, claims, edges, nodes, table


def _line_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order lines as claims of their part on its supplier, in a block for each year; those of the largest quantity that come first in their order are seeds, their state are the question's terms."""
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))))
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    claims = lines.select("id", name("part:", "l_partkey").alias("s"), F.lower(F.concat(F.lit("is_"), "l_returnflag", F.lit("_"), "l_linestatus")).alias("p"), name("supplier:", "l_suppkey").alias("o_id"), F.lit(None).cast("string").alias("o_literal"), F.round(1 - F.col("l_discount"), 6).alias("confidence"), F.year("l_shipdate").cast("string").alias("block_id"))
    asked = lines.where("l_linenumber = 1 AND l_quantity = 50")
    terms = asked.select(F.col("id").alias("seed"), F.explode(F.array(F.lower("l_returnflag"), F.lower("l_linestatus"))).alias("term"))
    return claims, asked.select(F.col("id").alias("seed")), terms


@query("""WITH c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'part:' || l_partkey AS s, 'supplier:' || l_suppkey AS o, list_distinct(['is', lower(l_returnflag), lower(l_linestatus)]) AS ws, round(1 - l_discount, 6) AS confidence,
  CAST(year(l_shipdate) AS VARCHAR) AS block, l_linenumber = 1 AND l_quantity = 50 AS asked, [lower(l_returnflag), lower(l_linestatus)] AS qs FROM lineitem),
pool AS (SELECT a.id AS seed, a.qs, b.id, b.ws, b.confidence, a.id <> b.id AS sibling FROM c a JOIN c b ON a.asked AND b.block = a.block AND b.s = a.s),
t AS (SELECT seed, id, q FROM (SELECT seed, id, ws, unnest(list_distinct(qs)) AS q FROM pool) WHERE list_contains(ws, q)), df AS (SELECT seed, q, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT seed, count(*) AS n FROM pool GROUP BY seed),
v AS (SELECT seed, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))), 9) AS coverage FROM t JOIN df USING (seed, q) JOIN n USING (seed) GROUP BY ALL),
r AS (SELECT seed, id, coalesce(coverage, 0) AS coverage, row_number() OVER (PARTITION BY seed ORDER BY sibling, coalesce(coverage, 0) DESC, confidence DESC, id) - 1 AS rank FROM pool LEFT JOIN v USING (seed, id))
SELECT seed, id, round(coverage, 6) AS coverage, rank FROM r WHERE rank <= 3""")
def claim_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that are seeds, with at most three siblings of the same part and year that cover most of the question."""
    found = graph.claim_seeds(*_line_claims(spark, sf_dir))
    return found.select("seed", "id", F.round("coverage", 6).alias("coverage"), F.col("rank").cast("long").alias("rank"))


@query()
def claim_ego_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops around each of these claims: its siblings, its part's claims, and those of the suppliers and parts that they name; greedy by levels, so a brute-force test stands for SQL."""
    found = graph.claim_ego_graph(*_line_claims(spark, sf_dir), cap=6, hops=2)
    return found.select("seed", "hop", "id", F.round("coverage", 6).alias("coverage"))


_PACKS_SQL = """e AS (SELECT DISTINCT * FROM (SELECT p_partkey AS pack, p_partkey // 2 AS import FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey * 2 FROM part WHERE p_size = 50 UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_size = 49)),
walk AS (
  SELECT p_partkey AS root, p_partkey AS pack, 0 AS depth, [p_partkey] AS path, CAST(NULL AS VARCHAR) AS fault FROM part UNION ALL
  SELECT w.root, e.import, w.depth + 1, list_append(w.path, e.import), CASE WHEN w.depth + 1 >= 32 THEN 'too_deep' WHEN e.import = w.pack THEN 'self_import' WHEN list_contains(w.path, e.import) THEN 'circular_import'
    WHEN e.import NOT IN (SELECT p_partkey FROM part) THEN 'unknown_pack' END FROM walk w JOIN e ON e.pack = w.pack WHERE w.fault IS NULL)"""


@query(f"""WITH RECURSIVE {_PACKS_SQL} SELECT root, count(DISTINCT pack) FILTER (WHERE fault IS NULL) AS n_packs, max(depth) FILTER (WHERE fault IS NULL) AS depth, arg_min(fault, (depth, path)) FILTER (WHERE fault IS NOT NULL) AS fault FROM walk GROUP BY root""")
def pack_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packs that import the part of half their number; the largest import one of twice theirs as well, the next themselves."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pack"), "p_size")
    half = part.where("pack > 1").select("pack", F.floor(F.col("pack") / 2).cast("long").alias("import"))
    more = part.where("p_size IN (49, 50)").select("pack", F.when(F.col("p_size") == 50, F.col("pack") * 2).otherwise(F.col("pack")).alias("import"))
    return packs.loadable(packs.import_closure(part.select("pack"), half.unionByName(more)))


def edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of all documents, a line for each sentence, before and after an edit that renames a word and adds a line; documents in English had claims."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), "lang", F.regexp_replace(C.text_or_empty(F.col("text")), r"\. ", ".\n").alias("text"))
    after = F.concat(F.regexp_replace("text", "(?m)^(\\w+) (\\w+)", "$2 $1"), F.lit("\nIn "), "lang", F.lit("."))
    edit = F.when(F.length("text") % 3 != 0, after).otherwise(F.col("text"))
    old, new = (ingest.blocks(docs.select("path", F.encode(c, "utf-8").alias("content")), 2000) for c in (F.col("text"), edit))
    told = docs.select("path", (F.col("lang") == "en").alias("has_claims"), edit.alias("whole"))
    raw = lambda df: df.join(told.select("path", F.encode("whole", "utf-8").alias("content")), "path").withColumn("raw", F.expr("substring(content, CAST(byte_start AS INT) + 1, CAST(byte_end - byte_start AS INT))")).drop("content")
    return materialise(old.join(told.select("path", "has_claims"), "path"), "blocks-before"), materialise(raw(new), "blocks-after")


@query()
def edited_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to extract of all documents after an edit; a line diff, so a test that puts the new texts together from the old ones and the units stands for SQL."""
    return incremental.extraction_units(*edited(spark, sf_dir)).select("path", "block_id", "byte_start", "byte_end", "content_hash", "whole")


@query()
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the stub's vector of its whole text, in calls of bounded size; made of digests, so a test stands for SQL."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return embedding.embed_in_batches(docs, most_tokens=20_000).drop("text")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t, regexp_extract(url, '://([^?#]*)', 1) AS path, regexp_extract(url, '://([^/?#]*)', 1) AS root FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '\s*/\s*', '/', 'g'), '^\s+|\s+$', '', 'g') AS bare, CASE WHEN starts_with(path, root || '/') THEN regexp_replace(substr(path, length(root) + 2), '([^/])\.[^/.]+$', '\1') END AS below FROM p)
SELECT page_id, regexp_replace(regexp_replace(coalesce(nullif(regexp_replace(bare, '/+$', ''), ''), bare), '^(?i)the\s+', ''), '^\s+|\s+$', '', 'g') AS canonical,
  coalesce(nullif(below, ''), regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '([^/])\.[^/.]+$', '\1')) AS title FROM b""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's title in canonical shape, as a concept, and its path below its host as the title of a document without front matter."""
    at = lambda pattern: F.regexp_extract("url", pattern, 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("t"), at("://([^?#]*)").alias("path"), at("://([^/?#]*)").alias("root"))
    return pages.select("page_id", C.canonical_title(F.lit("Concept"), F.col("t")).alias("canonical"), C.document_title(F.lit(None).cast("string"), F.col("path"), F.col("root")).alias("title"))


_CANON_SQL = """eq AS (SELECT 'customer:' || c_custkey AS member, 'customer:' || min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier:' || min(s_suppkey) OVER (PARTITION BY s_nationkey) FROM supplier)"""


def _kin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers of one nation and segment are one, as are suppliers of one nation; containing is including, and being placed by or supplied by someone their placing or supplying it."""
    named = lambda t, key, prefix, group: table(spark, sf_dir, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("member_id"), F.concat(F.lit(prefix), F.min(key).over(Window.partitionBy(*group)).cast("string")).alias("canonical_id"))
    kin = named("customer", "c_custkey", "customer:", ["c_nationkey", "c_mktsegment"]).unionByName(named("supplier", "s_suppkey", "supplier:", ["s_nationkey"]))
    made = lambda rows: spark.createDataFrame(rows, "predicate string, canonical string")
    return kin, made([("contains", "includes")]), made([("placed_by", "placed"), ("supplied_by", "supplies")])


@query(f"""WITH {EDGES_SQL}, {_CANON_SQL}, t AS (SELECT CASE type WHEN 'placed_by' THEN 'placed' WHEN 'supplied_by' THEN 'supplies' WHEN 'contains' THEN 'includes' ELSE type END AS type,
  CASE WHEN type IN ('placed_by', 'supplied_by') THEN dst ELSE src END AS src, CASE WHEN type IN ('placed_by', 'supplied_by') THEN src ELSE dst END AS dst FROM edges),
m AS (SELECT DISTINCT type, coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst FROM t LEFT JOIN eq a ON a.member = src LEFT JOIN eq b ON b.member = dst)
SELECT sha256('edge' || chr(31) || src || chr(31) || type || chr(31) || dst) AS id, type, src, dst FROM m WHERE src <> dst""")
def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges between canonical entities, in one direction for each relation."""
    return graph.canonical_edges(edges(spark, sf_dir), *_kin(spark, sf_dir))


@query(f"""WITH {CLAIMS_SQL}, {_CANON_SQL}, t AS (SELECT CASE WHEN p = 'placed_by' THEN 'placed' ELSE p END AS p, CASE WHEN p = 'placed_by' THEN o_id ELSE s END AS s, CASE WHEN p = 'placed_by' THEN s ELSE o_id END AS o_id, o_literal, confidence FROM claims)
SELECT coalesce(a.canonical, s) AS s, p, coalesce(b.canonical, o_id) AS o_id, o_literal, count(*) AS corroboration, max(confidence) AS confidence
FROM t LEFT JOIN eq a ON a.member = s LEFT JOIN eq b ON b.member = o_id GROUP BY ALL""")
def canonical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims on canonical entities, those on an entity turned round, with the number that say the same."""
    return graph.canonical_copy(claims(spark, sf_dir), *_kin(spark, sf_dir)).drop("id")


@query(f"WITH {NODES_SQL}, {_CANON_SQL} SELECT id, type FROM nodes WHERE id NOT IN (SELECT member FROM eq WHERE member <> canonical)")
def canonical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes that no other stands for."""
    return graph.canonical_nodes(nodes(spark, sf_dir).select("id", "type"), _kin(spark, sf_dir)[0])


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, {_CANON_SQL}, a AS (SELECT id, type, title FROM nodes WHERE type = 'Place' OR content IN ('FURNITURE', '1-URGENT')),
b AS (SELECT src AS id, 'out' AS direction, type AS edge_type, dst AS other FROM edges UNION ALL SELECT dst, 'in', type, src FROM edges)
SELECT a.id, a.type, a.title, coalesce(eq.canonical, a.id) AS canonical_id, direction, edge_type, other, n.title AS other_title FROM a LEFT JOIN eq ON eq.member = a.id LEFT JOIN b ON b.id = a.id LEFT JOIN nodes n ON n.id = b.other""")
def node_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, furniture makers and urgent orders with all their edges, the titles at the other end and the node that stands for them."""
    entity = nodes(spark, sf_dir)
    asked = entity.where("type = 'Place' OR content IN ('FURNITURE', '1-URGENT')").select("id")
    return lookups.node_edges(asked, entity, edges(spark, sf_dir), _kin(spark, sf_dir)[0])

"""The warehouse tables as a property graph: nodes, edges and claims, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, read: Callable[[SparkSession, str, str], DataFrame] = table) -> DataFrame:
    """``id, type, title, content``: one node for each region, nation, customer, supplier, part and order; ``read`` gives their tables."""
    kinds = (
        ("region", "Place", "r_regionkey", F.col("r_name"), F.lit("")),
        ("nation", "Place", "n_nationkey", F.col("n_name"), F.lit("")),
        ("customer", "Agent", "c_custkey", F.col("c_name"), F.col("c_mktsegment")),
        ("supplier", "Agent", "s_suppkey", F.col("s_name"), F.lit("")),
        ("part", "Concept", "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type")),
        ("orders", "Activity", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority")),
    )
    out = None
    for name, kind, key, title, content in kinds:
        part = read(spark, sf_dir, name).select(_key(name, key).alias("id"), F.lit(kind).alias("type"), title.alias("title"), content.alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


NODES_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Place' AS type, r_name AS title, '' AS content FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Place', n_name, '' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Agent', c_name, c_mktsegment FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Agent', s_name, '' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Concept', p_name, p_brand || ' ' || p_type FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'Activity', 'order ' || o_orderkey, o_orderpriority FROM orders
)"""


def edges(spark: SparkSession, sf_dir: str, read: Callable[[SparkSession, str, str], DataFrame] = table) -> DataFrame:
    """``id, type, src, dst`` with content-addressed ids, no edge twice."""
    from quillgraph.functions.columns import edge_id

    lines = read(spark, sf_dir, "lineitem")
    kinds = (
        (read(spark, sf_dir, "nation"), "in_region", ("nation", "n_nationkey"), ("region", "n_regionkey")),
        (read(spark, sf_dir, "customer"), "in_nation", ("customer", "c_custkey"), ("nation", "c_nationkey")),
        (read(spark, sf_dir, "supplier"), "in_nation", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
        (read(spark, sf_dir, "orders"), "placed_by", ("orders", "o_orderkey"), ("customer", "o_custkey")),
        (lines, "contains", ("orders", "l_orderkey"), ("part", "l_partkey")),
        (lines, "supplied_by", ("part", "l_partkey"), ("supplier", "l_suppkey")),
    )
    out = None
    for df, kind, src, dst in kinds:
        # no two kinds share an edge, so numbers are made distinct and not names
        part = df.select(src[1], dst[1]).distinct().select(F.lit(kind).alias("type"), _key(*src).alias("src"), _key(*dst).alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "type", "src", "dst")


EDGES_SQL = """
edges0 AS (
  SELECT 'in_region' AS type, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION SELECT 'in_nation', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'in_nation', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'placed_by', 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders
  UNION SELECT 'contains', 'orders:' || l_orderkey, 'part:' || l_partkey FROM lineitem
  UNION SELECT 'supplied_by', 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem
), edges AS (SELECT sha256('edge' || chr(31) || src || chr(31) || type || chr(31) || dst) AS id, type, src, dst FROM edges0)"""


def claims(spark: SparkSession, sf_dir: str, read: Callable[[SparkSession, str, str], DataFrame] = table) -> DataFrame:
    """``id, s, p, o_id, o_literal, confidence, block_id``: literal claims of customers, parts and orders, and one with an object for each order."""
    from quillgraph.functions.columns import sha256_id

    none = F.lit(None).cast("string")
    kinds = (
        (read(spark, sf_dir, "customer"), _key("customer", "c_custkey"), "market segment", none, F.col("c_mktsegment"), F.lit(0.9), _key("block", "c_nationkey")),
        (read(spark, sf_dir, "part"), _key("part", "p_partkey"), "Brand", none, F.col("p_brand"), F.lit(0.8), _key("block", "p_size")),
        (read(spark, sf_dir, "part"), _key("part", "p_partkey"), "label", none, F.col("p_type"), F.lit(0.7), _key("block", "p_size")),
        (read(spark, sf_dir, "orders"), _key("orders", "o_orderkey"), "has status", none, F.col("o_orderstatus"), F.lit(0.7), _key("block", "o_orderpriority")),
        (read(spark, sf_dir, "orders"), _key("orders", "o_orderkey"), "placed_by", _key("customer", "o_custkey"), none, F.lit(0.95), _key("block", "o_orderpriority")),
    )
    out = None
    for df, s, p, o_id, literal, confidence, block in kinds:
        part = df.select(s.alias("s"), F.lit(p).alias("p"), o_id.alias("o_id"), literal.alias("o_literal"), confidence.alias("confidence"), block.alias("block_id"))
        out = part if out is None else out.unionByName(part)
    return out.select(sha256_id(F.lit("claim"), F.col("s"), F.col("p"), F.coalesce("o_id", "o_literal")).alias("id"), "*")


CLAIMS_SQL = """
claims0 AS (
  SELECT 'customer:' || c_custkey AS s, 'market segment' AS p, CAST(NULL AS VARCHAR) AS o_id, c_mktsegment AS o_literal, 0.9::DOUBLE AS confidence, 'block:' || c_nationkey AS block_id FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'Brand', NULL, p_brand, 0.8, 'block:' || p_size FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'label', NULL, p_type, 0.7, 'block:' || p_size FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'has status', NULL, o_orderstatus, 0.7, 'block:' || o_orderpriority FROM orders
  UNION ALL SELECT 'orders:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, NULL, 0.95, 'block:' || o_orderpriority FROM orders
), claims AS (SELECT sha256('claim' || chr(31) || s || chr(31) || p || chr(31) || coalesce(o_id, o_literal)) AS id, * FROM claims0)"""

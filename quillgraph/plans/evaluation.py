"""Queries of evaluation, plans and runs, exports and labels, over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import evaluation, quality
from quillgraph.plans.registry import query
from quillgraph.sources.tables import NODES_SQL, nodes, table


def _name(prefix: str, value):
    return F.concat(F.lit(prefix), value.cast("string"))


# Orders as candidates for entities: a customer's orders are one entity, named by the first of them.
ENTITY_SQL = """o AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders),
op AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || o_orderkey || '!' END AS title, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE o_orderpriority END END AS kind,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE first END AS target FROM o WHERE o_orderkey % 13 <> 0),
t AS (SELECT o_orderkey AS k, coalesce(op.title, 'order ' || o_orderkey) AS title FROM o LEFT JOIN op ON k = o_orderkey),
e AS (SELECT 'o' || o_orderkey AS candidate_id, 'c' || o_custkey AS gold, CASE WHEN op.k IS NULL THEN '__missing__:o' || o_orderkey ELSE 'o' || target END AS predicted, op.k IS NULL AS missing,
  op.k IS NOT NULL AND coalesce(op.kind, o_orderstatus) = o_orderpriority AS type_right, op.k IS NOT NULL AND target = first AS canonical_right,
  CASE WHEN o_orderkey <> first THEN op.k IS NOT NULL AND target = first END AS alias_right, op.k IS NOT NULL AND t.title = 'order ' || first AS title_right
  FROM o LEFT JOIN op ON op.k = o_orderkey LEFT JOIN t ON t.k = op.target)"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    o = orders.join(orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")), "o_custkey")
    truth = o.select(_name("o", k).alias("candidate_id"), _name("c", F.col("o_custkey")).alias("cluster"), F.col("o_orderpriority").alias("kind"), _name("o", F.col("first")).alias("canonical"), _name("order ", F.col("first")).alias("title"))
    proposals = orders.select(_name("o", k).alias("candidate_id"), F.col("o_orderstatus").alias("kind"), _name("order ", k).alias("title"))
    title = F.when(k % 3 == 0, F.concat(_name("order ", k), F.lit("!"))).otherwise("  ")
    kind = F.when(k % 7 != 0, F.when(k % 11 == 0, "other").otherwise(F.col("o_orderpriority")))
    target = F.when(k % 5 != 0, _name("o", F.col("first")))
    said = o.where(k % 13 != 0).select(_name("o", k).alias("candidate_id"), kind.alias("kind"), title.alias("title"), target.alias("target"))
    return evaluation.entity_outcomes(truth, proposals, said)


@query(f"WITH {ENTITY_SQL} SELECT * FROM e")
def entity_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run made of every order as a candidate."""
    return _entities(spark, sf_dir)


@query(f"""WITH {ENTITY_SQL} SELECT count(*) AS labelled, count(*) FILTER (NOT missing) AS observed, round(avg(type_right::INT), 6) AS type_accuracy, round(avg(canonical_right::INT), 6) AS canonical_accuracy,
round(avg(alias_right::INT), 6) AS alias_accuracy, round(avg(title_right::INT), 6) AS title_accuracy FROM e""")
def entity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy over all candidates."""
    return evaluation.entity_metrics(_entities(spark, sf_dir))


@query(f"""WITH {ENTITY_SQL}, c AS (SELECT gold, predicted, count(*) AS n FROM e GROUP BY ALL), x AS (SELECT n, sum(n) OVER (PARTITION BY gold) AS g, sum(n) OVER (PARTITION BY predicted) AS p FROM c),
s AS (SELECT sum(n * n / p) / sum(n) AS p, sum(n * n / g) / sum(n) AS r FROM x) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""")
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-cubed of the clusters that a run made of the orders."""
    return quality.b_cubed(_entities(spark, sf_dir))


@query("""WITH t AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'queue' ELSE 'reject' END AS d, o_orderkey % 3 = 0 AS literal, o_custkey AS c, o_orderkey % 4 <> 0 AS grounded, o_orderkey % 5 <> 0 AS useful,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'queue' WHEN o_orderkey % 19 = 0 THEN 'missing' ELSE CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'queue' ELSE 'supersede' END END AS said FROM orders),
r AS (SELECT *, coalesce(said, 'missing') = d AS decision, k % 8 <> 0 OR said IS NULL AS predicate, k % 10 <> 0 AS kind_right, k % 10 <> 0 AND (k % 9 <> 0 OR said IS NULL) AS value_right,
  (literal OR k % 9 <> 0 OR said IS NULL) AND k % 14 <> 0 AS direction, coalesce(said, '') = 'accept' AS acc, d = 'accept' AS adm FROM t)
SELECT count(*) AS labelled, count(said) AS observed, round(avg(decision::INT), 6) AS decision_accuracy, round(avg(predicate::INT), 6) AS predicate_accuracy, round(avg(kind_right::INT), 6) AS object_kind_accuracy,
round(avg(value_right::INT), 6) AS object_value_accuracy, round(avg(direction::INT), 6) AS direction_accuracy, count(*) FILTER (adm AND acc) AS admission_tp, count(*) FILTER (NOT adm AND acc) AS admission_fp, count(*) FILTER (adm AND NOT acc) AS admission_fn,
count(*) FILTER (grounded AND acc) AS grounding_tp, count(*) FILTER (NOT grounded AND acc) AS grounding_fp, count(*) FILTER (grounded AND NOT acc) AS grounding_fn,
count(*) FILTER (useful AND acc) AS usefulness_tp, count(*) FILTER (NOT useful AND acc) AS usefulness_fp, count(*) FILTER (useful AND NOT acc) AS usefulness_fn FROM r""")
def relation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates for relations to their customers, or to a literal: what a run made of them."""
    k, node = F.col("o_orderkey"), _name("customer:", F.col("o_custkey"))
    literal, text = k % 3 == 0, _name("literal ", F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders")
    wanted = F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "queue").otherwise("reject")
    truth = orders.select(_name("o", k).alias("candidate_id"), wanted.alias("disposition"), F.lit("placed_by").alias("predicate"), F.when(literal, "literal").otherwise("topology").alias("object_kind"), _name("orders:", k).alias("src"),
                          F.when(~literal, node).alias("dst_ref"), F.when(literal, text).alias("dst_literal"), (k % 4 != 0).alias("grounded"), (k % 5 != 0).alias("useful"))
    # a tenth proposes both objects; a fourteenth another source
    first = orders.select(_name("o", k).alias("candidate_id"), F.lit(" placed_by ").alias("type"), F.when(k % 14 == 0, "else").otherwise(_name("orders:", k)).alias("src_ref"),
                          F.when(~literal | (k % 10 == 0), node).alias("dst_ref"), F.when(literal | (k % 10 == 0), text).alias("dst_literal"))
    usual = F.when(F.col("o_orderstatus") == "F", "create_edge_or_claim").when(F.col("o_orderstatus") == "O", "queue_review").otherwise("supersede_candidate")
    operation = F.when(k % 6 == 0, "queue_review").when(k % 19 == 0, "unheard_of").otherwise(usual)
    wrong = k % 9 == 0
    said = orders.where(k % 17 != 0).select(_name("o", k).alias("candidate_id"), operation.alias("operation"), F.when(k % 8 == 0, "other").alias("type"), F.lit(None).cast("string").alias("src_ref"),
                                            F.when(wrong & ~literal, "customer:none").alias("dst_ref"), F.when(wrong & literal, "else").alias("dst_literal"))
    return evaluation.relation_metrics(truth, first, said)


@query("""WITH r AS (SELECT bool_or(l_quantity > 40)::INT - bool_or(l_returnflag = 'R')::INT AS d FROM lineitem GROUP BY l_orderkey), n AS (SELECT count(*) AS n, count(*) FILTER (d < 0) AS less, count(*) FILTER (d = 0) AS none FROM r),
s AS (SELECT i, j, n, less, none, ('0x' || substr(md5('7:' || i || ':' || j), 1, 15))::BIGINT % n AS u FROM n, range(200) a(i), LATERAL (SELECT unnest(range(n)) AS j)),
m AS (SELECT i, sum(CASE WHEN u < less THEN -1 WHEN u < less + none THEN 0 ELSE 1 END) / any_value(n) AS mean FROM s GROUP BY i) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two arms over all orders with lines."""
    arms = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max((F.col("l_quantity") > 40).cast("int")) - F.max((F.col("l_returnflag") == "R").cast("int"))).alias("d"))
    return evaluation.bootstrap_ci(arms, "d", iters=200)


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity + l_tax * 100 + l_discount * 100) - greatest(l_quantity, l_tax * 100, l_discount * 100) - least(l_quantity, l_tax * 100, l_discount * 100) AS middle FROM lineitem")
def middle_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle one of three figures of each line."""
    middle = evaluation.median_of_three(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", middle.alias("middle"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of recall costs; some are faulty."""
    k, v = F.col("event_id"), F.abs("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(k % 101 == 0, "v0").otherwise("recall_cost.v1").alias("schema_version"),
        F.when(k % 103 == 0, "not_measured").when(k % 2 == 0, "measured").when(k % 107 == 0, "odd").alias("measurement_status"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("completion_calls"),
        F.when(k % 109 == 0, -1).otherwise(0).alias("generated_tokens"),
        F.lit(1).alias("query_embedding_calls"),
        (k % 20).alias("retrieved_results"),
        F.when(k % 113 != 0, k % 4096).alias("retrieved_bytes"),
        *(v.alias(c) for c in evaluation.RECALL_TIMES),
        F.lit("p").alias("query_embedding_provider"),
        F.when(k % 127 == 0, "  ").otherwise("m").alias("query_embedding_model"),
        F.when(k % 131 == 0, "cloud").otherwise("local").alias("query_embedding_execution"),
        F.when(k % 137 != 0, k % 25 != 0).alias("completion_free"),
    )


FAULT_SQL = """f AS (SELECT event_id, abs(value) AS v, event_id % 10 = 0 OR event_id % 25 = 0 AS broken, CASE WHEN event_id % 101 = 0 THEN 'schema_version' WHEN event_id % 103 = 0 THEN 'not_measured' WHEN event_id % 2 = 1 AND event_id % 107 = 0 THEN 'measurement_status'
  WHEN event_id % 109 = 0 THEN 'generated_tokens' WHEN event_id % 113 = 0 THEN 'retrieved_bytes' WHEN value IS NULL THEN 'query_embedding_latency_ms' WHEN event_id % 127 = 0 THEN 'query_embedding_model' WHEN event_id % 131 = 0 THEN 'query_embedding_execution'
  WHEN event_id % 137 = 0 THEN 'completion_free' END AS fault FROM events)"""


@query(f"WITH {FAULT_SQL} SELECT coalesce(fault, '') AS fault, count(*) AS n FROM f GROUP BY 1")
def recall_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of recall costs by what is wrong with them."""
    return _samples(spark, sf_dir).groupBy(F.coalesce(evaluation.recall_fault(), F.lit("")).alias("fault")).agg(F.count("*").alias("n"))


@query(f"""WITH {FAULT_SQL} SELECT count(*) AS provided, count(*) AS measured, 'measured' AS status, sum((event_id % 10 = 0)::INT)::BIGINT AS calls_total, max((event_id % 10 = 0)::INT) AS calls_max, 0::BIGINT AS tokens_total, count(*) FILTER (broken) AS violations,
quantile_disc(v, 0.5) AS total_latency_ms_p50, quantile_disc(v, 0.95) AS total_latency_ms_p95, quantile_disc(v, 0.5) AS deterministic_retrieval_latency_ms_p50, quantile_disc(v, 0.95) AS deterministic_retrieval_latency_ms_p95 FROM f WHERE fault IS NULL""")
def recall_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures over the samples that can be counted."""
    return evaluation.recall_layer(_samples(spark, sf_dir).where(evaluation.recall_fault().isNull()))


GATE_CODES = (*evaluation.REBUILD_CODES, "unheard_of", "unknown")


@query(f"""WITH names(i, code) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(GATE_CODES))}), c AS (SELECT code, CASE WHEN n_nationkey % 5 = 1 THEN 'unmeasured' ELSE 'passed' END AS status FROM nation JOIN names ON i = n_nationkey WHERE n_nationkey <> 4
  UNION ALL SELECT code, 'passed' FROM region JOIN names ON i = r_regionkey * 4 + 2),
f AS (SELECT code, count(*) AS n, max(status) AS status FROM c GROUP BY code), w AS (SELECT code, n, coalesce(status, 'missing') AS status, coalesce(n = 1 AND status = 'passed', false) AS ok FROM names LEFT JOIN f USING (code) WHERE i < {len(evaluation.REBUILD_CODES)})
SELECT code, ok, status AS source_status, CASE WHEN ok THEN NULL WHEN n > 1 THEN 'duplicate' WHEN n IS NULL THEN 'missing' ELSE 'status ' || status END AS reason FROM w""")
def rebuild_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered checks against a report with a missing, doubled and unknown ones."""
    code = F.element_at(F.array(*map(F.lit, GATE_CODES)), F.col("i").cast("int") + 1)
    first = table(spark, sf_dir, "nation").where(f"n_nationkey <> 4 AND n_nationkey < {len(GATE_CODES)}").select(F.col("n_nationkey").alias("i"), F.when(F.col("n_nationkey") % 5 == 1, "unmeasured").otherwise("passed").alias("status"))
    again = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 4 + 2).alias("i"), F.lit("passed").alias("status")).where(f"i < {len(GATE_CODES)}")
    return evaluation.gate_checks(first.unionByName(again).select(code.alias("code"), "status", F.lit(None).cast("string").alias("reason")))


@query("""WITH r AS (SELECT o_custkey AS run, o_orderkey AS seq, o_orderkey % 4 AS kind, o_orderkey % 4 = 0 AND o_orderpriority = '1-URGENT' AS gone, o_orderstatus, o_totalprice FROM orders),
g AS (SELECT run, arg_max(o_orderstatus, CASE WHEN kind = 0 AND NOT gone THEN seq END) AS model, arg_max(o_totalprice > 60000, CASE WHEN kind = 1 THEN seq END) AS good, min(CASE WHEN kind = 1 THEN seq END) AS place,
  bool_or(kind = 2 AND o_totalprice > 100000) AS closed, bool_or(kind = 3) AS planned, bool_or(gone) AS gone FROM r GROUP BY run)
SELECT 'r' || run AS run_id, place FROM g WHERE model = 'O' AND good AND closed AND planned AND NOT gone""")
def completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs whose orders are records: those whose decisions may be used again."""
    k = F.col("o_orderkey")
    kind = F.when((k % 4 == 0) & (F.col("o_orderpriority") == "1-URGENT"), "plan_abandoned").otherwise(F.element_at(F.array(*map(F.lit, ("ingest_run", "ingest_run", "commit_record", "commit_plan"))), (k % 4 + 1).cast("int")))
    dear, whole = F.col("o_totalprice") > 60000, F.when(k % 4 == 2, F.col("o_totalprice") > 100000).otherwise(F.lit(True))
    records = table(spark, sf_dir, "orders").select(_name("r", F.col("o_custkey")).alias("run_id"), k.alias("seq"), kind.alias("kind"), F.when(k % 4 == 0, "started").when(k % 4 == 1, "completed").alias("state"), F.when(dear, "complete").alias("quality"),
                                                    whole.alias("receipts_complete"), F.lit(1).alias("receipts"), F.col("o_orderstatus").alias("model"), F.lit("p1").alias("policy"), F.lit("p1").alias("post_policy"))
    return evaluation.completed_runs(records, {"model": "O", "policy": "p1"})


@query("""WITH p AS (SELECT o_orderkey AS plan, o_custkey AS run, o_orderpriority AS hash, o_orderkey * 100 AS seq, o_orderstatus AS st, o_orderkey AS k FROM orders),
op AS (SELECT l_orderkey AS plan, l_linenumber AS o, count(*) AS n, min(l_returnflag) AS meant FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey AS plan, l_linenumber AS o, l_orderkey * 100 + l_linenumber AS seq, meant, CASE WHEN l_tax > 0.065 THEN 'x' ELSE l_returnflag END AS operation, CASE WHEN l_discount > 0.085 THEN 'failed' WHEN l_discount > 0.065 THEN 'odd' ELSE 'applied' END AS status
  FROM lineitem JOIN p ON plan = l_orderkey LEFT JOIN op ON op.plan = l_orderkey AND o = l_linenumber WHERE l_quantity > 5),
kn AS (SELECT plan, count(*) AS n_receipts, max(last) AS last, bool_or(failed) AS failed FROM (SELECT plan, o, max(seq) AS last, bool_or(status = 'failed') AS failed FROM r GROUP BY ALL) GROUP BY plan),
s AS (SELECT p.*, coalesce(n_ops, 0) AS n_ops, coalesce(n_receipts, 0) AS n_receipts, last, failed FROM p LEFT JOIN (SELECT plan, count(*) AS n_ops FROM op GROUP BY plan) USING (plan) LEFT JOIN kn USING (plan)),
i AS (SELECT plan, o, 'invalid_receipt' AS code FROM r WHERE operation <> meant UNION ALL SELECT plan, o, 'invalid_receipt_status' FROM r WHERE status = 'odd' UNION ALL SELECT plan, o, 'duplicate_receipt' FROM r GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT plan, o, 'duplicate_operation_id' FROM op WHERE n > 1 AND plan IN (SELECT plan FROM p)
  UNION ALL SELECT plan, NULL, 'commit_hash_mismatch' FROM s WHERE st = 'F' AND k % 10 = 0 UNION ALL SELECT plan, NULL, 'commit_of_incomplete_plan' FROM s WHERE st = 'F' AND n_ops <> n_receipts
  UNION ALL SELECT plan, NULL, 'commit_before_receipt' FROM s WHERE st = 'F' AND last >= k * 100 + CASE WHEN k % 9 = 0 THEN 3 ELSE 50 END UNION ALL SELECT plan, NULL, 'commit_of_failed_plan' FROM s WHERE st = 'F' AND failed
  UNION ALL SELECT plan, NULL, 'commit_without_evidence' FROM s WHERE st = 'F' AND (k % 11 = 0 OR n_ops <> 3)
  UNION ALL SELECT plan, NULL, 'abandoned_run_mismatch' FROM s WHERE st = 'P' AND k % 4 = 0 UNION ALL SELECT plan, NULL, 'abandoned_before_plan' FROM s WHERE st = 'P' AND k % 6 = 0
  UNION ALL SELECT plan, NULL, 'abandoned_with_receipts' FROM s WHERE st = 'P' AND k % 2 = 1 AND n_receipts > 0 UNION ALL SELECT plan, NULL, 'abandoned_without_reason' FROM s WHERE st = 'P' AND k % 7 = 0)
SELECT plan AS plan_id, o AS operation_id, code FROM i""")
def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sealed plans, their lines as operations and receipts; finished ones are committed, pending ones abandoned."""
    orders, lines, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), F.col("o_orderkey")
    plans = orders.select(k.alias("plan_id"), F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("plan_hash"), (k * 100).alias("seq"))
    operations = lines.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("operation_id"), F.col("l_returnflag").alias("operation"))
    status = F.when(F.col("l_discount") > 0.085, "failed").when(F.col("l_discount") > 0.065, "odd").otherwise("applied")
    receipts = lines.where("l_quantity > 5").join(orders, F.col("l_orderkey") == k).select(k.alias("plan_id"), F.col("l_linenumber").alias("operation_id"), F.when(F.col("l_tax") > 0.065, "x").otherwise(F.col("l_returnflag")).alias("operation"),
                                                                                           F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("plan_hash"), status.alias("status"), (k * 100 + F.col("l_linenumber")).alias("seq"))
    commits = orders.where("o_orderstatus = 'F'").select(k.alias("plan_id"), F.when(k % 10 == 0, "x").otherwise(F.col("o_orderpriority")).alias("plan_hash"), (k * 100 + F.when(k % 9 == 0, 3).otherwise(50)).alias("seq"), (k % 11 != 0).alias("receipts_complete"), F.lit(3).alias("receipts"))
    gone = orders.where("o_orderstatus = 'P'").select(k.alias("plan_id"), (F.col("o_custkey") + F.when(k % 4 == 0, 1).otherwise(0)).alias("run_id"), F.col("o_orderpriority").alias("plan_hash"), (k * 100 + F.when(k % 6 == 0, -1).otherwise(60)).alias("seq"),
                                                      F.when(k % 7 == 0, " ").otherwise("r").alias("reason"), (k % 2 == 0).alias("force_partial"))
    return evaluation.plan_issues(plans, operations, receipts, commits, gone)


@query("""SELECT user_id, 'event_type' AS field, event_type AS key, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL UNION ALL SELECT user_id, 'size', CASE WHEN value > 50 THEN 'large' ELSE 'small' END, count(*) FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: their events by kind and size."""
    events = table(spark, sf_dir, "events").withColumn("size", F.when(F.col("value") > 50, "large").when(F.col("value").isNotNull(), "small"))
    return evaluation.run_progress(events, "user_id", ["event_type", "size"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def export_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes of customers as documents: of two types, some documents, and not before a day."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))
    documents = table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("document_id"))
    return evaluation.scoped(rows, ["1-URGENT", "2-HIGH"], documents, "1996-01-01").select("id")


@query(f"WITH {NODES_SQL}, a AS (SELECT DISTINCT 'part:' || (l_partkey + 50) AS id FROM lineitem) SELECT id, type, title, nodes.id IS NOT NULL AS found FROM a LEFT JOIN nodes USING (id)")
def nodes_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes asked for by id, some of which don't exist."""
    asked = table(spark, sf_dir, "lineitem").select(_name("part:", F.col("l_partkey") + 50).alias("id"))
    return evaluation.by_ids(nodes(spark, sf_dir), asked).select("id", "type", "title", "found")


@query("""WITH t AS (SELECT p_partkey AS k, p_size % 3 AS type, p_name AS title, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part), pool AS (SELECT DISTINCT type, w[1] AS token, title FROM t WHERE len(w) > 1),
f AS (SELECT type, token, string_agg(title, ';' ORDER BY title) AS names FROM (SELECT *, row_number() OVER (PARTITION BY type, token ORDER BY title) AS i FROM pool) WHERE i <= 3 GROUP BY ALL)
SELECT a.k AS a, b.k AS b, a.w[1] AS token, coalesce(names, '') AS names FROM t a JOIN t b ON b.k = a.k + 1 AND a.w[1] = b.w[1] LEFT JOIN f ON f.type = a.type AND f.token = a.w[1]""")
def competing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring parts that open on the same word, with other names that do."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 3).alias("type"), F.col("p_name").alias("title"))
    pairs = parts.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), "type", F.col("title").alias("a_title")).join(parts.select(F.col("k").alias("b"), F.col("title").alias("b_title")), "b")
    return evaluation.competing_names(pairs, parts).select("a", "b", "token", F.array_join("names", ";").alias("names"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), d AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 10 AS b FROM orders) SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE (d.a = p.a AND d.b = p.b) OR (d.a = p.b AND d.b = p.a))""")
def undecided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that no earlier decision, in either order, holds apart."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return evaluation.undecided(pairs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 10).alias("b")))


@query("SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN '/srv/vault/' || substr(url, strpos(url, '://') + 3) ELSE url END AS path FROM pages")
def relocated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages as paths below another root."""
    return table(spark, sf_dir, "pages").select("page_id", evaluation.relocated_path(F.col("url"), "://", "/srv/vault/").alias("path"))


@query("""WITH l AS (SELECT p_brand AS id, CASE WHEN p_size % 2 = 0 THEN 'pref' ELSE 'alt' END AS field, CASE p_size % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'en' WHEN 2 THEN 'pt-BR' ELSE CASE WHEN p_size % 3 = 0 THEN '!x_y' ELSE 'pt-BR' END END AS lang, CASE WHEN p_size = 7 THEN ' ' ELSE p_type END AS label FROM part),
c AS (SELECT id, field, lang, label, count(*) AS n FROM l GROUP BY ALL)
SELECT id, field, lang, label, 'lang_invalid_bcp47' AS code FROM c WHERE lang = '!x_y' UNION ALL SELECT id, field, lang, label, 'label_empty' FROM c WHERE trim(label) = '' UNION ALL SELECT id, field, lang, label, 'label_duplicate_in_lang' FROM c WHERE n > 1 AND lang <> '!x_y'
UNION ALL SELECT id, 'alt', lang, label, 'label_pref_alt_overlap' FROM c WHERE lang <> '!x_y' GROUP BY id, lang, label HAVING count(*) > 1""")
def label_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts as labels of their brand in several languages: faulty ones."""
    size = F.col("p_size")
    lang = F.when(size % 4 == 0, "EN").when(size % 4 == 1, "en").when(size % 4 == 2, "pt-br").otherwise(F.when(size % 3 == 0, "x_y").otherwise("PT-BR"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.when(size % 2 == 0, "pref").otherwise("alt").alias("field"), lang.alias("lang"), F.when(size == 7, " ").otherwise(F.col("p_type")).alias("label"))
    return evaluation.label_issues(rows)

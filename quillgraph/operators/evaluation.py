"""Evaluation against labelled truth, sealed plans and runs of a ledger, recall costs, export scopes, and checks of labels.

Everything is joined on ids and tallied with partial aggregates. A null counts as a missing value throughout; empty
inputs give empty results, or one row of zeros where a single row of figures is promised.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C

# Names and codes that must agree with existing ledgers and reports.
RECEIPT_STATUSES = ("applied", "already_present", "dead_lettered", "failed", "aborted")
DISPOSITIONS = {"create_edge_or_claim": "accept", "queue_review": "queue", "dead_letter": "reject", "supersede_candidate": "supersede"}
REBUILD_CODES = (
    "complete_store_scan",
    "closed_primitive_set",
    "claim_object_shape",
    "placeholder_predicates",
    "claim_source_anchors",
    "claim_bridge_materialization",
    "claim_provenance_materialization",
    "live_relation_endpoints",
    "relation_materialization",
    "topology_claim_coverage",
    "registered_predicates",
)
RECALL_COUNTS = ("completion_calls", "generated_tokens", "query_embedding_calls", "retrieved_results", "retrieved_bytes")
RECALL_TIMES = ("query_embedding_latency_ms", "deterministic_retrieval_latency_ms", "deterministic_projection_latency_ms", "total_latency_ms")
RECALL_NAMES = ("query_embedding_provider", "query_embedding_model", "query_embedding_execution")
COMPETING_NAMES = 3


def _filled(value: Column) -> Column:
    """Text without white space around it; null if nothing is left."""
    bare = F.trim(value)
    return F.when(bare != "", bare)


def _share(right: Column) -> Column:
    """Share of true rows among those that aren't null, to six places; null without any."""
    return F.round(F.avg(right.cast("int")), 6)


def _issues(rows: DataFrame, keep: Sequence[str], **found: Column) -> DataFrame:
    """One row for each issue that holds: the kept columns and its ``code``."""
    codes = F.array(*(F.when(hit, F.lit(code)) for code, hit in found.items()))
    return rows.select(*keep, F.explode(F.array_compact(codes)).alias("code"))


def entity_outcomes(truth: DataFrame, proposals: DataFrame, operations: DataFrame) -> DataFrame:
    """``candidate_id, gold, predicted, missing, type_right, canonical_right, alias_right, title_right`` for each labelled candidate.

    ``truth(candidate_id, cluster, kind, canonical, title)`` is met with ``proposals(candidate_id, kind, title)`` and
    ``operations(candidate_id, kind, title, target)``, each id at most once. A candidate without an operation is a
    cluster of its own and wrong in all else; one without a target stands for itself. ``alias_right`` is null for
    candidates that are their own canonical one. ``gold`` and ``predicted`` fit ``quality.b_cubed`` and ``pairwise_clusters``.
    """
    said = operations.select("candidate_id", F.lit(True).alias("known"), _filled(F.col("kind")).alias("op_kind"), _filled(F.col("title")).alias("op_title"), F.coalesce(_filled(F.col("target")), "candidate_id").alias("to"))
    both = proposals.select("candidate_id", _filled(F.col("kind")).alias("kind0"), F.col("title").alias("title0")).join(said, "candidate_id", "full_outer")
    titles = both.select(F.col("candidate_id").alias("to"), F.coalesce("op_title", "title0", F.lit("")).alias("to_title"))
    rows = truth.join(both, "candidate_id", "left").join(titles, "to", "left")
    known = F.coalesce("known", F.lit(False))
    canonical = known & F.coalesce(F.col("to") == F.col("canonical"), F.lit(False))
    return rows.select(
        "candidate_id",
        F.col("cluster").alias("gold"),
        F.when(known, F.col("to")).otherwise(F.concat(F.lit("__missing__:"), "candidate_id")).alias("predicted"),
        (~known).alias("missing"),
        (known & F.coalesce(F.coalesce("op_kind", "kind0") == F.col("kind"), F.lit(False))).alias("type_right"),
        canonical.alias("canonical_right"),
        F.when(F.col("candidate_id") != F.col("canonical"), canonical).alias("alias_right"),
        (known & F.coalesce(F.col("to_title") == F.col("title"), F.lit(False))).alias("title_right"),
    )


def entity_metrics(outcomes: DataFrame) -> DataFrame:
    """One row: labelled and observed candidates, and the shares that are right in type, canonical one, alias and title."""
    names = ("type", "canonical", "alias", "title")
    return outcomes.agg(F.count("*").alias("labelled"), F.count_if(~F.col("missing")).alias("observed"), *(_share(F.col(f"{n}_right")).alias(f"{n}_accuracy") for n in names))


def relation_metrics(truth: DataFrame, proposals: DataFrame, operations: DataFrame) -> DataFrame:
    """One row: coverage, shares of right decisions, predicates, object kinds, values and directions, and hits and misses of acceptance.

    ``truth(candidate_id, disposition, predicate, object_kind, src, dst_ref, dst_literal, grounded, useful)``;
    ``proposals`` and ``operations`` have ``candidate_id, type, src_ref, dst_ref, dst_literal``, the latter ``operation`` too,
    and what an operation states goes before its proposal. An object is a node or a literal; both or neither is invalid.
    """
    fields = ("type", "src_ref", "dst_ref", "dst_literal")
    op = operations.select("candidate_id", "operation", *(F.col(f).alias(f"op_{f}") for f in fields))
    first = proposals.select("candidate_id", *(F.col(f).alias(f"first_{f}") for f in fields))
    rows = truth.join(first, "candidate_id", "left").join(op.withColumn("known", F.lit(True)), "candidate_id", "left")
    now = {f: _filled(F.coalesce(f"op_{f}", f"first_{f}")) for f in fields}
    decided = F.coalesce(C.mapped(F.col("operation"), DISPOSITIONS), F.lit("missing"))
    decided = F.when(F.col("operation").isin(*DISPOSITIONS), decided).otherwise("missing")
    kind = F.when(now["dst_ref"].isNotNull() & now["dst_literal"].isNull(), "topology").when(now["dst_literal"].isNotNull() & now["dst_ref"].isNull(), "literal").otherwise("invalid")
    same_node, same_literal = now["dst_ref"].eqNullSafe(F.col("dst_ref")), now["dst_literal"].eqNullSafe(F.col("dst_literal"))
    rows = rows.select(
        F.coalesce("known", F.lit(False)).alias("known"),
        (decided == F.col("disposition")).alias("decision"),
        F.coalesce(now["type"] == F.col("predicate"), F.lit(False)).alias("predicate"),
        (kind == F.col("object_kind")).alias("object_kind"),
        (same_node & same_literal).alias("object_value"),
        (now["src_ref"].eqNullSafe(F.col("src")) & (same_node | (F.col("object_kind") != "topology"))).alias("direction"),
        (decided == "accept").alias("accepted"),
        (F.col("disposition") == "accept").alias("admission"),
        F.col("grounded").alias("grounding"),
        F.col("useful").alias("usefulness"),
    )
    shares = [_share(F.col(c)).alias(f"{c}_accuracy") for c in ("decision", "predicate", "object_kind", "object_value", "direction")]
    cells = []
    for c in ("admission", "grounding", "usefulness"):
        wanted, got = F.col(c), F.col("accepted")
        cells += [F.count_if(wanted & got).alias(f"{c}_tp"), F.count_if(~wanted & got).alias(f"{c}_fp"), F.count_if(wanted & ~got).alias(f"{c}_fn")]
    return rows.agg(F.count("*").alias("labelled"), F.count_if("known").alias("observed"), *shares, *cells)


def bootstrap_ci(diffs: DataFrame, value: str, iters: int = 1000, seed: int = 7, conf: float = 0.95) -> DataFrame:
    """``low, high``: seeded paired bootstrap of the mean of differences that are -1, 0 or 1; zeros without any.

    Draw ``j`` of sample ``i`` is a hash of seed, ``i`` and ``j``, so that any partitioning gives the same interval.
    Draws pick from the counts of the three values, hence no rows are joined; all draws are one range of numbers, dealt out
    evenly, of which each task sums its own, and ``iters`` sums are what is shuffled.
    """
    spark = diffs.sparkSession
    n, less, none = diffs.agg(F.count(value), F.count_if(F.col(value) < 0), F.count_if(F.col(value) == 0)).first()
    size = F.lit(max(n, 1)).cast("long")
    draws = spark.range(iters * n).select(F.expr(f"id div {max(n, 1)}").alias("i"), (F.col("id") % size).alias("j"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string"))), 1, 15), 16, 10).cast("long") % size
    drawn = F.when(place < less, -1).when(place < less + none, 0).otherwise(1)
    means = draws.groupBy("i").agg((F.sum(drawn) / size).alias("mean"))
    edge = (1 - conf) / 2
    return means.agg(*(F.round(F.coalesce(F.percentile("mean", F.lit(q)), F.lit(0.0)), 6).alias(name) for name, q in (("low", edge), ("high", 1 - edge))))


#: Quantiles of the normal distribution for a two-sided 5 % and a power of 80 %. Fixed values.
Z_ALPHA, Z_BETA = 1.95996, 0.84162


def detectable_share(discordant: int) -> float | None:
    """The share of discordant pairs that must favour one arm to be told from a half with 80 % power; None if no share can be."""
    if discordant <= 0:
        return None
    # sqrt(n) u = a + z sqrt(1/4 - u^2) for u = share - 1/2, a quadratic
    a, root = Z_ALPHA / 2, math.sqrt(discordant)
    u = (a * root + math.sqrt(a * a * discordant - (discordant + Z_BETA**2) * (a * a - Z_BETA**2 / 4))) / (discordant + Z_BETA**2) if discordant > 4 * a * a else 1.0
    return 0.5 + u if u < 0.5 else None


def needed_pairs(delta: float, discordance: float) -> float | None:
    """Pairs in all that tell a difference of ``delta`` at this share of discordant pairs; None if it can't be that large."""
    if discordance <= 0 or delta <= 0:
        return None
    share = 0.5 + delta / (2 * discordance)
    return ((Z_ALPHA / 2 + Z_BETA * math.sqrt(share * (1 - share))) / (share - 0.5)) ** 2 / discordance if share < 1 else None


def exact_mcnemar(only_a: int, only_b: int) -> float:
    """Exact two-sided p of discordant counts, summed in logarithms, so that counts of any size take time in proportion to them."""
    n, k = only_a + only_b, min(only_a, only_b)
    if n == 0:
        return 1.0
    top = math.lgamma(n + 1)
    logs = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(max(0, k - 100_000), k + 1)]  # terms further from the middle vanish
    most = max(logs)
    return min(1.0, 2 * math.exp(most) * math.fsum(math.exp(x - most) for x in logs))


def compare_arms(a: DataFrame, b: DataFrame, *, alpha: float = 0.05, material: float = 0.05, iters: int = 1000, seed: int = 7) -> dict[str, object]:
    """Whether arm ``b`` answers more questions right than ``a`` (both ``query_id, correct``): counts, tests, interval and verdict over the questions that both have.

    The verdict is ``REAL`` if the difference is above 0, significant, as large as the sample can tell, outside of an interval around 0, and ``material``; else ``directional, not proven`` or
    ``no improvement``, with the conditions that failed. ``escalate`` and ``confirm_n`` say whether a larger sample would settle it, and how large.

    * Null answers are wrong; of rows that repeat a question one right answer counts. No question in common is an error.
    * Only the four counts and the interval reach the driver.
    """
    right = lambda df, c: df.where("query_id IS NOT NULL").groupBy("query_id").agg(F.max(F.coalesce("correct", F.lit(False)).cast("int")).alias(c))
    both = right(a, "x").join(right(b, "y"), "query_id").select("x", "y", (F.col("y") - F.col("x")).alias("d"))
    cells = {(r["x"], r["y"]): r["count"] for r in both.groupBy("x", "y").count().collect()}
    n = sum(cells.values())
    if not n:
        raise ValueError("the arms have no question in common")
    only_a, only_b = cells.get((1, 0), 0), cells.get((0, 1), 0)
    odd, delta = only_a + only_b, (only_b - only_a) / n
    share = detectable_share(odd)
    least = None if share is None else odd / n * (2 * share - 1)
    p = exact_mcnemar(only_a, only_b)
    low, high = bootstrap_ci(both, "d", iters, seed).first()
    conditions = {"directional": delta > 0, "significant": p < alpha, "powered": least is not None and abs(delta) >= least, "ci_excludes_zero": low > 0 or high < 0, "material": abs(delta) >= material}
    verdict = "REAL" if all(conditions.values()) else "no improvement" if delta <= 0 else "directional, not proven"
    aim = max(abs(delta), material)
    return {
        "n": n, "both": cells.get((1, 1), 0), "only_a": only_a, "only_b": only_b, "neither": cells.get((0, 0), 0), "delta": delta, "exact_p": p, "chi2": (abs(only_b - only_a) - 1) ** 2 / odd if odd else None,
        "mde": least, "low": low, "high": high, "conditions": conditions, "failed": [c for c, ok in conditions.items() if not ok], "verdict": verdict, "escalate": delta > 0 and not conditions["powered"], "confirm_n": needed_pairs(aim, odd / n),
    }


def median_of_three(a: Column, b: Column, c: Column) -> Column:
    """The middle one of three samples; null if one is."""
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.array_sort(F.array(a, b, c))[1])


def recall_fault() -> Column:
    """Why a sample of recall costs can't be counted, the first reason of these; null if it can."""
    status = F.col("measurement_status")
    fault = F.when(~F.col("schema_version").eqNullSafe("recall_cost.v1"), "schema_version").when(status == "not_measured", "not_measured")
    fault = fault.when(status.isNotNull() & (status != "measured"), "measurement_status")
    for name in (*RECALL_COUNTS, *RECALL_TIMES):
        fault = fault.when(F.coalesce(F.col(name) < 0, F.lit(True)), name)
    for name in RECALL_NAMES:
        fault = fault.when(_filled(F.col(name)).isNull(), name)
    return fault.when(~F.col("query_embedding_execution").isin("local", "remote"), "query_embedding_execution").when(F.col("completion_free").isNull(), "completion_free")


def recall_layer(samples: DataFrame) -> DataFrame:
    """One row over samples of recall costs: provided, measured, calls and tokens, violations, latencies by nearest rank.

    One sample that can't be counted leaves the whole layer unmeasured, as do none at all: its figures are null then.
    """
    rows = samples.withColumn("__fault", recall_fault())
    broken = (F.col("completion_calls") != 0) | (F.col("generated_tokens") != 0) | ~F.col("completion_free")
    rank = lambda name, q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {name})")
    figures = {"calls_total": F.sum("completion_calls"), "calls_max": F.max("completion_calls"), "tokens_total": F.sum("generated_tokens"), "violations": F.count_if(broken)}
    for name in ("total_latency_ms", "deterministic_retrieval_latency_ms"):
        figures |= {f"{name}_p50": rank(name, 0.5), f"{name}_p95": rank(name, 0.95)}
    out = rows.agg(F.count("*").alias("provided"), F.count_if(F.col("__fault").isNull()).alias("measured"), *(v.alias(k) for k, v in figures.items()))
    whole = (F.col("provided") > 0) & (F.col("provided") == F.col("measured"))
    return out.select("provided", "measured", F.when(whole, "measured").otherwise("unmeasured").alias("status"), *(F.when(whole, F.col(k)).alias(k) for k in figures))


def gate_checks(checks: DataFrame, codes: Sequence[str] = REBUILD_CODES) -> DataFrame:
    """``code, ok, source_status, reason`` of each registered check of a report ``code, status, reason``; fits ``quality.rebuild_gate``.

    A check that is missing, stands there twice or has another status than ``passed`` fails; unregistered ones count for nothing.
    """
    found = checks.groupBy("code").agg(F.count("*").alias("n"), F.max(F.coalesce("status", F.lit(""))).alias("status"), F.max("reason").alias("why"))
    wanted = checks.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    rows = wanted.join(found, "code", "left")
    status, ok = F.coalesce("status", F.lit("missing")), F.coalesce((F.col("n") == 1) & (F.col("status") == "passed"), F.lit(False))
    reason = F.when(F.col("n") > 1, "duplicate").when(F.col("n").isNull(), "missing").otherwise(F.coalesce("why", F.concat(F.lit("status "), status)))
    return rows.select("code", ok.alias("ok"), status.alias("source_status"), F.when(~ok, reason).alias("reason"))


def completed_runs(records: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """``run_id, place``: closed runs whose decisions may be used again, in the ledger's order of their first end.

    ``records(seq, run_id, kind, state, quality, receipts_complete, receipts, post_policy, …)``. Of a run's starts and ends
    the last holds. It must have ended as completed, with complete quality and receipts, with a plan and a closing commit,
    not abandoned; its start must agree with ``wanted`` in each column, and its end with ``wanted["policy"]``.
    """
    if any(v is None or v == "" for v in wanted.values()):
        return records.select("run_id", F.col("seq").alias("place")).where("false")
    seq, run = F.col("seq"), F.col("kind") == "ingest_run"
    start, end = run & (F.col("state") == "started"), run & ~F.col("state").eqNullSafe("started")
    closing = (F.col("kind") == "commit_record") & F.col("receipts_complete") & F.col("receipts").isNotNull()
    fits = F.lit(True)
    for name, value in wanted.items():
        fits &= F.col(name).eqNullSafe(F.lit(value))
    good = (F.col("state") == "completed") & (F.col("quality") == "complete") & F.col("receipts_complete") & F.col("post_policy").eqNullSafe(F.lit(wanted.get("policy")))
    has = lambda hit, name: F.coalesce(F.bool_or(hit), F.lit(False)).alias(name)
    runs = records.where(F.col("run_id") != "").groupBy("run_id").agg(
        F.max_by(fits, F.when(start, seq)).alias("fits"),
        F.max_by(F.coalesce(good, F.lit(False)), F.when(end, seq)).alias("good"),
        F.min(F.when(end, seq)).alias("place"),
        has(closing, "closed"),
        has(F.col("kind") == "commit_plan", "planned"),
        has(F.col("kind") == "plan_abandoned", "abandoned"),
    )
    return runs.where("fits AND good AND closed AND planned AND NOT abandoned").select("run_id", "place")


def plan_issues(plans: DataFrame, operations: DataFrame, receipts: DataFrame, commits: DataFrame, abandoned: DataFrame) -> DataFrame:
    """``plan_id, operation_id, code``: where sealed plans, receipts and their ends disagree; all faults, not the first alone.

    ``plans(plan_id, run_id, plan_hash, seq)``, ``operations(plan_id, operation_id, operation)``,
    ``receipts(plan_id, operation_id, operation, run_id, plan_hash, status, seq)``,
    ``commits(plan_id, plan_hash, seq, receipts_complete, receipts)``, ``abandoned(plan_id, run_id, plan_hash, seq, reason, force_partial)``.
    A fault of the whole plan has a null ``operation_id``. Receipts of unknown plans are ``ledger.order_issues``'s.
    """
    key = ["plan_id", "operation_id"]
    ops = operations.groupBy(*key).agg(F.count("*").alias("n"), F.min("operation").alias("meant"))
    p = plans.select("plan_id", F.col("run_id").alias("p_run"), F.col("plan_hash").alias("p_hash"), F.col("seq").alias("p_seq"))
    r = receipts.join(p, "plan_id").join(ops.select(*key, "meant"), key, "left")
    agrees = F.col("operation").eqNullSafe(F.col("meant")) & F.col("meant").isNotNull() & F.col("run_id").eqNullSafe(F.col("p_run")) & F.col("plan_hash").eqNullSafe(F.col("p_hash"))
    each = _issues(r, key, invalid_receipt=~agrees, invalid_receipt_status=~F.coalesce(F.col("status").isin(*RECEIPT_STATUSES), F.lit(False)))
    twice = _issues(r.groupBy(*key).agg(F.count("*").alias("n")), key, duplicate_receipt=F.col("n") > 1)
    twice = twice.unionByName(_issues(ops.join(p, "plan_id", "left_semi"), key, duplicate_operation_id=F.col("n") > 1))

    known = r.where(F.col("meant").isNotNull()).groupBy(*key).agg(F.max("seq").alias("last"), F.bool_or(F.col("status").isin("failed", "aborted")).alias("failed"))
    known = known.groupBy("plan_id").agg(F.count("*").alias("n_receipts"), F.max("last").alias("last"), F.bool_or("failed").alias("failed"))
    sizes = ops.groupBy("plan_id").agg(F.count("*").alias("n_ops"))
    state = p.join(sizes, "plan_id", "left").join(known, "plan_id", "left").fillna(0, ["n_ops", "n_receipts"])
    none = F.lit(None).cast(operations.schema["operation_id"].dataType).alias("operation_id")
    committed = _issues(
        state.join(commits, "plan_id"),
        ["plan_id", none],
        commit_hash_mismatch=~F.col("plan_hash").eqNullSafe(F.col("p_hash")),
        commit_of_incomplete_plan=F.col("n_receipts") != F.col("n_ops"),
        commit_before_receipt=F.col("last") >= F.col("seq"),
        commit_of_failed_plan=F.col("failed"),
        commit_without_evidence=~(F.col("receipts_complete").eqNullSafe(True) & F.col("receipts").eqNullSafe(F.col("n_ops"))),
    )
    given_up = _issues(
        state.join(abandoned, "plan_id"),
        ["plan_id", none],
        abandoned_run_mismatch=~F.col("run_id").eqNullSafe(F.col("p_run")),
        abandoned_hash_mismatch=~F.col("plan_hash").eqNullSafe(F.col("p_hash")),
        abandoned_before_plan=F.col("seq") <= F.col("p_seq"),
        abandoned_with_receipts=(F.col("n_receipts") > 0) & ~F.col("force_partial").eqNullSafe(True),
        abandoned_without_reason=_filled(F.col("reason")).isNull(),
    )
    return each.unionByName(twice).unionByName(committed).unionByName(given_up)


def run_progress(records: DataFrame, run: str, fields: Sequence[str]) -> DataFrame:
    """``run, field, key, n``: how often each value of each field occurs in a run's records, in one pass; nulls aren't counted."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key")) for f in fields))
    long = records.select(F.col(run), F.explode(pairs).alias("x")).select(run, "x.field", "x.key").where("key IS NOT NULL")
    return long.groupBy(run, "field", "key").agg(F.count("*").alias("n"))


def scoped(nodes: DataFrame, types: Sequence[str] | None = None, documents: DataFrame | None = None, since: object = None) -> DataFrame:
    """The nodes of an export: of the types, of ``documents(document_id)``, created at ``since`` or later; None doesn't restrict."""
    if types is not None:
        nodes = nodes.where(F.col("type").isin(*types)) if types else nodes.where("false")
    if documents is not None:
        nodes = nodes.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return nodes if since is None else nodes.where(F.col("created_at") >= F.lit(since).cast("timestamp"))


def by_ids(nodes: DataFrame, asked: DataFrame, id_col: str = "id") -> DataFrame:
    """Each asked id once, with its node, and whether there is one (``found``)."""
    return asked.select(id_col).distinct().join(nodes.withColumn("found", F.lit(True)), id_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def competing_names(pairs: DataFrame, pool: DataFrame, cap: int = COMPETING_NAMES) -> DataFrame:
    """``pairs(type, a_title, b_title)`` that open on the same token, with ``token`` and ``names``: the first fuller names of the type that open on it too.

    Names are distinct, in order, at most ``cap`` (a limit of the prompt that shows them); an empty list says that none was found.
    Only the first names of each token are joined, so a token that most titles open on costs no more than another.
    """
    opening = lambda c: F.try_element_at(C.word_tokens(F.col(c)), F.lit(1))
    fuller = pool.where(F.size(C.word_tokens(F.col("title"))) > 1).select("type", opening("title").alias("token"), "title").distinct()
    first = fuller.withColumn("i", F.row_number().over(Window.partitionBy("type", "token").orderBy("title"))).where(F.col("i") <= cap)
    first = first.groupBy("type", "token").agg(F.array_sort(F.collect_list("title")).alias("names"))
    alike = pairs.withColumn("token", opening("a_title")).where(F.col("token") == opening("b_title"))
    return alike.join(first, ["type", "token"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def undecided(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that no decision (``a, b`` in either order) holds apart."""
    apart = distinct.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b"))
    return pairs.join(apart, (F.least("a", "b") == F.col("__a")) & (F.greatest("a", "b") == F.col("__b")), "left_anti")


def relocated_path(path: Column, anchor: str, prefix: str) -> Column:
    """``path`` with all up to the end of the first ``anchor`` replaced by ``prefix``; as it is where the anchor doesn't occur."""
    at = F.locate(anchor, path)
    return F.when(at > 0, F.concat(F.lit(prefix), F.substring(path, at + len(anchor), F.length(path)))).otherwise(path)


def label_issues(labels: DataFrame) -> DataFrame:
    """``id, field, lang, label, code`` of faulty rows ``id, field (pref or alt), lang, label``.

    Languages are compared in canonical case. Faults: a language of another shape, an empty label, one that stands twice in
    a field and language, one that is preferred and alternative at once.
    """
    rows = labels.withColumn("lang", F.coalesce(C.bcp47(F.col("lang")), F.concat(F.lit("!"), F.coalesce("lang", F.lit("")))))
    cells = rows.groupBy("id", "field", "lang", "label").agg(F.count("*").alias("n"))
    kept = ["id", "field", "lang", "label"]
    valid = ~F.col("lang").startswith("!")
    own = _issues(cells, kept, lang_invalid_bcp47=~valid, label_empty=F.coalesce(F.col("label").rlike(r"^\s*$"), F.lit(True)), label_duplicate_in_lang=valid & (F.col("n") > 1))
    both = cells.where(valid).groupBy("id", "lang", "label").agg(F.count_distinct("field").alias("n")).withColumn("field", F.lit("alt"))
    return own.unionByName(_issues(both, kept, label_pref_alt_overlap=F.col("n") > 1))

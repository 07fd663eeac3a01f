"""Integrity audit: one row for each issue, ``code, artifact_id, reference, expected, observed``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V
from quillgraph.runtime import materialise

#: Ranges of ids whose digests are compared before any edge is.
ID_RANGES = 1 << 15


def _issue(df: DataFrame, code: str, artifact, reference, expected, observed) -> DataFrame:
    return df.select(F.lit(code).alias("code"), artifact.alias("artifact_id"), reference.alias("reference"), expected.alias("expected"), observed.alias("observed"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no node.

    The names of ends meet the nodes, each once; edges, with their long ids, meet only the names that are lost.
    """
    named = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    lost = materialise(named.join(nodes.select(F.col("id").alias("node")), "node", "left_anti"), "lost-ends").withColumnRenamed("node", "name")
    ends = edges.select("id", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("node")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("node")))).alias("e")).select("id", "e.*")
    lost = ends.join(lost, F.col("node").eqNullSafe(F.col("name")), "left_semi")
    return _issue(lost, "missing_edge_endpoint", F.col("id"), F.col("side"), F.col("node"), F.lit("missing"))


def wrong_edge_ids(edges: DataFrame) -> DataFrame:
    """Content-addressed ids (64 hex digits) that aren't the hash of their edge, and identities that several ids claim.

    Of several ids all but one are wrong, so only identities of wrong ids are counted.
    """
    named = edges.where(F.col("id").rlike("^[0-9a-f]{64}$")).withColumn("identity", C.edge_id(F.col("src"), F.col("type"), F.col("dst")))
    odd = named.where("id <> identity")
    wrong = _issue(odd, "content_addressed_id_mismatch", F.col("id"), F.lit("id"), F.col("identity"), F.col("id"))
    held = named.join(materialise(odd.select("identity").distinct(), "claimed-identities"), "identity", "left_semi")
    several = held.groupBy("identity").agg(F.count_distinct("id").alias("n")).where("n > 1")
    clash = held.join(several, "identity")
    return wrong.unionByName(_issue(clash, "conflicting_deterministic_identity", F.col("id"), F.col("identity"), F.lit("one edge id per deterministic semantic identity"), F.concat(F.col("n").cast("string"), F.lit(" ids"))))


def missing_references(claims: DataFrame, nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """References of claims (facet name to column) that aren't null or empty and resolve to no node."""
    refs = claims.select("id", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("string").alias("ref")) for name, c in sorted(columns.items()) if name in V.CLAIM_REFERENCES])).alias("r")).select("id", "r.*")
    lost = refs.where("ref <> ''").join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti")
    return _issue(lost, "missing_facet_reference", F.col("id"), F.col("name"), F.col("ref"), F.lit("missing"))


def duplicate_ids(rows: DataFrame, code: str) -> DataFrame:
    """Ids that more than one row has."""
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return _issue(twice, code, F.col("id"), F.lit("id"), F.lit("1"), F.col("n").cast("string"))


def adjacency_issues(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Stored edges against physical ones (``id, src, dst``): different ends, and those that only one side has.

    Edges are dealt to ranges by their id, and a range whose edges have the same digests (two of 64 bits) and number on both sides has no issue,
    unless an id is repeated or something is null in it. So only edges of the other ranges meet by id.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(ID_RANGES)).cast("int")
    a, b = (df.select("id", "src", "dst", bucket.alias("bucket")) for df in (edges, observed))
    null = F.col("id").isNull() | F.col("src").isNull() | F.col("dst").isNull()
    tally = lambda df, sign: df.select("bucket", F.xxhash64("id", "src", "dst").alias("x"), F.xxhash64(F.lit(7919), "dst", "src", "id").alias("y"), F.lit(sign).alias("sign"), null.alias("unsure"))
    sums = tally(a, 1).unionByName(tally(b, -1)).groupBy("bucket")
    sums = sums.agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum(F.col("sign") * F.shiftright("x", 32)).alias("sum"), F.sum("sign").alias("n"), F.max("unsure").alias("unsure"))
    # where both sides are the same, one has the repeated ids of both
    twice = a.where("id IS NOT NULL").groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select(F.pmod("h", F.lit(ID_RANGES)).cast("int").alias("bucket"))
    open_ = materialise(sums.where("x <> 0 OR y <> 0 OR sum <> 0 OR n <> 0 OR unsure").select("bucket").unionByName(twice).distinct(), "open-ranges")
    a, b = (df.join(F.broadcast(open_), "bucket", "left_semi") for df in (a, b))  # at most ID_RANGES numbers
    both = a.select("id", F.col("src").alias("s1"), F.col("dst").alias("d1")).join(b.select("id", F.col("src").alias("s2"), F.col("dst").alias("d2")), "id", "full_outer")
    found = lambda where, code, reference, expected, observed: F.when(where, F.struct(F.lit(code).alias("code"), reference.cast("string").alias("reference"), expected.alias("expected"), observed.alias("observed")))
    issues = [
        found(F.col("s2").isNull(), "missing_adjacency_observation", F.lit(None), F.lit("physical relationship"), F.lit("missing")),
        found(F.col("s1").isNull(), "unlisted_physical_edge", F.lit(None), F.lit("edge property scan record"), F.lit("physical relationship only")),
        *(found(F.col(x) != F.col(y), "adjacency_property_mismatch", F.lit(side), F.col(y), F.col(x)) for side, x, y in (("src", "s1", "s2"), ("dst", "d1", "d2"))),
    ]
    rows = both.select("id", F.explode(F.array_compact(F.array(*issues))).alias("i"))
    return rows.select("i.code", F.col("id").alias("artifact_id"), "i.reference", "i.expected", "i.observed")


def manifest_issues(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Artifacts ``id, digest`` that are missing, unexpected or changed."""
    both = manifest.select("id", F.col("digest").alias("want")).join(observed.select("id", F.col("digest").alias("have")), "id", "full_outer")
    code = F.when(F.col("have").isNull(), "missing_artifact").when(F.col("want").isNull(), "unexpected_artifact").otherwise("artifact_mismatch")
    bad = both.where(~F.col("want").eqNullSafe(F.col("have")))
    return bad.select(code.alias("code"), F.col("id").alias("artifact_id"), F.lit("digest").alias("reference"), F.coalesce("want", F.lit("missing")).alias("expected"), F.coalesce("have", F.lit("missing")).alias("observed"))


def unwritable_types(nodes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Nodes of a type outside the closed set."""
    return _issue(nodes.where(~F.col("type").isin(*allowed) | F.col("type").isNull()), "closed_type_set", F.col("id"), F.lit("type"), F.lit(",".join(allowed)), F.coalesce("type", F.lit("missing")))


def audit(*issues: DataFrame) -> DataFrame:
    """``code, n``: issues by code."""
    out = None
    for part in issues:
        out = part if out is None else out.unionByName(part)
    return out.groupBy("code").agg(F.count("*").alias("n"))

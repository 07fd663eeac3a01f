"""Two populations compared by ranges of their members' digests, top down, so that only ranges that differ are read.

A member is the digest of what it says, so members are spread evenly over their first hexadecimal digits, whatever the data. A range
(a prefix) is folded to its number of members and four sums of parts of their digests; sums don't depend on order, so partial sums in each task
are all that is shuffled, and a parent is the sum of its children. The root is one stamp for the whole. The fold
finds accidental differences; it isn't meant to withstand someone who makes up members to collide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import udfs
from quillgraph.functions import vocabulary as V
from quillgraph.operators import gates

_LANES = ("h1", "h2", "h3", "h4")


def opaque_member(kind: str, value: Column) -> Column:
    """``sha256:`` and the digest of a kind, a zero byte and a value."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.encode(F.lit(kind), "utf-8"), F.lit(b"\x00"), F.encode(value, "utf-8")), 256))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields in order of their names, nulls included."""
    return F.to_json(F.struct(*(value.alias(name) for name, value in sorted(fields.items()))), {"ignoreNullFields": "false"})


def canonical_hash(value: Column) -> Column:
    """``sha256:`` and the digest of canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def semantic_members(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """``dimension, member`` of a graph: opaque digests of its identities, predicates and relations, which hold for any vault with the same knowledge.

    ``nodes(id, type, title)``, ``claims(id, s, p, o_id, o_literal)``. An entity is its type and surface key with its place among its equals in order of id; a relation
    names its ends so. Infrastructure, superseded claims and claims of a document's structure are left out; an end that doesn't exist is ``missing``.

    * Null titles are empty, a null literal of a claim without an object is JSON null. Repeated claims are members each.
    """
    known = nodes.where(~gates.is_infra(nodes)).select("id", "type", udfs.exact_surface_key(C.text_or_empty(F.col("title"))).alias("surface"))
    entity = F.col("type").isin(*V.PRIMITIVE_TYPES)
    ordinal = F.row_number().over(Window.partitionBy("type", "surface").orderBy("id"))
    identity = known.where(entity).withColumn("ordinal", ordinal).select("id", F.struct(F.struct("surface", "type").alias("identity"), "ordinal").alias("v")).select("id", F.to_json("v").alias("value"))
    others = known.where(~entity).select("id", F.to_json(F.struct("surface", "type")).alias("value"))
    ends = identity.unionByName(others)
    live = claims.where(~gates.is_superseded(claims)).withColumn("p", F.trim(C.text_or_empty(F.col("p")))).where(~F.col("p").isin(*V.STRUCTURAL_PREDICATES))
    end = lambda c: ends.select(F.col("id").alias(c), F.col("value").alias(f"{c}_value"))
    told = live.join(end("s"), "s", "left").join(end("o_id"), "o_id", "left")
    gone = F.lit('{"missing":true}')
    quoted = lambda c: F.expr(f"substr(to_json(struct({c} AS v)), 6, length(to_json(struct({c} AS v))) - 6)")
    literal = F.when(F.col("o_literal").isNull(), F.lit('{"kind":"literal","type":"NoneType","value":null}')).otherwise(F.concat(F.lit('{"kind":"literal","type":"str","value":'), quoted("o_literal"), F.lit("}")))
    thing = F.when(F.col("o_id").isNotNull(), F.concat(F.lit('{"kind":"entity","value":'), F.coalesce("o_id_value", gone), F.lit("}"))).otherwise(literal)
    value = F.concat(F.lit('{"object":'), thing, F.lit(',"predicate":'), quoted("p"), F.lit(',"subject":'), F.coalesce("s_value", gone), F.lit("}"))
    rows = (
        identity.select(F.lit("identities").alias("dimension"), opaque_member("identity", F.col("value")).alias("member")),
        live.select("p").distinct().select(F.lit("predicates").alias("dimension"), opaque_member("predicate", F.col("p")).alias("member")),
        told.select(F.lit("relations").alias("dimension"), opaque_member("relation", value).alias("member")),
    )
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _range(member: Column, depth: int) -> Column:
    return F.substring(F.substring_index(member, ":", -1), 1, depth)


def fold(members: DataFrame, depth: int, key: str = "range") -> DataFrame:
    """``dimension, range, n, h1..h4``: the fold of each range of ``depth`` digits that has members."""
    hexed = F.substring_index("member", ":", -1)
    lanes = [F.sum(F.conv(F.substring(hexed, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(lane) for i, lane in enumerate(_LANES)]
    return members.groupBy("dimension", _range(F.col("member"), depth).alias(key)).agg(F.count("*").alias("n"), *lanes)


def parents(folds: DataFrame) -> DataFrame:
    """The folds of the ranges that are one digit shorter."""
    shorter = F.expr("substr(range, 1, length(range) - 1)")
    return folds.groupBy("dimension", shorter.alias("range")).agg(F.sum("n").alias("n"), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in _LANES))


def stamps(folds: DataFrame) -> DataFrame:
    """``dimension, range, n, stamp``: a digest of each fold."""
    return folds.select("dimension", "range", "n", F.sha2(F.concat_ws("-", F.col("n").cast("string"), *(F.col(c).cast("string") for c in _LANES)), 256).alias("stamp"))


class DigestTree:
    """A population's members below ``path``, in a folder for each range of ``depth`` digits, with the folds of all levels."""

    def __init__(self, spark: SparkSession, path: str, depth: int = 2) -> None:
        if not 1 <= depth <= 4:
            raise ValueError("ranges have from 1 to 4 digits")
        self.spark, self.path, self.depth = spark, path.rstrip("/"), depth

    def write(self, members: DataFrame) -> DigestTree:
        """Write ``members(dimension, member)`` and their folds. Members are dealt by range and digest, so that no dimension or range falls to one task."""
        ranged = members.select("dimension", "member", _range(F.col("member"), self.depth).alias("range"))
        ranged.repartition(F.col("range")).write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/members")
        level = fold(self.members(), self.depth)
        for depth in range(self.depth, -1, -1):
            level.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folds/{depth}")  # at most 16 to the depth rows a dimension
            level = parents(self.folds(depth)) if depth else level
        return self

    def members(self, ranges: Sequence[str] | None = None) -> DataFrame:
        """``dimension, member, range``, of some ranges alone if they are given: others' folders aren't opened."""
        rows = self.spark.read.schema("dimension string, member string, range string").parquet(f"{self.path}/members")
        return rows if ranges is None else rows.where(F.col("range").isin(*ranges)) if ranges else rows.where("false")

    def folds(self, depth: int) -> DataFrame:
        """The folds of the ranges of ``depth`` digits; of 0 the whole."""
        lanes = ", ".join(f"{c} decimal(38,0)" for c in _LANES)
        return self.spark.read.schema(f"dimension string, range string, n long, {lanes}").parquet(f"{self.path}/folds/{depth}")

    def stamp(self) -> DataFrame:
        """``dimension, n, stamp`` of the whole population."""
        return stamps(self.folds(0)).drop("range")

    def differing(self, other: DigestTree) -> list[str]:
        """The ranges whose members differ, found from the root down: below a range that agrees nothing is looked at. At most 16 to the depth."""
        if self.depth != other.depth:
            raise ValueError("trees of different depths")
        above: list[str] = [""]
        for depth in range(self.depth + 1):
            if not above:
                return []
            inside = F.substring("range", 1, max(depth - 1, 0)).isin(*above) if depth else F.lit(True)
            left, right = (stamps(t.folds(depth).where(inside)).select("dimension", "range", F.col("stamp").alias(c)) for t, c in ((self, "a"), (other, "b")))
            odd = left.join(right, ["dimension", "range"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
            above = sorted(r["range"] for r in odd.select("range").distinct().collect())
        return above

    def difference(self, other: DigestTree) -> DataFrame:
        """``dimension, member, change``: members that are only here (``removed``) or only there (``added``), as often as the one has more of them."""
        ranges = self.differing(other)
        count = lambda t, c: t.members(ranges).groupBy("dimension", "member").agg(F.count("*").alias(c))
        both = count(self, "a").join(count(other, "b"), ["dimension", "member"], "full_outer").na.fill(0, ["a", "b"]).where("a <> b")
        more = F.expr("sequence(1, abs(a - b))")
        return both.select("dimension", "member", F.when(F.col("a") > F.col("b"), "removed").otherwise("added").alias("change"), F.explode(more).alias("i")).drop("i")

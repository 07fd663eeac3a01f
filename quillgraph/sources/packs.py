"""Type packs: YAML manifests of types and edge types with imports."""

from __future__ import annotations

import re
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.runtime import materialise

#: Imports may nest so deep.
MAX_DEPTH = 32


class PackError(ValueError):
    """A manifest that can't be used."""


class _Strict(yaml.SafeLoader):
    """YAML in which a key may stand once."""


def _mapping(loader: _Strict, node: yaml.MappingNode, deep: bool = False) -> dict:
    keys = [loader.construct_object(k, deep=deep) for k, _ in node.value]
    if len(keys) != len(set(map(str, keys))):
        raise PackError(f"a key stands twice: {keys}")
    return {k: loader.construct_object(v, deep=deep) for k, (_, v) in zip(keys, node.value, strict=True)}


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, lambda loader, node: _mapping(loader, node, True))


def parse_manifest(text: str) -> dict:
    """``id, version, imports, prefixes, types, edge_types`` of a manifest; raises PackError where it doesn't hold together."""
    try:
        found = yaml.load(text, _Strict)  # noqa: S506  (a safe loader)
    except yaml.YAMLError as e:
        raise PackError(str(e)) from e
    if not isinstance(found, dict):
        raise PackError("a manifest is a mapping")
    if not re.fullmatch(r"[a-z][a-z0-9-]*", str(found.get("id", ""))):
        raise PackError("id must be lower-case letters, digits and dashes")
    if not re.fullmatch(r"\d+\.\d+\.\d+", str(found.get("version", ""))):
        raise PackError("version must have three numbers")
    out = {"id": found["id"], "version": found["version"]}
    for name, empty in (("imports", []), ("prefixes", {}), ("types", []), ("edge_types", [])):
        value = found.get(name) or empty
        if not isinstance(value, type(empty)):
            raise PackError(f"{name} must be a {type(empty).__name__}")
        out[name] = value
    for name in ("types", "edge_types"):
        labels = [x["name"] if isinstance(x, dict) else x for x in out[name]]
        if len(labels) != len(set(labels)):
            raise PackError(f"{name} has repeats")
        out[name] = labels
    return out


def load(pack: str, fetch: Callable[[str], str], trail: tuple[str, ...] = ()) -> dict[str, dict]:
    """A pack with all that it imports, by id; raises PackError on cycles and beyond MAX_DEPTH."""
    if pack in trail:
        raise PackError(f"imports go round: {' > '.join((*trail, pack))}")
    if len(trail) >= MAX_DEPTH:
        raise PackError("imports nest too deep")
    manifest = parse_manifest(fetch(pack))
    out: dict[str, dict] = {}
    for other in manifest["imports"]:
        out |= load(other, fetch, (*trail, pack))
    return out | {manifest["id"]: manifest}


def type_table(spark: SparkSession, packs: dict[str, dict]) -> DataFrame:
    """``pack_id, kind, name``: a small dimension table."""
    rows = [(p, kind, name) for p, m in sorted(packs.items()) for kind in ("types", "edge_types") for name in m[kind]]
    return spark.createDataFrame(rows, "pack_id string, kind string, name string")


def resolve_type(packs: dict[str, dict], name: str, pack_id: str | None = None) -> str:
    """The qualified name; an unqualified one must be of one pack alone."""
    owners = sorted(p for p, m in packs.items() if name in m["types"] and pack_id in (None, p))
    if len(owners) != 1:
        raise PackError(f"{name}: {'ambiguous' if owners else 'unknown'}")
    return f"{owners[0]}:{name}"


def import_closure(packs: DataFrame, imports: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``root, pack, depth, path, fault``: all ways from each of ``packs(pack)`` along ``imports(pack, import)``, by recursion in the engine; written.

    A way ends at its fault: ``too_deep`` beyond ``max_depth`` packs, ``self_import``, ``circular_import`` for one that
    is on the way already, ``unknown_pack`` for one that ``packs`` lacks. Nulls and repeated rows count for nothing.
    """
    spark = packs.sparkSession
    known = packs.where("pack IS NOT NULL").select("pack").distinct()
    edges = imports.where("pack IS NOT NULL AND import IS NOT NULL").select("pack", "import").distinct()
    edges = materialise(edges.join(known.select(F.col("pack").alias("import"), F.lit(True).alias("known")), "import", "left").select("pack", "import", F.coalesce("known", F.lit(False)).alias("known")), "imports")
    limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(max_depth + 2)}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        walk = spark.sql(
            f"""
            WITH RECURSIVE walk(root, pack, depth, path, fault) AS (
              SELECT pack, pack, 0, array(pack), CAST(NULL AS STRING) FROM {{known}}
              UNION ALL
              SELECT w.root, e.import, w.depth + 1, array_append(w.path, e.import),
                CASE WHEN w.depth + 1 >= {max_depth} THEN 'too_deep' WHEN e.import = w.pack THEN 'self_import' WHEN array_contains(w.path, e.import) THEN 'circular_import' WHEN NOT e.known THEN 'unknown_pack' END
              FROM walk w JOIN {{edges}} e ON e.pack = w.pack WHERE w.fault IS NULL
            ) SELECT * FROM walk""",
            known=known,
            edges=edges,
        )
        return materialise(walk, "import-closure")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def loadable(closure: DataFrame) -> DataFrame:
    """``root, n_packs, depth, fault``: what loading each pack takes, and the fault that stops it, that of the shortest and then first way."""
    fine = F.col("fault").isNull()
    return closure.groupBy("root").agg(F.count_distinct(F.when(fine, F.col("pack"))).alias("n_packs"), F.max(F.when(fine, F.col("depth"))).alias("depth"), F.min_by("fault", F.when(~fine, F.struct("depth", "path"))).alias("fault"))

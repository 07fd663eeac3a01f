"""Which nodes a read may show: infrastructure, superseded claims, anchors of low salience.

A node's gates are durable facets: ``infra`` (boolean), ``superseded`` (boolean) and ``salience``. A frame without
one of these columns has no node that it marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import columns as C


def _known_id(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


#: Ids of the agent and the activity that stand for deterministic extraction.
SYSTEM_IDS = (_known_id("agent", "system"), _known_id("activity", "deterministic-v1"))


def model_ids(model: str) -> tuple[str, str]:
    """Ids of the agent and the activity of extraction by a language model."""
    return _known_id("agent", "llm", model), _known_id("activity", "llm-extraction", model)


def is_infra(nodes: DataFrame, extra_ids: Iterable[str] = ()) -> Column:
    """Plumbing of provenance, by its facet or by a known id; never by title."""
    known = F.col("id").cast("string").isin(*SYSTEM_IDS, *extra_ids)
    return known | F.coalesce(F.col("infra"), F.lit(False)) if "infra" in nodes.columns else known


def is_superseded(nodes: DataFrame) -> Column:
    return F.coalesce(F.col("superseded"), F.lit(False)) if "superseded" in nodes.columns else F.lit(False)


def is_low_salience(nodes: DataFrame) -> Column:
    return F.coalesce(F.col("salience") == "low", F.lit(False)) if "salience" in nodes.columns else F.lit(False)


def recallable(nodes: DataFrame, extra_ids: Iterable[str] = ()) -> Column:
    """What recall without a type may return: anchors of low salience stay, raw blocks don't."""
    return ~is_infra(nodes, extra_ids) & ~is_superseded(nodes) & (F.col("type") != "Block")


def passes(nodes: DataFrame, extra_ids: Iterable[str] = ()) -> Column:
    """What an ego graph may show."""
    return ~is_infra(nodes, extra_ids) & ~is_superseded(nodes) & ~is_low_salience(nodes)


def predicate_allowed(predicate: Column, allowed: Iterable[str] | None) -> Column:
    """Whether a list of relationship types lets the predicate pass, as it stands or as it is spoken; no types, or none but blanks, let all pass."""
    keys = sorted({x.strip().lower().replace(" ", "_") for x in allowed or () if x and x.strip()})
    if not keys:
        return F.lit(True)
    raw = F.lower(F.trim(C.text_or_empty(predicate)))
    return raw.isin(*keys) | F.translate(C.verbalized(predicate), " ", "_").isin(*keys)

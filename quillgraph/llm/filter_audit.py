"""What filters take from each other: every order of them, run as a trie of survivors.

The prefixes of all orders are a trie; two prefixes that hold the same filters leave the same rows, so each set of filters is
run once. The walk goes depth first: a state's survivors are a persisted DataFrame, from which one
aggregation counts, for each filter that is still to come, what it actually removes (an edge of the trie);
its children read it, and it is released when they are through. At most as many states are held at a time
as there are filters. Counts go to a table in the shared folder, never to the driver.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import texts_of
from quillgraph.runtime import materialise, scratch_path

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = [bytes([c]) for c in b"#$%&*|"]
#: Beyond this, orders are too many to report each (n! of them) and states too many to run (2 to the n).
MOST_FILTERS = 7


def text_failures(text: str) -> tuple[bool, bool, bool, bool]:
    """Whether a text fails A (under 50 words), B (under 65 % distinct words), C (over 5 % A-Z) and D (holds one of ``#$%&*|``)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at U+0020 and U+0009 to U+000D only
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * upper > 5 * len(text), any(sign in raw for sign in _SIGNS)


def document_failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, A, B, C, D, E, good, toxic``: for each document, which filters it fails and how it is labelled.

    * A null text is empty, a null part is the empty string; a null id is smaller than none and larger than none, so it never fails E and makes none fail.
    * E fails where a smaller id has the same text (its SHA-256) anywhere in the table; rows that repeat an id don't make each other fail.
    * A document is good or toxic if any row of ``labels(doc_id, quality, toxic)`` of its id says 1; without one it is neither.
    * Texts are read once, whole, where they lie; only digests, flags and ids are shuffled. A text of more than a
      thousandth of all rows finds its first id by a broadcast, of at most a thousand digests, all others by a join.
    """
    schema = "id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, digests = [], []
            for text in texts_of(batch.column(2)):
                text = text or ""
                flags.append(text_failures(text))
                digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
            columns = [pa.array([f[i] for f in flags], pa.bool_()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(digests, pa.binary())], names=["id", "part", "A", "B", "C", "D", "digest"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    flags = materialise(base.mapInArrow(run, schema), "failures")
    shared = materialise(flags.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared-texts")
    hot = F.broadcast(shared.where(F.col("n") * 1000 >= flags.count()).select("digest", "first"))  # at most 1,000 rows
    cold = shared.join(hot.select("digest"), "digest", "left_anti").select("digest", "first")
    many = flags.join(hot, "digest")
    few = flags.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest", "left")
    known = many.unionByName(few).withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return known.join(marks, "id", "left").select("part", "A", "B", "C", "D", "E", no("good"), no("toxic"))


def trie_edges(rows: DataFrame, filters: Sequence[str], marks: Sequence[str], *, part_col: str = "part") -> DataFrame:
    """``part, state, filter, here, removed, lost_<mark>...``: what each filter removes from the survivors of each set of others.

    ``rows`` has a boolean column for each filter (true: the row fails it) and each mark. ``state`` has a bit for each
    filter that was applied before. Every part has all edges, those without survivors with zeros.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "trie-edges")
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    root = rows.select(part, *map(yes, (*filters, *marks)), F.lit(1).alias("n"))
    # a row that counts for nothing and passes all filters keeps a part in sight when its documents are gone
    anchors = rows.select(part).distinct().select("part", *(F.lit(False).alias(c) for c in (*filters, *marks)), F.lit(0).alias("n"))
    root = materialise(root.unionByName(anchors), "trie-root")
    seen: set[int] = set()

    # one plan for all states, so that it is compiled once: the state is the folder's name, filters that were applied find nothing and are left out on reading
    n = lambda *conditions: F.coalesce(F.sum(F.when(F.expr(" AND ".join(f"`{c}`" for c in conditions)), F.col("n"))), F.lit(0)).cast("long")
    sums = [F.sum("n").cast("long").alias("here")]
    for i, f in enumerate(filters):
        sums += [n(f).alias(f"r{i}"), *(n(f, m).alias(f"r{i}_{j}") for j, m in enumerate(marks))]
    edge = lambda i, f: F.struct(F.lit(i).alias("place"), F.lit(f).alias("filter"), F.col(f"r{i}").alias("removed"), *(F.col(f"r{i}_{j}").alias(f"lost_{m}") for j, m in enumerate(marks)))
    edges_of = F.inline(F.array(*(edge(i, f) for i, f in enumerate(filters))))

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        left = [i for i in range(len(filters)) if not state >> i & 1]
        if not left:
            return
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            held.groupBy("part").agg(*sums).select("part", "here", edges_of).write.parquet(f"{path}/state={state}")
            for i in left:
                if state | 1 << i not in seen:
                    visit(state | 1 << i, held.where(~F.col(filters[i])))
        finally:
            held.unpersist()

    visit(0, root)
    lost = "".join(f", lost_{m} long" for m in marks)
    edges = spark.read.schema(f"part string, here long, place int, filter string, removed long{lost}, state int").parquet(path)
    return edges.where("(state >> place) & 1 = 0").select("part", "state", "filter", "here", "removed", *(f"lost_{m}" for m in marks))


def filter_audit(rows: DataFrame, filters: Sequence[str], marks: Sequence[str] = (), *, part_col: str = "part") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, lost_<mark>..., shapley``: a row for each part, order of the filters and step.

    ``kept`` are left after the step and ``removed`` go at it; ``redundant`` fail its filter but went before, ``unique_fails``
    fail no other; ``lost_<mark>`` are the removed rows with that mark; ``shapley`` sums what the filter removes
    over all orders. A null flag passes, a null part is the empty string; an empty table gives no rows.
    """
    names, every = list(filters), (1 << len(filters)) - 1
    edges = trie_edges(rows, names, marks, part_col=part_col)
    orders = []
    for order in itertools.permutations(range(len(names))):
        state = 0
        for step, i in enumerate(order, 1):
            orders.append(("".join(names[x] for x in order), step, state, names[i]))
            state |= 1 << i
    steps = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, state int, filter string")
    # orders that reach an edge: those of what came before, times those of what comes after
    ways = [math.factorial(s.bit_count()) * math.factorial(len(names) - 1 - s.bit_count()) if s != every else 0 for s in range(every + 1)]
    weight = F.element_at(F.array(*map(F.lit, ways)), F.col("state") + 1)
    alone = F.lit(every) - F.element_at(F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i)))), F.col("filter"))
    # beside each edge what holds for its filter in all states: at most 2^(n-1) rows for a part and filter
    of_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(F.col("state") == alone, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley")
    )
    known = edges.join(of_filter, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])  # n! * n rows
    return known.select("part", "filter_order", "step", (F.col("here") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *(f"lost_{m}" for m in marks), "shapley")

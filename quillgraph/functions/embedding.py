"""Embedding of a column of texts by a function that takes many at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quillgraph.functions import vocabulary as V
from quillgraph.functions.udfs import embedding_of

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def stub(texts: Sequence[str], dim: int = 16) -> list[list[float]]:
    """Vectors that depend on the texts alone, for runs without a model."""
    return [embedding_of(text, dim) for text in texts]


def _tokens(text: str) -> int:
    return int(len(text) / 4 * V.TOKEN_FACTOR) + 1


def _vectors(embed: Embed, texts: list[str], tries: int, wait: float) -> list[list[float]]:
    """The texts' vectors; a call that fails is made again by itself, then its halves are, so that one bad text fails alone."""
    for turn in range(tries):
        try:
            found = [list(map(float, v)) for v in embed(texts)]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found
        except Exception:  # noqa: BLE001  (whatever a provider raises)
            if turn == tries - 1 and len(texts) == 1:
                raise
            time.sleep(wait * 2**turn)
    half = len(texts) // 2
    return _vectors(embed, texts[:half], tries, wait) + _vectors(embed, texts[half:], tries, wait)


def embed_in_batches(rows: DataFrame, embed: Embed = stub, *, text_col: str = "text", out_col: str = "embedding", most_texts: int = 32, most_tokens: int = 8192, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """``rows`` with the vector of each text in ``out_col``, which replaces a column of that name; all others stay as they are.

    Calls take rows in the order in which a task reads them, across its Arrow batches, at most ``most_texts`` and about
    ``most_tokens`` tokens each; a longer text goes by itself. A row keeps its place, so the vectors don't depend on how
    rows are dealt to tasks and calls. A failed call is repeated alone, up to ``tries`` times, then halved.

    * A null text has a null vector and goes into no call; an empty one is embedded. Repeated rows are embedded each.
    * No rows need no call. A text that fails by itself fails the task, which Spark runs again.
    """
    if not 1 <= most_texts <= 256:
        raise ValueError("a call takes from 1 to 256 texts")
    kept = [f for f in rows.schema.fields if f.name != out_col]
    schema = StructType([*kept, StructField(out_col, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[str] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, texts, tokens
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            known = iter(_vectors(embed, texts, tries, wait) if texts else [])
            vectors = [None if t is None else next(known) for t in table.column(text_col).to_pylist()]
            held, texts, tokens = [], [], 0
            out = [*(table.column(f.name).combine_chunks() for f in kept), pa.array(vectors, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in kept), out_col])

        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                size = 0 if text is None else _tokens(text)
                if texts and text is not None and (len(texts) >= most_texts or tokens + size > most_tokens):
                    held.append(batch.slice(begin, i - begin))
                    begin = i
                    yield from flush()
                if text is not None:
                    texts.append(text)
                    tokens += size
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        yield from flush()

    return rows.mapInArrow(run, schema)


def reembedded(nodes: DataFrame, embed: Embed, **options) -> DataFrame:
    """A graph's nodes under another embedder, whatever its vectors' length: title and content are embedded, all else stays."""
    from pyspark.sql import functions as F

    text = F.trim(F.concat_ws(" ", "title", "content"))
    return embed_in_batches(nodes.withColumn("__text", text), embed, text_col="__text", **options).drop("__text")

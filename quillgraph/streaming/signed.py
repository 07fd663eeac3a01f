"""Tables of signed rows in committed versions: what batches of changes add and take away, net on reading.

A batch writes, for each table, the rows that it adds (``sign`` 1) and those that it takes back (``sign`` -1) to a folder of its
own, and last a commit that names every live folder. A reader sees committed folders alone, so a batch that failed or
is replayed leaves no trace: its folder is overwritten, and a batch id that isn't above the last committed
one is skipped. Merging folds all folders of a table into one of net rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.runtime import remove_path, shuffles_removed


class SignedTables:
    """Named tables below one path; each has a column ``sign``, and may be partitioned by one column."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str], partition: str | None = None) -> None:
        self.spark, self.path, self.schemas, self.partition = spark, path.rstrip("/"), dict(schemas), partition

    def _names(self, folder: str) -> list[str]:
        """Names in a folder, through Hadoop's file system API; none if it doesn't exist."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []

    def state(self) -> dict:
        """The last commit: its number, the last batch, the live folders of each table and the summary; of an empty store without folders."""
        done = [int(n) for n in self._names(f"{self.path}/commits") if n.isdigit()]
        for number in sorted(done, reverse=True):
            if "_SUCCESS" in self._names(f"{self.path}/commits/{number}"):
                row = self.spark.read.schema("state string").parquet(f"{self.path}/commits/{number}").first()
                return json.loads(row["state"])
        return {"number": 0, "batch": -1, "live": {name: [] for name in self.schemas}, "summary": {}}

    def _commit(self, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{state['number']}")

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """All live rows of a table with their signs."""
        folders = (state or self.state())["live"][name]
        schema = self._schema(name)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{folder}") for folder in folders]
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _schema(self, name: str) -> StructType:
        return StructType.fromDDL(self.schemas[name])

    def _write(self, name: str, rows: DataFrame, folder: str) -> None:
        writer = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema(name))).write.mode("overwrite")
        # a stream's batch has a session of its own
        with shuffles_removed(rows.sparkSession):
            (writer.partitionBy(self.partition) if self.partition else writer).option("compression", "zstd").parquet(f"{self.path}/{name}/{folder}")

    def apply(self, batch: int, changes: Mapping[str, DataFrame], summary: Mapping[str, float] | None = None) -> bool:
        """Write a batch's rows and commit them; false if the batch was committed before. ``summary`` is added up over batches."""
        state = self.state()
        if batch <= state["batch"]:
            return False
        number = state["number"] + 1
        for name, rows in changes.items():
            self._write(name, rows, str(number))
            state["live"][name].append(str(number))
        added = {k: state["summary"].get(k, 0) + v for k, v in (summary or {}).items()}
        self._commit({"number": number, "batch": batch, "live": state["live"], "summary": state["summary"] | added})
        return True

    def net(self, name: str, keys: Sequence[str], state: dict | None = None) -> DataFrame:
        """``keys, sign``: the rows of a table whose signs don't cancel, with their sum."""
        return self.read(name, state).groupBy(*keys).agg(F.sum("sign").alias("sign")).where("sign <> 0")

    def merge(self, name: str, keys: Sequence[str]) -> None:
        """Fold a table's folders into one, of its net rows.

        The old folders go after the commit; a reader that holds an older state must read it again.
        """
        state = self.state()
        if len(state["live"][name]) < 2:
            return
        number, old = state["number"] + 1, state["live"][name]
        self._write(name, self.net(name, keys, state), str(number))
        state["live"][name] = [str(number)]
        self._commit(state | {"number": number})
        for folder in old:
            remove_path(self.spark, f"{self.path}/{name}/{folder}")

    def clear(self) -> None:
        """Forget all rows; batch ids begin anew."""
        state = self.state()
        self._commit({"number": state["number"] + 1, "batch": -1, "live": {name: [] for name in self.schemas}, "summary": {}})
        for name, folders in state["live"].items():
            for folder in folders:
                remove_path(self.spark, f"{self.path}/{name}/{folder}")

"""A table by key in the shared folder: merges rewrite the touched buckets alone."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolith.session import forget, spill


class KeyedTable:
    """Rows with one key each, dealt to ``buckets`` by its hash, and counters that add up over merges.

    Data files are never changed: a merge writes the new state of the buckets that its rows touch
    into a folder of its own, and then a commit, which names the folder of every bucket. Readers
    take the last commit. What a failed merge has written no commit names; repeating it gives the
    same rows, as does repeating one that went through, but for the counters: those it is given count
    again, unless the merge carries the ``token`` of one that is committed, which is left out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _file_system(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> dict:
        where, fs = self._file_system(f"{self.path}/_commits")
        names = sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"number": 0, "folders": {}, "counters": {}, "tokens": [], "schema": None}
        lines = self.spark.read.text(f"{self.path}/_commits/{names[-1]}", wholetext=True).first()
        return json.loads(lines[0])

    def _commit(self, state: dict) -> None:
        """Named by its number; of two writers at once the second finds the name taken."""
        name = f"{self.path}/_commits/{state['number']:010d}"
        part, fs = self._file_system(f"{name}.{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final, _ = self._file_system(f"{name}.json")
        if fs.exists(final) or not fs.rename(part, final):
            fs.delete(part, False)
            raise RuntimeError(f"commit {state['number']} is there already: merge again")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """The rows of the last commit; raises where there is none."""
        state = self._last()
        if state["schema"] is None:
            raise ValueError(f"nothing is committed in {self.path}")
        reader = self.spark.read.schema(state["schema"])
        folders = sorted(set(state["folders"].values()))
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], state["schema"])

    def counters(self) -> dict[str, int]:
        return self._last()["counters"]

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not there: what a resumed run still has to do."""
        if self._last()["schema"] is None:
            return rows
        return rows.join(self.read().select(self.key), self.key, "left_anti")

    def merge(self, news: DataFrame, counters: dict[str, int] | None = None, token: str | None = None) -> list[int]:
        """Rows of ``news`` replace those of their key; the buckets that were rewritten.

        Of rows with one key the greatest stays; a null key is a key. At most ``buckets`` numbers
        reach the driver.
        """
        state = self._last()
        if token is not None and token in state["tokens"]:
            return []
        columns = news.columns
        rest = [c for c in columns if c != self.key]
        one = news.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_row")).select(self.key, "_row.*").select(columns) if rest else news.distinct()
        fresh, copy = spill(one.withColumn("_bucket", self._bucket()), "keyed")
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
        old = [state["folders"][str(b)] for b in touched if str(b) in state["folders"]]
        rows = fresh
        if old:
            held = self.spark.read.schema(state["schema"]).parquet(*sorted(set(old)))
            new = fresh.select(F.col(self.key).alias("_new"))
            rows = held.join(new, F.col(self.key).eqNullSafe(F.col("_new")), "left_anti").withColumn("_bucket", self._bucket()).select(*columns, "_bucket").unionByName(fresh)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        forget(self.spark, copy)
        folders = state["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        total = {k: state["counters"].get(k, 0) + (counters or {}).get(k, 0) for k in state["counters"].keys() | (counters or {}).keys()}
        self._commit({"number": state["number"] + 1, "folders": folders, "counters": total, "tokens": [*state["tokens"], *([token] if token else [])], "schema": state["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in news.schema)})
        return touched

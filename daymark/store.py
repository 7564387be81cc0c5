"""Tables in a shared folder: written once and read back, and sets of tables that readers see change all at once.

A store's state is a numbered list of tables and their folders. A change writes new folders beside the old ones and
then one new list, in one step that fails if another change was faster; readers take the newest list and see all of a
change or nothing of it. A change has an id: run again, after it died anywhere or after it was done, it does no harm.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which spark.checkpoint.dir names; only a local master may do without (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="daymark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what follows doesn't compute it again, and lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/daymark-kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Overtaken(RuntimeError):
    """Another change was published since this one read the store; run it again."""


@dataclass(frozen=True)
class Change:
    """New content of a table: whole, or of some parts (values of the column `by`) with all others staying as they are."""

    rows: DataFrame
    by: str | None = None
    parts: Sequence | None = None


@dataclass(frozen=True)
class Snapshot:
    """What readers see: for each table its schema and its folders by part; number 0 is the empty store."""

    number: int
    tables: Mapping[str, dict]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _lists(self) -> dict[int, str]:
        folder = self._path(f"{self.root}/_lists")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return {int(n.split("-")[0]): n for n in names if re.fullmatch(r"[0-9]+-[0-9a-f]{32}\.json", n)}

    def snapshot(self, number: int | None = None) -> Snapshot:
        lists = self._lists()
        if not lists and number is None:
            return Snapshot(0, {})
        number = max(lists) if number is None else number
        text = self.spark.read.text(f"{self.root}/_lists/{lists[number]}", wholetext=True).first()[0]
        return Snapshot(number, json.loads(text))

    def applied(self, change_id: str) -> bool:
        return any(n.endswith(f"-{self._digest(change_id)}.json") for n in self._lists().values())

    def table(self, name: str, at: Snapshot | None = None, parts: Sequence | None = None) -> DataFrame:
        """A table of a snapshot (the newest), or only some of its parts."""
        held = (at or self.snapshot()).tables[name]
        schema = T.StructType.fromJson(held["schema"])
        wanted = None if parts is None else {str(p) for p in parts}
        folders = [f for part, f in held["folders"].items() if wanted is None or part in wanted]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    @staticmethod
    def _digest(change_id: str) -> str:
        return hashlib.sha256(change_id.encode()).hexdigest()[:32]

    def _write(self, change: Change, folder: str) -> dict[str, str]:
        """Folders by part. A part is a folder without a partition column, which the rows keep."""
        if change.by is None:
            change.rows.write.mode("overwrite").parquet(f"{self.root}/{folder}")
            return {"": folder}
        rows = change.rows.withColumn("_part", F.col(change.by).cast("string"))
        if change.parts is not None:
            rows = rows.where(F.col("_part").isin([str(p) for p in change.parts]))
        plain = [f.name for f in change.rows.schema if isinstance(f.dataType, T.AtomicType)]  # a part of very many rows is several files
        rows.repartition("_part", F.pmod(F.xxhash64(*plain), F.lit(16))).write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/{folder}")
        made = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if f.isDirectory()]
        return {self.spark._jvm.org.apache.hadoop.fs.Path(n).getName().removeprefix("_part="): f"{folder}/{n}" for n in made if n.startswith("_part=")}

    def publish(self, change_id: str, changes: Mapping[str, Change], read: Snapshot | None = None) -> Snapshot:
        """Write all tables of a change and let readers see them together. A change that is there already changes nothing.

        read: the snapshot that the change was made from; if another change came after it, this one is refused.
        """
        if self.applied(change_id):
            return self.snapshot()
        before = read or self.snapshot()
        tables = {k: dict(v) for k, v in before.tables.items()}
        for name, change in changes.items():
            # a try of its own folder: one that died leaves files that no list names
            new = self._write(change, f"{name}/{self._digest(change_id)}-{uuid.uuid4().hex[:8]}")
            stay = {} if change.parts is None or name not in tables else {p: f for p, f in tables[name]["folders"].items() if p not in {str(x) for x in change.parts}}
            tables[name] = {"schema": change.rows.schema.jsonValue(), "folders": stay | new}
        self._flip(before.number + 1, change_id, tables)
        return Snapshot(before.number + 1, tables)

    def _flip(self, number: int, change_id: str, tables: dict) -> None:
        """The one step that readers see: the list of the next number, which only one change can make."""
        mark = self._path(f"{self.root}/_numbers/{number}")
        if not self._fs.mkdirs(self._path(f"{self.root}/_numbers")) or not self._claims(mark, change_id):
            raise Overtaken(f"list {number} was made by another change")
        name = f"{number:012d}-{self._digest(change_id)}.json"
        draft = self._path(f"{self.root}/_drafts/{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/_lists"))
        if not self._fs.rename(draft, self._path(f"{self.root}/_lists/{name}")) and not self.applied(change_id):
            raise Overtaken(f"list {number} could not be published")

    def _claims(self, mark, change_id: str) -> bool:
        """Whether this change holds the number: it makes the mark, or made it in a try that died before its list was there."""
        try:
            out = self._fs.create(mark, False)  # fails where it exists
        except Exception as error:
            if not self._fs.exists(mark):
                raise error
            return self.spark.read.text(mark.toString(), wholetext=True).first()[0] == change_id and not any(n == int(mark.getName()) for n in self._lists())
        out.write(bytearray(change_id.encode()))
        out.close()
        return True

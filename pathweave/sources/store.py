"""A store of entity tables as parquet folders with atomic commits.

A table is a list of folders; a commit is a small file that names the folders of all tables. Writers add folders and then the next
commit, a file that only the first of several writers can create; readers see one commit. Inserts add a folder, updates and
deletes replace the table's folders. A transaction that is rolled back leaves folders that no commit names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..runtime import create_once, fs, read_text


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.number, self.state = self._latest()
        self.staged: dict | None = None

    def _latest(self) -> tuple[int, dict]:
        system, p = fs(self.spark, f"{self.root}/commits")
        if not system.exists(p):
            return 0, {"tables": {}, "batches": {}}
        numbers = [int(s.getPath().getName().split(".")[0]) for s in system.listStatus(p) if s.getPath().getName().endswith(".json")]
        if not numbers:
            return 0, {"tables": {}, "batches": {}}
        n = max(numbers)
        return n, json.loads(read_text(self.spark, f"{self.root}/commits/{n:012d}.json"))

    # transactions --------------------------------------------------------------------------------------------------

    def begin(self) -> None:
        self.number, self.state = self._latest()
        self.staged = json.loads(json.dumps(self.state))

    def commit(self) -> None:
        n = self.number + 1
        if not create_once(self.spark, f"{self.root}/commits/{n:012d}.json", json.dumps(self.staged)):
            self.staged = None
            raise Conflict(f"commit {n} exists")
        self.number, self.state, self.staged = n, self.staged, None

    def rollback(self) -> None:
        self.staged = None

    def _now(self) -> dict:
        return self.staged if self.staged is not None else self.state

    def _write(self, change) -> None:
        """Runs a change of the state in the open transaction, or in one of its own."""
        own = self.staged is None
        if own:
            self.begin()
        try:
            change(self.staged)
        except BaseException:
            if own:
                self.rollback()
            raise
        if own:
            self.commit()

    # tables --------------------------------------------------------------------------------------------------------

    def tables(self) -> list[str]:
        return sorted(self._now()["tables"])

    def read(self, name: str) -> DataFrame:
        t = self._now()["tables"].get(name)
        if t is None:
            raise KeyError(f'table "{name}" doesn\'t exist')
        schema = T.StructType.fromJson(t["schema"])
        return self.spark.read.schema(schema).parquet(*t["folders"]) if t["folders"] else self.spark.createDataFrame([], schema)

    def create(self, name: str, schema: T.StructType, if_not_exists: bool = False) -> None:
        def change(s):
            if name in s["tables"]:
                if if_not_exists:
                    return
                raise ValueError(f'table "{name}" exists')
            s["tables"][name] = {"schema": schema.jsonValue(), "folders": []}

        self._write(change)

    def drop(self, name: str, if_exists: bool = False) -> None:
        def change(s):
            if s["tables"].pop(name, None) is None and not if_exists:
                raise KeyError(f'table "{name}" doesn\'t exist')

        self._write(change)

    def append(self, name: str, df: DataFrame) -> str:
        """Adds rows; the folder they are in."""
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"

        def change(s):
            df.write.parquet(path)
            s["tables"][name]["folders"].append(path)

        self._write(change)
        return path

    def replace(self, name: str, df: DataFrame) -> None:
        def change(s):
            path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            s["tables"][name] = {"schema": df.schema.jsonValue(), "folders": [path]}

        self._write(change)

    # batches of streams ----------------------------------------------------------------------------------------------

    def done(self, stream: str) -> int:
        """The last batch of a stream that was committed, -1 if none."""
        return self._now()["batches"].get(stream, -1)

    def mark(self, stream: str, batch: int) -> None:
        self._write(lambda s: s["batches"].__setitem__(stream, batch))

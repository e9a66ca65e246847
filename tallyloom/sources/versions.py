"""Tables whose content changes all at once, whatever number of partitions a change touches.

A table is a folder. Every write puts its rows into a folder of their own below `data`, partitioned by the table's
replace scope; a state is a small file that lists which folder holds each partition, and the highest state number is the
table. A replace writes all its partitions first and then publishes one new state. Until that file has its name, readers
see the old content whole, and from then on the new one; a writer that dies in between leaves folders that no state
names, which `clean` removes. Two writers that start from one state cannot both publish: the second is told.

A scan lists the folders of its state, so a filter on the scope prunes partitions before a file is opened, and a scope
table prunes them at run time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.sources.tables import conform

_WRITE = "_write"


class ConflictError(RuntimeError):
    """Another writer has published since the state that this change started from."""


class VersionedTable:
    """One of the tables of `schemas`, in the folder `path` of a shared store."""

    def __init__(self, spark: SparkSession, path: str, table: str):
        self.spark, self.path, self.table = spark, path.rstrip("/"), table
        self.by = list(schemas.PARTITIONS[table])

    # --- states ---------------------------------------------------------------------------------
    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._files().listStatus(at)] if self._files().exists(at) else []

    def version(self) -> int:
        """Number of the present state; 0 before the first write."""
        return max((int(n) for n in self._names("states") if n.isdigit()), default=0)

    def state(self, version: int | None = None) -> list[tuple[dict[str, str | None], str]]:
        """Partitions of a state: their values and the folder that holds them. One entry per partition."""
        number = self.version() if version is None else version
        if number == 0:
            return []
        text = self.spark.read.text(f"{self.path}/states/{number}", wholetext=True).first()[0]
        return [(entry["partition"], entry["folder"]) for entry in json.loads(text)]

    def _publish(self, version: int, entries: list[tuple[dict[str, str | None], str]]) -> None:
        body = json.dumps([{"partition": values, "folder": folder} for values, folder in entries])
        files, number = self._files(), self._hadoop(f"{self.path}/states/{version}")
        draft = self._hadoop(f"{self.path}/states/_draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, number, options)  # one step, and never over a state that is there
        except Exception as error:
            files.delete(draft, False)
            if files.exists(number):
                raise ConflictError(f"{self.table}: state {version} was published by another writer") from error
            raise

    # --- reading --------------------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a state, by default the present one."""
        known = schemas.schema(self.table)
        folders = [f"{self.path}/{folder}" for _, folder in self.state(version)]
        if not folders:
            return self.spark.createDataFrame([], known)
        body = [f for f in known if f.name not in self.by]
        ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in body), f"`{_WRITE}` string", *(f"`{c}` string" for c in self.by)])
        rows = self.spark.read.schema(ddl).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known])

    def scan(self, scope: Mapping[str, str | None]) -> DataFrame:
        """Rows of one value for some or all of the scope's columns; only their partitions are opened."""
        if not set(scope) <= set(self.by):
            raise ValueError(f"{self.table} is partitioned by {', '.join(self.by)}")
        rows = self.read()
        for column, value in scope.items():
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def scan_scopes(self, scopes: DataFrame) -> DataFrame:
        """Rows of the scopes that a frame lists. Spark prunes by a frame that has a comparison in it; the one added here
        holds for every value."""
        keys = [c for c in self.by if c in scopes.columns]
        listed = scopes.select(*keys).distinct()
        for c in keys:
            listed = listed.where(F.col(c) >= F.lit(""))
        return self.read().join(listed, keys, "left_semi")

    # --- writing --------------------------------------------------------------------------------
    def _staged(self, rows: DataFrame) -> list[tuple[dict[str, str | None], str]]:
        """Write rows below `data` and return the partitions they made."""
        folder = f"data/{_WRITE}={uuid.uuid4().hex}"
        body = [f.name for f in schemas.schema(self.table) if f.name not in self.by]
        # One shuffle by partition keeps a partition's rows together; adaptive execution splits the large ones.
        ready = conform(rows, self.table).select(*body, *self.by).hint("rebalance", *self.by)
        ready.write.partitionBy(*self.by).parquet(f"{self.path}/{folder}")
        text = ", ".join(f"`{c}` string" for c in self.by)
        back = self.spark.read.schema(text).option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")
        place = F.regexp_extract(F.input_file_name(), rf".*/({folder}(?:/.*)?)/[^/]*$", 1).alias("_place")
        # One row per partition, as many as the new state lists.
        found = back.select(*self.by, place).distinct().collect()
        return [({c: r[c] for c in self.by}, unquote(r["_place"])) for r in found]

    def replace(self, rows: DataFrame, scopes: DataFrame) -> int:
        """Replace all scopes that `scopes` lists (the table's partition columns) by `rows`, and return the new state's number.

        Rows of other scopes are left out. A listed scope without rows is cleared. All of it shows at once."""
        before = self.version()
        listed = scopes.select(*self.by).distinct()
        cleared = {tuple(r) for r in listed.collect()}  # at most one per partition that the caller wants replaced
        condition = None
        marks = {c: f"_scope_{k}" for k, c in enumerate(self.by)}
        for c, mark in marks.items():
            same = F.col(c).eqNullSafe(F.col(mark))
            condition = same if condition is None else condition & same
        own = rows.join(listed.withColumnsRenamed(marks), condition, "left_semi")
        kept = [(v, f) for v, f in self.state(before) if tuple(v[c] for c in self.by) not in cleared]
        self._publish(before + 1, kept + self._staged(own))
        return before + 1

    def clean(self, keep: int = 1) -> list[str]:
        """Delete folders that none of the last `keep` states names, and older states; returns the folders' names. Only for times
        without writers: a write under way has a folder that no state names yet."""
        last = self.version()
        used = {folder.split("/")[1] for n in range(max(1, last - keep + 1), last + 1) for _, folder in self.state(n)}
        gone = [name for name in self._names("data") if name not in used]
        for name in gone:
            self._files().delete(self._hadoop(f"{self.path}/data/{name}"), True)
        for name in self._names("states"):
            if not name.isdigit() or int(name) <= last - keep:
                self._files().delete(self._hadoop(f"{self.path}/states/{name}"), False)
        return gone

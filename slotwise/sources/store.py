"""Indexes on disk: Parquet tables under one root, and a session's cache of open ones.

    root/rows/column_path=.../version=.../        rg_id, component, slot, w, bits; sorted by slot
    root/dictionary/column_path=.../version=.../  value, rank
    root/catalogue/column_path=.../               a row a save: version, value_type, encoding, ...

A column is written under its own directories, so columns can be saved in any order and at the
same time. Slots and row groups are pruned by Parquet statistics, columns by path. A save
writes a new version and then one catalogue row that names it: a reader sees the old column or
the new one, whole, and a save that fails half-way leaves the old one. What no row names any
more is removed afterwards.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.digits import Basis
from slotwise.operators.encoding import Encoding, IndexType
from slotwise.operators.index import BitmapIndex, ColumnEntry, IndexAccuracy


class IndexNotFound(LookupError):
    """There is no saved index of that column, row group or path."""


_CATALOGUE = "column_path string, version string, saved long, value_type string, encoding string, index_type string, basis array<int>, cardinality long, accuracy string"


def _at(root: str, table: str, column: str, version: str | None = None) -> str:
    at = f"{root.rstrip('/')}/{table}/column_path={quote(column, safe='')}"
    return f"{at}/version={version}" if version else at


def save(index: BitmapIndex, root: str) -> None:
    """Writes each column of ``index``; a column that is there is replaced."""
    spark = index.rows.sparkSession
    for column, e in index.entries.items():
        version = uuid.uuid4().hex
        rows = index.rows.where(F.col("column_path") == column).drop("column_path")
        rows.repartitionByRange("component", "slot", "rg_id", "w").sortWithinPartitions("component", "slot", "rg_id", "w").write.parquet(_at(root, "rows", column, version))
        index.dictionaries[column].select("value", "rank").write.parquet(_at(root, "dictionary", column, version))
        entry = (column, version, time.time_ns(), e.value_type, e.encoding.name, e.index_type.name, list(e.basis.bases), e.cardinality, e.accuracy.name)
        _commit(spark.createDataFrame([entry], _CATALOGUE), root, column)
        _forget(spark, root, column, version)


def _commit(entry: DataFrame, root: str, column: str) -> None:
    entry.coalesce(1).write.mode("append").parquet(_at(root, "catalogue", column))


def _forget(spark: SparkSession, root: str, column: str, kept: str) -> None:
    """Removes the versions of ``column`` other than ``kept``."""
    for table in ("rows", "dictionary"):
        path = spark._jvm.org.apache.hadoop.fs.Path(_at(root, table, column))
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in files.listStatus(path):
            if x.getPath().getName() != f"version={kept}":
                files.delete(x.getPath(), True)


class Builder:
    """Collects indexes of a batch and saves them all, several at a time."""

    def __init__(self, root: str):
        self.root, self.queued = root, []

    def add_index(self, values: DataFrame, column_path: str, encoding: Encoding = Encoding.EQUALITY, index_type: IndexType = IndexType.BITMAP, **how) -> Builder:
        """``values`` is (rg_id, doc, value) of every row group of the batch."""
        self.queued.append(lambda: BitmapIndex.build(values, column_path, encoding, index_type, **how))
        return self

    def save_all(self, at_once: int = 4) -> None:
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(lambda make: save(make(), self.root), self.queued))
        self.queued.clear()


def entries(spark: SparkSession, root: str) -> dict[str, ColumnEntry]:
    """What the catalogue has of each saved column."""
    return {c: e for c, (e, _) in _catalogue(spark, root).items()}


def _catalogue(spark: SparkSession, root: str) -> dict[str, tuple[ColumnEntry, str]]:
    """The latest entry and version of each column."""
    try:
        rows = spark.read.schema(_CATALOGUE).parquet(f"{root.rstrip('/')}/catalogue/*").collect()
    except AnalysisException as e:
        raise IndexNotFound(f"no indexes under {root}") from e
    return {
        r["column_path"]: (ColumnEntry(r["column_path"], r["value_type"], Encoding[r["encoding"]], IndexType[r["index_type"]], Basis(r["basis"]), r["cardinality"], IndexAccuracy[r["accuracy"]]), r["version"])
        for r in sorted(rows, key=lambda r: (r["saved"], r["version"]))
    }


def load(spark: SparkSession, root: str, columns: list[str] | None = None) -> BitmapIndex:
    """The saved indexes of ``columns`` (all by default); rows are read when they are needed."""
    known = _catalogue(spark, root)
    wanted = list(known) if columns is None else columns
    if missing := [c for c in wanted if c not in known]:
        raise IndexNotFound(f"no index of {', '.join(missing)} under {root}")
    found = None
    for c in wanted:
        entry, version = known[c]
        rows = spark.read.schema("rg_id int, component int, slot long, w long, bits long").parquet(_at(root, "rows", c, version))
        rows = rows.select(F.lit(c).alias("column_path"), "rg_id", "component", "slot", "w", "bits")
        ranks = spark.read.schema(f"value {entry.value_type}, rank long").parquet(_at(root, "dictionary", c, version))
        own = BitmapIndex(rows, {c: ranks}, {c: entry})
        found = own if found is None else found.plus(own)
    return found


def get_index(spark: SparkSession, root: str, rg_id: int, column: str) -> BitmapIndex:
    """The index of one column in one row group."""
    found = load(spark, root, [column]).row_group(rg_id)
    if found.rows.isEmpty():
        raise IndexNotFound(f"no row group {rg_id} of {column} under {root}")
    return found


class OpenIndexes:
    """Shared open indexes, counted by their users: opened once by key, persisted while in use."""

    def __init__(self):
        self.lock = threading.Condition()
        self.open: dict[str, BitmapIndex | None] = {}
        self.users: dict[str, int] = {}

    def reserve(self, key: str, make: Callable[[], BitmapIndex]) -> BitmapIndex:
        """The index of ``key``; the first caller makes it while others wait."""
        with self.lock:
            while key in self.open and self.open[key] is None:
                self.lock.wait()
            if key in self.open:
                self.users[key] += 1
                return self.open[key]
            self.open[key], self.users[key] = None, 1
        try:
            made = make().persisted()
        except BaseException:
            with self.lock:
                del self.open[key], self.users[key]
                self.lock.notify_all()
            raise
        with self.lock:
            self.open[key] = made
            self.lock.notify_all()
        return made

    def get(self, key: str) -> BitmapIndex | None:
        with self.lock:
            return self.open.get(key)

    def release(self, key: str, last: Callable[[BitmapIndex], None] | None = None) -> None:
        """Gives up one use. The last one unpersists, and hands the index to ``last``. An index
        that is still being made isn't open: there is no use of it to give up."""
        with self.lock:
            if self.open.get(key) is None:
                raise IndexNotFound(f"{key} isn't open")
            self.users[key] -= 1
            if self.users[key]:
                return
            gone = self.open.pop(key)
            del self.users[key]
        gone.rows.unpersist()
        if last:
            last(gone)

    def __len__(self) -> int:
        with self.lock:
            return len(self.open)

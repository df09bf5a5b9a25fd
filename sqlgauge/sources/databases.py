"""Databases that gold and predicted queries run on.

Each database is a session of its own holding the tables as views, so equal table names of different
databases never meet and no shared catalog is written.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Mapping
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.session import file_bytes

SUFFIX = ".parquet"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Bytes of the files of a database up to which setting up a statement takes longer than running it; Spark reads that much as one partition.
SMALL = 1024 * 1024


class Databases:
    """Lookup from database name to a session that sees its tables, here from given paths; opened on first use."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Mapping[str, str]], keep_open: int = 64):
        self._spark = spark
        self._tables = {name: dict(paths) for name, paths in tables.items()}
        self._open: OrderedDict[str, SparkSession] = OrderedDict()
        self._keep_open = keep_open
        self._lock = Lock()

    def __contains__(self, name: str) -> bool:
        return bool(self._paths(name))

    def names_table(self) -> DataFrame:
        """The names of all databases, as a table: (database)."""
        return self._spark.createDataFrame([(name,) for name in self._tables], "database string")

    def tables(self, name: str) -> list[str]:
        return sorted(self._paths(name))

    def _paths(self, name: str) -> Mapping[str, str]:
        return self._tables.get(name, {})

    def session(self, name: str) -> SparkSession:
        with self._lock:
            session = self._open.pop(name, None) or self._new_session(name)
            self._open[name] = session
            if len(self._open) > self._keep_open:
                self._open.popitem(last=False)
            return session

    def _new_session(self, name: str) -> SparkSession:
        session = self._spark.newSession()
        tables = {table: session.read.parquet(path) for table, path in self._paths(name).items()}
        small = sum(file_bytes(rows) for rows in tables.values()) <= SMALL
        if small:
            # neither compiled nor dealt over partitions
            session.conf.set("spark.sql.codegen.wholeStage", "false")
            session.conf.set(PARTITIONS, "1")
        for table, rows in tables.items():
            # known to be one partition, rows need no exchange where a statement gathers them
            (rows.coalesce(1) if small else rows).createOrReplaceTempView(table)
        return session


class FolderDatabases(Databases):
    """Databases of a folder laid out as ``<db_id>/<table>.parquet``, each table a file or a folder of files.

    The tables of a database are listed when it is opened, and no other database is looked at then.
    """

    def __init__(self, spark: SparkSession, root: str, keep_open: int = 64):
        super().__init__(spark, {}, keep_open)
        self._root = root.rstrip("/")

    def _paths(self, name: str) -> Mapping[str, str]:
        jvm = self._spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}")
        files = folder.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not name or not files.exists(folder):
            return {}
        found = [f.getPath() for f in files.listStatus(folder)]
        return {p.getName().removesuffix(SUFFIX): p.toString() for p in found if p.getName().endswith(SUFFIX)}

    def names_table(self) -> DataFrame:
        """Spark lists the files as it does for any table; their contents are pruned, and the names stay a table."""
        files = (
            self._spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", f"*{SUFFIX}")
            .load(self._root)
        )
        name = F.regexp_extract("path", rf"^.*?/([^/]+)/[^/]+?{re.escape(SUFFIX)}(?:/.*)?$", 1)
        return files.select(name.alias("database")).distinct()


def register_databases(spark: SparkSession, root: str) -> FolderDatabases:
    """The databases of a folder; nothing is read or listed yet."""
    return FolderDatabases(spark, root)

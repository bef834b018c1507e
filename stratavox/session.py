"""Session helpers: a local session for tests, the shared folder, and written intermediate tables.

An intermediate table that several jobs read (or that must be the same on every read) is written as Parquet into the folder
that ``spark.checkpoint.dir`` names, which all executors share; losing an executor then loses nothing. Where the setting is empty, a
session on one machine (tests) gets a folder of its own, and a cluster must have a warehouse that is no folder of each machine.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN_FOLDER: list[str] = []
_WRITTEN: dict[str, Stash] = {}


@atexit.register
def _clear() -> None:
    """Deletes what this process has written for itself; nothing can read it any more."""
    for stash in list(_WRITTEN.values()):
        with contextlib.suppress(Exception):  # the session may be gone already; the folder is then cleared by its owner
            stash.drop()


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stratavox")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session. Where it is unset, a local session gets a folder of its own, and a
    cluster its warehouse; ValueError if that is a folder of each machine, where executors could not read one another's files."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="spark-stratavox-", dir=os.environ.get("TMPDIR", "/tmp")))
        return f"file://{_OWN_FOLDER[0]}"
    return cluster_folder(spark.conf.get("spark.sql.warehouse.dir"))


def cluster_folder(warehouse: str) -> str:
    """The warehouse, which must lie on storage that all machines share."""
    if not warehouse or warehouse.startswith(("file:", "/")):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share; the warehouse is a folder of each machine")
    return warehouse.rstrip("/")


@contextlib.contextmanager
def scratch():
    """Deletes, at its end, the intermediate tables written inside, for callers who have used up their result by then.

    A result is a plan over such tables, so they cannot go earlier; without this they go when the process ends.
    """
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            _WRITTEN[path].drop()


class Stash:
    """A DataFrame written once to the shared folder. ``df`` reads it; ``drop`` deletes it when nothing reads it any more.

    ``seen`` holds the aggregates ``observe`` (by name) over the rows, taken while they are written.
    """

    def __init__(self, df: DataFrame, label: str, observe: dict[str, Column] | None = None):
        self.spark = df.sparkSession
        self.conf = self.spark._jsc.hadoopConfiguration()
        self.path = f"{shared_folder(self.spark)}/stratavox-{label}-{uuid.uuid4().hex[:12]}"
        if observe:
            taken = Observation()
            df.observe(taken, *[c.alias(name) for name, c in observe.items()]).write.parquet(self.path)
            self.seen = taken.get
        else:
            df.write.parquet(self.path)
        _WRITTEN[self.path] = self
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.conf).delete(path, True)
        _WRITTEN.pop(self.path, None)

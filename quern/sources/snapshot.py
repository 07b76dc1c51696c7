"""Snapshots: every typed table as Parquet under a version, and a pointer to the last whole one."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[5:-3]) for s in fs.listStatus(p) if s.getPath().getName().startswith("done-"))


def save(tables: dict[str, DataFrame], root: str) -> int:
    """Write all tables as the next version. It counts only once its mark is there, so a failed save leaves the last one in place."""
    spark = next(iter(tables.values())).sparkSession
    version = max(_versions(spark, root), default=0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v{version:06d}/{name}")
    fs, mark = _fs(spark, f"{root}/done-{version:06d}.ok")
    fs.create(mark, True).close()
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last whole version, or of the given one; none without a snapshot."""
    known = _versions(spark, root)
    version = version or max(known, default=0)
    if version not in known:
        return {}
    fs, p = _fs(spark, f"{root}/v{version:06d}")
    return {s.getPath().getName(): spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(p)}


class BackgroundSave:
    """One save at a time on a thread of its own; ``wait`` raises what it raised."""

    def __init__(self):
        self._thread, self._error, self.version = None, None, 0

    def start(self, tables: dict[str, DataFrame], root: str) -> None:
        if self._thread and self._thread.is_alive():
            raise RuntimeError("background save in progress")
        self._error = None

        def run() -> None:
            try:
                self.version = save(tables, root)
            except Exception as e:
                self._error = e

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def wait(self) -> int:
        if self._thread:
            self._thread.join()
        if self._error:
            raise self._error
        return self.version

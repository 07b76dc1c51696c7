"""Scratch tables in the folder that driver and executors share.

Iterative operators cut their lineage here rather than in executor memory: a
table written to the shared folder outlives the executor that wrote it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master without that setting."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_quern_shared"):
        sc._quern_shared = "file://" + tempfile.mkdtemp(prefix="quern-")
    return sc._quern_shared


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session; they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quern-")), "quern.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    sc._quern_shipped = True


def trim(spark: SparkSession) -> str | None:
    """Have the driver's allocator give freed native memory back to the system; None where its JVM has no command for that."""
    jvm = spark._jvm
    server = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the class of the server itself is closed to reflection
    args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return next(m for m in server.getMethods() if m.getName() == "invoke").invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return None


class Scratch:
    """A folder of its own under the shared one, for the tables of one call of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._held: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return it as read back, with the lineage cut."""
        self._n += 1
        to = self.path(name or f"t{self._n}")
        df.write.mode("overwrite").parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._quern_path = to
        self._held.add(to)
        return out

    def _delete(self, to: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(to)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._held.discard(to)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            to = getattr(df, "_quern_path", None)
            if to:
                self._delete(to)

    def release(self) -> None:
        """Shuffle files are deleted when the driver collects what refers to them; after a large step it had better do so.

        Its threads also leave freed native memory with the allocator, which is then given back.
        """
        self.spark._jvm.System.gc()
        trim(self.spark)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete all tables but those that the result reads."""
        for to in self._held - {getattr(df, "_quern_path", None) for df in tables}:
            self._delete(to)

"""Stage tables: Parquet written to the folder all executors share, so that lineage is
cut without keeping anything on a single machine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, but only for an in-process
    ``local[...]`` master (tests): on a cluster a machine-local folder would be unreadable
    for the other executors, so that case raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="orrery-")
    return _OWN[app]


class Stages:
    """Named stage tables of one operator call, below one fresh folder."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/orrery/{owner}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        if self._n == 1:  # what no caller drops goes when the session ends
            root, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root), self.spark.sparkContext._jsc.hadoopConfiguration()
            root.getFileSystem(conf).deleteOnExit(root)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._orrery_stage = path
        return back

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Like :meth:`save`, with the number of rows written, which takes no further job."""
        rows = Observation()
        return self.save(df.observe(rows, F.count(F.lit(1)).alias("n")), name), int(rows.get["n"])

    def drop(self, *tables: DataFrame) -> None:
        """Delete stage tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._orrery_stage)
            path.getFileSystem(conf).delete(path, True)

    def drop_all(self) -> None:
        """Delete every stage table of this call."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

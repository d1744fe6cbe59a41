"""Tables that several results share, written once in the folder that driver and executors share, with a life that ends.

    with Stages(spark) as stages:
        messages = stages.keep(messages, "messages")
        ...                       # results that read it are written here

What is kept has no lineage: a lost executor costs the tasks that it ran, not the stage.  Queries that hand out a result for others to write use the
session's own Stages, which ends with the session or by close_all.
"""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that may be sent to every task.
BROADCAST_BYTES = 32 << 20
#: Bytes of rows that reach a Python worker at once.
ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let the session's Python workers import this package wherever the driver was started, and hand them rows in batches bounded by bytes:
    a number of rows alone bounds nothing where texts are long."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(limit, str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in a local session, where it is unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="echofold-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Stages:
    """The stage tables of one run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, name: str) -> str:
        """A path of its own, deleted with the rest."""
        self.paths.append(f"{shared_dir(self.spark)}/echofold-stage-{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.option("compression", "snappy").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the tables; whatever reads them must have been written."""
        sc = self.spark.sparkContext
        while self.paths and sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.close()


_OF: dict[str, Stages] = {}


def of(spark: SparkSession) -> Stages:
    """The session's own."""
    return _OF.setdefault(spark.sparkContext.applicationId, Stages(spark))


@atexit.register
def close_all() -> None:
    for s in _OF.values():
        try:
            s.close()
        except Exception:  # noqa: BLE001, the session may be gone, and its folder with it
            s.paths.clear()
    _OF.clear()

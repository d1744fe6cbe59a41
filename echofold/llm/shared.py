"""Session plumbing that the operators of this subpackage have in common."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many bytes, by a measured size.
BROADCAST_BYTES = 32 << 20


#: Of stored tables: hashes hardly shrink, and this codec takes no memory outside the heap.
CODEC = "lz4_raw"
#: Bytes of rows that reach a Python worker at once.
ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let the session's Python workers import this package wherever the driver was started, and hand them rows in batches bounded by bytes:
    a number of rows alone bounds nothing where texts are long."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(limit, str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Stored tables that nobody has deleted yet: of this process, and of the call that collects its own.
STORED: list[str] = []
_OWN: ContextVar[list[str] | None] = ContextVar("echofold_stored", default=None)


@contextmanager
def own_tables() -> Iterator[list[str]]:
    """The tables stored inside, whatever else runs beside it: a list for sweep."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)
        STORED.extend(own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  A folder of our own only in a local session, where it is unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="echofold-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    own = _OWN.get()
    listed = STORED if own is None else own
    listed.append(f"{shared_dir(spark)}/echofold-{name}-{uuid.uuid4().hex}")
    return listed[-1]


def sweep(spark: SparkSession, keep: DataFrame | None = None, stored: list[str] | None = None) -> None:
    """Delete stored tables, those of own_tables or else all that are listed, but not those that keep reads itself.  Only for a caller whose results are
    written."""
    stored = STORED if stored is None else stored
    used = {x.rpartition("/")[0].rpartition("/")[2] for x in keep.inputFiles()} if keep is not None else set()
    for path in list(stored):
        if path.rpartition("/")[2] not in used:
            delete(spark, path)
            stored.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store(df: DataFrame, name: str, codec: str = CODEC) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    if not spark.sparkContext.master.startswith("local["):
        # What was shuffled to write it isn't needed any more; Spark deletes it from the executors once the driver's collector finds out.
        spark.sparkContext._jvm.System.gc()
    # The codec's decompressor can't read a large dictionary page by itself, which is what a filter on dictionaries does.
    return spark.read.option("parquet.filter.dictionary.enabled", "false").schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by store(), once nothing reads it any more."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/echofold-" in folder:
            delete(spark, folder)


def one_text(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows(doc_id, text) with one text for each doc_id, that of the smallest hash, and whether any doc_id had several.  Ids must not be null."""
    own = F.xxhash64("text")
    several = rows.groupBy("doc_id").agg(F.min(own).alias("_least"), F.max(own).alias("_most")).filter("_least <> _most")
    several = store(several.select("doc_id", "_least"), "texts")
    if several.isEmpty():
        return rows, False
    return rows.join(several, "doc_id", "left").filter(F.col("_least").isNull() | (own == F.col("_least"))).drop("_least"), True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The test fold: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1

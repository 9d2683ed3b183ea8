"""What the operators of this subpackage share: reading, cutting lineage, batches of bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_scratch: dict[str, str] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: unless PYTHONPATH has it, it is sent to them as a zip, once a session."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="moundworks-")) / "moundworks.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (root / "moundworks").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


#: Rows and bytes of an Arrow batch between the JVM and a Python worker, where the session leaves Spark's own (10,000 rows, 64
#: MB): rows are whole texts here, and a batch is held on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    for key, (usual, ours) in BATCH.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """One folder for this application under spark.checkpoint.dir; only a local session without that setting gets a folder of
    its own machine. ``clear`` removes it."""
    conf, app = spark.sparkContext.getConf(), spark.sparkContext.applicationId
    shared = conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/moundworks-{app}"
    master = conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="moundworks-")
    return _own_scratch[app]


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table or folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has cut; for when its results have been written, as they read some of them."""
    drop(spark, scratch_dir(spark))


class Scratch:
    """Tables that cut lineage. Those that no result reads go when the block ends: ``with Scratch(spark) as s``, ``s.cut(df)``
    for tables of the block, ``s.cut(df, keep=True)`` for those that the block's result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop(self.spark, path)

    def cut(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """Write df as a table in the shared folder and read it back: it is computed once and survives lost executors."""
        path = f"{scratch_dir(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """A hash of doc_id and text, which tells rows apart, null ids and several texts of one id too."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.xxhash64(doc, doc.isNull(), text, text.isNull())


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with whole numbers from 0 in a total order. Ranges of the order are numbered each by itself; the numbers of rows of
    the ranges before (a row a range) are added: no task sees more than its range."""
    ranged = df.repartitionByRange(*order).withColumn("_r", F.spark_partition_id())
    own = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_r").orderBy(*order)) - 1)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_r").agg(F.count("*").alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return own.join(starts, "_r").withColumn(name, F.col("_s") + F.col("_i")).drop("_r", "_i", "_s")


def small_batches(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes, so that Python objects made from one stay few."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()

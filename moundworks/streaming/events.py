"""Streaming forms: windowed counts with watermarks, running priors as keyed state equal to the batch windows, sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relops import upsert

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    if given := conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    master = conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="moundworks-stream-")
    return _own[app]


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream; ts becomes a timestamp, as watermarks ask for one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "14 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "14 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "14 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


PRIORS = "event_id long, user_id long, seen long, prior_purchases long, prev_type string"
STATE = "seen long, purchases long, last string"


def _priors(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's rows of a micro-batch come in frames of any order: they are put together, then ordered, then counted."""
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
    seen, purchases, last = state.get if state.exists else (0, 0, None)
    bought = (rows.event_type == "purchase").astype("int64")
    types = rows.event_type.astype(object)
    previous = types.shift(1)
    previous.iloc[0] = last
    out = pd.DataFrame({"event_id": rows.event_id, "user_id": key[0], "seen": seen + pd.RangeIndex(len(rows)), "prior_purchases": purchases + bought.cumsum() - bought, "prev_type": previous})
    state.update((seen + len(rows), int(purchases + bought.sum()), types.iloc[-1]))
    yield out


def running_priors(events: DataFrame) -> DataFrame:
    """Before each event: the user's events and purchases so far and the last type, kept as state. Batches must come in time
    order; within a batch a user's rows are ordered here, so a batch should hold what one task can of a user: bound it by
    maxFilesPerTrigger or maxBytesPerTrigger at the source."""
    keyed = events.select("event_id", "user_id", "ts", "event_type")
    return keyed.groupBy("user_id").applyInPandasWithState(_priors, PRIORS, STATE, "append", GroupStateTimeout.NoTimeout)


def running_priors_by_batch(events: DataFrame, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the same priors where one user may have very many rows. Counts before the batch are kept as a table
    in the shared folder, one row a user; within the batch they are windows, so nothing is held in a task."""
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/priors-{uuid.uuid4().hex}"
    versions: list[str] = []

    def run(batch: DataFrame, number: int) -> None:
        order = "partition by user_id order by ts, event_id"
        before = f"over ({order} rows between unbounded preceding and 1 preceding)"
        rows = batch.selectExpr("event_id", "user_id", "ts", "event_type", f"count(*) {before} as n", f"coalesce(sum(cast(event_type = 'purchase' as int)) {before}, 0) as b", f"lag(event_type) over ({order}) as l")
        old = spark.read.parquet(versions[-1]) if versions else spark.createDataFrame([], f"user_id long, {STATE}")
        joined = rows.join(old, "user_id", "left")
        first = F.col("n") == 0
        write(joined.select("event_id", "user_id", (F.coalesce("seen", F.lit(0)) + F.col("n")).alias("seen"), (F.coalesce("purchases", F.lit(0)) + F.col("b")).alias("prior_purchases"), F.when(first, F.col("last")).otherwise(F.col("l")).alias("prev_type")), number)
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("b"), F.max_by("event_type", F.struct("ts", "event_id")).alias("l"))
        merged = old.join(new, "user_id", "full")
        zero = F.lit(0).cast("long")
        path = f"{folder}/{number}"
        merged.select("user_id", (F.coalesce("seen", zero) + F.coalesce("n", zero)).alias("seen"), (F.coalesce("purchases", zero) + F.coalesce("b", zero)).alias("purchases"), F.when(F.col("n").isNotNull(), F.col("l")).otherwise(F.col("last")).alias("last")).write.mode("overwrite").parquet(path)
        versions.append(path)

    return run


def upsert_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows that come again replace the older ones (late revisions), as a new version of the table in
    ``path``/<number>; ``latest_version`` tells the last."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("fetched_at", F.lit(number))
        before = latest_version(spark, path, below=number)
        rows = upsert(spark.read.parquet(f"{path}/{before}"), new, keys) if before is not None else upsert(new.limit(0), new, keys)
        rows.write.mode("overwrite").parquet(f"{path}/{number}")

    return run


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [int(s.getPath().getName()) for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((n for n in done if below is None or n < below), default=None)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream gives over the rows there are now, as a Parquet table in the shared folder; the query's own
    checkpoint lies beside it. Complete results are written whole by each batch, appended ones by the file sink."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

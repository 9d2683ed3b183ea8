"""Readers and writers of the raw and derived layers."""

from __future__ import annotations

import csv
import gzip
import hashlib
import logging
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.exprs import clean_null
from ..operators.relops import keep_first, most_complete, union_relaxed, with_overrides

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def read_pitches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw daily CSV (plain or gz): all text, null tokens cleaned, a leading byte-order mark dropped, pinned columns cast
    (unreadable values become null). Rows longer than the header are cut by the reader.

    Files of one header are read together; files whose columns differ, in name or order, are read by their own header and
    put together by name.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in files_of(spark, path):
        if header := header_of(spark, file):
            groups.setdefault(header, []).append(file)
    if not groups:
        return spark.createDataFrame([], ", ".join(f"{c} {t.simpleString()}" for c, t in S.PINNED.items()))
    frames = [spark.read.option("header", True).option("mode", "PERMISSIVE").csv(files).toDF(*header) for header, files in groups.items()]
    raw = union_relaxed(*frames)
    return raw.withColumns({c: clean_null(F.col(c)).try_cast(S.PINNED.get(c, T.StringType())) for c in raw.columns})


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files that paths, folders and patterns stand for; markers and hidden files are left out."""
    jvm, out = spark._jvm, []
    for p in [path] if isinstance(path, str) else path:
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(where) or []:
            inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += [s.getPath().toString() for s in inner if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(out)


def header_of(spark: SparkSession, file: str) -> tuple[str, ...] | None:
    """The column names of a file, or None of an empty one."""
    first = spark.read.text(file).limit(1).collect()
    names = next(csv.reader([first[0][0].lstrip("\ufeff")])) if first else []
    return tuple(n.strip() for n in names) if any(n.strip() for n in names) else None


def land(spark: SparkSession, path: str, payload: bytes) -> tuple[str, str]:
    """Writes an answer as it came, gzipped, once: (path, sha256 of the payload). An answer that is there already stays, and
    what is there is told."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where):
        return path, sha256_bytes(gzip.decompress(read_bytes(spark, path)))
    out = fs.create(where, False)
    out.write(bytearray(gzip.compress(payload, mtime=0)))
    out.close()
    return path, sha256_bytes(payload)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").collect()[0][0])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return read_bytes(spark, path).decode()


OVERRIDES = "key_mlbam long, key_fangraphs string, key_bbref string, key_retro string"
KEYS = ["key_fangraphs", "key_bbref", "key_retro"]


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Corrections by hand; without the file an empty table of the same types."""
    if not files_of(spark, path):
        return spark.createDataFrame([], OVERRIDES)
    raw = spark.read.option("header", True).csv(path)
    types = dict(c.split() for c in OVERRIDES.split(", "))
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).try_cast(t).alias(c) for c, t in types.items()])


def crosswalk(register: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row a player: the register's fullest row, corrected where an override says so."""
    best = most_complete(register, ["key_mlbam"], KEYS, *KEYS)
    return with_overrides(best, overrides, "key_mlbam", KEYS).withColumnRenamed("key_mlbam", "mlbam_id")


def unique_pitches(df: DataFrame, *order) -> DataFrame:
    return keep_first(df, S.PITCH_KEY, *(order or [F.col("game_date"), F.xxhash64(*df.columns)]))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON, one object a file; the schema is taken over all files; the last file of a game wins."""
    rows = spark.read.option("multiLine", True).option("samplingRatio", 1.0).json(path).withColumn("_file", F.input_file_name())
    return keep_first(rows, ["game_pk"], F.col("_file"), last=True).drop("_file")


def read_register(spark: SparkSession, paths: list[str], kept: dict[str, str], key: str) -> DataFrame:
    """Shards of an all-text register: the known columns, cast; rows without key go."""
    frames = [spark.read.option("header", True).csv(p) for p in paths]
    frames = [f.select(*[c for c in kept if c in f.columns]) for f in frames]
    rows = reduce(lambda a, b: union_relaxed(a, b), frames)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).try_cast(t).alias(c) for c, t in kept.items()]).filter(F.col(key).isNotNull())


def write_seasons(df: DataFrame, path: str) -> None:
    """Overwrites only the seasons that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("season").parquet(path)


def candidate_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    return days.filter(F.month("day").between(2, 11))


def sha256_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def url_hash(base: str, params: dict[str, str]) -> str:
    """The same for any order of the parameters."""
    return sha256_bytes(f"{base}?{'&'.join(f'{k}={v}' for k, v in sorted(params.items()))}".encode())[:16]


class Catalog:
    """Logical tables over Parquet folders; those that don't exist yet are left out."""

    def __init__(self, spark: SparkSession, root: str, names: dict[str, str]):
        self.spark, self.root, self.names = spark, root, {identifier(n): p for n, p in names.items()}

    def exists(self, name: str) -> bool:
        """Whether any rows were written: a partitioned table of none is a folder without files."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.names[name]}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return False
        files = fs.listFiles(path, True)
        while files.hasNext():
            if files.next().getPath().getName()[0] not in "._":
                return True
        return False

    def table(self, name: str) -> DataFrame:
        if name not in self.names or not self.exists(name):
            raise LookupError(f"table {name} is missing; build it first")
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{self.names[name]}")

    def register_all(self) -> list[str]:
        found = [n for n in self.names if self.exists(n)]
        for n in found:
            self.table(n).createOrReplaceTempView(n)
        return found

    def write(self, name: str, df: DataFrame, mode: str = "overwrite", partition: str | None = None) -> None:
        """Replaces or appends by name: a table's own column order and types stay; partition: one folder a value, and only
        those that df has are replaced."""
        path = f"{self.root}/{self.names[identifier(name)]}"
        if mode == "append" and self.exists(name):
            old = self.spark.read.parquet(path).schema
            if extra := sorted(set(df.columns) - set(old.names)):
                raise ValueError(f"{name} has no column {', '.join(extra)}")
            df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old])
        writer = df.write.mode(mode).option("compression", "zstd")
        if partition:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
        writer.parquet(path)

    def save_table(self, name: str, df: DataFrame, replace: bool = True) -> None:
        """A table of the session's catalog; appending goes by name, not by position."""
        if replace or not self.spark.catalog.tableExists(identifier(name)):
            df.write.mode("overwrite").saveAsTable(name)
        else:
            df.select(*self.spark.table(name).columns).write.insertInto(name)

    def try_register(self, name: str) -> bool:
        """A view after a write; that it can't be made is logged and no failure of the write."""
        try:
            self.table(name).createOrReplaceTempView(identifier(name))
        except Exception:  # noqa: BLE001  the table itself is written
            logging.getLogger(__name__).exception("%s is written but not registered", name)
            return False
        return True

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self.names if self.exists(n)}

    def drop(self, names: list[str] | None = None) -> list[str]:
        """Removes derived tables; raw answers lie elsewhere and stay."""
        jvm, gone = self.spark._jvm, []
        for n in names or list(self.names):
            if self.exists(n):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.names[n]}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                gone.append(n)
        return gone

"""Versions of models under one folder: <root>/<name>/<version>, and LATEST, which names the last."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import SparkSession

from ..sources.readers import identifier, read_text, write_text
from .boosted import Boosted


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, model: Boosted, name: str, metrics: dict | None = None, version: str | None = None) -> str:
        """The pointer is written last: a run that breaks off leaves the older version in place."""
        version = version or datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ")
        folder = model.save(self.spark, f"{self.root}/{identifier(name)}/{version}", metrics)
        write_text(self.spark, f"{self.root}/{name}/LATEST", version)
        return folder

    def latest(self, name: str) -> str | None:
        version = read_text(self.spark, f"{self.root}/{identifier(name)}/LATEST")
        return f"{self.root}/{name}/{version.strip()}" if version else None

    def load(self, name: str, features: list[str] | None = None) -> Boosted:
        folder = self.latest(name)
        if folder is None:
            raise LookupError(f"no model {name}; train it first")
        return Boosted.load(self.spark, folder, features)

    def status(self, names: list[str]) -> dict[str, str | None]:
        return {n: self.latest(n) for n in names}

"""Fetching days of pitches: request parameters, throttling, retries, the saturation guard, the manifest, resuming."""

from __future__ import annotations

import random
import sqlite3
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SATURATED_ROWS

RETRIED = {408, 425, 429, 500, 502, 503, 504}


class TokenBucket:
    """At most rps requests a second on average (rps may be below 1), with a burst."""

    def __init__(self, rps: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rps, self.capacity, self.clock, self.sleep = rps, max(1.0, burst), clock, sleep
        self.tokens, self.at = self.capacity, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rps), now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rps)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


def wait_before_retry(attempt: int, retry_after: str | None = None, rng: Callable[[], float] = random.random) -> float:
    """Seconds, whole or not, that the server asks for; else doubling with a little chance."""
    try:
        asked = float(retry_after) if retry_after else -1.0
    except ValueError:  # a date: take the usual wait
        asked = -1.0
    return asked if asked >= 0 else min(60.0, 2.0**attempt) + rng()


def fetch(get: Callable[[str], tuple[int, dict, bytes]], url: str, bucket: TokenBucket, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body. Refusals of RETRIED and broken connections are tried again."""
    said = ""
    for attempt in range(tries):
        bucket.take()
        wait = None
        try:
            status, headers, body = get(url)
        except (OSError, TimeoutError) as e:
            said = str(e)
        else:
            if status == 200:
                return body
            said, wait = f"status {status}", headers.get("Retry-After")
            if status not in RETRIED:
                break
        if attempt < tries - 1:
            sleep(wait_before_retry(attempt, wait))
    raise OSError(f"{url}: {said}")


def pitch_parameters(start: date, end: date, team: str | None = None) -> dict[str, str]:
    """What a request for the pitches of some days asks for. The service's own names."""
    asked = {
        "all": "true", "type": "details", "game_date_gt": start.isoformat(), "game_date_lt": end.isoformat(), "hfSea": f"{start.year}|",
        "min_pitches": "0", "min_results": "0", "group_by": "name", "sort_col": "pitches", "player_event_sort": "api_p_release_speed", "sort_order": "desc",
    }
    return asked | ({"hfTeam": f"{team}|"} if team else {})


def fetch_day(get_rows: Callable[[date, str | None], list[dict]], day: date, teams: Iterable[str], key: Callable[[dict], tuple]) -> list[dict]:
    """A day's rows; where the answer may have been cut off, team by team, without repeated keys."""
    rows = get_rows(day, None)
    if len(rows) < SATURATED_ROWS:
        return rows
    found: dict[tuple, dict] = {}
    for team in teams:
        part = get_rows(day, team)
        if len(part) >= SATURATED_ROWS:
            raise OverflowError(f"{day}: {team} alone reaches the row cap")
        for row in part:
            found.setdefault(key(row), row)
    return list(found.values())


def chunks(items: list, size: int = 90) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


class Manifest:
    """What has been fetched, by (source, partition)."""

    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path)
        self.db.execute("pragma journal_mode = wal")
        self.db.execute("create table if not exists runs (source text, part text, status text, n integer, sha256 text, error text, fetched_at text, primary key (source, part))")

    def done(self, source: str, part: str) -> bool:
        return self.db.execute("select 1 from runs where source = ? and part = ? and status in ('ok', 'empty')", (source, part)).fetchone() is not None

    def record(self, source: str, part: str, status: str, n: int = 0, sha256: str | None = None, error: str | None = None) -> None:
        self.db.execute("insert or replace into runs values (?, ?, ?, ?, ?, ?, ?)", (source, part, status, n, sha256, error, datetime.now(UTC).isoformat()))
        self.db.commit()

    def invalidate(self, source: str, parts: list[str]) -> None:
        self.db.executemany("delete from runs where source = ? and part = ?", [(source, p) for p in parts])
        self.db.commit()

    def rows(self) -> list[tuple]:
        return self.db.execute("select * from runs order by source, part").fetchall()

    def summary(self) -> list[tuple]:
        return self.db.execute("select source, status, count(*), coalesce(sum(n), 0) from runs group by source, status order by 1, 2").fetchall()

    def failures(self) -> list[tuple]:
        return self.db.execute("select source, part, error from runs where status = 'failed' order by 1, 2").fetchall()

    def frame(self, spark: SparkSession) -> DataFrame:
        """All runs as a table."""
        return spark.createDataFrame(self.rows(), RUNS)


RUNS = "source string, part string, status string, n long, sha256 string, error string, fetched_at string"


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source", "status").agg(F.count("*").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def run_failures(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'failed'").select("source", "part", "error")


def ingest(days: Iterable[date], load: Callable[[date], int], manifest: Manifest, source: str = "pitches") -> dict[str, int]:
    """Loads days that aren't done; a failure is recorded and the loop goes on."""
    counts = {"ok": 0, "empty": 0, "failed": 0, "skipped": 0}
    for day in days:
        part = day.isoformat()
        if manifest.done(source, part):
            counts["skipped"] += 1
            continue
        try:
            n = load(day)
            status = "ok" if n else "empty"
            manifest.record(source, part, status, n)
        except Exception as e:  # noqa: BLE001  the next day may work
            status = "failed"
            manifest.record(source, part, status, error=str(e))
        counts[status] += 1
    return counts


def refresh(today: date, load: Callable[[date], int], manifest: Manifest, trailing: int = 14, source: str = "pitches") -> dict[str, int]:
    days = [today - timedelta(days=i) for i in range(trailing, -1, -1)]
    manifest.invalidate(source, [d.isoformat() for d in days])
    return ingest(days, load, manifest, source)

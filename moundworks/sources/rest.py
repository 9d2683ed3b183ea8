"""The REST service of games, people and teams: what is asked, and nested answers as flat tables.

Answers are kept as text, one JSON document a row, and flattened by column paths: a missing branch is null, and a frame of
no answers has the same columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import chunks

#: The service's names beside the tables' own, and the types.
GAME = {
    "game_pk": ("gamePk", "long"), "game_date": ("officialDate", "date"), "game_type": ("gameType", "string"), "season": ("season", "short"),
    "day_night": ("dayNight", "string"), "double_header": ("doubleHeader", "string"), "game_number": ("gameNumber", "int"), "venue_id": ("venue.id", "long"),
    "venue_name": ("venue.name", "string"), "status": ("status.detailedState", "string"), "home_team_id": ("teams.home.team.id", "long"),
    "away_team_id": ("teams.away.team.id", "long"), "home_score": ("teams.home.score", "int"), "away_score": ("teams.away.score", "int"),
}
PERSON = {
    "mlbam_id": ("id", "long"), "full_name": ("fullName", "string"), "first_name": ("firstName", "string"), "last_name": ("lastName", "string"),
    "bats": ("batSide.code", "string"), "throws": ("pitchHand.code", "string"), "primary_position": ("primaryPosition.abbreviation", "string"),
    "position_type": ("primaryPosition.type", "string"), "birth_date": ("birthDate", "date"), "birth_country": ("birthCountry", "string"), "height": ("height", "string"),
    "weight": ("weight", "int"), "mlb_debut_date": ("mlbDebutDate", "date"), "active": ("active", "boolean"),
}
TEAM = {
    "team_id": ("id", "long"), "abbreviation": ("abbreviation", "string"), "name": ("name", "string"), "team_code": ("teamCode", "string"),
    "franchise_name": ("franchiseName", "string"), "club_name": ("clubName", "string"), "league": ("league.name", "string"), "division": ("division.name", "string"),
    "venue_id": ("venue.id", "long"), "venue_name": ("venue.name", "string"), "season": ("season", "short"),
}


def documents(spark: SparkSession, answers: Iterable[dict]) -> DataFrame:
    """(document): a row an answer."""
    return spark.createDataFrame([(json.dumps(a),) for a in answers], "document string")


def flat(docs: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """The fields of JSON documents as columns; what can't be read as its type is null."""
    return docs.select(*[F.get_json_object("document", f"$.{path}").try_cast(kind).alias(name) for name, (path, kind) in fields.items()])


def games(docs: DataFrame) -> DataFrame:
    return flat(docs, GAME)


def people(docs: DataFrame) -> DataFrame:
    return flat(docs, PERSON)


def teams(docs: DataFrame) -> DataFrame:
    return flat(docs, TEAM)


def officials(docs: DataFrame, roles: Iterable[str]) -> DataFrame:
    """(game_pk, umpire_<role>_id, umpire_<role>_name) from documents {gamePk, officials: [{official: {id, fullName},
    officialType}]}; of several documents of a game the last by text stands."""
    shape = "struct<gamePk:long,officials:array<struct<official:struct<id:long,fullName:string>,officialType:string>>>"
    parsed = docs.select(F.from_json("document", shape).alias("d"), "document").groupBy("d.gamePk").agg(F.max_by("d", "document").alias("d"))

    def of(role: str):
        hit = F.get(F.filter("d.officials", lambda o: F.lower(F.replace(o["officialType"], F.lit(" "), F.lit("_"))) == role), F.lit(0))
        return [hit["official"]["id"].alias(f"umpire_{role}_id"), hit["official"]["fullName"].alias(f"umpire_{role}_name")]

    return parsed.filter("gamePk is not null").select(F.col("gamePk").alias("game_pk"), *[c for r in roles for c in of(r)])


class Client:
    """Asks by ``get(path, parameters)``, which returns a parsed answer; throttling and retries are its own matter."""

    def __init__(self, get: Callable[[str, dict], dict]):
        self.get = get

    def schedule(self, season: int, kind: str = "R") -> Iterator[dict]:
        for day in self.get("schedule", {"sportId": 1, "season": season, "gameType": kind}).get("dates", []):
            yield from day.get("games", [])

    def game_officials(self, game_pk: int) -> dict:
        return {"gamePk": game_pk, "officials": self.get(f"game/{game_pk}/boxscore", {}).get("officials", [])}

    def people(self, ids: Iterable[int], size: int = 90) -> Iterator[dict]:
        """In requests of at most ``size`` ids."""
        for part in chunks(sorted(set(ids)), size):
            yield from self.get("people", {"personIds": ",".join(map(str, part))}).get("people", [])

    def teams(self, season: int) -> Iterator[dict]:
        yield from self.get("teams", {"sportId": 1, "season": season}).get("teams", [])

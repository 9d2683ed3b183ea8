"""From raw files to tables, models and marts: each step reads tables by name and writes one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import splits
from ..functions.pitches import enrich, next_pitch_features, quality_features, swing_frame, takes
from ..models import heads
from ..models.registry import Registry
from ..operators import quality
from ..operators.run_value import RunValue
from ..settings import Settings
from ..sources import rest
from ..sources.readers import Catalog, crosswalk, read_overrides, read_pitches, read_register, read_text, unique_pitches, write_seasons, write_text
from . import marts
from .api import TABLES

REGISTER = {"key_mlbam": "long", "key_fangraphs": "string", "key_bbref": "string", "key_retro": "string", "name_first": "string", "name_last": "string", "birth_year": "int", "mlb_played_first": "int", "mlb_played_last": "int"}
ROLES = ("home_plate", "first_base", "second_base", "third_base")
MODELS = ("next_pitch", "location", "stuff_plus", "location_plus", "pitching_plus", "swing_whiff", "swing_contact", "called_strike")


class Workspace:
    """Tables under the lake, models beside them. Nothing is built twice in a call; a missing table raises LookupError."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.catalog = Catalog(spark, settings.lake, {n: n for n in TABLES})
        self.registry = Registry(spark, settings.models)

    def keep(self, name: str, df: DataFrame, partition: str | None = None) -> DataFrame:
        self.catalog.write(name, df, partition=partition)
        if not self.catalog.exists(name):
            return df.limit(0)
        self.catalog.try_register(name)
        return self.catalog.table(name)

    # --- tables ---

    def pitches(self) -> DataFrame:
        """All raw days in one job; only the seasons that they hold are replaced."""
        raw = read_pitches(self.spark, f"{self.settings.raw}/pitches/*")
        write_seasons(enrich(unique_pitches(raw)), f"{self.settings.lake}/fact_pitch")
        self.catalog.try_register("fact_pitch")
        return self.catalog.table("fact_pitch")

    def officials(self) -> DataFrame:
        docs = self.spark.read.text(f"{self.settings.raw}/officials", wholetext=True).toDF("document")
        return self.keep("dim_official", rest.officials(docs, ROLES))

    def dims(self, client: rest.Client, season: int) -> dict[str, int]:
        """Games, the people who were seen and the teams, from the REST service; known teams are kept."""
        games = self.keep("dim_game", rest.games(rest.documents(self.spark, client.schedule(season))))
        seen = [r[0] for r in self.catalog.table("fact_pitch").select(F.explode(F.array("pitcher", "batter")).alias("id")).distinct().filter("id is not null").collect()]  # thousands of ids: they go into requests
        people = self.keep("dim_player", rest.people(rest.documents(self.spark, client.people(seen))))
        teams = self.keep("dim_team", rest.teams(rest.documents(self.spark, client.teams(season))), "season")
        return {"games": games.count(), "people": people.count(), "teams": teams.count()}

    def crosswalk(self, shards: list[str]) -> DataFrame:
        register = read_register(self.spark, shards, REGISTER, "key_mlbam")
        return self.keep("dim_player_ids", crosswalk(register, read_overrides(self.spark, f"{self.settings.data_root}/id_overrides.csv")))

    def fact(self) -> DataFrame:
        return self.catalog.table("fact_pitch")

    # --- models ---

    def _quality_frame(self) -> DataFrame:
        return quality_features(marts.competitive(self.fact()).filter("pitch_type is not null"))

    def _takes(self) -> DataFrame:
        officials = self.catalog.table("dim_official") if self.catalog.exists("dim_official") else None
        return takes(marts.competitive(self.fact()), officials)

    def train_next_pitch(self, params: dict | None = None) -> dict:
        frame = splits.prepared(next_pitch_features(self.fact()), "target_pitch_type")
        split = splits.auto(frame)
        model = heads.next_pitch(split, params)
        scored = heads.personal(heads.kept_to_repertoire(model.predict(split.test), split.train), split.train)
        return self._saved(model, "next_pitch", heads.class_report(scored, "target_pitch_type", model.classes))

    def train_location(self, params: dict | None = None) -> dict:
        split = splits.auto(splits.prepared(next_pitch_features(self.fact()), "target_location"))
        model = heads.location(split, params)
        return self._saved(model, "location", heads.class_report(model.predict(split.test), "target_location", model.classes))

    def train_quality(self, params: dict | None = None, least: int = 100, groups: int = 30) -> dict:
        """Run values are fitted on the training part only."""
        split = splits.auto(self._quality_frame(), features=False)
        worth = RunValue.fit(split.train)
        write_text(self.spark, f"{self.settings.models}/run_value.json", worth.to_json())
        parts = {k: splits.prepared(worth.attach(v), "rv_pitcher") for k, v in split.parts().items()}
        from ..operators import metrics

        out = {}
        for role in heads.QUALITY:
            model = heads.pitch_quality(role, parts["train"], parts["valid"], params, least, groups)
            out[role] = self._saved(model, f"{role}_plus", metrics.regression_report(model.predict(parts["test"]), "prediction", "rv_pitcher"))
        return out

    def train_swing(self, params: dict | None = None) -> dict:
        from ..operators import metrics

        split, out = splits.auto(swing_frame(self.fact()), features=False), {}
        for role in heads.TARGETS:
            model = heads.swing(role, split.train, split.valid, params)
            scored = model.predict(heads.rows_for(role, split.test))
            report = heads.binary_report(scored, "is_whiff") if role == "whiff" else metrics.regression_report(scored, "prediction", heads.TARGETS[role][1])
            out[role] = self._saved(model, f"swing_{role}", report)
        return out

    def train_called_strike(self, params: dict | None = None) -> dict:
        split = splits.auto(self._takes(), features=False)
        model = heads.called_strike(split.train, split.valid, params)
        return self._saved(model, "called_strike", heads.binary_report(model.predict(split.test), "is_called_strike"))

    def _saved(self, model: heads.Boosted, name: str, report: DataFrame) -> dict:
        numbers = {k: v for k, v in report.collect()[0].asDict().items()}
        self.registry.save(model, name, numbers)
        return numbers

    # --- marts ---

    def mart_arsenal(self) -> DataFrame:
        return self.keep("mart_pitcher_arsenal", marts.pitcher_arsenal(self.fact()))

    def mart_zones(self) -> DataFrame:
        rows = marts.zone_profiles(self.fact(), "batter").unionByName(marts.zone_profiles(self.fact(), "pitcher"))
        return self.keep("mart_zone_profile", rows, "role")

    def mart_spray(self) -> DataFrame:
        return self.keep("mart_batter_spray", marts.batter_spray(self.fact()))

    def mart_stuff(self, min_pitches: int = 25) -> DataFrame:
        frame = self._quality_frame()
        frame = RunValue.fit(frame).attach(frame)
        for role, features in heads.QUALITY.items():
            frame = heads.graded(self.registry.load(f"{role}_plus", features), frame)
        return self.keep("mart_pitcher_stuff", marts.pitcher_stuff(frame, min_pitches))

    def mart_swing(self, min_swings: int = 200) -> DataFrame:
        rows = swing_frame(self.fact())
        whiff, contact = (heads.plane_value(self.registry.load(f"swing_{r}", heads.SWING), rows) for r in ("whiff", "contact"))
        return self.keep("mart_batter_swing", marts.batter_swing(whiff, contact, min_swings))

    def mart_called_strike(self, min_n: int = 500) -> dict[str, DataFrame]:
        """Framing, umpires and both grids, from one scored frame."""
        text = read_text(self.spark, f"{self.settings.models}/run_value.json")
        worth = RunValue.from_json(text) if text else RunValue.fit(self._quality_frame())
        rows = self.registry.load("called_strike", heads.CALLED).predict(self._takes())
        rows = rows.withColumn("strike_value", worth.strike_value(F.col("balls"), F.col("strikes")))
        out = {"mart_catcher_framing": marts.framing_runs(rows, "fielder_2", "probability", "strike_value", min_n), "mart_umpire_zone": marts.umpire_zone(rows, "probability", "strike_value", min_n)}
        out = {n: self.keep(n, df) for n, df in out.items()}
        grids = marts.catcher_grid(rows, "probability", min_n).unionByName(marts.umpire_grid(rows, min_n))
        return out | {"mart_zone_profile": self.keep("mart_zone_profile", grids.select("mlbam_id", "season", "metric", "n_pitches", "grid_n", "surface", "reliability", "role"), "role")}

    def mart_clusters(self, min_pitches: int = 200) -> DataFrame:
        rows = quality_features(self.fact())
        return self.keep("mart_pitcher_arsenal_clusters", marts.arsenal_clusters(rows, min_pitches=min_pitches))

    def mart_embedding(self, encoding: str = "slot", reducer: str = "tsne", k: int = 10) -> DataFrame:
        clusters = self.catalog.table("mart_pitcher_arsenal_clusters")
        rows, _ = marts.arsenal_embedding(self.spark, clusters, encoding, reducer)
        self.keep("mart_arsenal_neighbors", marts.arsenal_neighbors(self.spark, marts.encoded(clusters, encoding), k))
        return self.keep("mart_arsenal_embedding", rows)

    def all(self) -> None:
        """Everything that needs no model."""
        for step in (self.pitches, self.mart_arsenal, self.mart_zones, self.mart_spray, self.mart_clusters):
            step()

    # --- looking ---

    def register(self) -> list[str]:
        return self.catalog.register_all()

    def status(self) -> dict[str, int | None]:
        return {n: self.catalog.table(n).count() if self.catalog.exists(n) else None for n in TABLES}

    def check(self) -> tuple[list[quality.Outcome], bool]:
        outcomes = quality.run_checks(self.catalog.tables())
        return outcomes, quality.failed(outcomes)

    def clean(self) -> list[str]:
        """Drops what is derived; raw answers stay."""
        return self.catalog.drop()


STEPS: dict[str, Callable[[Workspace], object]] = {
    "build pitches": Workspace.pitches, "build officials": Workspace.officials, "build marts": lambda w: (w.mart_arsenal(), w.mart_zones()), "build all": Workspace.all, "build register": Workspace.register,
    "train next-pitch": Workspace.train_next_pitch, "train location": Workspace.train_location, "train stuff": Workspace.train_quality, "train swing": Workspace.train_swing, "train called-strike": Workspace.train_called_strike,
    "mart stuff": Workspace.mart_stuff, "mart swing": Workspace.mart_swing, "mart spray": Workspace.mart_spray, "mart called-strike": Workspace.mart_called_strike, "mart arsenal": Workspace.mart_clusters, "mart embed": Workspace.mart_embedding,
    "mart bakeoff": lambda w: marts.bake_off(w.spark, w.catalog.table("mart_pitcher_arsenal_clusters")),
    "status": Workspace.status, "models": lambda w: w.registry.status(list(MODELS)), "config": lambda w: w.settings.shown(), "clean": Workspace.clean,
}

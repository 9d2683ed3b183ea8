"""The query surface as functions from tables to DataFrames, one for each route. Errors: MissingTable (which says what to
build), LookupError for a missing entity, ValueError for a value outside its list."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import escape_like, pitch_family, top_probabilities
from ..functions.pitches import swing_frame
from ..operators.grid import SPRAY, ZONE
from ..operators.relops import keep_first, optional_filters

STUFF_SORTS = ("stuff_plus", "location_plus", "pitching_plus", "rv_per_100")
SWING_SORTS = ("whiff_plane_value_per_100", "contact_plane_value_per_100", "attack_angle")
ROLES = ("batter", "pitcher", "catcher", "umpire")
METRICS = ("xwoba", "whiff", "swing", "exit_velo", "run_value", "framing", "strike_rate")
CHRONO = ("game_date", "game_pk", "at_bat_number", "pitch_number")

#: Columns of the payloads.
PITCH_COLUMNS = "game_date game_pk at_bat_number pitch_number pitcher batter pitch_type description events balls strikes stand p_throws release_speed plate_x plate_z plate_z_norm ivb_in hb_arm_in is_swing is_whiff is_in_zone launch_speed launch_angle delta_run_exp".split()
MOVEMENT_COLUMNS = "pitch_type pitch_name release_speed ivb_in hb_arm_in release_spin_rate is_whiff is_swing description".split()
SWING_COLUMNS = "attack_angle vaa_deg swing_length bat_speed swing_path_tilt pitch_type is_whiff is_in_play estimated_woba_using_speedangle game_date".split()
BATTED_BALL_COLUMNS = "game_date x_ft y_ft launch_speed launch_angle estimated_woba_using_speedangle events home_team".split()
TABLES = "fact_pitch dim_player dim_game dim_team dim_player_ids dim_official mart_pitcher_arsenal mart_zone_profile mart_pitcher_stuff mart_batter_swing mart_catcher_framing mart_umpire_zone mart_batter_spray mart_pitcher_arsenal_clusters mart_arsenal_embedding mart_arsenal_neighbors".split()


class MissingTable(LookupError):
    """A table that is still to be built."""


def need(tables: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise MissingTable(f"{name} is missing; build it first")
    return tables[name]


def one_of(value: str, allowed) -> str:
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of {', '.join(allowed)}")
    return value


def found(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise LookupError(f"no {what}")
    return df


def latest_season(df: DataFrame) -> int | None:
    """The last season that there is data of, whatever the calendar says."""
    return df.agg(F.max("season")).collect()[0][0]


def health(tables: dict[str, DataFrame]) -> dict:
    """Which stages have run."""
    return {"status": "ok", "tables": {n: n in tables for n in TABLES}, "pitches": tables["fact_pitch"].count() if "fact_pitch" in tables else 0}


def seasons(pitches: DataFrame) -> DataFrame:
    return pitches.groupBy("season").agg(F.count("*").alias("pitches"), F.count_distinct("game_pk").alias("games"), F.min("game_date").alias("first_game"), F.max("game_date").alias("last_game")).orderBy(F.desc("season"))


def search(players: DataFrame, name: str, term: str, limit: int = 20) -> DataFrame:
    """Names that contain the term (two characters at least); those that start with it first. Wildcards in it are plain."""
    if len(term) < 2:
        raise ValueError("search for two characters at least")
    t, n = escape_like(term.lower()), F.lower(F.col(name))
    return players.filter(n.like(f"%{t}%")).orderBy(F.when(n.like(f"{t}%"), 0).otherwise(1), name).limit(limit)


def profile(pitches: DataFrame, player: int) -> DataFrame:
    """Pitches thrown and seen by season, the newest first."""
    of = lambda c: F.count_if(F.col(c) == player)
    rows = pitches.filter((F.col("pitcher") == player) | (F.col("batter") == player))
    return rows.groupBy("season").agg(of("pitcher").alias("pitches_thrown"), of("batter").alias("pitches_seen")).orderBy(F.desc("season"))


def entity(df: DataFrame, key: str, value: int, what: str) -> DataFrame:
    return found(df.filter(F.col(key) == value), what)


def player_arsenal(mart: DataFrame, player: int, season: int | None = None) -> DataFrame:
    return optional_filters(mart, mlbam_id=player, season=season).orderBy(F.desc("season"), F.desc("pitches"), "pitch_type")


def player_ids(ids: DataFrame, player: int) -> DataFrame:
    return entity(ids, "mlbam_id", player, "crosswalk entry")


def player_games(pitches: DataFrame, player: int, season: int | None = None, limit: int = 25) -> DataFrame:
    rows = optional_filters(pitches, pitcher=player, season=season)
    return rows.groupBy("game_pk", "game_date", "season").agg(F.count("*").alias("pitches")).orderBy(F.desc("game_date"), "game_pk").limit(limit)


def player_leaders(mart: DataFrame, players: DataFrame, season: int | None = None, min_pitches: int = 500, limit: int = 50) -> DataFrame:
    """Pitchers by volume, their rates weighted by pitches."""
    season = latest_season(mart) if season is None else season
    mean = lambda c: F.round(F.sum(F.col("pitches") * F.col(c)) / F.sum("pitches"), 1).alias(c)
    rows = mart.filter(F.col("season") == season).join(players.select("mlbam_id", "full_name"), "mlbam_id")
    out = rows.groupBy("mlbam_id", "full_name", "season", "p_throws").agg(mean("velo_avg"), mean("csw_pct"), F.count("*").alias("pitch_types"), F.sum("pitches").alias("pitches"))
    return out.filter(F.col("pitches") >= min_pitches).orderBy(F.desc("pitches"), "mlbam_id").limit(limit)


def pitch_rows(pitches: DataFrame, columns: list[str] | None = None, limit: int = 5000, **wanted) -> DataFrame:
    """Filtered pitches in order of play; at least one of pitcher, batter and game_pk must be given."""
    if all(wanted.get(k) is None for k in ("pitcher", "batter", "game_pk")):
        raise ValueError("ask for a pitcher, a batter or a game")
    return optional_filters(pitches, **wanted).orderBy(*CHRONO).select(*(columns or PITCH_COLUMNS)).limit(limit)


def trajectory(pitches: DataFrame, game_pk: int, at_bat: int, pitch: int) -> DataFrame:
    return found(pitches.filter((F.col("game_pk") == game_pk) & (F.col("at_bat_number") == at_bat) & (F.col("pitch_number") == pitch) & F.col("vx0").isNotNull()).limit(1), "tracked pitch")


def movement(pitches: DataFrame, pitcher: int, season: int | None = None) -> DataFrame:
    rows = optional_filters(pitches, pitcher=pitcher, season=season).filter("is_tracked_pitch and is_competitive and pitch_type is not null")
    return rows.select(*MOVEMENT_COLUMNS)


def movement_centroids(points: DataFrame, least: int = 5) -> DataFrame:
    """(pitch_type, n, hb, ivb, velo) of types shown often enough; a null speed counts as 0, as the charts have it."""
    rows = points.filter("ivb_in is not null and hb_arm_in is not null and pitch_type is not null").groupBy("pitch_type")
    return rows.agg(F.count("*").alias("n"), F.avg("hb_arm_in").alias("hb"), F.avg("ivb_in").alias("ivb"), F.avg(F.coalesce("release_speed", F.lit(0.0))).alias("velo")).filter(F.col("n") >= least)


def velocity_trend(pitches: DataFrame, least: int = 5) -> DataFrame:
    """(family, inning, velo, n, thin): thin marks means of few pitches."""
    rows = pitches.filter("release_speed is not null and inning is not null and pitch_type is not null")
    out = rows.groupBy(pitch_family(F.col("pitch_type")).alias("family"), "inning").agg(F.avg("release_speed").alias("velo"), F.count("*").alias("n"))
    return out.withColumn("thin", F.col("n") < least)


def league_shapes(pitches: DataFrame, hand: str = "R", season: int | None = None, min_n: int = 100) -> DataFrame:
    season = latest_season(pitches) if season is None else season
    rows = optional_filters(pitches, p_throws=one_of(hand, ("L", "R")), season=season).filter("is_tracked_pitch and is_competitive and pitch_type is not null")
    stats = [F.round(F.avg(c), 1).alias(a) for c, a in (("release_speed", "velo"), ("ivb_in", "ivb_in"), ("hb_arm_in", "hb_arm_in"))] + [F.round(F.stddev_samp(c), 2).alias(a) for c, a in (("ivb_in", "ivb_sd"), ("hb_arm_in", "hb_sd"))]
    return rows.groupBy("pitch_type").agg(F.count("*").alias("n"), *stats).filter(F.col("n") >= min_n).orderBy(F.desc("n"), "pitch_type")


def _named(rows: DataFrame, players: DataFrame) -> DataFrame:
    return rows.join(players.select("mlbam_id", "full_name"), "mlbam_id", "left")


def _board(rows: DataFrame, players: DataFrame, season: int | None, sort: Column, limit: int) -> DataFrame:
    season = latest_season(rows) if season is None else season
    return _named(rows.filter(F.col("season") == season), players).orderBy(sort, "mlbam_id").limit(limit)


def stuff_leaders(stuff: DataFrame, players: DataFrame, season: int | None = None, sort: str = "stuff_plus", min_pitches: int = 25, limit: int = 50) -> DataFrame:
    rows = stuff.filter((F.col("pitch_type") == "ALL") & (F.col("pitches") >= min_pitches))
    return _board(rows, players, season, F.col(one_of(sort, STUFF_SORTS)).desc_nulls_last(), limit)


def stuff_detail(stuff: DataFrame, pitcher: int) -> DataFrame:
    return entity(stuff, "mlbam_id", pitcher, "such pitcher").orderBy(F.desc("season"), F.when(F.col("pitch_type") == "ALL", 0).otherwise(1), F.desc("pitches"), "pitch_type")


def swing_leaders(swing: DataFrame, players: DataFrame, season: int | None = None, sort: str = "whiff_plane_value_per_100", min_swings: int = 200, limit: int = 50) -> DataFrame:
    return _board(swing.filter(F.col("whiff_swings") >= min_swings), players, season, F.col(one_of(sort, SWING_SORTS)).desc_nulls_last(), limit)


def swing_detail(swing: DataFrame, batter: int, season: int | None = None) -> DataFrame:
    return found(optional_filters(swing, mlbam_id=batter, season=season), "graded swings of this batter").orderBy(F.desc("season"))


def swing_pitches(pitches: DataFrame, batter: int, season: int | None = None) -> DataFrame:
    """Every tracked swing of a batter: the rows that the mart is made of, so that the two can't drift apart."""
    return swing_frame(pitches, season).filter(F.col("batter") == batter).select(*SWING_COLUMNS)


def catcher_leaders(framing: DataFrame, players: DataFrame, season: int | None = None, min_pitches: int = 500, limit: int = 50) -> DataFrame:
    return _board(framing.filter(F.col("n") >= min_pitches), players, season, F.desc("framing_runs"), limit)


def catcher_detail(framing: DataFrame, catcher: int, season: int | None = None) -> DataFrame:
    return found(optional_filters(framing, mlbam_id=catcher, season=season), "framing grade of this catcher").orderBy(F.desc("season"))


def umpires(zones: DataFrame, officials: DataFrame, season: int | None = None, min_pitches: int = 500, limit: int = 50) -> DataFrame:
    """By the size of the edge, either way; an umpire of two spellings has two rows."""
    season = latest_season(zones) if season is None else season
    names = officials.select(F.col("umpire_home_plate_id").alias("mlbam_id"), F.col("umpire_home_plate_name").alias("full_name")).distinct()
    rows = zones.filter((F.col("season") == season) & (F.col("n") >= min_pitches)).join(names, "mlbam_id", "left")
    return rows.orderBy(F.abs("edge").desc(), "mlbam_id", "full_name").limit(limit)


def latest_grid(grids: DataFrame, entity: int, role: str, metric: str, season: int | None = None) -> DataFrame:
    rows = optional_filters(grids, mlbam_id=entity, role=one_of(role, ROLES), metric=one_of(metric, METRICS), season=season)
    return found(rows.orderBy(F.desc("season")).limit(1), f"{metric} grid")


def available_grids(grids: DataFrame, entity: int) -> DataFrame:
    return grids.filter(F.col("mlbam_id") == entity).select("season", "role", "metric", "n_pitches").orderBy(F.desc("season"), "role", "metric")


def grid_extent(kind: str = "zone") -> dict:
    spec = {"zone": ZONE, "spray": SPRAY}[one_of(kind, ("zone", "spray"))]
    (x0, x1, n), (y0, y1, _) = spec["x"], spec["y"]
    return {"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1, "grid_n": n, "min_reliable_n": spec["enough"]}


def batted_balls(pitches: DataFrame, batter: int, season: int | None = None) -> DataFrame:
    rows = optional_filters(pitches, batter=batter, season=season).filter("is_in_play and is_tracked_pitch and x_ft is not null and y_ft is not null")
    return rows.orderBy(*CHRONO).select(*BATTED_BALL_COLUMNS)


def spray_contour(spray: DataFrame, batter: int, season: int | None = None) -> DataFrame:
    return found(optional_filters(spray, mlbam_id=batter, season=season).orderBy(F.desc("season")).limit(1), "spray contour of this batter")


def embedding(mart: DataFrame, season: int | None = None, min_pitches: int = 0) -> DataFrame:
    return optional_filters(mart, season=season).filter(F.col("n_pitches") >= min_pitches)


def archetype_centroids(points: DataFrame) -> DataFrame:
    return points.groupBy("archetype_id").agg(F.any_value("archetype_label", True).alias("archetype_label"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))


def cluster_detail(clusters: DataFrame, pitcher: int, season: int | None = None) -> DataFrame:
    return found(optional_filters(clusters, mlbam_id=pitcher, season=season), "clusters of this pitcher").orderBy(F.desc("season"), F.desc("usage_pct"), "cluster_id")


def similar(neighbors: DataFrame, embedded: DataFrame, players: DataFrame, pitcher: int, season: int) -> DataFrame:
    own = optional_filters(neighbors, mlbam_id=pitcher, season=season)
    e = embedded.select(F.col("mlbam_id").alias("neighbor_id"), F.col("season").alias("neighbor_season"), "archetype_label")
    return own.join(e, ["neighbor_id", "neighbor_season"], "left").join(players.select(F.col("mlbam_id").alias("neighbor_id"), "full_name"), "neighbor_id", "left").orderBy("rank")


def next_pitch(model, features: DataFrame, classes: list[str], least: float = 0.005) -> DataFrame:
    """Features of pending rows with ``prediction``, the types by probability, and the number of earlier pitches."""
    scored = model.predict(features)
    return scored.withColumns({"prediction": top_probabilities(F.col("probability"), classes, least), "sample_size": F.coalesce("prior_pitches_seen", F.lit(0))})


def replay(model, features: DataFrame, game_pk: int, pitcher: int, classes: list[str]) -> DataFrame:
    """A pitcher's pitches of one game, what came and what was foreseen. features: of the whole season, so that the priors are
    those of training; the game is picked afterwards."""
    rows = found(features.filter((F.col("game_pk") == game_pk) & (F.col("pitcher") == pitcher)), "pitch of this pitcher in this game")
    out = next_pitch(model, rows, classes).select("at_bat_number", "pitch_number", "balls", "strikes", F.col("target_pitch_type").alias("actual_pitch_type"), "plate_x", "plate_z_norm", F.col("target_location").alias("actual_location_class"), F.slice("prediction", 1, 5).alias("predicted"))
    return out.withColumn("top", F.get("predicted", F.lit(0))["class"]).orderBy("at_bat_number", "pitch_number")


def latest(df: DataFrame, key: str, season: str = "season") -> DataFrame:
    return keep_first(df, [key], F.col(season), last=True)


def arrow_response(df: DataFrame, completed: bool) -> tuple[bytes, dict[str, str]]:
    """An uncompressed IPC stream and its headers; completed seasons may be kept 30 days, the current one an hour."""
    table, out = df.toArrow(), io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue(), {"X-Row-Count": str(table.num_rows), "Cache-Control": f"max-age={30 * 86400 if completed else 3600}"}


def json_rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]

"""A pitch table made from the events by whole-number arithmetic, as the driver's tables hold none.

One text in the dialect that Spark and DuckDB share, so that the domain's operators run over whole tables in queries and
their SQL sees the same rows. Fractions are whole numbers divided by whole numbers as doubles, hence equal on both sides.
Four events make a plate appearance, 240 a game. Every awkward case is there: null types, hands, spin and contact
estimates, impossible measurements, automatic balls, excluded outcomes, exhibition games, ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed multipliers of the draws; any numbers prime to PRIME do.
PRIME = 1_000_003


def draw(k: int, n: int, of: str = "event_id") -> str:
    """A whole number below n that looks random in ``of``."""
    a, b = 7_919 * k + 104_729, 15_485_863 * k % PRIME
    return f"(((({of}) % {PRIME}) * {a} + {b}) % {PRIME} % {n})"


def div(x: str, d: int) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) / CAST({d} AS DOUBLE)) AS BIGINT)"


def real(k: int, low: int, high: int, by: int = 100, of: str = "event_id", nulls: int = 0) -> str:
    """A double from low to high (both over ``by``); null for one of ``nulls`` rows."""
    value = f"CAST({low} + {draw(k, high - low + 1, of)} AS DOUBLE) / CAST({by} AS DOUBLE)"
    return f"CASE WHEN {draw(k + 100, nulls, of)} = 0 THEN NULL ELSE {value} END" if nulls else value


def one_of(k: int, values: list[str | None], of: str = "event_id") -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {draw(k, len(values), of)} {cases} END"


TEAMS = ["BOS", "NYY", "SEA", "COL"]
OUTCOMES = ["strikeout", "walk", "single", "field_out", "home_run", "field_out", "strikeout", "intent_walk", "single", "field_out", "hit_by_pitch"]
OPEN = ["ball", "called_strike", "foul", "swinging_strike", "ball", "foul_tip", "called_strike", "blocked_ball", "foul", "swinging_strike_blocked", "ball", "called_strike", "automatic_ball", "pitchout", "missed_bunt"]
KINDS = ["FF", "FF", "FF", "SI", "SL", "SL", "CU", "CH", "FC", "FF", "SI", "CH", "ST", "FS", None, "FF"]

_PLACES = f"""SELECT event_id, {div("event_id", 240)} AS game_pk, {div("event_id", 4)} AS pa, CAST(event_id % 4 + 1 AS INT) AS pitch_number FROM {{events}}"""
_STATES = f"""SELECT *, CAST(pa % 60 + 1 AS INT) AS at_bat_number, CAST({div("pa % 60", 30)} AS INT) AS half, CAST(2023 + game_pk % 3 AS INT) AS year_of,
  {one_of(1, OUTCOMES, "pa")} AS outcome, CAST({div("(pitch_number - 1) * (pa % 4)", 3)} AS INT) AS balls_now FROM ({_PLACES}) a"""

PITCHES = f"""SELECT CAST(make_date(year_of, CAST(4 + game_pk % 6 AS INT), CAST(1 + game_pk * 7 % 28 AS INT)) AS VARCHAR(10)) AS game_date, game_pk, at_bat_number, pitch_number, event_id,
  CASE WHEN game_pk % 11 = 5 THEN 'S' ELSE 'R' END AS game_type, {one_of(2, KINDS)} AS pitch_type, 'type ' || {one_of(2, KINDS)} AS pitch_name,
  CASE WHEN pitch_number < 4 THEN {one_of(3, OPEN)} WHEN outcome IN ('single', 'field_out', 'home_run') THEN 'hit_into_play' WHEN outcome = 'strikeout' THEN CASE WHEN pa % 2 = 0 THEN 'swinging_strike' ELSE 'called_strike' END WHEN outcome = 'hit_by_pitch' THEN 'hit_by_pitch' WHEN outcome = 'intent_walk' THEN 'intent_ball' ELSE 'ball' END AS description,
  CASE WHEN pitch_number = 4 THEN outcome END AS events, 100 + (game_pk * 3 + half * 5) % 16 AS pitcher, 500 + pa % 37 AS batter, 900 + (game_pk + half) % 5 AS fielder_2,
  CASE WHEN (game_pk * 3 + half * 5) % 16 < 6 THEN 'L' ELSE 'R' END AS p_throws, CASE pa % 37 % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE CASE WHEN pa % 37 % 5 = 0 THEN NULL ELSE 'R' END END AS stand,
  CAST(balls_now AS SMALLINT) AS balls, CAST(least(pitch_number - 1 - balls_now, 2) AS SMALLINT) AS strikes, CAST({div("at_bat_number - 1", 1)} % 3 AS SMALLINT) AS outs_when_up, CAST({div("at_bat_number - 1", 7)} + 1 AS SMALLINT) AS inning,
  CASE WHEN half = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot, {one_of(4, TEAMS, "game_pk")} AS home_team, CAST({draw(5, 9, "pa")} AS INT) AS bat_score, CAST({draw(6, 9, "pa")} AS INT) AS fld_score,
  CASE WHEN {draw(7, 3, "pa")} = 0 THEN 500 + pa % 7 END AS on_1b, CASE WHEN {draw(8, 4, "pa")} = 0 THEN 600 + pa % 7 END AS on_2b, CASE WHEN {draw(9, 5, "pa")} = 0 THEN 700 + pa % 7 END AS on_3b,
  CAST({div("at_bat_number - 1", 20)} + 1 AS INT) AS n_thruorder_pitcher, {real(10, 1, 9, 1, "game_pk", 6)} AS pitcher_days_since_prev_game,
  CASE WHEN {draw(11, 211)} = 7 THEN CAST(120 AS DOUBLE) ELSE {real(11, 7800, 10000, 100, nulls=41)} END AS release_speed, {real(12, -150, 150)} AS pfx_x, {real(13, -100, 180)} AS pfx_z, {real(14, -120, 160, nulls=5)} AS api_break_x_arm,
  {real(15, 50, 500)} AS api_break_z_with_gravity, {real(16, -180, 180, nulls=53)} AS plate_x, {real(17, 20, 480, nulls=53)} AS plate_z, {real(18, 320, 360, 100, "pa")} AS sz_top, CASE WHEN pa % 97 = 3 THEN {real(18, 320, 360, 100, "pa")} ELSE {real(19, 140, 170, 100, "pa")} END AS sz_bot,
  {real(20, -300, 300)} AS release_pos_x, {real(21, 480, 680)} AS release_pos_z, {real(22, 560, 720)} AS release_extension, {real(23, 1500, 2900, 1, nulls=37)} AS release_spin_rate, {real(24, 0, 359, 1, nulls=29)} AS spin_axis, {real(25, 100, 650, 10)} AS arm_angle,
  {real(26, -150, 150, 10)} AS vx0, {real(27, -1460, -1200, 10)} AS vy0, {real(28, -120, 20, 10)} AS vz0, {real(29, -250, 250, 10)} AS ax, CASE WHEN {draw(30, 89)} = 1 THEN CAST(0 AS DOUBLE) ELSE {real(30, 200, 360, 10)} END AS ay, {real(31, -450, -80, 10)} AS az,
  CASE WHEN pitch_number = 4 THEN {real(32, 400, 2100, 10, nulls=9)} END AS hc_x, CASE WHEN pitch_number = 4 THEN {real(33, 200, 1950, 10)} END AS hc_y, CASE WHEN pitch_number = 4 THEN {real(34, 500, 1150, 10)} END AS launch_speed, CASE WHEN pitch_number = 4 THEN {real(35, -400, 600, 10)} END AS launch_angle,
  CASE WHEN pitch_number = 4 THEN {real(36, 0, 1200, 1000, nulls=8)} END AS estimated_woba_using_speedangle, {real(37, -600, 600, 1000, nulls=61)} AS delta_run_exp,
  {real(38, 550, 850, 10)} AS bat_speed, {real(39, 55, 90, 10)} AS swing_length, {real(40, -200, 350, 10, nulls=31)} AS attack_angle, {real(41, -300, 300, 10)} AS attack_direction, {real(42, 150, 450, 10)} AS swing_path_tilt,
  {real(43, -400, 400, 10)} AS intercept_ball_minus_batter_pos_x_inches, {real(44, -100, 500, 10)} AS intercept_ball_minus_batter_pos_y_inches, 30 + game_pk % 7 AS umpire_of_game
  FROM ({_STATES}) b"""


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw pitch rows, with the pinned types of the pitch table where they are whole numbers."""
    rows = spark.sql(PITCHES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.withColumns({c: F.col(c).cast("byte") for c in ("balls", "strikes", "outs_when_up", "inning")})


def sql(name: str = "events") -> str:
    """The same rows for DuckDB."""
    return PITCHES.format(events=name)


#: The enriched table's SQL by plain definitions, on top of ``sql()``.
IMPOSSIBLE = "(coalesce(release_speed < 25 OR release_speed > 108, false) OR coalesce(abs(plate_x) > 15, false) OR coalesce(plate_z < -10 OR plate_z > 20, false) OR coalesce(release_pos_z <= 0 OR release_pos_z > 10, false) OR coalesce(abs(release_pos_x) > 8, false))"
SWING = "('foul', 'hit_into_play', 'swinging_strike', 'swinging_strike_blocked', 'foul_tip', 'foul_bunt', 'missed_bunt', 'bunt_foul_tip')"
WHIFF = "('swinging_strike', 'swinging_strike_blocked', 'missed_bunt')"


def enriched_sql(name: str = "events") -> str:
    return f"""SELECT *, base_state * 3 + outs_when_up AS base_out_state, is_called_strike OR is_whiff AS is_csw, is_swing AND NOT is_in_zone AS is_chase,
  degrees(atan2(x_ft, y_ft)) AS spray_angle_deg, sqrt(x_ft * x_ft + y_ft * y_ft) AS hit_distance_derived_ft, degrees(atan2(vz0 + az * t, abs(vy0 + ay * t))) AS vaa_deg, degrees(atan2(vx0 + ax * t, abs(vy0 + ay * t))) AS haa_deg FROM (
  SELECT * REPLACE (CAST(game_date AS DATE) AS game_date), year(CAST(game_date AS DATE)) AS season, month(CAST(game_date AS DATE)) AS game_month, pfx_z * 12 AS ivb_in, pfx_x * 12 AS hb_in,
  coalesce(api_break_x_arm * 12, CASE WHEN p_throws = 'R' THEN -(pfx_x * 12) ELSE pfx_x * 12 END) AS hb_arm_in, api_break_z_with_gravity * 12 AS vb_gravity_in, (hc_x - 125.91::DOUBLE) * 2.339::DOUBLE AS x_ft, (199.54::DOUBLE - hc_y) * 2.339::DOUBLE AS y_ft,
  CASE WHEN sz_top - sz_bot <> 0 THEN (plate_z - sz_bot) / (sz_top - sz_bot) END AS plate_z_norm, balls || '-' || strikes AS count_state,
  CASE WHEN on_1b IS NULL THEN 0 ELSE 1 END + CASE WHEN on_2b IS NULL THEN 0 ELSE 2 END + CASE WHEN on_3b IS NULL THEN 0 ELSE 4 END AS base_state, stand = p_throws AS is_platoon_same,
  description IN {SWING} AS is_swing, description IN {WHIFF} AS is_whiff, description = 'called_strike' AS is_called_strike, description = 'hit_into_play' AS is_in_play,
  description NOT IN ('automatic_ball', 'automatic_strike') AND NOT {IMPOSSIBLE} AS is_tracked_pitch, description NOT IN ('automatic_ball', 'automatic_strike', 'pitchout', 'intent_ball') AS is_competitive,
  abs(plate_x) <= 0.83::DOUBLE AND plate_z BETWEEN sz_bot AND sz_top AS is_in_zone,
  CASE WHEN ay <> 0 AND vy0 * vy0 - ay * (2 * (50 - 17 / 12.0::DOUBLE)) >= 0 THEN (-vy0 - sqrt(greatest(vy0 * vy0 - ay * (2 * (50 - 17 / 12.0::DOUBLE)), 0))) / ay END AS t FROM ({sql(name)}))"""


def players(spark: SparkSession) -> DataFrame:
    """dim_player and dim_player_ids in one; every thirteenth id is missing."""
    ids = spark.range(1000).filter("id % 13 <> 0")
    return ids.select(F.col("id").alias("mlbam_id"), F.concat(F.lit("Player "), F.col("id").cast("string")).alias("full_name"), F.when(F.col("id") < 500, "P").otherwise("IF").alias("primary_position"))


PLAYERS = "SELECT id AS mlbam_id, 'Player ' || id AS full_name, CASE WHEN id < 500 THEN 'P' ELSE 'IF' END AS primary_position FROM range(1000) r(id) WHERE id % 13 <> 0"


def officials(spark: SparkSession, games: int = 5000) -> DataFrame:
    """dim_official; every nineteenth game is missing."""
    g = spark.range(games).filter("id % 19 <> 7")
    return g.select(F.col("id").alias("game_pk"), (30 + F.col("id") % 7).alias("umpire_home_plate_id"), F.concat(F.lit("Umpire "), (F.col("id") % 7).cast("string")).alias("umpire_home_plate_name"))


OFFICIALS = "SELECT id AS game_pk, 30 + id % 7 AS umpire_home_plate_id, 'Umpire ' || (id % 7) AS umpire_home_plate_name FROM range(5000) r(id) WHERE id % 19 <> 7"

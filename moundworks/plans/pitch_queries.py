"""The domain's operators over the synthetic pitch table, each beside SQL that states the same by plain definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as E
from ..functions import pitches as P
from ..functions import splits
from ..operators import grid, learning, quality, relops
from ..operators.run_value import RunValue
from . import api, marts, synthetic
from .queries import query

PITCHES = f"WITH p AS ({synthetic.enriched_sql()})"
REGULAR = "is_tracked_pitch AND is_competitive AND game_type = 'R'"


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return P.enrich(synthetic.pitches(spark, sf))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t in ("double", "float")})


def rounding(columns: str, doubles: str, places: int = 6) -> str:
    return ", ".join([*columns.split(), *(f"round({c}, {places}) + 0.0::DOUBLE AS {c}" for c in doubles.split())])


DERIVED = "event_id season game_month count_state base_state base_out_state is_platoon_same is_swing is_whiff is_called_strike is_in_play is_tracked_pitch is_competitive is_csw is_in_zone is_chase"
MEASURED = "ivb_in hb_in hb_arm_in vb_gravity_in vaa_deg haa_deg x_ft y_ft spray_angle_deg hit_distance_derived_ft plate_z_norm"


@query(f"{PITCHES} SELECT {rounding(DERIVED, MEASURED)} FROM p")
def enrich_pitches(spark, sf):
    return rounded(enriched(spark, sf).select(*DERIVED.split(), *MEASURED.split()))


_COUNT = "least(greatest(balls, 0), 3) || '-' || least(greatest(strikes, 0), 2)"
_FAMILY = "CASE WHEN pitch_type IN ('FF', 'SI', 'FC', 'FA') THEN 'fastball' WHEN pitch_type IN ('SL', 'ST', 'CU', 'KC', 'SV', 'CS', 'SC') THEN 'breaking' ELSE 'offspeed' END"
_TURN = "radians(CASE WHEN p_throws = 'L' THEN (360 - spin_axis + 360) % 360 ELSE spin_axis END)"


@query(f"""{PITCHES} SELECT event_id, CASE WHEN plate_x IS NULL OR plate_z_norm IS NULL THEN NULL WHEN plate_x >= -1.5 AND floor((plate_x + 1.5) / 3.0::DOUBLE * 5) <= 4 AND plate_z_norm >= -0.5 AND floor((plate_z_norm + 0.5) / 2.0::DOUBLE * 5) <= 4 THEN CAST(5 * floor((plate_z_norm + 0.5) / 2.0::DOUBLE * 5) + floor((plate_x + 1.5) / 3.0::DOUBLE * 5) AS INTEGER) ELSE 25 END AS cell,
  {_COUNT} AS count_key, CASE {_COUNT} WHEN '0-0' THEN 'first' WHEN '0-1' THEN 'ahead' WHEN '2-1' THEN 'ahead' WHEN '0-2' THEN 'putaway' WHEN '1-2' THEN 'putaway' WHEN '2-2' THEN 'even_deep' WHEN '1-0' THEN 'behind' WHEN '2-0' THEN 'behind' WHEN '3-0' THEN 'must_strike' WHEN '3-1' THEN 'must_strike' WHEN '1-1' THEN 'even' WHEN '3-2' THEN 'full' ELSE 'even' END AS bucket,
  {_FAMILY} AS family, CASE WHEN release_speed >= 99 THEN '99+' WHEN release_speed >= 95 THEN '95-98' WHEN release_speed >= 90 THEN '90-94' WHEN release_speed IS NOT NULL THEN '80s-' END AS tier,
  CASE pitch_type WHEN 'CH' THEN 0 WHEN 'FF' THEN 1 WHEN 'SL' THEN 2 END AS code, round(sin({_TURN}), 9) + 0.0::DOUBLE AS sine, round(cos({_TURN}), 9) + 0.0::DOUBLE AS cosine, CASE WHEN stand = 'R' THEN -plate_x ELSE plate_x END + 0.0::DOUBLE AS out_x,
  CASE WHEN abs(v) < 0.08 THEN 0 ELSE CAST(sign(v) * least(5, floor((abs(v) - 0.08) / 0.92::DOUBLE * 5) + 1) AS INTEGER) END AS step, CASE WHEN release_pos_z >= 6 THEN 1 ELSE greatest(0.06, round(release_pos_z / 6 * 0.35, 9)) END AS fade
  FROM (SELECT *, least(greatest(delta_run_exp / 0.5::DOUBLE, -1), 1) AS v FROM p)""")
def pitch_labels(spark, sf):
    c = F.col
    sine, cosine = E.circular(c("spin_axis"), c("p_throws"))
    return enriched(spark, sf).select(
        "event_id", E.location_class(c("plate_x"), c("plate_z_norm")).alias("cell"), E.count_key(c("balls"), c("strikes")).alias("count_key"), E.count_bucket(c("balls"), c("strikes")).alias("bucket"),
        E.pitch_family(c("pitch_type")).alias("family"), E.velocity_tier(c("release_speed")).alias("tier"), E.encode_sorted(c("pitch_type"), ["SL", "FF", "CH"]).alias("code"), F.round(sine, 9).alias("sine"), F.round(cosine, 9).alias("cosine"),
        (E.mirror(c("plate_x"), c("stand")) + 0.0).alias("out_x"), E.ramp_step(c("delta_run_exp"), 0.5).alias("step"), F.round(E.fade(c("release_pos_z"), 6.0), 9).alias("fade"),
    )


_RANKS = ", ".join(f"CASE WHEN pitches >= 50 THEN percent_rank() OVER (PARTITION BY season, pitch_type ORDER BY {v} NULLS LAST) END AS {k}" for k, v in (("pct_velo", "velo_avg"), ("pct_whiff", "whiff_pct"), ("pct_csw", "csw_pct"), ("pct_rv", "rv_per_100")))
ARSENAL = f"""{PITCHES}, t AS (SELECT pitcher AS mlbam_id, season, pitch_type, max(pitch_name) AS pitch_name, max(p_throws) AS p_throws, count(*) AS pitches, avg(release_speed) AS velo_avg, max(release_speed) AS velo_max, stddev_samp(release_speed) AS velo_sd, avg(release_spin_rate) AS spin_avg,
  avg(release_extension) AS extension_avg, avg(ivb_in) AS ivb_in, avg(hb_arm_in) AS hb_arm_in, avg(arm_angle) AS arm_angle, avg(spin_axis) AS spin_axis, count(*) FILTER (is_swing) AS swings, count(*) FILTER (is_whiff) AS whiffs, count(*) FILTER (is_csw) * 100.0::DOUBLE / count(*) AS csw_pct,
  count(*) FILTER (is_in_zone) * 100.0::DOUBLE / count(*) AS zone_pct, count(*) FILTER (is_chase) * 100.0::DOUBLE / count(*) AS chase_pct, avg(estimated_woba_using_speedangle) AS xwoba, avg(launch_speed) AS exit_velo_avg, -100 * sum(delta_run_exp) / count(*) AS rv_per_100
  FROM p WHERE {REGULAR} AND pitch_type IS NOT NULL GROUP BY 1, 2, 3),
  u AS (SELECT *, whiffs * 100.0::DOUBLE / nullif(swings, 0) AS whiff_pct, CAST(sum(pitches) OVER k AS BIGINT) AS season_pitches, pitches * 100.0::DOUBLE / sum(pitches) OVER k AS usage_pct, first_value(CASE WHEN pitch_type IN ('FF', 'SI', 'FA', 'FC') THEN velo_avg END) OVER h AS v0,
  first_value(CASE WHEN pitch_type IN ('FF', 'SI', 'FA', 'FC') THEN ivb_in END) OVER h AS i0, first_value(CASE WHEN pitch_type IN ('FF', 'SI', 'FA', 'FC') THEN hb_arm_in END) OVER h AS h0 FROM t
  WINDOW k AS (PARTITION BY mlbam_id, season), h AS (PARTITION BY mlbam_id, season ORDER BY CASE WHEN pitch_type IN ('FF', 'SI', 'FA') THEN 0 WHEN pitch_type = 'FC' THEN 1 ELSE 2 END, pitches DESC, pitch_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  m AS (SELECT * EXCLUDE (v0, i0, h0), velo_avg - v0 AS velo_diff_fb, ivb_in - i0 AS ivb_diff_fb, hb_arm_in - h0 AS hb_diff_fb, {_RANKS} FROM u)"""
ARSENAL_KEYS = "mlbam_id season pitch_type pitch_name p_throws pitches swings whiffs season_pitches"
ARSENAL_MEANS = "velo_avg velo_max velo_sd spin_avg extension_avg ivb_in hb_arm_in arm_angle spin_axis whiff_pct csw_pct zone_pct chase_pct xwoba exit_velo_avg rv_per_100 usage_pct velo_diff_fb ivb_diff_fb hb_diff_fb pct_velo pct_whiff pct_csw pct_rv"


@query(f"{ARSENAL} SELECT {rounding(ARSENAL_KEYS, ARSENAL_MEANS)} FROM m")
def pitcher_arsenal(spark, sf):
    return rounded(marts.pitcher_arsenal(enriched(spark, sf)))


_PRIOR = "OVER (PARTITION BY pitcher, season ORDER BY game_date, game_pk, at_bat_number, pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_KINDS = {f"usage_{t.lower()}": f"pitch_type = '{t}'" for t in S.PRIOR_TYPES} | {"usage_ff_family": "pitch_type IN ('FF', 'SI', 'FC', 'FA')", "usage_breaking": "pitch_type IN ('SL', 'ST', 'CU', 'KC', 'SV', 'CS', 'SC')", "usage_offspeed": "pitch_type IN ('CH', 'FS', 'KN', 'EP')", "zone_rate": "is_in_zone"}
_CHRONO = "ORDER BY game_date, game_pk, at_bat_number, pitch_number"
NEXT_KEYS = "event_id balls strikes outs_when_up inning base_state base_out_state score_diff is_platoon_same stand p_throws pitch_count_in_game n_thruorder_pitcher pitch_in_ab prev_pitch_type_1 prev_pitch_type_2 prev_pitch_type_3 prev_was_swing_1 prev_was_whiff_1 prev_was_in_zone_1 last_pitch_type_vs_batter prior_pitches_seen prior_usage_this_count home_team is_home_pitching"
NEXT_RATES = "pitcher_days_since_prev_game prev_plate_x_1 prev_plate_z_norm_1 prev_velo_1 " + " ".join(f"prior_{k}" for k in _KINDS)


@query(f"""{PITCHES}, f AS (SELECT * REPLACE (CAST(is_platoon_same AS INTEGER) AS is_platoon_same), bat_score - fld_score AS score_diff, count(*) OVER (PARTITION BY game_pk, pitcher {_CHRONO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pitch_count_in_game, pitch_number AS pitch_in_ab,
  {", ".join(f"lag(pitch_type, {k}) OVER a AS prev_pitch_type_{k}" for k in (1, 2, 3))}, lag(plate_x) OVER a AS prev_plate_x_1, lag(plate_z_norm) OVER a AS prev_plate_z_norm_1, lag(release_speed) OVER a AS prev_velo_1,
  {", ".join(f"CAST(lag(is_{k}) OVER a AS INTEGER) AS prev_was_{k}_1" for k in ("swing", "whiff", "in_zone"))}, lag(pitch_type) OVER (PARTITION BY game_pk, batter {_CHRONO}) AS last_pitch_type_vs_batter, count(*) {_PRIOR} AS prior_pitches_seen,
  count(*) OVER (PARTITION BY pitcher, season, balls, strikes {_CHRONO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_usage_this_count, CASE WHEN inning_topbot = 'Top' THEN 1 ELSE 0 END AS is_home_pitching,
  {", ".join(f"CASE WHEN count(*) {_PRIOR} > 0 THEN coalesce(sum(CASE WHEN {x} THEN 1 ELSE 0 END) {_PRIOR}, 0) / CAST(count(*) {_PRIOR} AS DOUBLE) END AS prior_{k}" for k, x in _KINDS.items())}
  FROM p WINDOW a AS (PARTITION BY game_pk, at_bat_number {_CHRONO})) SELECT {rounding(NEXT_KEYS, NEXT_RATES, 9)} FROM f""")
def next_pitch_features(spark, sf):
    rows = P.feature_matrix_of(P.next_pitch_features(enriched(spark, sf)), ["event_id"])
    return rounded(rows, 9)


_DIFFS = "velo_diff_fb ivb_diff_fb hb_diff_fb release_pos_x_arm plate_x_out spin_axis_sin spin_axis_cos"


@query(f"""{PITCHES}, f AS (SELECT pitcher, season, avg(release_speed) AS v, avg(ivb_in) AS i, avg(hb_arm_in) AS h, row_number() OVER (PARTITION BY pitcher, season ORDER BY CASE WHEN pitch_type = 'FC' THEN 1 ELSE 0 END, count(*) DESC, pitch_type) AS rn FROM p WHERE pitch_type IN ('FF', 'SI', 'FA', 'FC') GROUP BY pitcher, season, pitch_type HAVING count(*) >= 25),
  q AS (SELECT event_id, release_speed - v AS velo_diff_fb, ivb_in - i AS ivb_diff_fb, hb_arm_in - h AS hb_diff_fb, CASE WHEN p_throws = 'R' THEN -release_pos_x ELSE release_pos_x END AS release_pos_x_arm, CASE WHEN stand = 'R' THEN -plate_x ELSE plate_x END AS plate_x_out, sin({_TURN}) AS spin_axis_sin, cos({_TURN}) AS spin_axis_cos
  FROM p LEFT JOIN (SELECT * FROM f WHERE rn = 1) USING (pitcher, season)) SELECT {rounding("event_id", _DIFFS)} FROM q""")
def stuff_features(spark, sf):
    return rounded(P.quality_features(enriched(spark, sf)).select("event_id", *_DIFFS.split()))


@query(f"""{PITCHES} SELECT event_id, CASE WHEN stand = 'R' THEN -attack_direction ELSE attack_direction END AS attack_direction_pull, CASE WHEN stand = 'R' THEN -intercept_ball_minus_batter_pos_x_inches ELSE intercept_ball_minus_batter_pos_x_inches END AS intercept_x_pull,
  CASE WHEN stand = 'R' THEN -plate_x ELSE plate_x END AS plate_x_pull, intercept_ball_minus_batter_pos_y_inches AS intercept_y_in, is_in_play AND estimated_woba_using_speedangle IS NOT NULL AS for_contact FROM p WHERE {REGULAR} AND is_swing AND attack_angle IS NOT NULL AND vaa_deg IS NOT NULL AND season >= 2023""")
def swing_rows(spark, sf):
    rows = P.swing_frame(enriched(spark, sf))
    contact = P.rows_for("contact", rows).select("event_id", F.lit(True).alias("for_contact"))
    return P.rows_for("whiff", rows).select("event_id", "attack_direction_pull", "intercept_x_pull", "plate_x_pull", "intercept_y_in").join(contact, "event_id", "left").withColumn("for_contact", F.coalesce("for_contact", F.lit(False)))


TAKES = f"{PITCHES}, k AS (SELECT p.*, CASE WHEN stand = 'R' THEN -plate_x ELSE plate_x END AS plate_x_out, umpire_home_plate_id AS umpire_hp, {synthetic.draw(60, 1000)} / 1000.0::DOUBLE AS prob, 0.1::DOUBLE + balls * 0.02::DOUBLE AS worth FROM p LEFT JOIN ({synthetic.OFFICIALS}) o USING (game_pk) WHERE description IN ('ball', 'called_strike', 'blocked_ball'))"


def takes(spark, sf):
    prob = F.expr(synthetic.draw(60, 1000)) / F.lit(1000.0)
    return P.takes(enriched(spark, sf), synthetic.officials(spark)).withColumns({"prob": prob, "worth": F.lit(0.1) + F.col("balls") * F.lit(0.02)})


@query(f"{TAKES} SELECT event_id, plate_x_out, umpire_hp FROM k")
def take_rows(spark, sf):
    return takes(spark, sf).select("event_id", "plate_x_out", "umpire_hp")


RUN = f"""{PITCHES}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number DESC) AS rn FROM p WHERE events IS NOT NULL AND events NOT IN ('intent_walk', 'catcher_interf', 'truncated_pa', 'game_advisory')) WHERE rn = 1),
  l AS (SELECT regr_slope(delta_run_exp, estimated_woba_using_speedangle) AS b, regr_intercept(delta_run_exp, estimated_woba_using_speedangle) AS a FROM e WHERE description = 'hit_into_play' AND estimated_woba_using_speedangle IS NOT NULL AND delta_run_exp IS NOT NULL),
  w AS (SELECT events, avg(delta_run_exp) AS w FROM e WHERE delta_run_exp IS NOT NULL GROUP BY 1),
  t AS (SELECT game_pk, at_bat_number, CASE WHEN description = 'hit_into_play' AND estimated_woba_using_speedangle IS NOT NULL THEN a + b * estimated_woba_using_speedangle ELSE w END AS terminal FROM e CROSS JOIN l LEFT JOIN w USING (events)),
  c AS (SELECT p.*, {_COUNT} AS cnt FROM p), r AS (SELECT cnt, avg(terminal) AS re FROM (SELECT DISTINCT game_pk, at_bat_number, cnt, terminal FROM c JOIN t USING (game_pk, at_bat_number)) GROUP BY 1)"""


@query(RUN + """, n AS (SELECT *, lead(cnt) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) AS nxt, lead(1) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) IS NULL AS last FROM c)
  SELECT event_id, round(r1.re - CASE WHEN last THEN terminal ELSE r2.re END, 9) + 0.0::DOUBLE AS rv_pitcher FROM n LEFT JOIN t USING (game_pk, at_bat_number) LEFT JOIN r r1 ON r1.cnt = n.cnt LEFT JOIN r r2 ON r2.cnt = n.nxt""")
def pitch_run_values(spark, sf):
    rows = enriched(spark, sf)
    return rounded(RunValue.fit(rows).attach(rows).select("event_id", "rv_pitcher"), 9)


@query(RUN + """, g AS (SELECT b, s FROM range(4) x(b), range(3) y(s)) SELECT b || '-' || s AS count, round(CASE WHEN b = 3 THEN (SELECT w FROM w WHERE events = 'walk') ELSE (SELECT re FROM r WHERE cnt = (b + 1) || '-' || s) END
  - CASE WHEN s = 2 THEN (SELECT w FROM w WHERE events = 'strikeout') ELSE (SELECT re FROM r WHERE cnt = b || '-' || (s + 1)) END, 9) AS strike_value FROM g""")
def strike_values(spark, sf):
    table = RunValue.fit(enriched(spark, sf)).strike_values()
    return rounded(spark.createDataFrame(sorted(table.items()), "count string, strike_value double"), 9)


def smoothed_sql(rows: str, keys: str, x: str, y: str, value: str, spec: dict) -> str:
    """CTEs g(keys, i, j, v, c): smoothed sums and counts of every cell that a row reaches."""
    (x0, x1, nx), (y0, y1, ny), (sx, sy) = spec["x"], spec["y"], spec["sigma"]

    def kernel(n: int, s: float) -> str:
        r = int(4 * s + 0.5)
        w = lambda d: f"exp(-{d} * {d} / (2 * {s!r}::DOUBLE * {s!r}::DOUBLE))"
        return f"(SELECT a.i, greatest(0, least({n - 1}, a.i + b.d)) AS ci, sum({w('b.d')} / (SELECT sum({w('e')}) FROM range({-r}, {r + 1}) z(e))) AS w FROM range({n}) a(i), range({-r}, {r + 1}) b(d) GROUP BY 1, 2)"

    place = lambda c, lo, hi, n: f"CAST(least({n - 1}, floor((least(greatest({c}, {lo}), {hi}) - ({lo})) / (({hi} - ({lo})) / {n}::DOUBLE))) AS INTEGER)"
    return f"""rr AS ({rows}), hh AS (SELECT {keys}, {place(x, x0, x1, nx)} AS ci, {place(y, y0, y1, ny)} AS cj, sum({value}) AS v, count(*) AS c FROM rr WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {value} IS NOT NULL GROUP BY ALL),
  aa AS (SELECT {keys}, k.i, cj, sum(w * v) AS v, sum(w * c) AS c FROM hh JOIN {kernel(nx, sx)} k USING (ci) GROUP BY ALL), g AS (SELECT {keys}, aa.i, k.i AS j, sum(w * v) AS v, sum(w * c) AS c FROM aa JOIN {kernel(ny, sy)} k ON k.ci = aa.cj GROUP BY ALL),
  nn AS (SELECT {keys}, CAST(sum(c) AS BIGINT) AS n FROM hh GROUP BY ALL)"""


def summed_sql(keys: str, spec: dict) -> str:
    """Each group's surface and reliability, as 32-bit cells, summed and probed."""
    sx, sy = spec["sigma"]
    real = lambda x: f"CAST(CAST({x} AS REAL) AS DOUBLE)"
    rel = real(f"c * 2 * pi() * {sx!r}::DOUBLE * {sy!r}::DOUBLE")
    return f"SELECT {keys}, any_value(n) AS n_pitches, count(*) FILTER (c > 1e-9) AS cells, round(sum({real('v / c')}) FILTER (c > 1e-9), 2) AS surface_sum, round(sum({rel}), 2) AS reliability_sum, round(max({real('v / c')}) FILTER (c > 1e-9 AND i = 25 AND j = 25), 4) AS middle FROM g JOIN nn USING ({keys}) GROUP BY ALL"


def summed(arrays: DataFrame, keys: list[str], n: str = "n_pitches") -> DataFrame:
    known = F.filter("surface", lambda v: v.isNotNull())
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")), 2)
    middle = F.round(F.get("surface", F.col("grid_n") * 25 + 25).cast("double"), 4)
    return arrays.select(*keys, F.col(n).alias("n_pitches"), F.size(known).cast("long").alias("cells"), total(known).alias("surface_sum"), total(F.col("reliability")).alias("reliability_sum"), middle.alias("middle"))


_ZONE = dict(grid.ZONE, min_rows=50)
_STACKED = " UNION ALL ".join(
    f"SELECT pitcher AS mlbam_id, season, '{m}' AS metric, plate_x, plate_z_norm, CASE WHEN {s or 'TRUE'} THEN CAST({v} AS DOUBLE) * {scale} END AS value FROM z" for m, (s, v, scale) in marts.ZONE_METRICS.items()
)


@query(f"{PITCHES}, z AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY pitcher, season) AS n FROM p WHERE {REGULAR} AND plate_x IS NOT NULL AND plate_z_norm IS NOT NULL) WHERE n >= 50), {smoothed_sql(_STACKED, 'mlbam_id, season, metric', 'plate_x', 'plate_z_norm', 'value', _ZONE)} {summed_sql('mlbam_id, season, metric', _ZONE)}")
def zone_profiles(spark, sf):
    return summed(marts.zone_profiles(enriched(spark, sf), "pitcher", _ZONE), ["mlbam_id", "season", "metric"])


_SPRAY = dict(grid.SPRAY, min_rows=10)
_BATTED = f"SELECT batter AS mlbam_id, season, x_ft, y_ft, estimated_woba_using_speedangle FROM (SELECT *, count(*) OVER (PARTITION BY batter, season) AS n FROM p WHERE {REGULAR} AND is_in_play AND x_ft IS NOT NULL AND y_ft IS NOT NULL) WHERE n >= 10"


@query(f"{PITCHES}, {smoothed_sql(_BATTED, 'mlbam_id, season', 'x_ft', 'y_ft', 'estimated_woba_using_speedangle', _SPRAY)}, bb AS (SELECT mlbam_id, season, count(*) AS n_batted_balls FROM rr GROUP BY ALL) SELECT s.* REPLACE (n_batted_balls AS n_pitches) FROM ({summed_sql('mlbam_id, season', _SPRAY)}) s JOIN bb USING (mlbam_id, season)")
def spray_grid(spark, sf):
    return summed(marts.batter_spray(enriched(spark, sf), _SPRAY), ["mlbam_id", "season"], "n_batted_balls")


def _entity_sql(who: str, value: str) -> str:
    rows = f"SELECT {who} AS mlbam_id, season, plate_x, plate_z_norm, {value} AS value FROM (SELECT *, count(*) OVER (PARTITION BY {who}, season) AS n FROM k WHERE {who} IS NOT NULL) WHERE n >= 60"
    return f"{TAKES}, {smoothed_sql(rows, 'mlbam_id, season', 'plate_x', 'plate_z_norm', 'value', grid.ZONE)} {summed_sql('mlbam_id, season', grid.ZONE)}"


@query(_entity_sql("fielder_2", "CAST(is_called_strike AS DOUBLE) - prob"))
def catcher_grids(spark, sf):
    return summed(marts.catcher_grid(takes(spark, sf), "prob", 60), ["mlbam_id", "season"])


@query(_entity_sql("umpire_hp", "CAST(is_called_strike AS DOUBLE) * 100"))
def umpire_grids(spark, sf):
    return summed(marts.umpire_grid(takes(spark, sf), 60), ["mlbam_id", "season"])


@query(f"{TAKES} SELECT fielder_2 AS mlbam_id, season, round(sum((CAST(is_called_strike AS DOUBLE) - prob) * worth), 6) AS framing_runs, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 50")
def catcher_framing(spark, sf):
    return rounded(marts.framing_runs(takes(spark, sf), "fielder_2", "prob", "worth", 50))


UMPIRE = f"""{TAKES}, b AS (SELECT umpire_hp AS mlbam_id, season, avg(CAST(is_called_strike AS DOUBLE)) AS actual_rate, avg(prob) AS expected_rate, count(*) AS n FROM k WHERE umpire_hp IS NOT NULL AND prob BETWEEN 0.2 AND 0.8 GROUP BY 1, 2 HAVING count(*) >= 20),
  f AS (SELECT umpire_hp AS mlbam_id, season, sum((CAST(is_called_strike AS DOUBLE) - prob) * worth) AS framing_runs, count(*) AS framing_n FROM k WHERE umpire_hp IS NOT NULL GROUP BY 1, 2),
  u AS (SELECT mlbam_id, season, n, framing_n, round(actual_rate, 6) AS actual_rate, round(expected_rate, 6) AS expected_rate, round(actual_rate - expected_rate, 6) AS edge, round(framing_runs, 6) AS framing_runs FROM b LEFT JOIN f USING (mlbam_id, season))"""


@query(f"{UMPIRE} SELECT * FROM u")
def umpire_zone(spark, sf):
    return rounded(marts.umpire_zone(takes(spark, sf), "prob", "worth", 20))


_SCORES = {"stuff_plus": 61, "location_plus": 62, "pitching_plus": 63}
SCORED = f"{PITCHES}, q AS (SELECT *, {', '.join(f'80 + {synthetic.draw(k, 401)} / 10.0::DOUBLE AS {c}' for c, k in _SCORES.items())}, -delta_run_exp AS rv_pitcher FROM p WHERE {REGULAR} AND pitch_type IS NOT NULL)"
STUFF = f"""{SCORED}, t AS (SELECT pitcher AS mlbam_id, season, pitch_type, {', '.join(f'round(avg({c}), 1) AS {c}' for c in _SCORES)}, round(100 * avg(rv_pitcher), 3) AS rv_per_100, count(*) AS pitches FROM q GROUP BY 1, 2, 3
  UNION ALL SELECT pitcher, season, 'ALL', {', '.join(f'round(avg({c}), 1)' for c in _SCORES)}, round(100 * avg(rv_pitcher), 3), count(*) FROM q GROUP BY 1, 2),
  m AS (SELECT *, round(pitches * 100.0::DOUBLE / max(CASE WHEN pitch_type = 'ALL' THEN pitches END) OVER (PARTITION BY mlbam_id, season), 1) AS usage_pct FROM t WHERE pitches >= 25)"""


def scored(spark, sf):
    rows = marts.competitive(enriched(spark, sf)).filter("pitch_type is not null")
    return rows.withColumns({**{c: F.lit(80.0) + F.expr(synthetic.draw(k, 401)) / F.lit(10.0) for c, k in _SCORES.items()}, "rv_pitcher": -F.col("delta_run_exp")})


@query(f"{STUFF} SELECT * FROM m")
def pitcher_stuff(spark, sf):
    return marts.pitcher_stuff(scored(spark, sf))


_SWINGS = f"{PITCHES}, q AS (SELECT *, {synthetic.draw(64, 401)} / 2000.0::DOUBLE - 0.1 AS plane_value FROM p WHERE {REGULAR} AND is_swing AND attack_angle IS NOT NULL AND vaa_deg IS NOT NULL)"
SWING = f"""{_SWINGS}, w AS (SELECT batter AS mlbam_id, season, round(100 * avg(plane_value), 3) AS whiff_plane_value_per_100, round(avg(attack_angle), 2) AS attack_angle, count(*) AS whiff_swings FROM q GROUP BY 1, 2 HAVING count(*) >= 12),
  c AS (SELECT batter AS mlbam_id, season, round(100 * avg(plane_value), 3) AS contact_plane_value_per_100, count(*) AS contact_swings FROM q WHERE is_in_play AND estimated_woba_using_speedangle IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 12), m AS (SELECT * FROM w LEFT JOIN c USING (mlbam_id, season))"""


def swing_mart(spark, sf):
    rows = P.swing_frame(enriched(spark, sf)).withColumn("plane_value", F.expr(synthetic.draw(64, 401)) / F.lit(2000.0) - 0.1)
    return marts.batter_swing(P.rows_for("whiff", rows), P.rows_for("contact", rows), 12)


@query(f"{SWING} SELECT * FROM m")
def batter_swing(spark, sf):
    return swing_mart(spark, sf)


PLAYERS = f"pl AS ({synthetic.PLAYERS})"


@query(f"{STUFF}, {PLAYERS} SELECT m.*, full_name FROM m LEFT JOIN pl USING (mlbam_id) WHERE pitch_type = 'ALL' AND season = (SELECT max(season) FROM m) ORDER BY stuff_plus DESC, mlbam_id LIMIT 10")
def leaderboard_stuff(spark, sf):
    return api.stuff_leaders(marts.pitcher_stuff(scored(spark, sf)), synthetic.players(spark), limit=10)


@query(f"{SWING}, {PLAYERS} SELECT m.*, full_name FROM m LEFT JOIN pl USING (mlbam_id) WHERE season = (SELECT max(season) FROM m) ORDER BY whiff_plane_value_per_100 DESC NULLS LAST, mlbam_id LIMIT 10")
def leaderboard_swing(spark, sf):
    return api.swing_leaders(swing_mart(spark, sf), synthetic.players(spark), min_swings=12, limit=10)


@query(f"{TAKES}, {PLAYERS}, m AS (SELECT fielder_2 AS mlbam_id, season, sum((CAST(is_called_strike AS DOUBLE) - prob) * worth) AS framing_runs, count(*) AS n FROM k GROUP BY 1, 2) SELECT mlbam_id, season, round(framing_runs, 6) AS framing_runs, n, full_name FROM m LEFT JOIN pl USING (mlbam_id) WHERE season = (SELECT max(season) FROM m) ORDER BY m.framing_runs DESC, mlbam_id LIMIT 10")
def leaderboard_catchers(spark, sf):
    return rounded(api.catcher_leaders(marts.framing_runs(takes(spark, sf), "fielder_2", "prob", "worth", 1), synthetic.players(spark), min_pitches=1, limit=10))


@query(f"{UMPIRE}, o AS (SELECT DISTINCT umpire_home_plate_id AS mlbam_id, umpire_home_plate_name AS full_name FROM ({synthetic.OFFICIALS})) SELECT u.*, full_name FROM u LEFT JOIN o USING (mlbam_id) WHERE season = (SELECT max(season) FROM u) ORDER BY abs(edge) DESC, mlbam_id LIMIT 5")
def leaderboard_umpires(spark, sf):
    return rounded(api.umpires(rounded(marts.umpire_zone(takes(spark, sf), "prob", "worth", 20)), synthetic.officials(spark), min_pitches=20, limit=5))


@query(f"{ARSENAL}, {PLAYERS} SELECT mlbam_id, full_name, season, p_throws, CAST(sum(pitches) AS BIGINT) AS pitches, count(*) AS pitch_types, round(sum(pitches * velo_avg) / sum(pitches), 1) AS velo_avg, round(sum(pitches * csw_pct) / sum(pitches), 1) AS csw_pct FROM m JOIN pl USING (mlbam_id) WHERE season = (SELECT max(season) FROM m) GROUP BY 1, 2, 3, 4 HAVING sum(pitches) >= 100 ORDER BY pitches DESC, mlbam_id LIMIT 50")
def leaderboard_pitchers(spark, sf):
    return api.player_leaders(marts.pitcher_arsenal(enriched(spark, sf)), synthetic.players(spark), min_pitches=100)


@query(f"{ARSENAL} SELECT {rounding(ARSENAL_KEYS, ARSENAL_MEANS)} FROM m WHERE mlbam_id = 105")
def player_arsenal(spark, sf):
    return rounded(api.player_arsenal(marts.pitcher_arsenal(enriched(spark, sf)), 105))


@query(f"{PITCHES} SELECT season, count(*) FILTER (pitcher = 105) AS pitches_thrown, count(*) FILTER (batter = 105) AS pitches_seen FROM p WHERE pitcher = 105 OR batter = 105 GROUP BY 1")
def player_profile(spark, sf):
    return api.profile(enriched(spark, sf), 105)


@query(f"{PITCHES} SELECT game_pk, game_date, season, count(*) AS pitches FROM p WHERE pitcher = 105 GROUP BY 1, 2, 3 ORDER BY game_date DESC, game_pk LIMIT 25")
def player_games(spark, sf):
    return api.player_games(enriched(spark, sf), 105)


@query(f"{PITCHES} SELECT season, count(*) AS pitches, count(DISTINCT game_pk) AS games, min(game_date) AS first_game, max(game_date) AS last_game FROM p GROUP BY 1")
def api_seasons(spark, sf):
    return api.seasons(enriched(spark, sf))


@query(f"{PITCHES} SELECT {', '.join(api.PITCH_COLUMNS)} FROM p WHERE batter = 505 AND pitch_type = 'FF'")
def api_pitches(spark, sf):
    return api.pitch_rows(enriched(spark, sf), limit=1_000_000, batter=505, pitch_type="FF", pitcher=None)


@query(f"{PITCHES} SELECT {', '.join(api.MOVEMENT_COLUMNS)} FROM p WHERE pitcher = 108 AND is_tracked_pitch AND is_competitive AND pitch_type IS NOT NULL")
def api_movement(spark, sf):
    return api.movement(enriched(spark, sf), 108)


@query(f"{PITCHES} SELECT pitch_type, count(*) AS n, round(avg(hb_arm_in), 6) AS hb, round(avg(ivb_in), 6) AS ivb, round(avg(coalesce(release_speed, 0)), 6) AS velo FROM p WHERE pitcher = 108 AND is_tracked_pitch AND is_competitive AND pitch_type IS NOT NULL AND ivb_in IS NOT NULL AND hb_arm_in IS NOT NULL GROUP BY 1 HAVING count(*) >= 5")
def movement_centroids(spark, sf):
    return rounded(api.movement_centroids(api.movement(enriched(spark, sf), 108)))


@query(f"{PITCHES} SELECT {_FAMILY} AS family, inning, round(avg(release_speed), 6) AS velo, count(*) AS n, count(*) < 5 AS thin FROM p WHERE pitcher = 108 AND release_speed IS NOT NULL AND pitch_type IS NOT NULL GROUP BY 1, 2")
def velocity_trend(spark, sf):
    return rounded(api.velocity_trend(enriched(spark, sf).filter("pitcher = 108")))


@query(f"{PITCHES} SELECT pitch_type, count(*) AS n, round(avg(release_speed), 1) AS velo, round(avg(ivb_in), 1) AS ivb_in, round(avg(hb_arm_in), 1) AS hb_arm_in, round(stddev_samp(ivb_in), 2) AS ivb_sd, round(stddev_samp(hb_arm_in), 2) AS hb_sd FROM p WHERE p_throws = 'R' AND season = (SELECT max(season) FROM p) AND is_tracked_pitch AND is_competitive AND pitch_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 20")
def api_league_shapes(spark, sf):
    return api.league_shapes(enriched(spark, sf), min_n=20)


@query(f"{PITCHES} SELECT {', '.join(api.SWING_COLUMNS)} FROM p WHERE {REGULAR} AND is_swing AND attack_angle IS NOT NULL AND vaa_deg IS NOT NULL AND season >= 2023 AND batter = 505".replace("SELECT attack_angle, vaa_deg", "SELECT attack_angle, round(vaa_deg, 6) AS vaa_deg"))
def api_swing_pitches(spark, sf):
    return rounded(api.swing_pitches(enriched(spark, sf), 505))


@query(f"{PITCHES} SELECT game_date, round(x_ft, 6) AS x_ft, round(y_ft, 6) AS y_ft, launch_speed, launch_angle, estimated_woba_using_speedangle, events, home_team FROM p WHERE batter = 505 AND is_in_play AND is_tracked_pitch AND x_ft IS NOT NULL AND y_ft IS NOT NULL")
def api_batted_balls(spark, sf):
    return rounded(api.batted_balls(enriched(spark, sf), 505))


def _dq(name: str, sql: str, rows):
    def run(spark, sf):
        return rows(spark, enriched(spark, sf))

    run.__name__ = f"quality_{name}"
    query(f"{PITCHES} {sql}")(run)


def _players(spark):
    return synthetic.players(spark)


_ids = lambda df: df.select("event_id")
_dq("not_empty", "SELECT count(*) > 0 AS filled FROM p", lambda s, p: s.createDataFrame([(not p.limit(1).isEmpty(),)], "filled boolean"))
_dq("duplicate_places", "SELECT game_pk, at_bat_number, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1", lambda s, p: quality.duplicates(p, ["game_pk", "at_bat_number"]))
_dq("saturated_day", "SELECT game_date, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 240", lambda s, p: quality.saturated_days(p, 240))
_dq("game_size", "SELECT game_pk, count(*) AS n FROM p WHERE game_type = 'R' GROUP BY 1 HAVING count(*) NOT BETWEEN 100 AND 200", lambda s, p: quality.odd_games(p, 100, 200))
_dq("velocity", "SELECT event_id FROM p WHERE is_tracked_pitch AND (release_speed < 80 OR release_speed > 99)", lambda s, p: _ids(quality.impossible_velocity(p, 80, 99)))
_dq("location", "SELECT event_id FROM p WHERE is_tracked_pitch AND (abs(plate_x) > 1.7 OR plate_z < 0.5 OR plate_z > 4.5 OR abs(release_pos_x) > 2.9 OR release_pos_z <= 5 OR release_pos_z > 6.7)", lambda s, p: _ids(quality.impossible_place(p, {"plate_x": (-1.7, 1.7, False), "plate_z": (0.5, 4.5, False), "release_pos_x": (-2.9, 2.9, False), "release_pos_z": (5.0, 6.7, True)})))
_dq("quarantined", "SELECT season, count(*) AS n FROM p WHERE NOT is_tracked_pitch AND description NOT IN ('automatic_ball', 'automatic_strike') GROUP BY 1 HAVING count(*) > 0", lambda s, p: quality.quarantined(p, 0))
_dq("slow_pitchers", f"SELECT pitcher, min(release_speed) AS slowest FROM p WHERE is_tracked_pitch AND pitcher IN (SELECT mlbam_id FROM ({synthetic.PLAYERS}) WHERE primary_position = 'P') GROUP BY 1 HAVING min(release_speed) < 79", lambda s, p: quality.slow_pitchers(p, _players(s), 79))
_dq("zones", "SELECT event_id FROM p WHERE is_tracked_pitch AND (sz_top <= sz_bot OR sz_top > 3.55 OR sz_bot < 0)", lambda s, p: _ids(quality.odd_zones(p, 3.55)))
_dq("sinkers", "SELECT season, p_throws, round(avg(hb_arm_in), 6) AS hb FROM p WHERE is_tracked_pitch AND pitch_type = 'SI' GROUP BY 1, 2 HAVING avg(hb_arm_in) <= 3", lambda s, p: rounded(quality.sinkers_that_cut(p, 3.0)))
_dq("zone_rate", "SELECT round(avg(CASE WHEN is_in_zone THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct FROM p WHERE is_tracked_pitch", lambda s, p: rounded(quality.zone_rate(p, 99, 100)))
_dq("csw_rate", "SELECT round(avg(CASE WHEN is_csw THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct FROM p WHERE is_tracked_pitch", lambda s, p: rounded(quality.csw_rate(p, 99, 100)))
_dq("pitchers_mapped", f"SELECT DISTINCT pitcher FROM p WHERE pitcher NOT IN (SELECT mlbam_id FROM ({synthetic.PLAYERS}))", lambda s, p: relops.unmatched(p, _players(s), "pitcher", "mlbam_id"))
_dq("batters_mapped", f"SELECT DISTINCT batter FROM p WHERE batter NOT IN (SELECT mlbam_id FROM ({synthetic.PLAYERS}))", lambda s, p: relops.unmatched(p, _players(s), "batter", "mlbam_id"))
_dq("games_mapped", f"SELECT DISTINCT game_pk FROM p WHERE game_pk NOT IN (SELECT game_pk FROM ({synthetic.OFFICIALS}))", lambda s, p: relops.unmatched(p, synthetic.officials(s), "game_pk", "game_pk"))
_dq("coverage", "SELECT season, count(*) AS n, round(count(plate_x) * 100.0::DOUBLE / count(*), 1) AS plate_x_pct, round(count(hc_x) * 100.0::DOUBLE / count(*), 1) AS hc_x_pct FROM p GROUP BY 1", lambda s, p: quality.season_coverage(p, ["plate_x", "hc_x"]))


@query(f"""{PITCHES}, d AS (SELECT game_date, row_number() OVER (ORDER BY game_date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT game_date FROM p)),
  c AS (SELECT max(CASE WHEN k = greatest(1, floor(n * 0.7::DOUBLE)) THEN game_date END) AS a, max(CASE WHEN k = greatest(1, floor(n * 0.85::DOUBLE)) THEN game_date END) AS b FROM d)
  SELECT CASE WHEN game_date <= a THEN 'train' WHEN game_date <= b THEN 'valid' ELSE 'test' END AS part, count(*) AS n, min(game_date) AS first_day, max(game_date) AS last_day FROM p, c GROUP BY 1""")
def split_by_date(spark, sf):
    parts = splits.by_date(enriched(spark, sf)).parts()
    out = [p.groupBy(F.lit(n).alias("part")).agg(F.count("*").alias("n"), F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day")) for n, p in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"{PITCHES} SELECT CASE season WHEN 2023 THEN 'train' WHEN 2024 THEN 'valid' ELSE 'test' END AS part, count(*) AS n FROM p GROUP BY 1")
def split_by_season(spark, sf):
    parts = splits.auto(enriched(spark, sf), features=False).parts()
    out = [p.groupBy(F.lit(n).alias("part")).agg(F.count("*").alias("n")) for n, p in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"{PITCHES} SELECT game_pk, at_bat_number, 'train' AS a, 'valid' AS b FROM p GROUP BY 1, 2 HAVING min(pitch_number) <= 2 AND max(pitch_number) > 2")
def straddling(spark, sf):
    rows = enriched(spark, sf)
    cut = splits.Split(rows.filter("pitch_number <= 2"), rows.filter("pitch_number > 2"), rows.limit(0))
    return splits.straddling(cut)


@query(f"""{PITCHES}, b AS (SELECT *, CASE {_COUNT} WHEN '0-0' THEN 'first' WHEN '0-1' THEN 'ahead' WHEN '2-1' THEN 'ahead' WHEN '0-2' THEN 'putaway' WHEN '1-2' THEN 'putaway' WHEN '2-2' THEN 'even_deep' WHEN '1-0' THEN 'behind' WHEN '2-0' THEN 'behind' WHEN '3-0' THEN 'must_strike' WHEN '3-1' THEN 'must_strike' WHEN '1-1' THEN 'even' WHEN '3-2' THEN 'full' ELSE 'even' END AS bucket FROM p WHERE pitch_type IS NOT NULL),
  t AS (SELECT * FROM b WHERE season = 2023 AND pitcher <> 105), own AS (SELECT pitcher, count(*) FILTER (pitch_type = 'FF') + 1 AS k, count(*) + 15 AS n FROM t WHERE pitch_type IN {tuple(S.PITCH_TYPES)} GROUP BY 1), cell AS (SELECT pitcher, bucket, count(*) FILTER (pitch_type = 'FF') + 1 AS k, count(*) + 15 AS n FROM t GROUP BY 1, 2),
  league AS (SELECT count(*) FILTER (pitch_type = 'FF') + 1 AS k, count(*) + 15 AS n FROM t)
  SELECT event_id, round(coalesce(cell.k / cell.n::DOUBLE, own.k / own.n::DOUBLE, league.k / league.n::DOUBLE), 9) AS p_ff FROM b LEFT JOIN cell USING (pitcher, bucket) LEFT JOIN own USING (pitcher) CROSS JOIN league WHERE season > 2023""")
def baseline_fallback(spark, sf):
    rows = enriched(spark, sf).filter("pitch_type is not null").withColumn("bucket", E.count_bucket(F.col("balls"), F.col("strikes")))
    train = rows.filter("season = 2023 and pitcher <> 105")
    out = learning.baseline_probabilities(rows.filter("season > 2023"), train, "pitcher", "bucket", "pitch_type", S.PITCH_TYPES)
    return rounded(out.select("event_id", F.get("baseline", F.lit(0)).alias("p_ff")), 9)

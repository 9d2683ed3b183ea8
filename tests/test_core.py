"""Invariants of the core operators on small fixtures, and the registered queries against their SQL."""

import datetime as dt
import math
import random
from dataclasses import fields

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import exprs as E
from moundworks.functions.pitches import check_features, enrich, feature_matrix, next_pitch_features, quality_features
from moundworks.operators import geometry, grid, learning, metrics, neighbors, quality, relops, windows
from moundworks.operators.run_value import RunValue
from moundworks.plans import marts, pitch_queries
from moundworks.plans import queries as Q
from moundworks.sources.ingest import Manifest, TokenBucket, chunks, fetch_day, ingest, refresh, wait_before_retry
from moundworks.streaming.live import LiveState, PendingPitch
from moundworks.sources.readers import Catalog, candidate_days, identifier, read_pitches, unique_pitches, url_hash, write_seasons

SF = "/root/testdata/sf0.001"
#: An own pitch of round numbers, so that what is derived from it can be worked out by hand.
PITCH = {
    "game_pk": 77, "at_bat_number": 3, "pitch_number": 2, "game_date": "2024-08-03", "p_throws": "L", "stand": "R", "pitch_type": "SL", "description": "ball", "balls": 2, "strikes": 1,
    "outs_when_up": 2, "on_1b": 41, "on_2b": None, "on_3b": None, "release_speed": 85.0, "release_pos_x": 1.25, "release_pos_z": 6.0, "plate_x": 0.5, "plate_z": 2.0, "sz_bot": 1.5, "sz_top": 3.5,
    "pfx_x": 0.25, "pfx_z": -0.5, "api_break_x_arm": -0.75, "api_break_z_with_gravity": 3.5, "vx0": 3.0, "vy0": -120.0, "vz0": -2.0, "ax": 6.0, "ay": 20.0, "az": -30.0, "hc_x": None, "hc_y": None,
}
TYPES = {c: S.PINNED[c].simpleString() if c in S.PINNED else "string" for c in PITCH}


def pitches(spark, *changes):
    schema = ", ".join(f"{c} {t}" for c, t in TYPES.items())
    return spark.createDataFrame([tuple({**PITCH, **c}.values()) for c in changes or [{}]], schema)


def one(spark, **change):
    return enrich(pitches(spark, change)).collect()[0]


def test_enrich(spark):
    r = one(spark)
    assert (r.season, r.game_month, r.count_state, r.base_state, r.base_out_state) == (2024, 8, "2-1", 1, 5)
    assert (r.ivb_in, r.hb_in, r.hb_arm_in, r.vb_gravity_in, r.plate_z_norm) == (-6.0, 3.0, -9.0, 42.0, 0.25)
    assert not r.is_platoon_same and not r.is_swing and not r.is_csw and r.is_in_zone and r.x_ft is None
    # from y = 50 to 17/12 at ay = 20: v(plate) = -sqrt(120^2 - 2*20*(50 - 17/12)) = -111.6065, after 0.419674 s
    speed = math.sqrt(120**2 - 40 * (50 - 17 / 12))
    t = (120 - speed) / 20
    assert r.vaa_deg == pytest.approx(-math.degrees(math.atan((2 + 30 * t) / speed))) and r.haa_deg == pytest.approx(math.degrees(math.atan((3 + 6 * t) / speed)))
    assert one(spark, api_break_x_arm=None).hb_arm_in == 3.0 and one(spark, api_break_x_arm=None, p_throws="R").hb_arm_in == -3.0
    assert one(spark, plate_z=3.5).plate_z_norm == 1 and one(spark, sz_top=1.5).plate_z_norm is None
    assert one(spark, ay=0.0).vaa_deg is None and one(spark, ay=400.0).vaa_deg is None
    assert not one(spark, release_speed=19.0).is_tracked_pitch and one(spark, release_speed=None).is_tracked_pitch and not one(spark, release_pos_z=0.0).is_tracked_pitch
    assert not one(spark, description="automatic_strike").is_tracked_pitch and not one(spark, description="intent_ball").is_competitive
    assert one(spark, description="missed_bunt", plate_x=-0.84).is_chase and one(spark, description="missed_bunt").is_csw and not one(spark, description="foul_tip").is_whiff
    assert one(spark, on_1b=None, on_2b=5, on_3b=7).base_state == 6 and one(spark, stand=None).is_platoon_same is None
    hit = one(spark, hc_x=125.91, hc_y=99.54)
    assert hit.x_ft == 0 and hit.spray_angle_deg == 0 and hit.hit_distance_derived_ft == pytest.approx(233.9)


def test_enrich_of_nothing(spark):
    assert enrich(pitches(spark).limit(0)).count() == 0


def test_expressions(spark):
    r = spark.range(1).select(
        E.location_class(F.lit(0.0), F.lit(0.5)).alias("a"), E.location_class(F.lit(9.0), F.lit(0.5)).alias("b"), E.location_class(F.lit(None).cast("double"), F.lit(0.5)).alias("c"),
        E.count_bucket(F.lit(3), F.lit(2)).alias("d"), E.count_key(F.lit(5), F.lit(7)).alias("e"), E.pitch_family(F.lit("XX")).alias("f"), E.velocity_tier(F.lit(96.0)).alias("g"),
        E.encode_sorted(F.lit("b"), ["c", "b", "a"]).alias("h"), E.encode_sorted(F.lit("z"), ["c"]).alias("i"), E.ramp_step(F.lit(0.01), 1.0).alias("j"), E.ramp_step(F.lit(-5.0), 1.0).alias("k"),
        E.fade(F.lit(0.0), 25.0).alias("l"), E.safe_div(F.lit(1.0), F.lit(0.0)).alias("m"), E.clean_null(F.lit("NA")).alias("n"),
    ).collect()[0]
    assert tuple(r) == (12, 25, None, "full", "3-2", "offspeed", "95-98", 1, None, 0, -5, 0.06, None, None)


GAME = [  # at bat, pitch, pitcher, batter, type, balls, strikes, swing, zone: two at bats of one pitcher, one of another
    (1, 1, 9, 4, "FF", 0, 0, False, True), (1, 2, 9, 4, None, 0, 1, True, False), (1, 3, 9, 4, "SL", 0, 2, False, None), (2, 1, 9, 5, "FF", 0, 0, True, True), (2, 2, 9, 5, "CH", 0, 1, False, False), (3, 1, 8, 4, "CU", 0, 0, False, True),
]
GAME_TYPES = "at_bat_number int, pitch_number int, pitcher long, batter long, pitch_type string, balls int, strikes int, is_swing boolean, is_in_zone boolean"


def game(spark):
    rest = {"game_date": dt.date(2024, 8, 3), "game_pk": 1, "season": 2024, "bat_score": 1, "fld_score": 3, "inning_topbot": "Top", "stand": "R", "p_throws": "R", "home_team": "SEA", "base_state": 2, "outs_when_up": 1, "inning": 4, "n_thruorder_pitcher": 1}
    df = spark.createDataFrame(GAME, GAME_TYPES).withColumns({k: F.lit(v) for k, v in rest.items()})
    return df.withColumns({"plate_x": F.lit(0.3), "plate_z_norm": F.lit(0.9), "release_speed": 80.0 + F.col("pitch_number"), "is_whiff": F.col("is_swing"), "pitcher_days_since_prev_game": F.lit(5.0)})


def test_next_pitch_features_by_hand(spark):
    rows = {(r.at_bat_number, r.pitch_number): r for r in next_pitch_features(game(spark)).collect()}
    assert feature_matrix(next_pitch_features(game(spark))).columns == S.NEXT_PITCH
    a = rows[1, 1]
    assert (a.score_diff, a.pitch_in_ab, a.pitch_count_in_game, a.prior_pitches_seen, a.prior_usage_ff, a.prior_zone_rate, a.prev_pitch_type_1, a.prior_usage_this_count) == (-2, 1, 0, 0, None, None, None, 0)
    assert (a.is_home_pitching, a.is_platoon_same, a.base_out_state) == (1, 1, 7)
    b = rows[2, 2]  # before it four pitches: FF, unknown, SL, FF; in the zone yes, no, unknown, yes
    assert (b.prior_pitches_seen, b.prior_usage_ff, b.prior_usage_sl, b.prior_usage_ch, b.prior_usage_breaking, b.prior_zone_rate) == (4, 0.5, 0.25, 0.0, 0.25, 0.5)
    assert (b.prior_usage_this_count, b.pitch_count_in_game, b.prev_pitch_type_1, b.prev_pitch_type_2, b.prev_was_swing_1, b.prev_velo_1) == (1, 4, "FF", None, 1, 81.0)
    c = rows[3, 1]  # another pitcher, a batter seen before
    assert (c.prior_pitches_seen, c.pitch_count_in_game, c.last_pitch_type_vs_batter, c.prev_pitch_type_1) == (0, 0, "SL", None)
    assert rows[1, 3].prev_pitch_type_1 is None and rows[1, 3].prev_pitch_type_2 == "FF"
    assert a.target_location == 3 * 5 + 3  # x 0.3 in the fourth column of 0.6 ft, z 0.9 in the fourth row of 0.4
    with pytest.raises(ValueError):
        check_features(["balls", "release_speed"])
    with pytest.raises(ValueError):
        feature_matrix(game(spark))


def test_live_features_equal_batch_features(spark):
    batch = {(r.at_bat_number, r.pitch_number): r for r in next_pitch_features(game(spark)).collect()}
    names = [f.name for f in fields(PendingPitch)]
    for at in (0, 2, 4, 5):
        key = GAME[at][:2]
        before = game(spark).filter(F.struct("at_bat_number", "pitch_number") < F.struct(F.lit(key[0]), F.lit(key[1])))
        now = game(spark).filter((F.col("at_bat_number") == key[0]) & (F.col("pitch_number") == key[1])).collect()[0]
        state = LiveState(before.limit(0)).record(before)
        pending = PendingPitch(**{n: now[n] for n in names} | {"game_date": None})  # a what-if has no date: it comes last all the same
        live = state.features_for(pending).collect()[0]
        assert {n: live[n] for n in S.NEXT_PITCH} == {n: batch[key][n] for n in S.NEXT_PITCH}
    assert LiveState.seeded(game(spark), 8, 2024).history.count() == 1 and not {"pitch_type", "release_speed", "plate_x"} & set(names)


def test_mirrored_pitchers_have_equal_shapes(spark):
    cols = "pitcher long, season int, pitch_type string, release_speed double, ivb_in double, hb_arm_in double, release_pos_x double, spin_axis double, plate_x double, p_throws string, stand string"
    rows = [(1, 2024, "FF", 95.0, 16.0, 8.0, -2.0, 210.0, 0.5, "R", "R"), (2, 2024, "FF", 95.0, 16.0, 8.0, 2.0, 150.0, -0.5, "L", "L")]
    a, b = quality_features(spark.createDataFrame(rows, cols), 1).orderBy("pitcher").collect()
    assert a.release_pos_x_arm == b.release_pos_x_arm and a.plate_x_out == b.plate_x_out and a.spin_axis_sin == pytest.approx(b.spin_axis_sin) and a.velo_diff_fb == b.velo_diff_fb == 0


def test_grid_keeps_constants(spark):
    rng = random.Random(1)
    rows = [(1, rng.gauss(0, 0.3), rng.gauss(0.5, 0.2), 7.0) for _ in range(300)] + [(1, 99.0, 99.0, 7.0)]
    arrays = grid.smooth_arrays(spark.createDataFrame(rows, "id int, x double, y double, v double"), ["id"], "x", "y", "v", grid.ZONE)
    out = grid.grid_cells(arrays, ["id"]).collect()
    assert len(out) == 2500 and all(r.surface is None or r.surface == pytest.approx(7.0) for r in out) and sum(r.surface is not None for r in out) > 300
    packed = arrays.collect()[0]
    assert len(packed.surface) == len(packed.reliability) == 2500 and packed.n == 301
    for n, s in ((50, 4.0), (60, 1.543)):
        sums = {}
        for i, _, w in grid.folded_kernel(n, s):
            sums[i] = sums.get(i, 0) + w
        assert all(v == pytest.approx(1) for v in sums.values())


def surface(spark, n, values):
    return spark.createDataFrame([(1, n, n, values)], "id int, grid_n int, grid_m int, surface array<double>")


def test_contour_rings_a_bump(spark):
    values = [1.0 if (i, j) == (2, 2) else 0.0 for i in range(5) for j in range(5)]
    out = grid.contours(surface(spark, 5, values), ["id"], 0.5).collect()
    assert len(out) == 4 and all(abs(math.hypot(r.x1 - 2, r.y1 - 2) - 0.5) < 1e-9 for r in out)


def test_contour_saddles_and_gaps(spark):
    # corners by (i, j): (0, 0) and (1, 1) high, then the other way round: left with bottom and right with top, both times
    want = [((0.0, 0.5), (0.5, 0.0)), ((1.0, 0.5), (0.5, 1.0))]
    for values in ([1.0, 0.0, 0.0, 1.0], [0.0, 1.0, 1.0, 0.0]):
        out = grid.contours(surface(spark, 2, values), ["id"], 0.5).collect()
        assert sorted(((r.x1, r.y1), (r.x2, r.y2)) for r in out) == want
    for gap in (None, math.nan, math.inf):
        assert grid.contours(surface(spark, 2, [1.0, gap, 0.0, 0.0]), ["id"], 0.5).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=3, max_size=30))
def test_hull_holds_all_points(points):
    hull = geometry.hull_points(points)
    assert set(hull) <= set(points)
    if len(hull) > 2:
        for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in points)


def test_hull_and_wall_and_flight(spark):
    square = [(1, float(x), float(y)) for x in range(4) for y in range(4)]
    out = geometry.convex_hull(spark.createDataFrame(square, "id int, x double, y double").repartition(3), "id", "x", "y").orderBy("k").collect()
    assert [(r.x, r.y) for r in out] == [(0, 0), (3, 0), (3, 3), (0, 3)]
    wall = spark.sql("SELECT 'p' AS park, array(named_struct('angle', -45D, 'distance', 330D), named_struct('angle', -22D, 'distance', 370D), named_struct('angle', 0D, 'distance', 400D), named_struct('angle', 22D, 'distance', 370D), named_struct('angle', 45D, 'distance', 330D)) AS marks")
    w = geometry.park_wall(wall, "park").orderBy("k").collect()
    assert len(w) == 41 and w[20].y == pytest.approx(400) and w[0].x == pytest.approx(-330 * math.sin(math.pi / 4))
    path = Q.flight_path(spark, SF).filter("event_id = 0").orderBy("k").collect()
    assert path[0].y == pytest.approx(54) and path[-1].y == pytest.approx(17 / 12) and path[0].mph > path[-1].mph


def test_every_event_has_its_own_flight(spark):
    paths, n = Q.flight_path(spark, SF), Q.events(spark, SF).count()
    assert paths.select("event_id").distinct().count() == n > 50 and paths.count() == 21 * n
    assert paths.filter("k = 20").select("mph").distinct().count() > 50


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.booleans()), min_size=2, max_size=12))
def test_rank_auc_is_pairwise(spark, rows):
    got = windows.rank_auc(spark.createDataFrame([(1, float(s), p) for s, p in rows], "g int, s double, p boolean"), ["g"], "s", "p").collect()[0].auc
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    assert got == (None if want is None else pytest.approx(want))


def test_relational_operators(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0), (1, "b", 2, 2.0), (None, "c", 3, 3.0)], "k int, t string, v int, w double")
    assert relops.keep_first(df, ["k"], "t", last=True).filter("k = 1").collect()[0].t == "b"
    assert relops.most_complete(df, ["k"], ["v"], F.col("t")).filter("k = 1").collect()[0].t == "b"
    assert relops.qualified(df, ["k"], 2).count() == 2
    over = spark.createDataFrame([(1, "z")], "k int, t string")
    assert {r.t for r in relops.with_overrides(df, over, "k", ["t"]).collect()} == {"z", "c"}
    assert relops.histogram(df.filter("k is null"), "w", 5).count() == 0 and relops.histogram(df, "w", 4).agg(F.sum("n")).collect()[0][0] == 3
    with_nulls = spark.createDataFrame([("x", None), ("x", "q")], "k string, t string")
    assert {(r.t, r.n) for r in relops.rollup_all(with_nulls, ["k"], "t", [F.count("*").alias("n")]).collect()} == {("q", 1), ("ALL", 1)}


def test_run_values_average_to_nothing(spark):
    rows = Q._run_values(spark, SF).filter("rv_batting is not null")
    first = rows.groupBy("user_id", "day").agg(F.sum("rv_batting").alias("gain"), F.max("terminal").alias("t"))
    re00 = rows.filter("cnt = '0-0'").agg(F.avg("re")).collect()[0][0]
    assert first.filter(F.abs(F.col("gain") - (F.col("t") - F.lit(re00))) > 1e-9).count() == 0


def league(spark, n=120):
    """Strikeouts of three pitches, walks of four, and a ball followed by a single that is hit ever harder."""
    rows = []
    for i in range(n):
        for k, (counts, last, worth) in enumerate(((((0, 0), (0, 1), (0, 2)), "strikeout", -0.25), (((0, 0), (1, 0), (2, 0), (3, 0)), "walk", 0.3), (((0, 0), (1, 0)), "single", 0.2 + 0.002 * i))):
            for p, (balls, strikes) in enumerate(counts, 1):
                end = p == len(counts)
                hit = end and last == "single"
                rows.append((i * 3 + k, 1, p, balls, strikes, "hit_into_play" if hit else "ball", last if end else None, worth if end else 0.0, 0.4 + 0.002 * i if hit else None))
    rows += [(9999, 1, 1, 0, 0, "intent_ball", "intent_walk", 0.3, None)]
    return spark.createDataFrame(rows, "game_pk long, at_bat_number int, pitch_number int, balls int, strikes int, description string, events string, delta_run_exp double, estimated_woba_using_speedangle double")


def test_run_value_model(spark):
    df = league(spark)
    model = RunValue.fit(df)
    assert model.slope == pytest.approx(1) and model.intercept == pytest.approx(-0.2) and model.event_value["walk"] == pytest.approx(0.3) and "intent_walk" not in model.event_value
    assert model.count_re["3-0"] > model.count_re["0-0"] > model.count_re["0-2"] and model.n_fit == 360
    out = model.attach(df)
    assert out.filter("events = 'intent_walk'").collect()[0].rv_pitcher is None
    means = out.filter("rv_pitcher is not null").groupBy("balls", "strikes").agg(F.avg("rv_pitcher").alias("m")).collect()
    assert len(means) == 6 and all(abs(r.m) < 1e-9 for r in means)
    values = model.strike_values()
    assert values["0-0"] == pytest.approx(model.count_re["1-0"] - model.count_re["0-1"]) and values["3-2"] == pytest.approx(0.3 + 0.25) and values["1-0"] is None
    again = RunValue.from_json(model.to_json())
    assert again == model
    with pytest.raises(ValueError):
        RunValue.fit(league(spark, 20))
    with pytest.raises(ValueError):
        RunValue.fit(df.drop("events"))


def test_clusters_merge_one_shape_and_keep_two(spark):
    import numpy as np

    rng, rows = np.random.default_rng(0), []
    for label, centre in (("FF", (95, 16, 8, 0, 1)), ("SI", (95, 16, 8, 0, 1)), ("CU", (78, -12, -6, 1, 0))):
        rows += [(1, 2024, label, *map(float, rng.normal(centre, 0.5))) for _ in range(120)]
    df = spark.createDataFrame(rows, "pitcher int, season int, pitch_type string, " + ", ".join(f"{c} double" for c in S.CLUSTER))
    out = learning.shape_clusters(df, ["pitcher", "season"], "pitch_type", S.CLUSTER).orderBy("cluster_id").collect()
    assert [(r.label, r.n_savant_labels) for r in out] == [("FF", 2), ("CU", 1)] and out[0].cluster_k == 2 and out[0].arsenal_size_diff == -1 and out[0].season_purity == pytest.approx(2 / 3) and out[1].velo_avg == pytest.approx(78, abs=0.3) and sum(r.usage_pct for r in out) == pytest.approx(100)


def shapes(*parts):
    """Rows of (label, n, velocity, ivb, hb, spin in degrees, first day, days) as in FIXTURES A7."""
    import numpy as np

    rows = []
    for seed, (label, n, velo, ivb, hb, spin, first, days) in enumerate(parts):
        rng = np.random.default_rng(seed)
        for day in rng.integers(first, first + days, n):
            sin, cos = math.sin(math.radians(spin)), math.cos(math.radians(spin))
            shape = rng.normal((velo, ivb, hb, sin, cos), (0.8, 1, 1, 0.03, 0.03))
            rows.append((1, 2025, label, *map(float, shape), dt.date(2025, 4, 1) + dt.timedelta(int(day))))
    return rows


@pytest.mark.parametrize(
    "parts, want",
    [
        ([("SL", 200, 88, 2, 3, 180, 0, 180), ("SL", 200, 78, -4, 14, 230, 0, 180)], [("SL", 200, 1), ("SL-2", 200, 1)]),
        ([("SL", 200, 88, 2, 3, 180, 0, 90), ("SL", 200, 78, -4, 14, 230, 90, 90)], [("SL", 400, 1)]),  # one after the other: drift
        ([("SL", 300, 88, 2, 3, 180, 0, 180), ("SL", 31, 78, -4, 14, 230, 0, 180)], [("SL", 331, 1)]),  # under a tenth
        ([("FF", 150, 94, 15, 8, 210, 0, 180), ("SI", 150, 94.2, 15.3, 8.1, 211, 0, 180)], [("FF", 300, 0.5)]),
        ([("FF", 200, 95, 16, 8, 210, 0, 180), ("SL", 150, 85, 1, 2, 100, 0, 180), ("CH", 120, 86, 6, 14, 250, 0, 180)], [("CH", 120, 1), ("FF", 200, 1), ("SL", 150, 1)]),
        ([("FF", 300, 95, 16, 8, 210, 0, 180), ("CU", 20, 78, -9, -6, 40, 0, 180), ("EP", 20, 55, 1, 2, 100, 0, 180)], [("CU", 40, 0.5), ("FF", 300, 1)]),  # 40 rows together
    ],
)
def test_clusters_split_and_merge_as_the_fixtures(spark, parts, want):
    schema = "pitcher long, season int, pitch_type string, " + ", ".join(f"{c} double" for c in S.CLUSTER) + ", game_date date"
    df = spark.createDataFrame(shapes(*parts), schema).withColumns({"is_tracked_pitch": F.lit(True), "is_competitive": F.lit(True)})
    out = marts.arsenal_clusters(df).collect()
    assert sorted((r.label, r.n) for r in out) == [w[:2] for w in want] and sum(r.usage_pct for r in out) == pytest.approx(100)
    assert [r.purity for r in sorted(out, key=lambda r: r.label)] == pytest.approx([w[2] for w in want])


def test_nearest_breaks_ties_by_key_in_any_row_order(spark):
    rows = [(i, [1.0, 1.0]) for i in range(60, 0, -1)] + [(0, [0.0, 0.0]), (61, [0.0, 3.0])]
    for key in ("long", "string"):
        name = (lambda i: i) if key == "long" else "{:03d}".format
        df = spark.createDataFrame([(name(i), v) for i, v in rows], f"id {key}, v array<double>").coalesce(1)
        out = neighbors.nearest(spark, df, "id", "v", 5, df.filter(F.col("id") == name(0))).orderBy("rank").collect()
        assert [(r["rank"], r.neighbor) for r in out] == [(k, name(k)) for k in range(1, 6)]


def test_metrics(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1], 0, [0.0, 0.0, 1.0], 1500), ([0.1, 0.3, 0.6], 1, [0.0, 0.0, 1.0], 0)], "p array<double>, y int, own array<double>, n int")
    r = metrics.multiclass_report(df, "p", "y", 2).collect()[0]
    assert r.top1 == 0.5 and r.topk == 1.0 and r.log_loss == pytest.approx(-(math.log(0.7) + math.log(0.3)) / 2)
    a, b = df.select(metrics.blended("p", "own", "n").alias("m")).collect()
    assert a.m == pytest.approx([0.56, 0.16, 0.28]) and b.m == pytest.approx([0.1, 0.3, 0.6])


def test_quality_checks(spark):
    good = enrich(pitches(spark, *[{"pitch_number": i, "description": "called_strike" if i % 4 else "ball"} for i in range(8)])).withColumns({"pitcher": F.lit(1), "batter": F.lit(2), "game_type": F.lit("R")})
    done = {o.name: o for o in quality.run_checks({"fact_pitch": good.unionByName(good.limit(1))})}
    assert not done["primary_key_unique"].passed and done["not_empty"].passed and done["velocity_possible"].passed and "games_mapped" not in done
    assert quality.failed(done.values())
    assert quality.season_coverage(good, ["plate_x", "hc_x"]).collect()[0].hc_x_pct == 0.0


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿game_pk,at_bat_number,pitch_number,release_speed,description\n1,1,1,95.5,ball\n1,1,1,null,ball\n1,1,2,NA,\n", encoding="utf-8")
    df = read_pitches(spark, str(tmp_path / "d.csv"))
    assert df.columns[0] == "game_pk" and [r.release_speed for r in df.collect()] == [95.5, None, None] and dict(df.dtypes)["game_pk"] == "bigint"
    assert unique_pitches(df.withColumn("game_date", F.lit("2024-04-01"))).count() == 2
    seasons = spark.createDataFrame([(1, 2023), (2, 2024)], "v int, season int")
    write_seasons(seasons, str(tmp_path / "lake"))
    write_seasons(spark.createDataFrame([(3, 2024)], "v int, season int"), str(tmp_path / "lake"))
    assert {r.v for r in spark.read.parquet(str(tmp_path / "lake")).collect()} == {1, 3}
    catalog = Catalog(spark, str(tmp_path), {"lake": "lake", "none": "none"})
    assert catalog.register_all() == ["lake"] and spark.sql("select count(*) from lake").collect()[0][0] == 2
    with pytest.raises(LookupError):
        catalog.table("none")
    with pytest.raises(ValueError):
        identifier("a; drop")
    assert candidate_days(spark, "2024-01-30", "2024-02-02").count() == 2
    assert url_hash("u", {"a": "1", "b": "2"}) == url_hash("u", {"b": "2", "a": "1"})


def test_ingest():
    clock, slept = [0.0], []
    bucket = TokenBucket(0.5, clock=lambda: clock[0], sleep=slept.append)
    bucket.take()
    bucket.take()
    assert slept == [2.0] and wait_before_retry(3, "7") == 7 and wait_before_retry(9, rng=lambda: 0.5) == 60.5
    assert [len(c) for c in chunks(list(range(200)))] == [90, 90, 20]
    full = [{"k": i} for i in range(S.SATURATED_ROWS)]
    assert len(fetch_day(lambda d, t: full if t is None else full[:10], dt.date(2024, 4, 1), ["A", "B"], lambda r: r["k"])) == 10
    with pytest.raises(OverflowError):
        fetch_day(lambda d, t: full, dt.date(2024, 4, 1), ["A"], lambda r: r["k"])
    m, days = Manifest(), [dt.date(2024, 4, d) for d in (1, 2, 3)]
    counts = ingest(days, lambda d: {1: 5, 2: 0}[d.day], m)
    assert counts == {"ok": 1, "empty": 1, "failed": 1, "skipped": 0} and len(m.failures()) == 1
    assert ingest(days, lambda d: 1, m) == {"ok": 1, "empty": 0, "failed": 0, "skipped": 2}
    assert refresh(dt.date(2024, 4, 3), lambda d: 1, m, trailing=1)["ok"] == 2


@pytest.fixture(scope="module", autouse=True)
def enriched_once(spark, tmp_path_factory):
    """The enriched pitch table is written once; the queries over it read it, rather than derive it a hundred times."""
    path, derive = str(tmp_path_factory.mktemp("lake") / "enriched"), pitch_queries.enriched
    derive(spark, SF).write.parquet(path)
    pitch_queries.enriched = lambda session, sf: session.read.parquet(path)
    yield
    pitch_queries.enriched = derive


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "customer supplier orders lineitem part events documents embeddings labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = Q.QUERIES[name](spark, SF), con.execute(Q.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    show = lambda v: "" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v).replace("+00:00", "")
    assert sorted(tuple(map(show, r)) for r in df.select(*names).collect()) == sorted(tuple(map(show, r)) for r in want.fetchall())


def test_hulls_of_many_groups_at_once(monkeypatch):
    """Groups of few rows never cost a pass of plain Python each before the shuffle; what is left has the same hulls."""
    rng = np.random.default_rng(3)
    key = np.r_[rng.integers(0, 3000, 20_000), np.full(5000, 7), np.full(5000, 8)]
    x = np.r_[rng.integers(0, 50, 20_000) / 10, rng.normal(size=5000), np.arange(5000) * 0.1]
    y = np.r_[rng.integers(0, 9, 20_000) / 10, rng.normal(size=5000), np.arange(5000) * 0.3]
    calls, plain = [], geometry.hull_points
    monkeypatch.setattr(geometry, "hull_points", lambda points: calls.append(len(points)) or plain(points))
    batches = pa.table({"id": key, "x": x, "y": y}).to_batches(max_chunksize=1000)
    left = pa.Table.from_batches(geometry._local_hulls("id")(iter(batches)))
    assert len(calls) <= 2 and left.num_rows < len(key) - 9000
    hulls = lambda k, x, y: {int(i): plain(list(zip(x[k == i].tolist(), y[k == i].tolist(), strict=True))) for i in np.unique(k)}
    rest = [left.column(c).to_numpy() for c in ("id", "x", "y")]
    want = hulls(key, x, y)
    assert hulls(*rest) == want
    order = np.argsort(rest[0], kind="stable")
    final = pa.Table.from_batches(geometry._final_hulls("id")(iter(pa.table({"id": rest[0][order], "x": rest[1][order], "y": rest[2][order]}).to_batches(max_chunksize=700)))).to_pylist()
    assert {i: [(r["x"], r["y"]) for r in final if r["id"] == i] for i in (0, 7, 8)} == {i: want[i] for i in (0, 7, 8)} and len(final) == sum(map(len, want.values()))


def test_final_hull_of_a_group_that_fills_many_chunks(monkeypatch):
    monkeypatch.setattr(geometry, "HULL_ROWS", 50)
    rng = np.random.default_rng(5)
    key, x, y = np.sort(rng.choice(["a", "b", "b", "b", "c"], 2000)), rng.normal(size=2000).round(1), rng.normal(size=2000)
    rows = [r for b in geometry._final_hulls("id")(iter(pa.table({"id": key, "x": x, "y": y}).to_batches(max_chunksize=30))) for r in b.to_pylist()]
    for k in "abc":
        assert [(r["x"], r["y"]) for r in rows if r["id"] == k] == geometry.hull_points(list(zip(x[key == k].tolist(), y[key == k].tolist(), strict=True)))
        assert [r["k"] for r in rows if r["id"] == k] == list(range(sum(r["id"] == k for r in rows)))


def test_next_season_rank_counts_without_pairs(spark, monkeypatch):
    """Whatever the number of blocks, ties, null and NaN places, rows without key or season and repeated rows are counted as by
    the join of all pairs, and the plan joins by keys only."""
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 50 else None, int(s) if i % 41 else None, float(rng.integers(0, 8)), float(rng.integers(0, 8))) for i in range(1, 120) for s in (2020, 2021, 2022)]
    rows += [(3, 2020, 1.0, 5.0), (5, 2021, None, 2.0), (6, 2020, float("nan"), 2.0), (None, 2020, 0.0, 0.0), (None, None, 3.0, 3.0)]
    spark.createDataFrame(rows, "id long, season int, x double, y double").createOrReplaceTempView("seasons")
    want = spark.sql("""WITH p AS (SELECT a.*, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM seasons a JOIN seasons b ON a.id = b.id AND b.season = a.season + 1),
      r AS (SELECT p.id, p.season, count_if(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) < d AND (c.id <> p.id OR c.season <> p.season)) AS k FROM p CROSS JOIN seasons c GROUP BY 1, 2)
      SELECT median(k / (SELECT count(*) - 2 FROM seasons)), count(*) FROM r""").collect()[0]
    for size in (1 << 18, 60):
        monkeypatch.setattr(neighbors, "POINTS", size)
        monkeypatch.setattr(neighbors, "PLACES", size)
        out = neighbors.next_season_rank(spark.table("seasons"), "id", "season", "x", "y")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = out.collect()[0]
        assert (got["rank"], got["pairs"]) == (pytest.approx(want[0], abs=1e-12), want[1])


def test_points_nearer_than():
    rng = np.random.default_rng(6)
    for make in (lambda n: rng.normal(size=n), lambda n: rng.integers(0, 9, n).astype(float), lambda n: 1e6 + rng.integers(0, 50, n) * 0.1):
        x, y, px, py = make(900), make(900), make(120), make(120)
        goal = rng.integers(0, 900, 120)
        d = np.sqrt((px - x[goal]) ** 2 + (py - y[goal]) ** 2)
        x[0], y[1], d[2], px[3] = np.nan, np.inf, np.inf, np.nan
        far = np.sqrt((px[:, None] - x) ** 2 + (py[:, None] - y) ** 2)
        assert (neighbors.nearer_than(x, y, px, py, d) == ((far < d[:, None]) | (np.isnan(d)[:, None] & ~np.isnan(far))).sum(axis=1)).all()

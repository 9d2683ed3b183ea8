"""Models, marts, the query surface, sources, streams and the command line on small tables."""

import datetime as dt
import gzip
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moundworks import cli
from moundworks import schema as S
from moundworks.functions import exprs as E
from moundworks.functions import splits
from moundworks.functions.pitches import next_pitch_features, quality_features, rows_for, swing_frame
from moundworks.models import heads
from moundworks.models.boosted import Boosted
from moundworks.models.registry import Registry
from moundworks.operators import encodings, geometry, learning, metrics, neighbors, relops, windows
from moundworks.operators.run_value import RunValue
from moundworks.plans import api, marts, pitch_queries, synthetic
from moundworks.plans.build import Workspace
from moundworks.settings import Settings
from moundworks.sources import ingest, readers, rest
from moundworks.streaming import events as ev

SF = "/root/testdata/sf0.01"
QUICK = {"maxIter": 8, "maxDepth": 4}


@pytest.fixture(scope="module")
def pitches(spark, tmp_path_factory):
    """The enriched synthetic table, written once."""
    path = str(tmp_path_factory.mktemp("lake") / "fact_pitch")
    pitch_queries.enriched(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


# --- models ---


@pytest.fixture(scope="module")
def sequence(spark):
    """A league whose next pitch follows from the count: with two strikes a slider, else mostly what the pitcher likes."""
    rng, rows = random.Random(8), []
    for i in range(6000):
        game, at, n = i // 120, i % 120 // 4 + 1, i % 4 + 1
        strikes = min(n - 1, 2)
        likes = ["FF", "SI", "CH"][game % 3]
        kind = "SL" if strikes == 2 and rng.random() < 0.9 else likes if rng.random() < 0.8 else rng.choice(["FF", "SL", None])
        rows.append((dt.date(2024, 4, 1) + dt.timedelta(game), game, at, n, game % 3 + 1, at % 9, kind, 0, strikes, rng.random() < 0.5))
    rest_ = {"season": 2024, "bat_score": 1, "fld_score": 3, "inning_topbot": "Top", "stand": "R", "p_throws": "R", "home_team": "SEA", "base_state": 0, "outs_when_up": 1, "inning": 4, "n_thruorder_pitcher": 1}
    df = spark.createDataFrame(rows, "game_date date, game_pk long, at_bat_number int, pitch_number int, pitcher long, batter long, pitch_type string, balls int, strikes int, is_swing boolean").withColumns({k: F.lit(v) for k, v in rest_.items()})
    df = df.withColumns({"plate_x": F.lit(0.3), "plate_z_norm": F.lit(0.9), "release_speed": F.lit(90.0), "is_whiff": F.lit(False), "is_in_zone": F.col("is_swing"), "pitcher_days_since_prev_game": F.lit(None).cast("double")})
    return next_pitch_features(df).cache()


def test_next_pitch_beats_the_baseline(spark, sequence, tmp_path):
    split = splits.auto(splits.prepared(sequence, "target_pitch_type"))
    model = heads.next_pitch(split, {"numTrees": 12, "maxDepth": 6})
    scored = model.predict(split.test)
    assert scored.filter(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    report = heads.class_report(scored, "target_pitch_type", model.classes).collect()[0]
    bucket = E.count_bucket(F.col("balls"), F.col("strikes"))
    own = learning.baseline_probabilities(split.test.withColumn("b", bucket), split.train.withColumn("b", bucket), "pitcher", "b", "target_pitch_type", model.classes).withColumnRenamed("baseline", "probability")
    league = own.withColumn("probability", F.array(*[F.lit(1 / 15)] * 15))
    base = heads.class_report(league, "target_pitch_type", model.classes).collect()[0]
    assert report.log_loss < 0.95 * base.log_loss and report.top1 > 0.7 and report.topk >= report.top1 and 0 <= report.ece < 0.2
    both = heads.personal(heads.kept_to_repertoire(scored, split.train), split.train)
    assert both.filter(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    assert heads.class_report(both, "target_pitch_type", model.classes).collect()[0].log_loss < base.log_loss
    registry = Registry(spark, str(tmp_path))
    registry.save(model, "next_pitch", report.asDict(), "v1")
    again = registry.load("next_pitch", S.NEXT_PITCH)
    pick = lambda m: [r.probability for r in m.predict(split.test).orderBy("game_pk", "at_bat_number", "pitch_number").limit(5).collect()]
    assert pick(again) == pick(model) and registry.status(["next_pitch", "none"]) == {"next_pitch": f"{tmp_path}/next_pitch/v1", "none": None}
    assert json.loads(readers.read_text(spark, f"{tmp_path}/next_pitch/v1/metrics.json"))["top1"] == report.top1
    with pytest.raises(ValueError):
        registry.load("next_pitch", ["balls"])
    with pytest.raises(LookupError):
        registry.load("none")
    assert model.importance()[0][0] in ("strikes", "pitch_in_ab", "prev_pitch_type_1") and abs(sum(g for _, g in model.importance()) - 1) < 1e-6
    told = api.replay(model, sequence, 3, 1, model.classes)
    assert told.count() == 120 and {c["class"] for r in told.collect() for c in r.predicted} <= set(S.PITCH_TYPES)
    hits = metrics.hit_rate(told, "top", "actual_pitch_type").collect()[0]
    assert hits.n == 120 and hits.pct == pytest.approx(100 * hits.hits / 120) and hits.pct > 50
    with pytest.raises(LookupError):
        api.replay(model, sequence, 3, 999, model.classes)


def test_model_handles_nulls_and_unseen_values(spark):
    rows = [(float(i % 10), "a" if i % 2 else "b", float(i % 10 > 4), None if i % 3 else 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, c string, y double, z double")
    model = Boosted("binary", ["x", "c", "z"], ["c"], [], QUICK).fit(df, "y", df)
    odd = spark.createDataFrame([(None, "new", None), (9.0, None, 2.0), (0.0, "a", None)], "x double, c string, z double")
    p = [r.probability for r in model.predict(odd).collect()]
    assert p[1] > 0.8 and p[2] < 0.2 and 0 <= p[0] <= 1
    with pytest.raises(RuntimeError):
        Boosted("binary", ["x"]).predict(df)


def test_called_strike_swing_and_quality(spark, pitches):
    rows = pitches.withColumn("is_called_strike", F.col("is_in_zone")).filter("is_in_zone is not null and plate_z is not null").withColumn("plate_x_out", E.mirror(F.col("plate_x"), F.col("stand")))
    split = splits.auto(rows, features=False)
    model = heads.called_strike(split.train, split.valid, QUICK)
    report = heads.binary_report(model.predict(split.test), "is_called_strike").collect()[0]
    assert report.auc > 0.85 and report.ece < 0.15 and report.log_loss < 0.5
    swings = swing_frame(pitches).withColumn("is_whiff", F.col("attack_angle") > 10.0)
    head = heads.swing("whiff", swings, None, QUICK)
    worth = heads.plane_value(head, swings)
    flat = worth.filter(F.abs(F.col("attack_angle") - head.extra["league_plane"]) < 0.3)
    steep = worth.filter("attack_angle > 20").agg(F.avg("plane_value")).collect()[0][0]
    assert steep < -0.3 and abs(flat.agg(F.avg("plane_value")).collect()[0][0]) < 0.5 and "plane_value" in worth.columns and worth.count() == rows_for("whiff", swings).count()
    with pytest.raises(ValueError):
        rows_for("other", swings)
    frame = quality_features(marts.competitive(pitches).filter("pitch_type is not null")).withColumn("rv_pitcher", F.col("release_speed") / 100 - F.abs("plate_x") / 10)
    frame = frame.filter("rv_pitcher is not null")
    grade = heads.pitch_quality("stuff", frame, None, QUICK, least=10, groups=5)
    plus_ = heads.graded(grade, frame)
    back = learning.group_means(plus_, "stuff_plus", ["pitcher", "season", "pitch_type"], 10).agg(F.avg("mean"), F.stddev_samp("mean")).collect()[0]
    assert back[0] == pytest.approx(100) and back[1] == pytest.approx(10)
    assert metrics.aggregate_correlation(plus_, "stuff_plus", "rv_pitcher", ["pitcher", "pitch_type"], 10).collect()[0].spearman > 0.5
    assert metrics.stability(plus_, "stuff_plus", "rv_pitcher", 5, 5).columns == ["season", "entities", "grade_yoy", "own_rv_yoy"]
    table = metrics.predictive_validity(plus_, "stuff_plus", "rv_pitcher", 5, 5)
    got = [r.grade_vs_next for r in table.collect()]
    assert got and metrics.mean_correlations(table).collect()[0].grade_vs_next == pytest.approx(sum(got) / len(got))
    with pytest.raises(ValueError):
        heads.pitch_quality("stuff", frame, None, QUICK, least=10**6)


# --- maps of repertoires ---


def repertoires(spark):
    """Three kinds of pitcher over two seasons."""
    rng, rows = np.random.default_rng(4), []
    for p in range(24):
        kind = p % 3
        for season in (2023, 2024):
            for c, (label, velo, use) in enumerate(((("FF", 96, 60), ("SL", 88, 40)), (("SI", 91, 55), ("CH", 83, 45)), (("FC", 88, 50), ("CU", 76, 50)))[kind]):
                rows.append((p, season, c, label, 100, use + float(rng.normal(0, 1)), velo + float(rng.normal(0, 0.3)), 10.0 * (kind + c), 5.0 * kind, 90.0 + 30 * kind, 2, 2, 0, 1.0))
    return spark.createDataFrame(rows, "mlbam_id long, season int, cluster_id int, label string, n long, usage_pct double, velo_avg double, ivb_in double, hb_arm_in double, spin_axis_arm_deg double, cluster_k int, savant_pitch_types int, arsenal_size_diff int, season_purity double")


def test_embedding(spark):
    clusters = repertoires(spark)
    rows, scores = marts.arsenal_embedding(spark, clusters, reducer="pca")
    got = rows.collect()
    assert len(got) == 48 and [k for k, _ in scores] == list(range(4, 13)) and {r.primary_label for r in got} <= {"FF", "SI", "FC", "CU"}
    names = {r.archetype_id: r.archetype_label for r in got}
    assert len(set(names.values())) == len(names) and all(" · " in n for n in names.values())
    vectors = marts.encoded(clusters)
    assert len(vectors.collect()[0].vector) == 36
    near = marts.arsenal_neighbors(spark, vectors, 3).collect()
    assert len(near) == 48 * 3 and all(r.mlbam_id % 3 == r.neighbor_id % 3 for r in near) and not [r for r in near if (r.mlbam_id, r.season) == (r.neighbor_id, r.neighbor_season)]
    spot = marts.spot_check(rows, 4).collect()
    assert len(spot) == 5 and all(r.mlbam_id % 3 == 1 for r in spot)
    table = marts.bake_off(spark, clusters, ("pca",))
    assert [t["encoding"] for t in table] == ["slot", "histogram"] and all(t["trustworthiness"] > 0.7 and t["yoy_neighbor_rank"] < 0.5 for t in table)
    assert marts.cluster_stability(clusters).collect()[0].pairs == 24
    players = spark.createDataFrame([(p, f"P{p}") for p in range(24)], "mlbam_id long, full_name string")
    told = api.similar(marts.arsenal_neighbors(spark, vectors, 3), rows, players, 4, 2024).collect()
    assert [r["rank"] for r in told] == [1, 2, 3] and all(r.full_name == f"P{r.neighbor_id}" and r.archetype_label for r in told)
    centres = api.archetype_centroids(rows).collect()
    assert sum(c.n for c in centres) == 48 and api.embedding(rows, 2024, 1).count() == 24
    assert api.cluster_detail(clusters, 4).collect()[0].season == 2024
    with pytest.raises(NotImplementedError):
        encodings.reduced(spark, vectors, marts.SEASON, "umap")
    with pytest.raises(ValueError):
        marts.encoded(clusters, "other")


def test_tsne_and_trustworthiness():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (25, 6)) for c in (0, 5, 10)])
    y = encodings.tsne(x, perplexity=8)
    own = np.repeat(np.arange(3), 25)
    d = neighbors.distances(y)
    np.fill_diagonal(d, np.inf)
    assert (own[d.argmin(axis=1)] == own).mean() > 0.95
    assert neighbors.trustworthiness(x, x, 5) == 1.0 > neighbors.trustworthiness(x, rng.normal(size=(75, 2)), 5) > 0
    # by the definition, on a few points
    a, b, k, n = x[:9], rng.normal(size=(9, 2)), 2, 9
    far, near = neighbors.distances(a), neighbors.distances(b)
    lost = 0
    for i in range(n):
        rank = {j: r for r, j in enumerate(sorted((j for j in range(n) if j != i), key=lambda j: far[i, j]), 1)}
        lost += sum(max(0, rank[j] - k) for j in sorted((j for j in range(n) if j != i), key=lambda j: near[i, j])[:k])
    assert neighbors.trustworthiness(a, b, k) == pytest.approx(1 - 2 * lost / (n * k * (2 * n - 3 * k - 1)))


def test_archetype_names(spark):
    members = spark.createDataFrame([(0, "FF", "SL", 96.0), (0, "FF", "CH", 97.0), (0, "SI", "CH", 96.0), (1, "FF", "CH", 95.5), (2, "SI", None, 88.0), (3, "FF", "CH", 98.0)], "archetype_id int, primary_label string, secondary_label string, primary_velo double")
    got = {r.archetype_id: r.archetype_label for r in encodings.archetype_names(members).collect()}
    assert got == {3: "FF/CH · 95-98", 0: "FF/CH · 95-98-2", 1: "FF/CH · 95-98-3", 2: "SI · 80s-"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=15), st.integers(1, 5))
def test_best_of_is_exact(rows, k):
    x, own = np.array(rows, dtype=float), np.arange(len(rows))
    got = neighbors.best_of(x, own.tolist(), x, own, k)
    for i in own:
        want = sorted((math.dist(x[i], x[j]), j) for j in own if j != i)[:k]
        mine = got[got.q == i]
        assert [(d, n) for d, n in zip(mine.d, mine.n, strict=True)] == [(pytest.approx(d), n) for d, n in want]


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    out = neighbors.nearest(spark, df, "id", "v", 4, block=16).collect()
    d = neighbors.distances(x)
    np.fill_diagonal(d, np.inf)
    assert {(r.id, r["rank"]): r.neighbor for r in out} == {(i, k + 1): int(j) for i in range(70) for k, j in enumerate(d[i].argsort()[:4])}
    assert neighbors.nearest(spark, df, "id", "v", 4, df.limit(0)).count() == 0


# --- query surface ---


def test_api_errors_and_answers(spark, pitches):
    with pytest.raises(api.MissingTable):
        api.need({}, "mart_batter_spray")
    told = api.health({"fact_pitch": pitches})
    assert told["tables"]["fact_pitch"] and not told["tables"]["dim_team"] and told["pitches"] == 10000
    with pytest.raises(ValueError):
        api.search(synthetic.players(spark), "full_name", "P")
    with pytest.raises(ValueError):
        api.pitch_rows(pitches)
    with pytest.raises(LookupError):
        api.trajectory(pitches, 1, 1, 999)
    with pytest.raises(LookupError):
        api.player_ids(synthetic.players(spark), 13)
    with pytest.raises(ValueError):
        api.league_shapes(pitches, "X")
    grids = marts.zone_profiles(pitches.filter("pitcher < 103"), "pitcher", dict(api.ZONE, min_rows=50))
    listed = api.available_grids(grids, 100).collect()
    assert {(r.role, r.metric) for r in listed} == {("pitcher", m) for m in marts.ZONE_METRICS} and [r.season for r in listed] == sorted((r.season for r in listed), reverse=True)
    assert api.latest_grid(grids, 100, "pitcher", "whiff").collect()[0].season == listed[0].season
    with pytest.raises(ValueError):
        api.latest_grid(grids, 100, "coach", "whiff")
    with pytest.raises(LookupError):
        api.spray_contour(marts.batter_spray(pitches, dict(api.SPRAY, min_rows=10**6)), 505)
    framing = spark.createDataFrame([(7, 2023, 1.0, 600), (7, 2024, 2.0, 700)], "mlbam_id long, season int, framing_runs double, n long")
    assert [r.season for r in api.catcher_detail(framing, 7).collect()] == [2024, 2023]
    with pytest.raises(LookupError):
        api.catcher_detail(framing, 8)
    swing = spark.createDataFrame([(7, 2023, 1.0, None, 3.0, 300)], "mlbam_id long, season int, whiff_plane_value_per_100 double, contact_plane_value_per_100 double, attack_angle double, whiff_swings long")
    assert api.swing_detail(swing, 7).count() == 1 and api.swing_leaders(swing, synthetic.players(spark)).collect()[0].full_name == "Player 7"
    with pytest.raises(ValueError):
        api.swing_leaders(swing, synthetic.players(spark), sort="mlbam_id")
    stuff = spark.createDataFrame([(7, 2024, "FF", 101.0, 60), (7, 2024, "ALL", 99.0, 90), (7, 2024, "SL", 95.0, 30)], "mlbam_id long, season int, pitch_type string, stuff_plus double, pitches long")
    assert [r.pitch_type for r in api.stuff_detail(stuff, 7).collect()] == ["ALL", "FF", "SL"]
    body, head = api.arrow_response(pitches.limit(3).select("event_id"), True)
    assert head["X-Row-Count"] == "3" and len(body) > 0 and api.grid_extent("spray")["grid_n"] == 60 and len(api.json_rows(pitches.limit(2).select("event_id"))) == 2


def test_null_entities_make_no_grid(spark):
    rng = random.Random(3)
    rows = [(1 if i < 600 else None, 2024, rng.gauss(0, 0.4), rng.gauss(0.5, 0.3), 1.0) for i in range(3000)]
    out = marts.entity_grids(spark.createDataFrame(rows, "who long, season int, plate_x double, plate_z_norm double, w double"), "who", "umpire", "m", F.col("w"), 500).collect()
    assert [(r.mlbam_id, r.n_pitches, r.role, r.metric) for r in out] == [(1, 600, "umpire", "m")]


# --- splits, sets ---


def test_splits(spark, pitches):
    a = splits.auto(pitches, features=False)
    assert {n: [r[0] for r in p.select("season").distinct().collect()] for n, p in a.parts().items()} == {"train": [2023], "valid": [2024], "test": [2025]}
    d = splits.auto(pitches.filter("season > 2023"), features=False)
    assert sum(p.count() for p in d.parts().values()) == pitches.filter("season > 2023").count()
    h = splits.by_entity(pitches)
    ids = [{r[0] for r in p.select("pitcher").distinct().collect()} for p in h.parts().values()]
    assert not ids[0] & ids[1] and not ids[1] & ids[2] and not ids[0] & ids[2] and len(set.union(*ids)) == 16
    with pytest.raises(ValueError, match="ends"):
        splits.check(splits.Split(a.valid, a.train, a.test), False)
    with pytest.raises(ValueError, match="two parts"):
        splits.check(splits.Split(a.train.filter("pitch_number < 3").withColumn("game_date", F.date_sub("game_date", 1000)), a.train.filter("pitch_number > 2"), a.test.limit(0)), False)
    with pytest.raises(ValueError, match="missing"):
        splits.check(a)
    empty = splits.by_date(pitches.limit(0))
    assert empty.train.count() == 0
    some = [r.event_id for r in splits.subsample(pitches, "event_id", 50).collect()]
    assert len(set(some)) == 50 and some == [r.event_id for r in splits.subsample(pitches.repartition(3), "event_id", 50).collect()]
    assert E.without_scratch(pitches.withColumn("_x", F.lit(1))).columns == pitches.columns


def test_plus_scale_and_repertoire(spark):
    df = spark.createDataFrame([(g, float(g)) for g in range(30) for _ in range(100)], "g int, v double")
    mean, sd = learning.plus_scale(df, "v", ["g"])
    assert mean == pytest.approx(14.5) and sd == pytest.approx(np.std(np.arange(30), ddof=1))
    assert learning.plus_scale(df.withColumn("v", F.lit(3.0)), "v", ["g"]) == (3.0, 1.0)
    with pytest.raises(ValueError):
        learning.plus_scale(df.filter("g < 29"), "v", ["g"])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=2, max_size=10))
def test_auc_of_one_group_equals_auc_by_keys(spark, rows):
    df = spark.createDataFrame([(1, float(s), p) for s, p in rows], "g int, s double, p boolean")
    for ties in ("average", "low"):
        a, b = windows.rank_auc(df, [], "s", "p", ties).collect()[0], windows.rank_auc(df, ["g"], "s", "p", ties).collect()[0]
        assert a.n == b.n and (a.auc == b.auc or a.auc == pytest.approx(b.auc))


# --- sources ---


def test_files_of_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿game_pk,pitch_number,release_speed\n1,1,95.5\n2,1,NA\n", encoding="utf-8")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("release_speed,game_pk,new_column\n88.5,3,x\n")
    (tmp_path / "c.csv").write_text("")
    df = readers.read_pitches(spark, str(tmp_path))
    rows = {r.game_pk: r for r in df.collect()}
    assert rows[1].release_speed == 95.5 and rows[2].release_speed is None and rows[3].release_speed == 88.5 and rows[3].new_column == "x" and rows[3].pitch_number is None and len(rows) == 3
    assert readers.read_pitches(spark, str(tmp_path / "c.csv")).count() == 0
    path, digest = readers.land(spark, str(tmp_path / "raw" / "d.csv.gz"), b"a,b\n1,2\n")
    assert digest == readers.sha256_bytes(b"a,b\n1,2\n") and readers.land(spark, path, b"other") == (path, digest)


def test_crosswalk(spark, tmp_path):
    register = spark.createDataFrame([(1, "f1", None, None), (1, "f1", "b1", None), (2, None, None, "r2")], "key_mlbam long, key_fangraphs string, key_bbref string, key_retro string")
    none = readers.read_overrides(spark, str(tmp_path / "none.csv"))
    assert none.count() == 0 and dict(none.dtypes)["key_mlbam"] == "bigint"
    (tmp_path / "o.csv").write_text("key_mlbam,key_fangraphs\n2,f2\n")
    out = {r.mlbam_id: r for r in readers.crosswalk(register, readers.read_overrides(spark, str(tmp_path / "o.csv"))).collect()}
    assert out[1].key_bbref == "b1" and (out[2].key_fangraphs, out[2].key_retro) == ("f2", "r2")


def test_rest_answers(spark):
    asked = []

    def get(path, params):
        asked.append((path, params))
        if path == "people":
            return {"people": [{"id": int(i), "fullName": f"N{i}", "batSide": {"code": "L"}, "birthDate": "1990-13-01" if i == "1" else "1990-12-01"} for i in params["personIds"].split(",")]}
        if path == "schedule":
            return {"dates": [{"games": [{"gamePk": 5, "season": "2024", "officialDate": "2024-08-03", "teams": {"home": {"team": {"id": 9}, "score": 3}}}]}, {}]}
        return {"officials": [{"official": {"id": 3, "fullName": "U"}, "officialType": "Home Plate"}]} if "boxscore" in path else {"teams": [{"id": 9, "name": "T", "league": {"name": "L"}}]}

    client = rest.Client(get)
    people = rest.people(rest.documents(spark, client.people(range(200)))).collect()
    assert [len(p["personIds"].split(",")) for _, p in asked] == [90, 90, 20] and len(people) == 200
    assert people[1].birth_date is None and people[2].birth_date == dt.date(1990, 12, 1) and people[2].bats == "L" and people[2].throws is None
    g = rest.games(rest.documents(spark, client.schedule(2024))).collect()[0]
    assert (g.game_pk, g.season, g.home_team_id, g.home_score, g.away_score, g.game_date) == (5, 2024, 9, 3, None, dt.date(2024, 8, 3))
    assert rest.teams(rest.documents(spark, client.teams(2024))).collect()[0].league == "L"
    docs = rest.documents(spark, [{"gamePk": 4}, client.game_officials(5)])
    o = {r.game_pk: r for r in rest.officials(docs, ("home_plate", "first_base")).collect()}
    assert (o[5].umpire_home_plate_id, o[5].umpire_home_plate_name, o[5].umpire_first_base_id) == (3, "U", None) and o[4].umpire_home_plate_id is None
    assert rest.games(rest.documents(spark, [])).count() == 0


def test_fetch_retries_broken_connections():
    bucket, slept, answers = ingest.TokenBucket(1000.0), [], [OSError("reset"), (503, {"Retry-After": "1.5"}, b""), (200, {}, b"ok")]

    def get(_):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert ingest.fetch(get, "u", bucket, sleep=slept.append) == b"ok" and slept[1] == 1.5 and 1 <= slept[0] <= 2
    with pytest.raises(OSError, match="404"):
        ingest.fetch(lambda _: (404, {}, b""), "u", bucket, sleep=slept.append)
    with pytest.raises(OSError, match="reset"):
        ingest.fetch(lambda _: (_ for _ in ()).throw(OSError("reset")), "u", bucket, tries=2, sleep=slept.append)
    p = ingest.pitch_parameters(dt.date(2024, 8, 3), dt.date(2024, 8, 3), "SEA")
    assert p["hfSea"] == "2024|" and p["hfTeam"] == "SEA|" and "hfTeam" not in ingest.pitch_parameters(dt.date(2024, 8, 3), dt.date(2024, 8, 3))


def test_catalog_and_manifest(spark, tmp_path):
    c = readers.Catalog(spark, str(tmp_path), {"t": "t", "gone": "gone"})
    c.write("t", spark.createDataFrame([(1, "a")], "x long, y string"))
    c.write("t", spark.createDataFrame([("b", 2)], "y string, x int"), "append")
    assert sorted(tuple(r) for r in c.table("t").collect()) == [(1, "a"), (2, "b")] and c.try_register("t") and not c.try_register("gone")
    with pytest.raises(ValueError):
        c.write("t", spark.createDataFrame([(1,)], "z long"), "append")
    assert c.drop(["t", "gone"]) == ["t"] and not c.exists("t")
    m = ingest.Manifest(str(tmp_path / "m.db"))
    m.record("p", "d1", "ok", 5)
    m.record("p", "d2", "failed", error="x")
    runs = m.frame(spark)
    assert {(r.status, r.parts, r.rows) for r in ingest.run_summary(runs).collect()} == {("ok", 1, 5), ("failed", 1, 0)} and ingest.run_failures(runs).collect()[0].error == "x"


# --- streams ---


def test_running_priors_in_small_frames_and_batches(spark, tmp_path):
    """Shuffled rows, frames of three rows, several micro-batches: equal to the window over all."""
    rng, rows = random.Random(6), []
    for i in range(200):
        rows.append((i, i % 4, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * (i // 3)), rng.choice(["purchase", "view", None])))
    folder = tmp_path / "in"
    for k in range(4):
        part = rows[k * 50 : (k + 1) * 50]
        rng.shuffle(part)
        spark.createDataFrame(part, "event_id long, user_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(folder / f"p{k}"))
    stream = lambda: spark.readStream.schema("event_id long, user_id long, ts timestamp, event_type string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    want, before = {}, {}
    for i, u, t, e in sorted(rows, key=lambda r: (r[2], r[0])):
        h = before.setdefault(u, [])
        want[i] = (len(h), h.count("purchase"), h[-1] if h else None)
        h.append(e)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.event_id: (r.seen, r.prior_purchases, r.prev_type) for r in ev.drained(ev.running_priors(stream()), "append").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want
    out = str(tmp_path / "out")
    q = stream().writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    q = q.foreachBatch(ev.running_priors_by_batch(stream(), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"))).start()
    q.awaitTermination()
    assert {r.event_id: (r.seen, r.prior_purchases, r.prev_type) for r in spark.read.parquet(f"{out}/*").collect()} == want


def test_late_revisions_replace_rows(spark, tmp_path):
    write = ev.upsert_sink(str(tmp_path / "t"), ["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)  # a batch that is tried again
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t" / "1")).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert ev.latest_version(spark, str(tmp_path / "t")) == 1 and ev.latest_version(spark, str(tmp_path / "none")) is None


# --- settings and command line ---


def test_settings():
    s = Settings.load({"MW_DATA_ROOT": "/d", "MW_PITCH_RPS": "0.5"}, season_start=2020)
    assert (s.lake, s.pitch_rps, s.seasons(dt.date(2022, 2, 1))) == ("/d/lake", 0.5, [2020, 2021]) and s.current_season(dt.date(2022, 3, 1)) == 2022
    with pytest.raises(NotImplementedError):
        Settings.load({"MW_BACKEND": "postgres"})
    with pytest.raises(ValueError):
        Settings.load({"MW_REFRESH_DAYS": "x"})


def test_workspace_and_command_line(spark, tmp_path, capsys, pitches):
    work = Workspace(spark, Settings.load({}, data_root=str(tmp_path)))
    raw = synthetic.pitches(spark, "/root/testdata/sf0.001").drop("event_id")
    raw.coalesce(2).write.option("header", True).csv(str(tmp_path / "raw/pitches/day1"))
    raw.limit(50).coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "raw/pitches/day2"))
    assert cli.main(["status"], work) == 0 and '"fact_pitch": null' in capsys.readouterr().out
    assert cli.main(["build", "pitches"], work) == 0 and work.fact().count() == 1000
    assert cli.main(["build", "marts"], work) == 0 and work.catalog.exists("mart_pitcher_arsenal")
    assert cli.main(["build", "register"], work) == 0 and spark.sql("select count(*) from mart_pitcher_arsenal").collect()[0][0] > 0
    assert cli.main(["check"], work) == 1 and "ok: primary_key_unique" in capsys.readouterr().out
    assert cli.main(["models"], work) == 0 and cli.main(["config"], work) == 0 and str(tmp_path) in capsys.readouterr().out
    assert cli.main(["fly"], work) == 2 and cli.main(["ingest", "pitches", "--manifest", str(tmp_path / "m.db")], work) == 2
    args = ["--manifest", str(tmp_path / "m.db"), "--start", "2024-04-01", "--end", "2024-04-03", "--loader", "math:isnan"]
    assert cli.main(["ingest", "pitches", *args], work) == 0 and "'failed': 3" in capsys.readouterr().out
    assert cli.main(["ingest", "status", *args], work) == 0 and "failed" in capsys.readouterr().out
    client = rest.Client(lambda path, params: {"people": [{"id": int(i), "fullName": i} for i in params["personIds"].split(",")]} if path == "people" else {})
    assert work.dims(client, 2024)["people"] > 20
    assert cli.main(["clean"], work) == 0 and not work.catalog.exists("fact_pitch") and (tmp_path / "raw").exists()
    with pytest.raises(LookupError):
        work.mart_swing()


def test_geometry_queries(spark):
    view = geometry.fitted_view(spark.createDataFrame([(0.0, 0.0), (10.0, 4.0)], "x double, y double"), "x", "y", 100.0, 100.0, 0.0).collect()[0]
    assert (view.centre_x, view.centre_y, view.scale) == (5.0, 2.0, 10.0)
    assert len(geometry.PARKS) == 30 and geometry.parks(spark).count() == 30
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c")], "k int, t string")
    got = {r.k: r for r in relops.purity(rows, ["k"], "t").collect()}
    assert got[1].label == "b" and got[1].purity == pytest.approx(2 / 3) and got[2].whole_purity == pytest.approx(0.75)


def test_run_value_of_the_synthetic_table(pitches):
    model = RunValue.fit(pitches)
    assert set(model.count_re) <= {f"{b}-{s}" for b in range(4) for s in range(3)} and model.n_fit > 1500

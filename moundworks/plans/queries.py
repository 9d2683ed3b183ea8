"""One query for each operator family over the driver's tables, each beside the SQL that must give the same rows.

Roles: l_suppkey is the entity, the ship year its season, l_returnflag the kind, l_linestatus 'O' a hit; events (user, time,
type, value) are the sequence; embeddings are the feature matrix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import encodings, geometry, grid, learning, metrics, neighbors, quality, relops, run_value, windows
from ..streaming import events as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("season", F.year("l_shipdate"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


ARSENAL = """
WITH agg AS (SELECT l_suppkey, {grain} AS season, l_returnflag AS kind, count(*) AS n, avg(l_quantity) AS avg_qty, max(l_quantity) AS max_qty,
  stddev_samp(l_extendedprice) AS sd_price, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  CAST(sum(CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM lineitem GROUP BY 1, 2, 3),
shared AS (SELECT *, CAST(100 AS DOUBLE) * n / sum(n) OVER (PARTITION BY l_suppkey, season) AS usage_pct,
  CASE WHEN hits = 0 THEN NULL ELSE CAST(100 AS DOUBLE) * big / hits END AS big_pct FROM agg),
first AS (SELECT l_suppkey, season, avg_qty AS fb_qty FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, season
  ORDER BY CASE kind WHEN 'A' THEN 0 WHEN 'N' THEN 0 ELSE 1 END, n DESC, kind) AS rn FROM agg) WHERE rn = 1)
SELECT s.*, fb_qty, avg_qty - fb_qty AS qty_diff, CASE WHEN n >= {shown} THEN percent_rank() OVER (PARTITION BY season, kind ORDER BY avg_qty NULLS LAST) END AS qty_pctile,
  CASE WHEN n >= {shown} THEN percent_rank() OVER (PARTITION BY season, kind ORDER BY big_pct NULLS LAST) END AS big_pctile
FROM shared s LEFT JOIN first USING (l_suppkey, season)"""


def _arsenal(rows: DataFrame, shown: int) -> DataFrame:
    hit = F.col("l_linestatus") == "O"
    agg = rows.groupBy("l_suppkey", "season", F.col("l_returnflag").alias("kind")).agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("avg_qty"), F.max("l_quantity").alias("max_qty"), F.stddev_samp("l_extendedprice").alias("sd_price"), F.count_if(hit).alias("hits"), F.count_if(hit & (F.col("l_quantity") > 25)).alias("big")
    )
    shared = agg.withColumn("usage_pct", windows.share_of_total(F.col("n"), ["l_suppkey", "season"])).withColumn("big_pct", E.percent(F.col("big"), F.col("hits")))
    first = windows.first_by_priority(agg, ["l_suppkey", "season"], F.when(F.col("kind").isin("A", "N"), 0).otherwise(1), "n", "kind").select("l_suppkey", "season", F.col("avg_qty").alias("fb_qty"))
    enough = F.col("n") >= shown
    return shared.join(first, ["l_suppkey", "season"], "left").withColumns({
        "qty_diff": F.col("avg_qty") - F.col("fb_qty"), "qty_pctile": windows.masked_percent_rank("avg_qty", ["season", "kind"], enough),
        "big_pctile": windows.masked_percent_rank("big_pct", ["season", "kind"], enough),
    })


@query(ARSENAL.format(grain="year(l_shipdate)", shown=50))
def arsenal_mart(spark, sf):
    return _arsenal(lines(spark, sf), 50)


@query(ARSENAL.format(grain="year(l_shipdate) * 100 + month(l_shipdate)", shown=2))
def arsenal_mart_sparse(spark, sf):
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long")
    return _arsenal(table(spark, sf, "lineitem").withColumn("season", month), 2)


@query("""SELECT event_id, user_id, CAST(row_number() OVER w - 1 AS BIGINT) AS seen, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER p, 0) AS BIGINT) AS purchases,
  CASE WHEN row_number() OVER w > 1 THEN coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER p, 0) / CAST(row_number() OVER w - 1 AS DOUBLE) END AS error_rate,
  coalesce(sum(value) OVER p, 0) AS value_before FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_priors(spark, sf):
    w = windows.over(["user_id"], "ts", "event_id")
    one = F.lit(1)
    return events(spark, sf).select("event_id", "user_id", windows.ordinal(w).cast("long").alias("seen"), windows.prior_sum((F.col("event_type") == "purchase").cast("int"), w).cast("long").alias("purchases"), windows.prior_rate((F.col("event_type") == "error").cast("int"), one, w).alias("error_rate"), windows.prior_sum(F.col("value"), w).alias("value_before"))


@query("""SELECT event_id, lag(event_type) OVER w AS prev_event_type_1, lag(event_type, 2) OVER w AS prev_event_type_2, lag(event_type, 3) OVER w AS prev_event_type_3,
  lead(event_type) OVER w AS next_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def sequence_lags(spark, sf):
    w = windows.over(["user_id"], "ts", "event_id")
    return events(spark, sf).select("event_id", *windows.lags("event_type", w, 3), F.lead("event_type").over(w).alias("next_type"), F.lead(F.lit(1)).over(w).isNull().alias("is_last"))


RUN_VALUE = """
WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), c AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER p, 0) AS b,
  coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER p, 0) AS s FROM e WINDOW p AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT user_id, day, event_id, event_type, value, ts, CAST(least(b, 3) AS VARCHAR) || '-' || CAST(least(s, 2) AS VARCHAR) AS cnt,
  row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1 AS is_last FROM c),
w AS (SELECT event_type, avg(value) AS w FROM k WHERE is_last GROUP BY 1), t AS (SELECT user_id, day, w AS terminal FROM k JOIN w USING (event_type) WHERE is_last),
r AS (SELECT cnt, avg(terminal) AS re FROM (SELECT DISTINCT user_id, day, cnt, terminal FROM k JOIN t USING (user_id, day) WHERE terminal IS NOT NULL) GROUP BY 1)"""


def _run_values(spark, sf):
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    w = windows.over(["user_id", "day"], "ts", "event_id")
    b, s = (windows.prior_sum((F.col("event_type") == t).cast("int"), w) for t in ("error", "click"))
    return run_value.run_values(e.withColumn("cnt", E.count_key(b, s)), ["user_id", "day"], ["ts", "event_id"], "cnt", "value", "event_type")


@query(RUN_VALUE + " SELECT * FROM r")
def run_value_fit(spark, sf):
    return _run_values(spark, sf).groupBy("cnt").agg(F.any_value("re", True).alias("re"))


@query(RUN_VALUE + """, n AS (SELECT *, lead(cnt) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS nxt FROM k)
SELECT event_id, n.cnt, CASE WHEN is_last THEN terminal ELSE r2.re END - r1.re AS rv_batting FROM n LEFT JOIN t USING (user_id, day) LEFT JOIN r r1 ON n.cnt = r1.cnt LEFT JOIN r r2 ON n.nxt = r2.cnt""")
def run_value_attach(spark, sf):
    return _run_values(spark, sf).select("event_id", "cnt", "rv_batting")


@query("""SELECT l_suppkey, season, kind, n, qty, CAST(100 AS DOUBLE) * n / max(CASE WHEN kind = 'ALL' THEN n END) OVER (PARTITION BY l_suppkey, season) AS usage_pct FROM (
  SELECT l_suppkey, year(l_shipdate) AS season, l_returnflag AS kind, count(*) AS n, avg(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3
  UNION ALL SELECT l_suppkey, year(l_shipdate), 'ALL', count(*), avg(l_quantity) FROM lineitem GROUP BY 1, 2)""")
def rollup_all(spark, sf):
    rows = relops.rollup_all(lines(spark, sf).withColumnRenamed("l_returnflag", "kind"), ["l_suppkey", "season"], "kind", [F.count("*").alias("n"), F.avg("l_quantity").alias("qty")])
    return rows.withColumn("usage_pct", windows.share_of_row("n", F.col("kind") == "ALL", ["l_suppkey", "season"]))


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1")
def dedupe_first(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h"))
    return rows.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT l_orderkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_suppkey, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def keep_first_row(spark, sf):
    return relops.keep_first(table(spark, sf, "lineitem"), ["l_orderkey"], F.desc("l_quantity"), F.desc("l_extendedprice"), "l_suppkey", "l_partkey").select("l_orderkey", "l_suppkey", "l_quantity")


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END) + (CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END) DESC, c_custkey) AS rn FROM customer) WHERE rn = 1")
def completeness_dedupe(spark, sf):
    c = table(spark, sf, "customer").withColumns({"a": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "b": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))})
    return relops.most_complete(c, ["c_nationkey"], ["a", "b"], F.col("c_custkey")).select("c_nationkey", "c_custkey")


@query("SELECT nullif(l_linenumber, 1) AS k, count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 1) IS NOT NULL GROUP BY 1 HAVING count(*) >= 100")
def null_group_exclusion(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("k", F.nullif(F.col("l_linenumber"), F.lit(1)))
    return relops.qualified(rows, ["k"], 100).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf):
    return relops.unmatched(table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def ref_integrity(spark, sf):
    return relops.unmatched(table(spark, sf, "lineitem"), table(spark, sf, "part").filter("p_size <= 40"), "l_partkey", "p_partkey")


YOY = "WITH y AS (SELECT l_suppkey, year(l_shipdate) AS season, avg(l_quantity) AS qty FROM lineitem GROUP BY 1, 2), p AS (SELECT a.l_suppkey, a.season, a.qty, b.qty AS qty_prev FROM y a JOIN y b ON a.l_suppkey = b.l_suppkey AND a.season = b.season + 1)"


def _yoy(spark, sf):
    return relops.consecutive(lines(spark, sf).groupBy("l_suppkey", "season").agg(F.avg("l_quantity").alias("qty")), "l_suppkey", "season", ["qty"])


@query(YOY + " SELECT * FROM p")
def yoy_pairs(spark, sf):
    return _yoy(spark, sf)


@query(YOY + """, r AS (SELECT season, rank() OVER (PARTITION BY season ORDER BY qty) + (count(*) OVER (PARTITION BY season, qty) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY season ORDER BY qty_prev) + (count(*) OVER (PARTITION BY season, qty_prev) - 1) / 2.0 AS y FROM p)
  SELECT season, count(*) AS n, round(corr(x, y), 9) AS spearman FROM r GROUP BY season""")
def yoy_spearman(spark, sf):
    return windows.spearman(_yoy(spark, sf), ["season"], "qty", "qty_prev").withColumn("spearman", F.round("spearman", 9))


SCORED = "WITH s AS (SELECT doc_id, n_chars / (n_chars + CAST(2000 AS DOUBLE)) AS p, quality = 1 AS y FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf):
    p = F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", p.alias("p"), (F.col("quality") == 1).alias("y"))


@query(SCORED + """, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s)
  SELECT count(*) AS n, round((sum(CASE WHEN y THEN r END) - count_if(y) * (count_if(y) + 1) / 2.0) / (count_if(y) * (count(*) - count_if(y))), 9) AS auc FROM r""")
def rank_auc(spark, sf):
    return windows.rank_auc(_scored(spark, sf), [], "p", "y").select("n", F.round("auc", 9).alias("auc"))


@query(SCORED.replace("n_chars / (n_chars + CAST(2000 AS DOUBLE))", "floor(n_chars / CAST(500 AS DOUBLE))") + " SELECT (SELECT count(*) FROM s) AS n, round(sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE ELSE 0 END) / count(*), 9) AS auc FROM s a JOIN s b ON a.y AND NOT b.y")
def rank_auc_without_ties(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.floor(F.col("n_chars") / 500).alias("p"), (F.col("quality") == 1).alias("y"))
    return windows.rank_auc(rows, [], "p", "y", "low").select("n", F.round("auc", 9).alias("auc"))


@query(SCORED + " SELECT CAST(ceil(p * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, avg(CASE WHEN y THEN 1.0::DOUBLE ELSE 0 END) AS mean_y FROM s WHERE p > 0 GROUP BY 1")
def ece_bins(spark, sf):
    return metrics.calibration(_scored(spark, sf), "p", "y").withColumn("mean_p", F.round("mean_p", 9))


@query(SCORED + " SELECT count(*) AS n, round(avg(-(CASE WHEN y THEN ln(p) ELSE ln(1 - p) END)), 9) AS log_loss, round(avg((p - CASE WHEN y THEN 1 ELSE 0 END) ** 2), 9) AS brier FROM s")
def log_loss(spark, sf):
    return metrics.binary_report(_scored(spark, sf), "p", "y").select("n", F.round("log_loss", 9).alias("log_loss"), F.round("brier", 9).alias("brier"))


SMALL = {"x": (0.0, 50.0, 12), "y": (0.0, 0.1, 8), "sigma": (1.5, 1.0), "enough": 25.0, "min_rows": 0}


def _values(n, sigma):
    return ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, j, w in grid.folded_kernel(n, sigma))


GRID = f"""WITH kx(i, ci, w) AS (VALUES {_values(12, 1.5)}), ky(j, cj, w) AS (VALUES {_values(8, 1.0)}),
  h AS (SELECT l_returnflag, CAST(least(11, floor(l_quantity / (50.0::DOUBLE / 12))) AS INTEGER) AS ci, CAST(least(7, floor(l_discount / (0.1::DOUBLE / 8))) AS INTEGER) AS cj, sum(l_extendedprice) AS v, count(*) AS c FROM lineitem GROUP BY 1, 2, 3),
  a AS (SELECT l_returnflag, kx.i, cj, sum(w * v) AS v, sum(w * c) AS c FROM h JOIN kx USING (ci) GROUP BY 1, 2, 3),
  g AS (SELECT l_returnflag, a.i, ky.j, sum(w * v) / sum(w * c) AS surface, sum(w * c) * 2 * pi() * 1.5 AS reliability FROM a JOIN ky USING (cj) GROUP BY 1, 2, 3)"""


def _grid(spark, sf):
    return grid.smooth_arrays(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice", SMALL)


@query(GRID + " SELECT l_returnflag, i, j, round(surface, 4) AS surface, round(reliability, 4) AS reliability FROM g")
def zone_grid(spark, sf):
    cells = grid.grid_cells(_grid(spark, sf), ["l_returnflag"])
    return cells.select("l_returnflag", "i", "j", F.round("surface", 4).alias("surface"), F.round("reliability", 4).alias("reliability"))


@query("SELECT l_returnflag, CAST(least(11, floor(l_quantity / (50.0::DOUBLE / 12))) AS INTEGER) AS i, CAST(least(7, floor(l_discount / (0.1::DOUBLE / 8))) AS INTEGER) AS j, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def grid_cells(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", grid.cell("l_quantity", *SMALL["x"]).alias("i"), grid.cell("l_discount", *SMALL["y"]).alias("j")).agg(F.count("*").alias("n"))


#: Edges by number, as in grid.CROSSED; the SQL names each case's segments by itself.
_POINTS = {0: "i + (53000 - s0) / (s1 - s0), j", 1: "i + 1, j + (53000 - s1) / (s2 - s1)", 2: "i + (53000 - s3) / (s2 - s3), j + 1", 3: "i, j + (53000 - s0) / (s3 - s0)"}
_LINES = {"(1, 14, 5, 10)": (3, 0), "(2, 13)": (0, 1), "(3, 12)": (3, 1), "(4, 11, 5, 10)": (1, 2), "(6, 9)": (0, 2), "(7, 8)": (2, 3)}
CONTOUR = GRID + """, q AS (SELECT l_returnflag, a.i, a.j, a.surface AS s0, b.surface AS s1, c.surface AS s2, d.surface AS s3 FROM g a JOIN g b USING (l_returnflag) JOIN g c USING (l_returnflag) JOIN g d USING (l_returnflag)
  WHERE b.i = a.i + 1 AND b.j = a.j AND c.i = a.i + 1 AND c.j = a.j + 1 AND d.i = a.i AND d.j = a.j + 1),
  k AS (SELECT *, CASE WHEN s0 >= 53000 THEN 1 ELSE 0 END + CASE WHEN s1 >= 53000 THEN 2 ELSE 0 END + CASE WHEN s2 >= 53000 THEN 4 ELSE 0 END + CASE WHEN s3 >= 53000 THEN 8 ELSE 0 END AS code FROM q),
  z(l_returnflag, i, j, x1, y1, x2, y2) AS (""" + " UNION ALL ".join(f"SELECT l_returnflag, i, j, {_POINTS[p]}, {_POINTS[q]} FROM k WHERE code IN {codes}" for codes, (p, q) in _LINES.items()) + ") SELECT l_returnflag, i, j, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM z"


@query(CONTOUR)
def contour_segments(spark, sf):
    lines = grid.contours(_grid(spark, sf), ["l_returnflag"], 53_000.0)
    return lines.withColumns({c: F.round(c, 6) for c in ("x1", "y1", "x2", "y2")})


@query("""WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem), c AS (SELECT CAST(least(19, floor((l_extendedprice - a) / ((b - a) / 20))) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
  SELECT CAST(g AS INTEGER) AS bin, round(a + (b - a) / 20 * g, 6) AS lo, round(a + (b - a) / 20 * (g + 1), 6) AS hi, coalesce(n, 0) AS n FROM e, range(20) r(g) LEFT JOIN c ON c.bin = g""")
def histogram_equal_width(spark, sf):
    return relops.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20).withColumn("lo", F.round("lo", 6)).withColumn("hi", F.round("hi", 6))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id, b.vec_id AS neighbor, list_distance(q.e, b.embedding::DOUBLE[]) AS d FROM q JOIN embeddings b ON q.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor) AS rank FROM d) SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor, round(d, 6) AS distance FROM r WHERE rank <= 10""")
def knn_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return neighbors.nearest(spark, e, "vec_id", "embedding", 10, e.filter("vec_id % 50 = 0")).withColumn("distance", F.round("distance", 6))


@query("""WITH c AS (SELECT user_id, hour(ts) // 6 AS b, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3), s AS (SELECT user_id, b, sum(n) AS t FROM c GROUP BY 1, 2),
  k AS (SELECT event_type, count(*) AS ln FROM events GROUP BY 1), o AS (SELECT user_id, event_type, sum(n) AS o FROM c GROUP BY 1, 2), ot AS (SELECT user_id, sum(n) AS ot FROM c GROUP BY 1)
  SELECT s.user_id, CAST(s.b AS BIGINT) AS b, k.event_type, (coalesce(n, 0) + 1.0::DOUBLE) / (t + (SELECT count(*) FROM k)) AS p, (coalesce(o, 0) + 1.0::DOUBLE) / (ot + (SELECT count(*) FROM k)) AS own_p,
  (ln + 1.0::DOUBLE) / ((SELECT sum(ln) FROM k) + (SELECT count(*) FROM k)) AS league_p FROM s CROSS JOIN k LEFT JOIN c ON c.user_id = s.user_id AND c.b = s.b AND c.event_type = k.event_type LEFT JOIN o ON o.user_id = s.user_id AND o.event_type = k.event_type JOIN ot ON ot.user_id = s.user_id""")
def usage_baseline(spark, sf):
    return learning.usage_baseline(events(spark, sf).withColumn("b", F.floor(F.hour("ts") / 6)), "user_id", "b", "event_type")


_SLOTS = ", ".join(f"coalesce(max(CASE WHEN slot = {k} THEN n END), 0)::DOUBLE, coalesce(max(CASE WHEN slot = {k} THEN qty END), (SELECT avg(qty) FROM a)), coalesce(max(CASE WHEN slot = {k} THEN disc END), (SELECT avg(disc) FROM a))" for k in range(1, 7))


@query(f"""WITH a AS (SELECT l_suppkey, year(l_shipdate) AS season, l_linenumber AS kind, count(*) AS n, avg(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, season ORDER BY n DESC, kind) AS slot FROM a), v AS (SELECT l_suppkey, season, [{_SLOTS}] AS vec FROM r GROUP BY 1, 2),
  e AS (SELECT l_suppkey, season, CAST(p - 1 AS INTEGER) AS i, vec[p] AS x FROM v, range(1, 19) q(p)), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY 1)
  SELECT l_suppkey, season, i, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM e JOIN m USING (i)""")
def slot_encoding(spark, sf):
    kinds = lines(spark, sf).groupBy("l_suppkey", "season", F.col("l_linenumber").alias("kind")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    vectors = encodings.standardised_vectors(encodings.slot_encoding(kinds, ["l_suppkey", "season"], "n", ["qty", "disc"]))
    return vectors.select("l_suppkey", "season", F.posexplode("vector").alias("i", "z")).withColumn("z", F.round("z", 6))


@query("""WITH a AS (SELECT l_suppkey, year(l_shipdate) AS season, l_linenumber AS kind, count(*)::DOUBLE AS n, avg(l_quantity) AS qty, avg(l_extendedprice) - 38000 AS dx, avg(l_quantity) - 25 AS dy FROM lineitem GROUP BY 1, 2, 3),
  c AS (SELECT quantile_cont(qty, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM a),
  h AS (SELECT l_suppkey, season, len(list_filter(q, lambda x: qty >= x)) * 8 + least(7, floor((degrees(atan2(dy, dx)) + 180) / 45)) AS cell, sum(n) AS u FROM a, c GROUP BY 1, 2, 3)
  SELECT l_suppkey, season, CAST(cell AS INTEGER) AS i, u FROM h""")
def histogram_encoding(spark, sf):
    kinds = lines(spark, sf).groupBy("l_suppkey", "season", F.col("l_linenumber").alias("kind")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("qty"), (F.avg("l_extendedprice") - 38000).alias("dx"))
    vectors = encodings.histogram_encoding(kinds, ["l_suppkey", "season"], "n", "qty", F.degrees(F.atan2(F.col("qty") - 25, "dx")))
    return vectors.select("l_suppkey", "season", F.posexplode("vector").alias("i", "u")).filter("u > 0")


@query("SELECT l_suppkey, season, kind AS primary_label, qty AS primary_velo, nxt AS secondary_label FROM (SELECT *, lead(kind) OVER w AS nxt, row_number() OVER w AS rn FROM (SELECT l_suppkey, year(l_shipdate) AS season, l_returnflag AS kind, count(*) AS n, avg(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY l_suppkey, season ORDER BY n DESC, kind)) WHERE rn = 1")
def primary_kind(spark, sf):
    kinds = lines(spark, sf).groupBy("l_suppkey", "season", F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("qty"))
    return encodings.primary_and_secondary(kinds, ["l_suppkey", "season"], "n", "kind", "qty", "kind")


@query("SELECT event_id, lead(event_type) OVER w AS next_type, lead(ts) OVER w IS NULL AS is_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def next_state(spark, sf):
    w = windows.over(["user_id"], "ts", "event_id")
    return events(spark, sf).select("event_id", F.lead("event_type").over(w).alias("next_type"), F.lead(F.lit(1)).over(w).isNull().alias("is_last"))


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS q, avg(l_extendedprice) / 1000 AS p FROM lineitem GROUP BY 1)
  SELECT a.l_suppkey AS l_suppkey_a, b.l_suppkey AS l_suppkey_b, round(sqrt((a.q - b.q) ** 2 + (a.p - b.p) ** 2), 6) AS d FROM s a JOIN s b ON a.l_suppkey < b.l_suppkey""")
def label_pairs(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), (F.avg("l_extendedprice") / 1000).alias("p"))
    both = neighbors.pairs(s, "l_suppkey", ["q", "p"])
    return both.select("l_suppkey_a", "l_suppkey_b", F.round(F.hypot(F.col("q_a") - F.col("q_b"), F.col("p_a") - F.col("p_b")), 6).alias("d"))


@query("""WITH s AS (SELECT l_suppkey, year(l_shipdate) AS season, avg(l_quantity) AS x, avg(l_discount) * 500 AS y FROM lineitem GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM s),
  p AS (SELECT a.l_suppkey, a.season, a.x, a.y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND b.season = a.season + 1),
  r AS (SELECT p.l_suppkey, p.season, count_if(sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) < d AND (c.l_suppkey <> p.l_suppkey OR c.season <> p.season)) AS k FROM p CROSS JOIN s c GROUP BY 1, 2)
  SELECT round(median(k / (n - 2.0::DOUBLE)), 9) AS rank, count(*) AS pairs FROM r, n""")
def next_season_rank(spark, sf):
    s = lines(spark, sf).groupBy("l_suppkey", "season").agg(F.avg("l_quantity").alias("x"), (F.avg("l_discount") * 500).alias("y"))
    return neighbors.next_season_rank(s, "l_suppkey", "season", "x", "y").withColumn("rank", F.round("rank", 9))


@query("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def quality_primary_key(spark, sf):
    return quality.duplicates(table(spark, sf, "orders"), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def quality_primary_key_violated(spark, sf):
    return quality.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) < 2 OR count(*) > 7")
def quality_group_size(spark, sf):
    return quality.groups_beyond(table(spark, sf, "lineitem"), ["l_orderkey"], 2, 7)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 2 OR l_quantity > 49")
def quality_range(spark, sf):
    return quality.out_of_range(table(spark, sf, "lineitem"), "l_quantity", 2, 49).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT avg(CASE WHEN l_linestatus = 'O' THEN 100.0::DOUBLE ELSE 0 END) AS pct FROM lineitem HAVING pct < 90 OR pct > 95")
def quality_rate(spark, sf):
    return quality.rate_beyond(table(spark, sf, "lineitem"), F.col("l_linestatus") == "O", 90, 95)


@query("SELECT lang, count(*) AS n, round(CAST(100 AS DOUBLE) * count(text) / count(*), 1) AS text_pct, round(CAST(100 AS DOUBLE) * count(nullif(source, 'src1')) / count(*), 1) AS src_pct FROM documents GROUP BY 1")
def coverage(spark, sf):
    d = table(spark, sf, "documents").withColumn("src", F.nullif(F.col("source"), F.lit("src1")))
    return relops.coverage(d, "lang", ["text", "src"])


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%00001%' ORDER BY CASE WHEN lower(c_name) LIKE '00001%' THEN 0 ELSE 1 END, c_name LIMIT 20")
def player_search(spark, sf):
    from .api import search

    return search(table(spark, sf, "customer"), "c_name", "00001").select("c_custkey", "c_name")


@query("SELECT l_suppkey, sum(l_discount * l_quantity) / sum(l_quantity) AS disc, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 100 ORDER BY disc DESC, l_suppkey LIMIT 25")
def weighted_leaderboard(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(relops.weighted_mean("l_discount", "l_quantity").alias("disc"), F.count("*").alias("n")).filter("n >= 100")
    return relops.leaders(rows, 25, F.desc("disc"), "l_suppkey")


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem GROUP BY 1")
def profile_filter_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"))


@query("SELECT year(l_shipdate) AS season, count(*) AS n, count(DISTINCT l_orderkey) AS orders, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem GROUP BY 1")
def season_summary(spark, sf):
    return lines(spark, sf).groupBy("season").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"))


@query("SELECT l_suppkey, max(year(l_shipdate)) AS season FROM lineitem GROUP BY 1")
def latest_row(spark, sf):
    return relops.keep_first(lines(spark, sf).select("l_suppkey", "season").distinct(), ["l_suppkey"], F.col("season"), last=True)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_suppkey = 3 AND l_returnflag = 'R'")
def optional_filters(spark, sf):
    return relops.optional_filters(table(spark, sf, "lineitem"), l_suppkey=3, l_returnflag="R", l_linestatus=None).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_extendedprice), 2) AS price, round(stddev_samp(l_quantity), 3) AS sd, median(l_quantity) AS mid, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1 HAVING count(*) >= 100")
def league_shapes(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("price"), F.round(F.stddev_samp("l_quantity"), 3).alias("sd"), F.median("l_quantity").alias("mid"), F.percentile("l_extendedprice", 0.9).alias("p90")).filter("n >= 100")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf):
    return st.drained(st.tumbling(st.event_stream(spark, sf)), "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT d AS start, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS d, event_type FROM events, range(2) r(k)) GROUP BY 1, 2")
def event_sliding(spark, sf):
    return st.drained(st.sliding(st.event_stream(spark, sf)), "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_session(spark, sf):
    return st.drained(st.sessions(st.event_stream(spark, sf)), "complete").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT event_id, user_id, CAST(row_number() OVER w - 1 AS BIGINT) AS seen, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER p, 0) AS BIGINT) AS prior_purchases, lag(event_type) OVER w AS prev_type FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def stateful_priors(spark, sf):
    return st.drained(st.running_priors(st.event_stream(spark, sf)), "append")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 3 = 0")
def manifest_upsert(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit("a").alias("fetched_at"))
    new = old.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("fetched_at", F.lit("b"))
    return relops.upsert(old, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(spark, sf):
    return relops.union_relaxed(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS h FROM customer")
def sha256_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat("c_name", F.lit("|"), "c_mktsegment"), 256).alias("h"))


@query("""SELECT event_id, round(degrees(atan2(vz, abs(vy))), 9) AS vaa, round(degrees(atan2(vx, abs(vy))), 9) AS haa FROM (SELECT event_id, 5 + -10 * t AS vx, vy0 + ay * t AS vy, -5 + -15 * t AS vz FROM (
  SELECT *, (-vy0 - sqrt(vy0 * vy0 - ay * (2 * (50 - 17 / 12.0::DOUBLE)))) / ay AS t FROM (SELECT event_id, -(130 + value / 100) AS vy0, 25 + value / 50 AS ay FROM events)))""")
def approach_angles(spark, sf):
    e = events(spark, sf).select("event_id", (-(F.lit(130.0) + F.col("value") / 100)).alias("vy0"), (F.lit(25.0) + F.col("value") / 50).alias("ay"))
    vaa, haa = E.approach_angles(F.lit(5.0), F.col("vy0"), F.lit(-5.0), F.lit(-10.0), F.col("ay"), F.lit(-15.0))
    return e.select("event_id", F.round(vaa, 9).alias("vaa"), F.round(haa, 9).alias("haa"))


@query("""SELECT *, x0 + vx0 * t + ax * t * t * 0.5::DOUBLE AS x, 50.0::DOUBLE + vy0 * t + ay * t * t * 0.5::DOUBLE AS y, z0 + vz0 * t + az * t * t * 0.5::DOUBLE AS z,
  sqrt((vx0 + ax * t) * (vx0 + ax * t) + (vy0 + ay * t) * (vy0 + ay * t) + (vz0 + az * t) * (vz0 + az * t)) * (3600.0::DOUBLE / 5280.0::DOUBLE) AS mph FROM (
  SELECT *, t0 + (t1 - t0) * k / 20.0::DOUBLE AS t FROM (
  SELECT *, (-vy0 - sqrt(vy0 * vy0 - ay * 2.0::DOUBLE * (50.0::DOUBLE - release_y))) / ay AS t0, (-vy0 - sqrt(vy0 * vy0 - ay * 2.0::DOUBLE * (50.0::DOUBLE - 17.0::DOUBLE / 12.0::DOUBLE))) / ay AS t1 FROM (
  SELECT event_id, -1.9::DOUBLE - value / 500 AS x0, 5.8::DOUBLE + value / 1000 AS z0, 54.0::DOUBLE AS release_y, 5.0::DOUBLE + value / 200 AS vx0, -(130.0::DOUBLE + value / 100) AS vy0, -5.0::DOUBLE - value / 300 AS vz0,
  -10.0::DOUBLE - value / 100 AS ax, 25.0::DOUBLE + value / 50 AS ay, -15.0::DOUBLE - value / 150 AS az FROM events)), (SELECT CAST(r AS INTEGER) AS k FROM range(21) s(r)) WHERE t0 IS NOT NULL AND t1 IS NOT NULL)""")
def flight_path(spark, sf):
    of = {"x0": (-1.9, -500), "z0": (5.8, 1000), "release_y": (54.0, None), "vx0": (5.0, 200), "vy0": (-130.0, -100), "vz0": (-5.0, -300), "ax": (-10.0, -100), "ay": (25.0, 50), "az": (-15.0, -150)}
    own = [(F.lit(base) + F.col("value") / by if by else F.lit(base)).alias(k) for k, (base, by) in of.items()]
    return geometry.flight(table(spark, sf, "events").select("event_id", *own))


@query()
def convex_hull(spark, sf):
    return geometry.convex_hull(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")


@query("SELECT c_custkey, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS z FROM customer")
def standardise(spark, sf):
    return relops.standardised(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("z")), ["z"])


@query()
def kmeans_silhouette(spark, sf):
    _, scores = encodings.archetypes(table(spark, sf, "embeddings"), ["vec_id"], "embedding")
    return spark.createDataFrame(scores, "k int, silhouette double")


@query()
def pca(spark, sf):
    return encodings.pca_map(table(spark, sf, "embeddings"), ["vec_id"], "embedding")


_WALL = "(2 * p1 + (p2 - p0) * f + (2 * p0 - 5 * p1 + 4 * p2 - p3) * f * f + (3 * p1 - p0 - 3 * p2 + p3) * f * f * f) * 0.5::DOUBLE"
_MARKED = ", ".join(f"('{n}', [{', '.join(f'{d}.0::DOUBLE' for d in at)}])" for n, at in geometry.PARKS.items())


@query(f"""WITH p(park, d) AS (VALUES {_MARKED}), k AS (SELECT park, d, CAST(q AS INTEGER) AS k, least(3, q // 10) AS i, (q - 10 * least(3, q // 10)) / 10.0::DOUBLE AS f FROM p, range(41) r(q)),
  m AS (SELECT park, k, f, d[greatest(i, 1)] AS p0, d[i + 1] AS p1, d[i + 2] AS p2, d[least(i + 3, 5)] AS p3, -45 + 22.5::DOUBLE * greatest(i - 1, 0) AS a0, -45 + 22.5::DOUBLE * i AS a1, -45 + 22.5::DOUBLE * (i + 1) AS a2, -45 + 22.5::DOUBLE * least(i + 2, 4) AS a3 FROM k)
  SELECT park, k, round(sin(radians({_WALL.replace("p0", "a0").replace("p1", "a1").replace("p2", "a2").replace("p3", "a3")})) * {_WALL}, 6) AS x, round(cos(radians({_WALL.replace("p0", "a0").replace("p1", "a1").replace("p2", "a2").replace("p3", "a3")})) * {_WALL}, 6) AS y FROM m""")
def park_walls(spark, sf):
    return geometry.park_wall(geometry.parks(spark), "park").withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("SELECT l_suppkey, round(d, 9) AS distance, x, y FROM (SELECT l_suppkey, sqrt((l_quantity - 25) ** 2 + ((l_extendedprice - 30000) / 1000) ** 2) AS d, l_quantity AS x, (l_extendedprice - 30000) / 1000 AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY sqrt((l_quantity - 25) ** 2 + ((l_extendedprice - 30000) / 1000) ** 2), l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1 AND d <= 2")
def nearest_point(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("price", (F.col("l_extendedprice") - 30000) / 1000)
    return geometry.nearest_point(rows, ["l_suppkey"], "l_quantity", "price", F.lit(25.0), F.lit(0.0), 2.0).withColumn("distance", F.round("distance", 9))


@query("SELECT (min(l_quantity) + max(l_quantity)) / 2 AS centre_x, (min(l_extendedprice) + max(l_extendedprice)) / 2 AS centre_y, round(least(800 * 0.9::DOUBLE / (max(l_quantity) - min(l_quantity)), 600 * 0.9::DOUBLE / (max(l_extendedprice) - min(l_extendedprice))), 12) AS scale FROM lineitem")
def viewport(spark, sf):
    return geometry.fitted_view(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 800.0, 600.0).withColumn("scale", F.round("scale", 12))


@query("SELECT l_suppkey, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT l_suppkey, l_returnflag || l_linenumber AS kind FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1")
def repertoire(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("kind", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    return learning.repertoire(rows, "l_suppkey", "kind", 5).withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT count(*) AS n, avg(m) AS mean, stddev_samp(m) AS sd FROM (SELECT avg(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey, year(l_shipdate), l_returnflag HAVING count(*) >= 3)")
def two_level_calibration(spark, sf):
    means = learning.group_means(lines(spark, sf), "l_extendedprice", ["l_suppkey", "season", "l_returnflag"], 3)
    return means.agg(F.count("*").alias("n"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"))


@query("""WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE + 1 AS n FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, event_type, coalesce(n, 1) AS n FROM u CROSS JOIN k LEFT JOIN c USING (user_id, event_type)),
  p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS rn FROM p WHERE p >= 0.1)
  SELECT user_id, string_agg(event_type || ':' || printf('%.4f', round(p, 4)), ',' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY 1""")
def top_probabilities(spark, sf):
    classes = ["click", "error", "purchase", "signup", "view"]
    n = events(spark, sf).groupBy("user_id").agg(F.array(*[F.count_if(F.col("event_type") == c) + F.lit(1.0) for c in classes]).alias("n"))
    p = n.select("user_id", F.transform("n", lambda v: v / F.aggregate("n", F.lit(0.0), lambda s, x: s + x)).alias("p"))
    top = E.top_probabilities(F.col("p"), classes, 0.1, 3)
    return p.select("user_id", F.array_join(F.transform(top, lambda t: F.concat(t["class"], F.lit(":"), F.format_string("%.4f", t["probability"]))), ",").alias("top"))


@query("SELECT user_id, event_type, mode FROM (SELECT user_id, event_type, event_type AS mode, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def most_common(spark, sf):
    return encodings.most_common(events(spark, sf), "user_id", "event_type").withColumn("mode", F.col("event_type"))


@query("""WITH t AS (SELECT l_suppkey, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, sum(n) AS total, max(n) AS top, min(CASE WHEN n = x THEN kind END) AS label, count(*) AS labels FROM (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS x FROM t) GROUP BY 1)
  SELECT l_suppkey, CAST(total AS BIGINT) AS n, label, labels, top / total::DOUBLE AS purity, (SELECT sum(top) / sum(total)::DOUBLE FROM m) AS whole_purity FROM m""")
def group_purity(spark, sf):
    return relops.purity(table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier")
def id_union(spark, sf):
    return relops.ids(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "supplier").select("s_suppkey"), name="id")


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def id_difference(spark, sf):
    return relops.missing(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey"), name="id")


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def id_intersection(spark, sf):
    return relops.shared(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey"), name="id")


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM events WHERE regexp_matches(props, '\\{\"k\": [0-9]+\\}') GROUP BY 1")
def regex_filter(spark, sf):
    rows = table(spark, sf, "events").filter(F.col("props").rlike(r'^\{"k": [0-9]+\}$'))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("big"))

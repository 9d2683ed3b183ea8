"""Times the queries, each twice with the better kept (after one warm-up query), and prints one JSON line.

"value" is the sum over the headline queries; "queries" also has the domain's and the text operators.
"""

import importlib.util
import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

from moundworks.plans import pitch_queries  # noqa: E402, F401  registers its queries
from moundworks.plans.queries import QUERIES  # noqa: E402
from moundworks.session import session  # noqa: E402

HEADLINE = ["arsenal_mart", "arsenal_mart_sparse", "expanding_priors", "sequence_lags", "run_value_attach", "rollup_all", "yoy_spearman", "rank_auc", "zone_grid", "histogram_equal_width", "knn_topk", "usage_baseline", "quality_primary_key_violated", "season_summary", "weighted_leaderboard"]
DOMAIN = ["enrich_pitches", "pitcher_arsenal", "next_pitch_features", "pitch_run_values", "zone_profiles"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = dict(QUERIES)
    text: dict = {}
    if importlib.util.find_spec("moundworks.llm"):
        from moundworks.llm.queries import QUERIES as text

    def timed(query) -> float:
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - began

    timed(queries["season_summary"])
    took = {name: round(min(timed(queries[name]) for _ in range(2)), 3) for name in HEADLINE + DOMAIN}
    took |= {name: round(timed(query), 3) for name, query in text.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

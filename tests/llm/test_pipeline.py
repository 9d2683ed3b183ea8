"""run() and each stage against brute force."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from moundworks.llm import mixing  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[\x20\x09-\x0D]"


def words(text):
    return [w for w in re.split(f"{SPACE}+", text or "") if w]


def survivors(rows):
    """Rows (doc_id, text, source) after the first three stages, by their definitions; no label is there, so that the base
    rule alone rejects."""

    def good(text):
        w = words(text)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)

    rows = [r for r in rows if good(r[1])]
    small = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words(t)]
    sets = [frozenset(zip(small(t), small(t)[1:])) for _, t, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for g, r in zip(group, rows, strict=True):
        first[g] = min(first.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    rows = list(first.values())
    seen = Counter(tuple(w[k : k + 35]) for _, t, _ in rows for w in [words(t)] for k in range(len(w) - 34))
    out = []
    for i, t, s in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        if gone:
            runs = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)
            t = "".join(x for p, x in enumerate(runs) if p not in gone)
        if t:
            out.append((i, t, s))
    return out


def corpus():
    rng, rows, number = random.Random(12), [], iter(range(1, 10**6))
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(60)
    for i in range(120):
        w = fresh(rng.randrange(12, 150))
        if i % 6 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((next(number), " ".join(w) + ("\n" if i % 3 else ""), None if i % 11 == 0 else f"s{i % 4}"))
        if i % 5 == 0:  # an exact copy and a near one
            rows.append((next(number), rows[-1][1], "s1"))
            near = list(w)
            near[rng.randrange(len(near))] = "changed"
            rows.append((next(number), " ".join(near).upper() if i % 2 else " ".join(near), "s2"))
    rows += [(next(number), None, "s0"), (next(number), "", "s0"), (next(number), "too short", None), (next(number), "x y z " * 40, "s0"), (None, " ".join(fresh(30)), "s0"), (None, " ".join(fresh(40)), None)]
    rows += [(next(number), " ".join(fresh(200_000)), "s3"), (next(number), " ".join(passage), "s1"), (7_000, "é ü 漢字 " + " ".join(fresh(20)), "s0"), (7_000, " ".join(fresh(25)), "s0")]
    return rows


def saved(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS).withColumns({"copies": F.lit("mine"), "stratum": F.lit(1)})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run_equals_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(corpus_pipeline.vocabulary_path())
    got = corpus_pipeline.run(spark, saved(spark, tmp_path, corpus())).collect()
    left = survivors(corpus())
    assert 100 < len(left) < 135 and any(i is None for i, _, _ in left)
    size = Counter()
    for _, t, s in left:
        size[s] += len(words(t))
    goal = mixing.targets(list(size.items()))
    counts, of = Counter((r.doc_id, r.decoded) for r in got), {(i, t): s for i, t, s in left}
    assert set(counts) <= set(of)
    for (i, t), s in of.items():
        rate = goal[s] / size[s]
        assert math.floor(rate) <= counts[i, t] <= math.ceil(rate), (i, s, rate)
    for s in size:
        own = [t for i, t, x in left if x == s]
        taken = sum(n * len(words(t)) for (i, t), n in counts.items() if of[i, t] == s)
        largest, total = max(len(words(t)) for t in own), sum(len(words(t)) for t in own)
        assert abs(taken - goal[s]) <= (total / len(own) + 1 if 2 * largest < total else largest), s  # one document of s3 outweighs the rest
    for r in got:
        ids = public.encode(r.decoded, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == b"".join(x.to_bytes(4, "little") for x in ids)


def test_run_of_nothing_and_of_nulls(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert corpus_pipeline.run(spark, saved(spark, tmp_path / "a", [])).count() == 0
    assert corpus_pipeline.run(spark, saved(spark, tmp_path / "b", [(None, None, None), (None, None, None), (1, "", "s")])).count() == 0


def test_stages_on_whole_tables(spark):
    """Every stage of the first three, on all that its predecessor kept of sf0.001."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((i, t) for i, t, _ in survivors(rows))


def test_last_stage_carries_ids(spark):
    docs = spark.createDataFrame([(1, "a mound"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    own = corpus_pipeline.bpe.load(corpus_pipeline.vocabulary_path())
    assert out[1].ids == own.encode_packed("a mound") != b"" and out[1].decoded == "a mound" and out[2].ids == b""

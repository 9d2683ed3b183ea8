"""Operator 1: quality rules with risk-controlled cutoffs (DataFrame functions only).

Four integer signals are taken from each whole text. Documents failing the base rule go at once. For the others each
rule of ``RULES`` scores a document, and rejects it above a cutoff that is chosen for each stratum (length band) from
the labelled holdout: a cutoff is admissible when the exact binomial test rejects "more than ``alpha`` of the good
documents are lost", i.e. P(Bin(n, alpha) <= k) <= delta / m for k losses among n good ones. Within a rule and stratum
the cutoffs are tested in fixed sequence from lenient to strict, stopping at the first failure; across the m pairs of
rule and stratum delta is split evenly (Bonferroni). A pair without an admissible cutoff never rejects.

The bound takes the labelled documents as independent: copies of one text under several ids count as often as they are
labelled, so a labelled set with many copies should be thinned to one label a text before it is passed.

Defined cases: null doc_id is judged like others and is never in the holdout; null text has no words, so base_failed; empty labels or few of them leave all method rules inactive;
labels with null quality are ignored; several labels of one document count as the lowest of them; repeated document
rows are judged one by one, and count once each in the holdout; extra columns are ignored by ``judge`` and carried by
``keep_good``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, let

#: Per rule: the score's name and its cutoffs from lenient to strict. Scores are percentages.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_pct": (60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 15.0, 10.0, 5.0, 2.0),
    "dup_line_pct": (80.0, 60.0, 50.0, 40.0, 30.0, 20.0, 10.0, 5.0),
    "repeat_pct": (18.0, 15.0, 12.0, 10.0, 8.0, 6.0, 4.0, 2.0),
}
#: Upper ends of the length bands in words; the strata are a fixed, small number by construction.
BANDS = (50, 200, 1000)
ALPHA, DELTA = 0.02, 0.05


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words covered by windows of n words that occur twice or more in the array; windows compare by 64-bit hash."""
    size = F.size(words)

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def hits(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            found = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.array_sort(F.transform(found, lambda x: x["i"]))

        def union(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g.cast("long"))

        some = let(let(pairs, hits), union)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(some)

    windows = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(size > n, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def signal() -> Column:
    """A struct of the counts and scores of the column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def long(c: Column) -> Column:
        return c.cast("long")

    def counts(w: Column) -> Column:
        return F.struct(
            long(F.size(w)).alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + long(F.length(x))).alias("word_chars"),
            long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
            let(lines, lambda x: F.struct(long(F.size(x) - F.size(F.array_distinct(x))).alias("dup"), long(F.size(x)).alias("all"))).alias("lines"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def scored(c: Column) -> Column:
        pct = lambda a, b: F.coalesce(F.try_divide(a * F.lit(100.0), b), F.lit(0.0))
        band = reduce(lambda a, x: a.when(c["n_words"] < x[1], x[0]), list(enumerate(BANDS))[1:], F.when(c["n_words"] < BANDS[0], 0))
        return F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            c["lines"]["dup"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
            ((c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)).alias("base_failed"),
            band.otherwise(len(BANDS)).alias("stratum"),
            pct(c["n_symbols"], c["word_chars"]).alias("symbol_pct"),
            pct(c["lines"]["dup"], c["lines"]["all"]).alias("dup_line_pct"),
            pct(c["n_repeat_words"], c["n_words"]).alias("repeat_pct"),
        )

    return let(let(words, counts), scored)


def with_signals(docs: DataFrame) -> DataFrame:
    """Adds the column ``signal``; nothing else is touched."""
    return docs.withColumn("signal", signal())


def _ln_gamma(x: Column) -> Column:
    """Stirling's series after shifting x by ten; relative error below 1e-14 for x >= 1."""
    shifted = reduce(lambda a, i: a * (x + i), range(1, 10), x)
    y = x + 10
    z = F.lit(1.0) / (y * y)
    series = (F.lit(1 / 12) - z * (F.lit(1 / 360) - z * (F.lit(1 / 1260) - z * F.lit(1 / 1680)))) / y
    big = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series
    return F.when(x < 1e6, big - F.log(F.least(shifted, F.lit(1e300)))).otherwise((x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + F.lit(1 / 12) / x)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k). From the term at k downwards; terms that could not change a double are left out. 1 where k >= n p."""
    a, b = k.cast("double"), n.cast("double")
    top = _ln_gamma(b + 1) - _ln_gamma(a + 1) - _ln_gamma(b - a + 1) + a * F.log(F.lit(p)) + (b - a) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(F.sqrt(b * p) * 12) + 60).cast("int")
    add = lambda s, j: F.struct((s["t"] * (a - j) / (b - a + j + 1) * F.lit((1 - p) / p)).alias("t"), (s["s"] + s["t"]).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), steps), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), add, lambda s: s["s"])
    return F.when(a >= b * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def fit_cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """One row for each stratum: stratum and one cutoff (null: inactive) a rule. scored has doc_id and the fields of signal."""
    good = labels.groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").alias("_quality")).filter("_quality = 1")
    held = scored.filter("not base_failed").join(good, F.col("doc_id") == F.col("_label_id"), "left_semi")
    cells = [(r, c) for r, cs in rules.items() for c in cs]
    losses = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"k{i}") for i, (r, c) in enumerate(cells)])
    tested = losses.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(cells)])).alias("t")).select("stratum", "n", "t.*")
    m = len(rules) * (len(BANDS) + 1)
    tested = tested.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / m)
    so_far = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    accepted = tested.withColumn("ok", F.min("ok").over(so_far)).filter("ok")
    return accepted.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in rules])


def verdict(scored: DataFrame, cutoffs: DataFrame, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """Adds the cutoffs and ``kept``. The cutoffs have one row a stratum, of which BANDS makes four: a fixed size."""
    hit = reduce(or_, [F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False)) for r in rules])
    return scored.join(F.broadcast(cutoffs), F.col("stratum") == F.col("_stratum"), "left").drop("_stratum").withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~hit))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the scores and the cutoffs that applied, for each row of docs."""
    scored = Scratch(spark).cut(with_signals(docs.select("doc_id", "text")).select("doc_id", "signal.*"), keep=True)
    judged = verdict(scored, fit_cutoffs(scored, labels))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum"]
    return judged.select(*first, *RULES, *[f"{r}_cutoff" for r in RULES])


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    The cutoffs (four rows: BANDS fixes the number) come to the driver and go into the plan as literals, so that the second
    pass is a plain filter over the scan: no join, no shuffle and no copy of a text. Signals are taken twice for that.
    """
    scored = with_signals(docs.select("doc_id", "text")).select("doc_id", "signal.*")
    cutoffs = fit_cutoffs(scored, labels).collect()

    def passes(c: Column) -> Column:
        hit = [(c["stratum"] == r["_stratum"]) & (c[rule] > r[f"{rule}_cutoff"]) for r in cutoffs for rule in RULES if r[f"{rule}_cutoff"] is not None]
        return reduce(lambda a, x: a & ~x, hit, ~c["base_failed"])

    return docs.filter(let(signal(), passes))

"""Operator 8: mixing sources to target weights by pivotal dependent rounding.

Source sizes are counted in words. The sources, by code point with null last, get the weights 5, 2, 1, repeating, and
share 100 % of all words; a target stops at three times its source's words and the excess goes to the others by weight.
Sources, their numbers and targets are tables; the driver sees a few totals a round, whatever the number of sources.
A document is expected target / source words times: the whole part is taken for sure, the fractional part is a copy
probability. Pairs of probabilities meet and move *word mass* at random from one to the other (a martingale, so every
document keeps its probability) until one of the two is integral; the expected words of a group never change. Each
source is dealt into bounded groups by a hash of the row's key; a group leaves at most one fractional row, and the
residual rows are combined by a reduction tree, level by level, until one is left for each source and is drawn. Larger
documents meet first. As that last row may be a long document, each source's first group holds back up to RESERVE_ROWS
rows of at most average size: after the draw they take over its rounding error, as far as they have room for either
outcome, and then meet each other; the one left of them is drawn too, so a source's taken words end within one such document
of its target unless one document outweighs the reserve. As all rows of a source have the same probability, what the reserve
gains after one outcome and loses after the other cancels: its documents keep their probability as well.

Defined cases: null text and texts without words have size 0, never move mass and take their copies by an own draw; rows are
told apart by doc_id, source and text (null ids too), equal ones are numbered and are units of their own; an empty table
gives an empty table; a source of no words has target 0. All draws come from hashes of fixed seeds and row keys: reruns
agree, whatever the partitioning.
"""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, numbered

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Rows of a group of the first level, and residual rows that meet in one group of a further level.
GROUP_ROWS, FAN_IN, RESERVE_ROWS = 20_000, 1_000, 256

#: doc is doc_id as text: a null would make pandas turn the whole column into doubles.
UNIT = "k long, copy_no int, doc string, source string, size long, source_size long, target double, whole int, p double, held boolean, extra int"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """The target words of each source, from the sources' words: the plain form, for a few sources."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, open_ = dict(order), float(sum(n for _, n in order)), [s for s, _ in order]
    out: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * size[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def uniform(*key) -> float:
    return xxhash.xxh3_64_intdigest(repr(key).encode()) / 2**64


def pivotal(keys: list, sizes: list[float], p: list[float], seed) -> list[float]:
    """p after the rounds: all 0 or 1 but at most one; sum(p * size) is kept up to rounding errors. In the order given."""
    p, held = list(p), -1
    for j, s in enumerate(sizes):
        if s <= 0 or not 0 < p[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        i = held
        to_i = min((1 - p[i]) * sizes[i], p[j] * s)
        to_j = min(p[i] * sizes[i], (1 - p[j]) * s)
        up = uniform(seed, keys[i], keys[j]) * (to_i + to_j) < to_j
        moved = to_i if up else -to_j
        p[i], p[j] = p[i] + moved / sizes[i], p[j] - moved / s
        p[i], p[j] = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (p[i], p[j]))
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def settle(keys: list, sizes: list[int], p: list[float], held: list[bool], seed) -> list[int]:
    """0 or 1 for each row of a source's last group: the rows that aren't held first, then the reserve makes up for them.

    Of the first part one row at most is left open; its draw errs by (1 - q) or q times its size. The reserve takes over the
    same share of either error, as much as it has room for both ways, so that the two outcomes cancel in expectation.
    """
    p = list(p)
    parts = [[i for i in range(len(p)) if held[i] == part and sizes[i] > 0] for part in (False, True)]

    def meet(own: list[int], part: bool) -> int:
        """The row that is left open, or -1."""
        left = -1
        for i, x in zip(own, pivotal([keys[i] for i in own], [sizes[i] for i in own], [p[i] for i in own], (seed, part)), strict=True):
            p[i] = x
            left = i if 0 < x < 1 else left
        return left

    left = meet(parts[0], False)
    if left >= 0:
        q, size = p[left], sizes[left]
        p[left] = float(uniform("draw", seed, 0, keys[left]) < q)
        up, down = (sum(x * sizes[i] for i, x in ((i, 1 - p[i] if way else p[i]) for i in parts[1])) for way in (True, False))
        share = min(1.0, up / (q * size), down / ((1 - q) * size))
        for i in parts[1]:
            p[i] += (1 - p[i]) * share * q * size / up if p[left] == 0 and up else -p[i] * share * (1 - q) * size / down if p[left] == 1 and down else 0.0
            p[i] = min(1.0, max(0.0, p[i]))
    left = meet(parts[1], True)
    if left >= 0:
        p[left] = float(uniform("draw", seed, 1, keys[left]) < p[left])
    return [int(x) if n else int(uniform("draw", seed, k) < x) for x, n, k in zip(p, sizes, keys, strict=True)]


def _round_group(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "k", "copy_no"], ascending=[False, True, True], kind="stable")
        keys = list(zip(rows.k.tolist(), rows.copy_no.tolist(), strict=True))
        sizes, p, held = rows["size"].tolist(), rows.p.tolist(), rows.held.tolist()
        if level == 0 and rows["_group"].iloc[0] == 0:
            small = [i for i, n in enumerate(sizes) if 0 < n <= rows["size"].mean() and 0 < p[i] < 1]
            for i in sorted(small, key=lambda i: uniform("reserve", keys[i]))[:RESERVE_ROWS]:
                held[i] = True
        if last:
            extra = settle(keys, sizes, p, held, level)
        else:
            free = [i for i, h in enumerate(held) if not h]
            for i, x in zip(free, pivotal([keys[i] for i in free], [sizes[i] for i in free], [p[i] for i in free], level), strict=True):
                p[i] = x
            extra = [int(x) if not h and x in (0, 1) else int(uniform("draw", k) < x) if n == 0 else None for x, h, n, k in zip(p, held, sizes, keys, strict=True)]
        rows["p"], rows["held"], rows["extra"] = p, held, pd.array(extra, dtype="Int32")
        return rows.drop(columns="_group")

    return run


def _key() -> Column:
    """Tells rows apart: doc_id, source and text, nulls included."""
    doc, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    return F.xxhash64(doc, doc.isNull(), source, source.isNull(), text, text.isNull())


def _numbered_copies(rows: DataFrame) -> DataFrame:
    """Numbers rows of one key, so that (k, copy_no) is a key."""
    return rows.withColumn("copy_no", F.row_number().over(Window.partitionBy("k").orderBy("k")))


def target_table(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, words, n, target) of (source, words, n).

    The level is the words that a weight of 1 gets while no target stops; sources that stop leave theirs to the others, which
    raises it, until no more stop. Every round is one aggregate whose sums are exact, so that reruns agree to the last bit.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.get(F.array(*map(F.lit, weights)), F.col("_no") % len(weights))
    table = scratch.cut(numbered(sizes, order, "_no").withColumn("_w", weight).drop("_no"))
    total, level = table.agg(F.sum("words")).collect()[0][0], None
    while True:
        stops = F.lit(False) if level is None else F.lit(level) * F.col("_w") > F.lit(most) * F.col("words")
        r = table.agg(F.sum(F.when(stops, F.col("words"))).alias("full"), F.sum(F.when(~stops, F.col("_w").cast("decimal(18,6)"))).alias("open")).collect()[0]
        new = (total - most * (r.full or 0)) / float(r.open) if r.open else level
        if new is None or new == level:
            break
        level = new
    level = 0.0 if level is None else level
    target = F.least(F.lit(level) * F.col("_w"), F.lit(most) * F.col("words"))
    return table.withColumn("target", target).drop("_w")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text, source): k, copy_no, doc_id, source, size, source_size, target, copies, taken."""
    with Scratch(spark) as scratch:
        return scratch.cut(_mixed(scratch, docs), keep=True)


def _mixed(scratch: Scratch, docs: DataFrame) -> DataFrame:
    sized = docs.select(_key().alias("k"), F.col("doc_id").cast("long").cast("string").alias("doc"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    units = scratch.cut(_numbered_copies(sized))
    sizes = scratch.cut(units.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    if sizes.isEmpty():
        return units.select("k", "copy_no", F.col("doc").cast("long").alias("doc_id"), "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"))
    goals = scratch.cut(target_table(scratch, sizes).withColumn("_groups", F.ceil(F.col("n") / GROUP_ROWS).cast("int")))
    most = goals.agg(F.max("_groups")).collect()[0][0]
    by_source = goals.select(F.col("source").alias("_s"), F.col("words").alias("source_size"), "target", "_groups")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = units.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_rate", rate)
    rows = rows.withColumns({"whole": F.floor("_rate").cast("int"), "p": F.col("_rate") - F.floor("_rate"), "held": F.lit(False), "extra": F.lit(None).cast("int")})
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("k", "copy_no"), F.col("_groups")).cast("int")).drop("_rate", "_groups")

    level, done, reserve = 0, [], None
    while True:
        columns = [c.split()[0] for c in UNIT.split(", ")]
        out = scratch.cut(rows.select(*columns, "_group").groupBy("source", "_group").applyInPandas(_round_group(level, most == 1), UNIT))
        done.append(out.filter("extra is not null"))
        if most == 1:
            break
        level, most = level + 1, math.ceil(most / FAN_IN)
        left = out.filter("extra is null")
        reserve = left.filter("held") if reserve is None else reserve
        left = left.filter("not held").union(reserve) if most == 1 else left.filter("not held")
        rows = left.withColumn("_group", F.pmod(F.xxhash64(F.lit(level), "k", "copy_no"), F.lit(most)).cast("int"))
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    copies = F.col("whole") + F.col("extra")
    return result.select("k", "copy_no", F.col("doc").cast("long").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, with the columns of docs. Of rows equal in doc_id, source and text any
    may be the one that is taken."""
    chosen = mix(spark, docs).filter("copies > 0").select(F.col("k").alias("_k"), F.col("copy_no").alias("_no"), "copies")
    rows = _numbered_copies(docs.select(F.struct("*").alias("_row"), _key().alias("k")))
    kept = rows.join(chosen, (F.col("k") == F.col("_k")) & (F.col("copy_no") == F.col("_no")))
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")

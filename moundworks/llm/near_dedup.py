"""Operator 5: near-duplicate groups by one-permutation MinHash, optimal densification, bands and star-shaped edges.

A document's set is its distinct shingles of WIDTH words, or of another width by parameter (A-Z lower-cased; fewer words:
the whole sequence). Each shingle is hashed once to 64 bits; the hash range is cut into BINS bins and a bin keeps its
smallest hash (one permutation). An empty bin borrows from the bin that a fixed hash sequence of its own number reaches
first and that isn't empty (optimal densification). ROWS bins make a band; equal bands put documents into one bucket. Two
sets with Jaccard 0.8 share no band with probability (1 - 0.8**8)**64 < 1e-5.

Documents of equal sets are first folded into a class. Each bucket's *hub* is its class that shares most buckets with
others; star-shaped edges go from the hub to the bucket's other classes, so the candidate pairs are no more than the places
in buckets. They are confirmed on full sets, which the texts give again: 100 * intersection >= 80 * union. Stars alone lose
links whose ends aren't similar to their hub; the exact rest: of every hub whose classes lie in several components, those
outside the hub's component are compared with all its classes, in blocks of about BLOCK shingles. A block indexes its sets by
shingle and counts intersections, so that no pair becomes a row: a block returns links between components only. After that
any two classes of one bucket are of one component or have been compared.

Components come from repeated hooking to the smallest neighbour and contraction over distributed tables.

Defined cases: null or wordless text has an empty set, is linked with nothing and kept. Rows are told apart by doc_id and
text: rows of one doc_id with different texts are documents of their own, rows with null doc_id too (their component_id is
the smallest doc_id of the group, null if it has none; of such a group one row is kept). Rows equal in both are one document
repeated. An empty table gives an empty table; extra columns are ignored by ``groups`` and carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, as_bytes, row_key, small_batches

WIDTH = 2
BINS, ROWS = 512, 8
BANDS = BINS // ROWS
#: Edges that one task may finish.
FINISH = 20_000
#: Shingles of a block of sets that are compared with another block in one task.
BLOCK = 1_000_000
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

SIGNED = "doc_id long, k long, n_shingles long, digest binary, bands array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _donors(tries: int = 2048) -> np.ndarray:
    """For each bin the bins to borrow from, in order."""
    with np.errstate(over="ignore"):
        grid = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(tries) + np.arange(tries, dtype=np.uint64)[None, :]
        return (mixed(grid + MIX1) % np.uint64(BINS)).astype(np.int32)


DONORS = _donors()


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The set as sorted distinct 64-bit hashes."""
    words = [xxhash.xxh3_64_intdigest(w) for w in (text or b"").lower().split()]
    h = np.array(words, dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(h) < 2:
            return mixed(h * MIX2)
        n = max(1, len(h) - width + 1)
        out = h[:n]
        for k in range(1, min(width, len(h))):
            out = mixed(out * MIX1 + np.uint64(1)) + h[k : k + n] * MIX2
        return np.unique(mixed(out))


def signature(s: np.ndarray) -> np.ndarray:
    """BINS hashes of a set that isn't empty. s is sorted, so the first hash of each bin is its smallest."""
    with np.errstate(over="ignore"):
        bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out, full = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
        out[bins[first]], full[bins[first]] = s[first], True
        own, empty = np.flatnonzero(full), np.flatnonzero(~full)
        for start in range(0, DONORS.shape[1], 32):
            if not len(empty):
                break
            hit = full[DONORS[empty, start : start + 32]]
            some = hit.any(axis=1)
            out[empty[some]] = out[DONORS[empty[some], start + hit[some].argmax(axis=1)]]
            empty = empty[~some]
        if len(empty):  # few full bins and an unlucky sequence: the next full bin to the right
            out[empty] = out[own[np.searchsorted(own, empty) % len(own)]]
        return mixed(out + np.arange(BINS, dtype=np.uint64) * MIX1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64) * MIX2
        for column in sig.reshape(BANDS, ROWS).T:
            key = mixed(key * MIX1 + column)
        return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sizes, digests, bands = [], [], []
        for text in as_bytes(batch, "text"):
            s = shingles(text, width)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(band_keys(signature(s)) if len(s) else None)
        columns = [batch.column("doc_id"), batch.column("k"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "n_shingles", "digest", "bands"])


def links_of(asks: list[tuple[int, int, np.ndarray]], answers: list[tuple[int, int, bool, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between the components of a block: asks (node, comp, set) against answers (node, comp, whether it asks too,
    set). Components that a link joins count as one from then on, so there are fewer links than components."""
    if not asks or not answers:
        return []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    sizes = np.array([len(s) for *_, s in answers], dtype=np.int64)
    codes, owner = np.concatenate([s for *_, s in answers]), np.repeat(np.arange(len(answers)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    out = []
    for node, comp, mine in asks:
        start = np.searchsorted(codes, mine, "left")
        n = np.searchsorted(codes, mine, "right") - start
        place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[place], minlength=len(answers))
        for i in np.flatnonzero(100 * both >= 80 * (len(mine) + sizes - both)).tolist():
            other, other_comp, asking, _ = answers[i]
            if other == node or (asking and other < node) or find(comp) == find(other_comp):
                continue
            root[find(comp)] = find(other_comp)
            out.append((node, other))
    return out


def _linked(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (hub, part, against): one block after the other."""
    at, asks, answers, out = None, [], [], []

    def flush() -> pa.RecordBatch:
        ends = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ends], names=["a", "b"])

    for batch in small_batches(batches):
        columns = (batch.column(c).to_pylist() for c in ("hub", "part", "against", "node", "comp", "asks", "rest"))
        for hub, part, against, node, comp, asking, rest, text in zip(*columns, as_bytes(batch, "text"), strict=True):
            if (hub, part, against) != at:
                out += links_of(asks, answers)
                at, asks, answers = (hub, part, against), [], []
                if len(out) > 10_000:
                    yield flush()
                    out = []
            s = shingles(text, width)
            if asking:
                asks.append((node, comp, s))
            else:
                answers.append((node, comp, rest, s))
    out += links_of(asks, answers)
    yield flush()


def compared(scratch: Scratch, rows: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """The links (a, b) of blocks (hub, part, against) of rows node, comp, asks, rest."""
    full = rows.join(bodies, "node").repartition("hub", "part", "against").sortWithinPartitions("hub", "part", "against")
    return scratch.cut(full.select("hub", "part", "against", "node", "comp", "asks", "rest", "text").mapInArrow(partial(_linked, width=width), "a long, b long"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over at most FINISH edges: (u, p) for every end, p one id for each component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent[root(a)] = root(b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "p"])


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of an edge, comp the smallest id reachable.

    Contraction: every node goes to its neighbour (or itself) of the smallest hash, edges follow, and what is left is
    done again; a hash order lets any graph shrink by a constant factor, so the rounds are few. What is left once it has
    no more than FINISH edges is finished by union-find in one task, whose input that number bounds.
    """
    left = scratch.cut(edges.select("a", "b").filter("a <> b").distinct())
    label: DataFrame | None = None
    while n_left := left.count():
        both = left.union(left.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        last = n_left <= FINISH
        hop = left.coalesce(1).mapInArrow(_trees, "u long, p long") if last else low.select("u", F.when(F.col("m.h") < F.xxhash64("u"), F.col("m.v")).otherwise(F.col("u")).alias("p"))
        hop = scratch.cut(hop)
        label = hop if label is None else label.join(hop.toDF("q", "r"), F.col("p") == F.col("q"), "left").select("u", F.coalesce("r", "p").alias("p"))
        if last:
            break
        moved = left.join(hop.toDF("a", "pa"), "a").join(hop.toDF("b", "pb"), "b").filter("pa <> pb")
        left = scratch.cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if label is None:
        return left.toDF("id", "comp")
    label = scratch.cut(label)
    least = label.groupBy("p").agg(F.min("u").alias("comp"))
    return scratch.cut(label.join(least, "p").select(F.col("u").alias("id"), "comp"))


def merged(scratch: Scratch, label: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after further links: components of components."""
    ends = with_component(with_component(found, label, "a").withColumnRenamed("comp", "ca"), label, "b").select(F.col("ca").alias("a"), F.col("comp").alias("b"))
    over = components(scratch, ends)
    new = found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp"))
    return scratch.cut(with_component(label.union(new).withColumnRenamed("comp", "old"), over, "old").select("id", "comp"))


def with_component(rows: DataFrame, label: DataFrame, on: str) -> DataFrame:
    return rows.join(label.select(F.col("id").alias("_id"), F.col("comp")), F.col(on) == F.col("_id"), "left").drop("_id").withColumn("comp", F.coalesce("comp", on))


def _parts(size: str) -> Column:
    return F.ceil(F.col(size) / BLOCK).cast("int")


def _part(node: str, of: str) -> Column:
    return F.pmod(F.xxhash64(node), F.col(of)).cast("int")


def by_stars(scratch: Scratch, spokes: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """Links of the star-shaped edges: each hub against the classes of its buckets."""
    near = spokes.filter("100 * least(size, hub_size) >= 80 * greatest(size, hub_size)")
    parts = near.groupBy("hub").agg(F.sum("size").alias("all")).select("hub", _parts("all").alias("parts"))
    blocked = near.select("hub", "node").join(parts, "hub")
    no = F.lit(False)
    answers = blocked.select("hub", _part("node", "parts").alias("part"), F.lit(0).alias("against"), "node", F.col("node").alias("comp"), no.alias("asks"), no.alias("rest"))
    asks = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("against"), F.col("hub").alias("node"), F.col("hub").alias("comp"), F.lit(True).alias("asks"), no.alias("rest"))
    return compared(scratch, answers.union(asks), bodies, width)


def by_blocks(scratch: Scratch, spokes: DataFrame, label: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """Links that the stars missed: of hubs with several components, the classes outside the hub's against all."""
    hubs = spokes.groupBy("hub").agg(F.max("hub_size").alias("size")).select("hub", F.col("hub").alias("node"), "size")
    members = with_component(spokes.select("hub", "node", "size").union(hubs), label, "node")
    own = F.max(F.when(F.col("node") == F.col("hub"), F.col("comp")))
    several = members.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), own.alias("main")).filter("lo < hi").select("hub", "main")
    members = scratch.cut(members.join(several, "hub").withColumn("rest", F.col("comp") != F.col("main")))
    if members.isEmpty():
        return members.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    parts = members.groupBy("hub").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("rest"), F.col("size"))).alias("some")).select("hub", _parts("all").alias("parts"), _parts("some").alias("askers"))
    blocked = members.join(parts, "hub")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    answers = blocked.select("hub", _part("node", "parts").alias("part"), upto("askers").alias("against"), "node", "comp", F.lit(False).alias("asks"), "rest")
    asks = blocked.filter("rest").select("hub", upto("parts").alias("part"), _part("node", "askers").alias("against"), "node", "comp", F.lit(True).alias("asks"), "rest")
    return compared(scratch, answers.union(asks), bodies, width)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("k"))


def _classes(scratch: Scratch, docs: DataFrame, signed: DataFrame, width: int) -> DataFrame:
    """(digest, comp, head): the class of each set, the component it is in, and the class's first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("head")
    classes = signed.filter("digest is not null").groupBy("digest").agg(first, F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()))  # numbered once: the table is written

    member = classes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    in_bucket = scratch.cut(member.join(buckets, "bucket"))
    central = in_bucket.groupBy("node").agg(F.sum("members").alias("weight"))
    hubs = in_bucket.join(central, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("last"), "size")).alias("h"))
    hubs = hubs.select("bucket", (-F.col("h.last")).alias("hub"), F.col("h.size").alias("hub_size"))
    spokes = scratch.cut(in_bucket.join(hubs, "bucket").filter("node <> hub").select("hub", "hub_size", "node", "size").distinct())

    wanted = spokes.select(F.explode(F.array("hub", "node")).alias("node")).distinct().join(classes.select("node", F.col("head.k").alias("k")), "node")
    bodies = scratch.cut(docs.select("k", "text").join(wanted, "k").groupBy("node").agg(F.first("text").alias("text")))
    label = components(scratch, by_stars(scratch, spokes, bodies, width))
    more = by_blocks(scratch, spokes, label, bodies, width)
    if not more.isEmpty():
        label = merged(scratch, label, more)
    return with_component(classes.select("digest", "node", "head"), label, "node").select("digest", "comp", "head")


def _grouped(spark: SparkSession, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, k, n_shingles, component_id, stands (whether it is the one that stands for its group): a row for each of docs."""
    docs = _keyed(docs)
    with Scratch(spark) as scratch:
        signed = scratch.cut(docs.select("doc_id", "k", "text").mapInArrow(partial(_sign, width=width), SIGNED))
        placed = scratch.cut(_classes(scratch, docs, signed, width))
        heads = placed.groupBy("comp").agg(F.min("head").alias("first"))
        placed = placed.join(heads, "comp").select(F.col("digest").alias("_digest"), "first")
        rows = signed.select("doc_id", "k", "n_shingles", "digest").join(placed, F.col("digest") == F.col("_digest"), "left")
        component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
        stands = F.col("digest").isNull() | ((F.col("k") == F.col("first.k")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
        return scratch.cut(rows.select("doc_id", "k", "n_shingles", component.alias("component_id"), stands.alias("stands")), keep=True)


def groups(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each of docs."""
    rows = _grouped(spark, docs, width)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("stands")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that stand for their group, with the columns of docs. All rows without words stay; of rows equal in
    doc_id and text one stays, that of the smallest hash over all columns."""
    reps = _grouped(spark, docs, width).filter("stands and n_shingles > 0").select(F.col("k").alias("_k")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), row_key().alias("_k"), F.col("text").cast("string").alias("_t")).withColumn("_h", F.xxhash64("_row"))
    worded = F.coalesce(F.col("_t").rlike(WORD), F.lit(False))
    one = rows.filter(worded).join(reps, "_k", "left_semi").groupBy("_k").agg(F.min_by("_row", "_h").alias("_row"))
    return one.select("_row.*").union(rows.filter(~worded).select("_row.*"))

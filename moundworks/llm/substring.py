"""Operator 7: substring dedup by suffix automata of reference shards and matching statistics.

A window is LENGTH consecutive words. A word goes when a window that covers it starts anywhere else as well. Here the
reference is the corpus itself, so its automata can't be broadcast: their size would grow with the data. Each reference
shard is therefore co-located with the passages that can match it, which is the same automaton and the same streaming,
with a bounded shard in place of a broadcast:

1. every window has a key, the least hash of its KGRAM-word grams (a minimiser): equal windows have equal keys. Runs of
   windows with one key make a *piece*; a piece is a row of hashes and numbers (one for about 15 words).
2. keys seen once go (by a pre-aggregated count);
3. of the other keys one example of each different piece, with its number of occurrences, is sent to the key's shard. A
   shard builds the suffix automaton of its pieces, with occurrence counts, and streams the pieces through it: where the
   matching statistic reaches LENGTH, the state tells how often the window occurs. Maximal repeated spans of a piece are
   what the automaton finds, and they go from every place where the piece stands.
4. a key with more than SHARD_PIECES different pieces (a very common passage) is cut into several shards; windows that
   are unique in their shard are then counted over the key's shards by hash, so the result stays exact.

Words compare by 64-bit hashes. Defined cases: null text has no words (kept_sha256 of the empty text); fewer than LENGTH
words: nothing goes; repeated rows repeat each other's windows, so all their windows go; rows are told apart by a hash of
doc_id and text, so null ids and several texts of one id are rows like others; an empty table gives an empty table; extra
columns are ignored by ``dedup`` and carried by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, row_key, small_batches
from .near_dedup import mixed

LENGTH, KGRAM = 35, 8
SHARD_PIECES = 400
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

PIECES = "key long, piece long, k long, s int, n int, inner int"
FETCHED = "key long, part int, parts int, piece long, times int, words binary"
FOUND = "key long, piece long, a int, b int, w long, times int"


class _Powers:
    """Powers of BASE and of its inverse, as far as a text has needed them."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                size = max(n, 2 * len(cls.up))
                cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE)], dtype=np.uint64)
                cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE_INVERSE)], dtype=np.uint64)
        return cls.up, cls.down


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def pieces(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, piece hashes, first window, number of windows, 1 if the key's gram occurs again in the text, so that the
    piece may hold a window twice) of a text of at least LENGTH words."""
    n = len(h)
    up, down = _Powers.of(n + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(h * up[:n], dtype=np.uint64)]
        least = mixed((sums[KGRAM:] - sums[:-KGRAM]) * down[: n - KGRAM + 1])
        ordered = np.sort(least)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        span, have = LENGTH - KGRAM + 1, 1
        while have < span:  # least over spans of twice the length, up to the window
            step = min(have, span - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[first, len(least)])
        end = first + count + LENGTH - 1
        piece = mixed((sums[end] - sums[first]) * down[first] + count.astype(np.uint64))
    return least[first], piece, first, count, np.isin(least[first], twice) if len(twice) else np.zeros(len(first), dtype=bool)


def window_hashes(h: np.ndarray) -> np.ndarray:
    up, down = _Powers.of(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]
        return mixed((sums[LENGTH:] - sums[:-LENGTH]) * down[: len(h) - LENGTH + 1]).view(np.int64)


class SuffixAutomaton:
    """Of several sequences, each weighing as often as it occurs; ``times`` counts the occurrences of a state's strings."""

    def __init__(self, sequences: list[list[int]], weights: list[int]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.times = [-1], [0], [0]
        last = 0
        for k, (sequence, weight) in enumerate(zip(sequences, weights, strict=True)):
            for token in sequence:
                last = self._extend(last, token, weight)
            last = self._extend(last, ("end", k), 0)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.times[self.link[state]] += self.times[state]

    def _extend(self, last: int, token, weight: int) -> int:
        next_, link, length = self.next, self.link, self.length
        new = len(next_)
        next_.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.times.append(weight)
        p = last
        while p >= 0 and token not in next_[p]:
            next_[p][token] = new
            p = link[p]
        if p >= 0:
            q = next_[p][token]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(next_)
                next_.append(next_[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.times.append(0)
                link[q] = link[new] = clone
                while p >= 0 and next_[p].get(token) == q:
                    next_[p][token] = clone
                    p = link[p]
        return new

    def windows(self, sequence: list[int], size: int) -> list[tuple[int, int]]:
        """(state, occurrences) of each window of size tokens; (-1, 0) where the matching statistic is shorter."""
        out, state, matched = [], 0, 0
        next_, link, length, times = self.next, self.link, self.length, self.times
        for i, token in enumerate(sequence):
            while state and token not in next_[state]:
                state = link[state]
                matched = length[state]
            if token in next_[state]:
                state = next_[state][token]
                matched += 1
            if matched > size:
                matched = size
            while matched == size and length[link[state]] >= size:
                state = link[state]
            if i >= size - 1:
                out.append((state, times[state]) if matched >= size else (-1, 0))
        return out


def spans(repeated: list[bool]) -> Iterator[tuple[int, int]]:
    """Maximal runs of repeated windows as word spans (first word, word after the last)."""
    start = None
    for i, r in enumerate([*repeated, False]):
        if r and start is None:
            start = i
        elif not r and start is not None:
            yield start, i + LENGTH - 1
            start = None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 2 << 20):
        rows = []
        for k, text in zip(batch.column("k").to_pylist(), as_bytes(batch, "text"), strict=True):
            words = (text or b"").split()
            if len(words) >= LENGTH:
                key, piece, first, count, inner = pieces(word_hashes(words))
                rows.append((key, piece, np.full(len(key), k), first, count, inner))
        if rows:
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
            columns = [np.concatenate([r[i] for r in rows]) for i in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(t) if c.dtype == np.uint64 else c.astype(t)) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the examples that each text was asked for."""
    for batch in small_batches(batches, 2 << 20):
        out = []
        for text, wanted in zip(as_bytes(batch, "text"), batch.column("wanted").to_pylist(), strict=True):
            h = word_hashes(text.split())
            out += [(x["key"], x["part"], x["parts"], x["piece"], x["times"], h[x["s"] : x["s"] + x["n"] + LENGTH - 1].tobytes()) for x in wanted]
        for start in range(0, len(out), 2000):
            yield _batch(out[start : start + 2000], FETCHED)


def _shard(key: int, rows: list[tuple], parts: int) -> list[tuple]:
    """Spans (in words of the piece) of one shard's pieces (piece, times, words), and for a key of several shards the windows
    that must be counted over all of them."""
    sequences = [np.frombuffer(words, dtype=np.int64) for *_, words in rows]
    tokens = [s.tolist() for s in sequences]
    automaton = SuffixAutomaton(tokens, [times for _, times, _ in rows])
    out, told = [], set()
    for (piece, _, _), sequence, own in zip(rows, sequences, tokens, strict=True):
        found = automaton.windows(own, LENGTH)
        out += [(key, piece, a, b, None, None) for a, b in spans([times > 1 for _, times in found])]
        if parts > 1:
            for i, ((state, times), w) in enumerate(zip(found, window_hashes(sequence.view(np.uint64)).tolist(), strict=True)):
                if times == 1:
                    out.append((key, piece, i, i + LENGTH, w, 1))
                elif state not in told:
                    told.add(state)
                    out.append((None, None, None, None, w, 2))
    return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, part): one shard after the other."""
    held: list[tuple] = []
    at, parts, out = None, 1, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "part", "parts", "piece", "times", "words"))
        for key, part, many, *row in zip(*columns, strict=True):
            if (key, part) != at:
                if held:
                    out += _shard(at[0], held, parts)
                at, parts, held = (key, part), many, []
                if len(out) > 5000:
                    yield _batch(out, FOUND)
                    out = []
            held.append(tuple(row))
    if held:
        out += _shard(at[0], held, parts)
    if out:
        yield _batch(out, FOUND)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("k"))


def repeated_spans(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(k, s, e): spans of words that go. docs: k and text, as from ``_keyed``."""
    cuts = scratch.cut(docs.mapInArrow(_cut_pieces, PIECES))
    keys = cuts.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("t"), F.max("inner").alias("i")).filter("t > 1 or i > 0").select("_key")
    open_ = scratch.cut(cuts.join(keys, F.col("key") == F.col("_key")).drop("_key", "inner"))
    examples = open_.groupBy("key", "piece").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("times"), F.min(F.struct("k", "s", "n")).alias("x")).select("key", "piece", "times", "x.*")
    examples = scratch.cut(examples)
    parts = examples.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count("*") / SHARD_PIECES).cast("int").alias("parts"))
    dealt = examples.join(parts, F.col("key") == F.col("_key")).drop("_key").withColumn("part", F.pmod(F.xxhash64("piece"), F.col("parts")).cast("int"))
    wanted = dealt.groupBy("k").agg(F.collect_list(F.struct("key", "part", "parts", "piece", "times", "s", "n")).alias("wanted"))
    asked = docs.join(wanted, "k").dropDuplicates(["k"]).select("text", "wanted")
    content = asked.mapInArrow(_fetch, FETCHED).repartition("key", "part").sortWithinPartitions("key", "part")
    found = scratch.cut(content.mapInArrow(_match, FOUND))
    again = found.filter("w is not null").groupBy("w").agg(F.sum("times").alias("t")).filter("t > 1").select("w")
    shared = found.filter("key is not null and w is not null").join(again, "w")
    of_piece = found.filter("w is null").select("key", "piece", "a", "b").union(shared.select("key", "piece", "a", "b"))
    return open_.join(of_piece, ["key", "piece"]).select("k", (F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("b")).alias("e"))


def _covered(n: int, gone: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    if gone:
        np.add.at(edge, [x["s"] for x in gone], 1)
        np.add.at(edge, [x["e"] for x in gone], -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        counts, removed, digests = [], [], []
        for text, gone in zip(as_bytes(batch, "text"), batch.column("gone").to_pylist(), strict=True):
            words = (text or b"").split()
            if gone:
                words, n = [w for w, g in zip(words, _covered(len(words), gone).tolist(), strict=True) if not g], len(words)
            else:
                n = len(words)
            counts.append(n)
            removed.append(n - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _by_row(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(k, gone): the spans of each row that has some. The table grows with the data, so the join with it is the same at every
    size: by merging, never by a broadcast that small tables would allow."""
    with Scratch(spark) as scratch:
        gone = repeated_spans(scratch, docs.select("k", "text"))
        return scratch.cut(gone.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("gone")), keep=True).hint("merge")


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, a row for each of docs."""
    docs = _keyed(docs)
    rows = docs.join(_by_row(spark, docs), "k", "left").select("doc_id", "text", "gone")
    return rows.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")


WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with the repeated words cut out of text (with the white space behind them), and a new n_chars if there is one.
    A document of which nothing is left goes."""
    keyed = docs.select(F.struct("*").alias("_row"), row_key().alias("k"), F.col("text").cast("string").alias("text"))
    joined = keyed.join(_by_row(spark, _keyed(docs)), "k", "left")

    @F.pandas_udf("string")
    def clean(text, gone):
        import pandas as pd
        import regex

        split = regex.compile(WORD_AND_GAP).findall
        out = []
        for t, spans_ in zip(text, gone, strict=True):
            if spans_ is None or not len(spans_):
                out.append(t)
            else:
                runs = split(t)
                out.append("".join(r for r, g in zip(runs, _covered(len(runs), list(spans_)).tolist(), strict=True) if not g))
        return pd.Series(out)

    clean = clean.asNondeterministic()  # else the filter below cuts each text again, in Python workers of its own
    fresh = joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(clean("text", "gone")))
    kept = fresh.filter(F.col("gone").isNull() | (F.length("text") > 0))
    columns = [F.col("text").alias(c) if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return kept.select(*columns)

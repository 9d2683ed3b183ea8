"""Operator 4: byte-level BPE by a priority queue of merge ranks over a doubly linked symbol list.

A piece of text (split by the vocabulary's pattern) starts as a list of byte symbols, linked both ways by index. Every
adjacent pair with a merge rank is queued; the lowest rank, leftmost first, is popped, an entry whose symbols have
changed since is stale and skipped, and a merge queues its two new pairs. Decoding concatenates the vocabulary's bytes.
Special tokens of the file are cut out of the text first, as the public library does.

Defined cases: null text is empty; an empty text has no ids; bytes that are no UTF-8 are read as U+FFFD; repeated rows
are encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import gc
import json
import threading
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

#: The split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Bytes of pieces whose ids a worker remembers (the table starts anew when it is full), and of the longest such piece.
REMEMBERED, LONGEST = 24 << 20, 64

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def check(spec: dict) -> None:
    """Refuses a tokenizer file whose parts this operator doesn't have, rather than encode by others."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    odd += [f"model.{k}" for k in ("byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["model.type"] if model.get("type", "BPE") != "BPE" else []
    odd += ["normalizer"] if spec.get("normalizer") else []
    odd += ["pre_tokenizer"] if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) else []
    odd += ["decoder"] if (spec.get("decoder") or {}).get("type") != "ByteLevel" else []
    odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(odd)}")


class ByteBpe:
    def __init__(self, spec: dict):
        check(spec)
        model = spec["model"]
        letters = {c: b for b, c in byte_alphabet().items()}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        of = {t: i for t, i in model["vocab"].items()}
        self.start = [of.get(byte_alphabet()[b], -1) for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(of[a], of[b]): (rank, of[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.split = regex.compile(PATTERN).findall
        self.cuts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")").split if special else None
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.start[b] for b in piece]
        n, ranks = len(symbols), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*found, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
        heapify(queue)
        while queue:
            _, made, i, a, b = heappop(queue)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # stale
            symbols[i], symbols[j] = made, -1
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                if found := ranks.get((made, symbols[after])):
                    heappush(queue, (*found, i, made, symbols[after]))
            before = left[i]
            if before >= 0 and (found := ranks.get((symbols[before], made))):
                heappush(queue, (*found, before, symbols[before], made))
        return [s for s in symbols if s >= 0]

    def packed(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= LONGEST:
            self.held += len(piece) + len(out) + 100  # about what Python adds to the two
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[piece] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts, get, packed = [], self.known.get, self.packed
        for k, part in enumerate(self.cuts(text) if self.cuts else (text,)):
            if k % 2:
                parts.append(self.special[part].to_bytes(4, "little"))
            else:
                parts += [get(p) or packed(p) for p in self.split(part)]
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def _loaded(spec: str) -> ByteBpe:
    return ByteBpe(json.loads(spec))


#: Seconds without a task after which a Python worker gives up its tokenizer.
IDLE_S = 5.0
_timer: threading.Timer | None = None


def _busy() -> None:
    if _timer:
        _timer.cancel()


def _idle() -> None:
    """Gives up the tokenizer and the pieces it remembers, unless another task begins soon: workers outlive their stage, and
    count as their executor's memory while later stages run."""
    global _timer
    _busy()

    def release() -> None:
        _loaded.cache_clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # a C library without it keeps its free pages
            ctypes.CDLL(None).malloc_trim(0)

    _timer = threading.Timer(IDLE_S, release)
    _timer.daemon = True
    _timer.start()


def load(path: str) -> ByteBpe:
    with open(path, encoding="utf-8") as f:
        return _loaded(f.read())


def _encode(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    _busy()
    try:
        bpe = _loaded(spec)
        for batch in small_batches(batches):
            ids, decoded = [], []
            for raw in as_bytes(batch, "text"):
                ids.append(packed := bpe.encode_packed((raw or b"").decode("utf-8", "replace")))
                decoded.append(bpe.decode(memoryview(packed).cast("I").tolist()))
            counts = [len(packed) // 4 for packed in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
    finally:
        _idle()


def encode_rows(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each of docs: doc_id, n_tokens, ids, decoded. vocabulary: path of the tokenizer's JSON on the driver.

    ids are little-endian unsigned 32-bit integers, decoded is the text they give back. The file's text (1.5 MB; fixed by
    the vocabulary, not by the data) is broadcast once.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode(batches, spec.value)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of ``encode_rows``."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_table(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """The digests of ``encode_rows``."""
    return digests(encode_rows(spark, docs, vocabulary))

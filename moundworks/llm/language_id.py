"""Operator 3: language identification by error-correcting output codes over hashed character n-grams.

Each language gets a codeword of BITS bits (all bipartitions for up to four languages, else random words kept far
apart). A linear classifier for each bit is fitted by logistic regression on the square roots of hashed counts of byte
n-grams of one to GRAMS bytes within letters-only words, scaled to unit length. A text's margins are decoded by the
loss-weighted distance to every codeword, each bit weighing by its accuracy on the sample beyond chance; the nearest
word wins, and a text whose two nearest are within AMBIGUOUS of each other is flagged.

The classifier is fitted on a sample of labelled texts, each different text once, drawn by a hash with equal expected numbers
for each language: about SAMPLE, at most 4 * SAMPLE, a documented bound on what the driver holds (DIMENSIONS * 4 bytes each).
Languages that the sample holds can be predicted; with more than SAMPLE / 2 of them two texts each are expected. All rows
are predicted.

Defined cases: null text or text without a letter is ``und`` with score 0; without a labelled row all texts are ``und``;
with one language all other texts are that language; repeated rows get equal predictions; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

DIMENSIONS, GRAMS = 4096, 3
SAMPLE = 1600
AMBIGUOUS = 0.05
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"

#: Bytes of letters: a-z, A-Z as a-z, and all beyond ASCII; all else separates words.
LETTERS = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def has_letter(text: bytes) -> bool:
    if any(65 <= b <= 90 or 97 <= b <= 122 for b in text[:64]):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def features(text: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", dtype=np.uint8).astype(np.uint32)
    h, counts = np.zeros(len(b), dtype=np.uint32), np.zeros(DIMENSIONS)
    with np.errstate(over="ignore"):
        for n in range(GRAMS):
            h = h[: len(b) - n] * np.uint32(0x01000193) + b[n:] + np.uint32(1 + n)
            slot = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
            counts += np.bincount(slot, minlength=DIMENSIONS)
    x = np.sqrt(counts)
    return (x / max(np.sqrt((x * x).sum()), 1e-9)).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 4:
        return np.array([[1 if i == 0 or not c >> (i - 1) & 1 else -1 for c in range(1, 2 ** (k - 1))] for i in range(k)])
    bits, rng, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None
    for _ in range(20):
        words = rng.choice([-1, 1], size=(k, bits))
        near = (words @ words.T - np.eye(k) * 10 * bits).max()
        mixed = (np.abs(words.sum(axis=0)) < k).all()
        if mixed and (best is None or near < best[0]):
            best = (near, words)
    return best[1] if best else rng.choice([-1, 1], size=(k, bits))


def fit(x: np.ndarray, y: np.ndarray, words: np.ndarray, rounds: int = 300, rate: float = 40.0, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, intercepts, bit weights) by full-batch gradient descent with momentum; languages weigh alike."""
    goal = words[y].astype(np.float32)
    share = (1.0 / np.bincount(y, minlength=len(words))[y]).astype(np.float32)[:, None] / len(words)
    w, b = np.zeros((x.shape[1], words.shape[1]), dtype=np.float32), np.zeros(words.shape[1], dtype=np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        pull = share * goal / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30)))
        dw, db = 0.9 * dw + x.T @ pull - ridge * w, 0.9 * db + pull.sum(axis=0)
        w, b = w + rate * 0.1 * dw, b + rate * 0.01 * db
    right = ((goal * (x @ w + b) > 0) * share).sum(axis=0)
    return w, b, np.maximum(right - 0.5, 1e-3)


class Model:
    def __init__(self, languages: list[str], words: np.ndarray, w: np.ndarray, b: np.ndarray, weight: np.ndarray):
        self.languages, self.words, self.w, self.b, self.weight = languages, words.astype(np.float32), w, b, (weight / weight.sum()).astype(np.float32)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) by weighted logistic loss against each codeword."""
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.weight).sum(axis=1) for word in self.words], axis=1)
        near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        share = near / near.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        two = np.sort(loss, axis=1)[:, :2]
        close = two[:, -1] - two[:, 0] < AMBIGUOUS if len(self.languages) > 1 else np.zeros(len(best), dtype=bool)
        return best, share[np.arange(len(best)), best], close


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array([features(t).tobytes() for t in as_bytes(batch, "text")], pa.binary())], names=["lang", "h", "x"])


def train(spark: SparkSession, labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """labelled: text and lang. None without a usable row. Reruns fit on the same texts in the same order."""
    usable = labelled.filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counts = usable.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("h").alias("n"))
    many = F.count("*").over(Window.partitionBy())  # a row a language
    rates = counts.select("_lang", F.least(F.lit(1.0), F.greatest(F.lit(2.0), F.lit(float(sample)) / many) / F.greatest("n", F.lit(1))).alias("_rate"))
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.join(rates, F.col("lang") == F.col("_lang")).filter(draw < F.col("_rate"))
    different = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = different.select("lang", "h", "text").mapInArrow(_sample, "lang string, h long, x binary").orderBy("h", "lang").limit(4 * sample).collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in rows])
    y = np.array([languages.index(r.lang) for r in rows])
    words = codewords(len(languages))
    return Model(languages, words, *fit(x, y, words))


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out (passed through), lang_pred, score, ambiguous, a row for each of docs."""
    sent = spark.sparkContext.broadcast(model)  # DIMENSIONS * bits * 4 bytes: 1.7 MB at a thousand languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in small_batches(batches, 2 << 20):
            texts = as_bytes(batch, "text")
            known = [i for i, t in enumerate(texts) if m is not None and t and has_letter(t)]
            langs, scores, close = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if known:
                found = m.decode(np.stack([features(texts[i]) for i in known]) @ m.w + m.b)
                for i, k, s, c in zip(known, *(f.tolist() for f in found), strict=True):
                    langs[i], scores[i], close[i] = m.languages[k], float(s), bool(c)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs), pa.array(scores, pa.float64()), pa.array(close)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, PREDICTED)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(rest == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict(spark, rows, train(spark, rows.filter("not held_out").select("text", "lang")))

"""Toxicity by compression distance: windows compressed with a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundtable.llm.common import discard, sliced, write_table
from soundtable.llm.simhash import word_blocks

#: Labelled documents of each class that a model is fitted on, at most.
SAMPLE_DOCS = 4000
#: Windows that one document gives to the dictionaries at most, spread over it; scores use all windows.
SAMPLE_WINDOWS = 64
#: Words in a window that trains, and in one that is scored.
TRAIN_WORDS, SCORE_WORDS = 8, 24
#: Bytes of ordinary text that both dictionaries begin with, and of the trained part that they end with.
COMMON_BYTES, TRAINED_BYTES = 1 << 20, 1 << 12
LEVEL = 10
#: Bytes by which a window must be shorter under the toxic dictionary to count as marked.
MARK_BYTES = 3


def windows(text: str, size: int):
    """Runs of `size` words, lower-cased, the last one shorter; a blank before and after."""
    rest: list[bytes] = []
    for block in word_blocks(text):
        rest += block
        for i in range(0, len(rest) - size + 1, size):
            yield b" " + b" ".join(rest[i : i + size]) + b" "
        rest = rest[len(rest) // size * size :]
    if rest:
        yield b" " + b" ".join(rest) + b" "


def _trained(samples: list[bytes], size: int) -> bytes:
    """The dictionary the library trains on the samples; their last bytes, where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Dictionaries:
    """Both share their beginning, so that ordinary text costs the same under either, and what differs is what was trained."""

    common: bytes
    toxic: bytes
    ordinary: bytes

    def compressors(self):
        def made(trained: bytes):
            content = zstandard.ZstdCompressionDict(self.common + trained, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)

        return made(self.toxic), made(self.ordinary)


def features(text: str, toxic, ordinary) -> list[float]:
    """Of the bytes saved in each window: mean, sum over the root of their number, share of marked windows, mean of the three best, log of the number."""
    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text, SCORE_WORDS)], dtype=float)
    if not len(saved):
        return [0.0] * 5
    best = np.sort(saved)[-3:].mean()
    return [float(x) for x in (saved.mean(), saved.sum() / np.sqrt(len(saved)), (saved >= MARK_BYTES).mean(), best, np.log(len(saved)))]


@dataclass
class ToxicityModel:
    dictionaries: Dictionaries | None
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    shift: float

    def score(self, values: list[float]) -> float:
        if self.dictionaries is None:
            return 0.0
        z = float((np.array(values) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]) - self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), 1e-2 * np.eye(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge, z.T @ (p - y) / len(y) + ridge @ w)
    return w, mean, scale


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on the calibration documents."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    last = logits[order[at + 1]] if at + 1 < len(y) else logits[order[at]] - 1.0
    return float((logits[order[at]] + last) / 2)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """A model fitted on the texts of at most sample_docs ids of each label.

    `labels` has the ids to learn from and their labels; an id with several counts as 1 if one of them is. Of each label
    the ids with the smallest hashes are drawn, so that the bound holds whatever repeats; only these narrow ids meet the
    driver and only texts under them leave their table, once. Seven of ten drawn ids give windows to the dictionaries;
    the others calibrate: a logistic model of their features and the cut with the best F1. Null ids, labels and texts do
    not count, nor do ids without a text. With no document of either label in either part the model knows nothing and
    scores 0.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    known = known.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")).join(texts.select("id"), "id", "left_semi")
    first = [known.where(F.col("label") == x).orderBy(F.xxhash64("id"), "id").limit(sample_docs) for x in (0, 1)]
    drawn = write_table(spark, first[0].union(first[1]).withColumn("fits", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) < 7), "drawn-ids")
    # A table with rows that repeat an id gives one of them, the least text.
    chosen = texts.join(F.broadcast(drawn), "id").groupBy("id", "label", "fits").agg(F.min("text").alias("text")).select("label", "fits", "text")
    sample = write_table(spark, chosen, "toxicity-sample")

    def cut(batches):
        for batch in sliced(batches, 2):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = list(windows(text, TRAIN_WORDS))
                found = found[:: max(1, -(-len(found) // SAMPLE_WINDOWS))]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["label", "window"])

    got = sample.where("fits").mapInArrow(cut, "label int, window binary").toPandas()
    # At most SAMPLE_WINDOWS for each of the drawn ids; in an order that does not depend on tasks.
    toxic, ordinary = (sorted(map(bytes, got.window[got.label == x]), key=lambda w: (xxhash.xxh64_intdigest(w), w)) for x in (1, 0))
    nothing = ToxicityModel(None, np.zeros(6), np.zeros(5), np.ones(5), 0.0)
    if not toxic or not ordinary:
        discard(spark, drawn, sample)
        return nothing
    second = ordinary[-min(len(toxic), max(1, len(ordinary) // 2)) :]
    common = b"".join(ordinary[: max(0, len(ordinary) - len(second))])[:COMMON_BYTES]
    made = Dictionaries(common, _trained(toxic, TRAINED_BYTES), _trained(second, TRAINED_BYTES))
    shared = spark.sparkContext.broadcast(made)

    def measure(batches):
        pair = shared.value.compressors()
        for batch in sliced(batches, 1):
            found = [features(x, *pair) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["label", "found"])

    held = sample.where("not fits").select("label", "text").mapInArrow(measure, "label int, found array<double>").toPandas()
    shared.destroy()
    discard(spark, drawn, sample)
    if held.label.nunique() < 2:
        return nothing
    x, y = np.array(held.found.tolist()), held.label.to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    weights, mean, scale = _logistic(x, y)
    return ToxicityModel(made, weights, mean, scale, _threshold((x - mean) / scale @ weights[:-1] + weights[-1], y))


def score(df: DataFrame, model: ToxicityModel, text: Column, keep: list[Column]) -> DataFrame:
    """The `keep` columns and `score` (0 to 1, the cut at 0.5) for each row of df.

    Only the text is an input; all its windows are compressed. A null or empty text has no window and gets the score
    of zero features. Rows may repeat; other columns are not read; a text is split into words a block at a time.
    """
    narrow = df.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    names = narrow.columns[:-1]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = shared.value
        pair = found.dictionaries.compressors() if found.dictionaries else None
        for batch in sliced(batches, len(names)):
            scores = [found.score(features(x.as_py(), *pair) if pair else []) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, "score"])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], T.StructField("score", T.DoubleType(), False)]))

"""WAVE files as rows of audio chunks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHUNKS = "program_id string, channel int, chunk_no long, frame0 long, rate double, samples array<float>, error string"

# Fixed values of the format: tags of integer, float and extensible samples.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def _parts(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """Name and body of each chunk of a RIFF file; bodies start at even places, the last may be cut short."""
    view, at = memoryview(data), 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def decode(data: bytes) -> tuple[float, np.ndarray]:
    """Rate and samples (frames x channels, float32, full scale 1). A ValueError says what is wrong with the file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    found = {}
    for name, body in _parts(data):
        found.setdefault(name, body)
    form = found.get(b"fmt ", b"")
    if len(form) < 16:
        raise ValueError("missing/invalid fmt chunk")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
    if tag == EXTENSIBLE and len(form) >= 26:
        tag = struct.unpack_from("<H", form, 24)[0]
    if channels == 0:
        raise ValueError("missing/invalid fmt chunk")
    body = found.get(b"data", b"")
    if not len(body):
        raise ValueError("no data chunk / empty audio")
    width = bits // 8
    if (tag, bits) not in {(PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
        raise ValueError("invalid bit depth")
    whole = np.frombuffer(body, np.uint8)[: len(body) // (width * channels) * width * channels]
    if tag == FLOAT:
        flat = whole.view(f"<f{width}").astype(np.float32)
    elif bits == 24:
        # Three bytes become the upper ones of four, which keeps the sign.
        wide = np.zeros((len(whole) // 3, 4), np.uint8)
        wide[:, 1:] = whole.reshape(-1, 3)
        flat = (wide.view("<i4").ravel() / 2.0**31).astype(np.float32)
    else:
        flat = (whole.view(f"<i{width}") / 2.0 ** (bits - 1)).astype(np.float32)
    return float(rate), flat.reshape(-1, channels)


def read_wav_corpus(spark: SparkSession, path: str, chunk_sec: float = 1.0) -> DataFrame:
    """Chunks of all channels of the files under `path` (files, folders or patterns).

    A file that cannot be decoded gives one row with only program_id (its path) and error; it fails no job. A task holds
    one file at a time, of 2 GB at most; its rows leave in batches of one chunk number.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rate, x = decode(bytes(content))
                except ValueError as why:
                    yield pd.DataFrame([(name, None, None, None, None, None, str(why))], columns=_NAMES)
                    continue
                step = max(1, round(rate * chunk_sec))
                for k, first in enumerate(range(0, len(x), step)):
                    part = x[first : first + step]
                    yield pd.DataFrame([(name, c, k, first, rate, np.ascontiguousarray(part[:, c]), None) for c in range(x.shape[1])], columns=_NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, CHUNKS)


_NAMES = [field.split()[0] for field in CHUNKS.split(", ")]

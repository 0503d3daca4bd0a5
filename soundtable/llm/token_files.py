"""Token ids in binary files whose document boundaries are Elias-Fano coded.

A file holds, in this order: the concatenated ids (little-endian, 2 bytes each if the vocabulary allows, else 4), the
coded end offsets of its documents, the coded document ids, and a JSON footer followed by its length (8 bytes).
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.llm.common import new_path, sliced, write_table
from soundtable.llm.files import committed, opened
from soundtable.llm.ranges import range_bounds, shard_count, shard_of

#: Ones between two entries of the select directory.
SELECT_STEP = 256
#: Bytes of text encoded at once.
ENCODE_BYTES = 1 << 22
#: Pieces of text whose ids a worker remembers (about 200 bytes each), and the bytes of the longest such piece.
MEMO_PIECES, MEMO_BYTES = 1 << 20, 48
#: New pieces that go to the library as one text.
JOINED = 128

# No match of the byte-level splitting pattern spans the place between a non-blank and a space or line end, nor that
# between a letter and a punctuation mark, and none looks ahead past it: both sides get the ids they have in the whole text.
_LETTER, _OTHER, _MARK, _BLANK, _HIGH = 1, 2, 3, 4, 5


def _kind(byte: int) -> int:
    """Of a byte of UTF-8; 0: neither end of a safe place."""
    if byte >= 0x80:
        return _HIGH
    if chr(byte) in " \n":
        return _BLANK
    return 0 if byte <= 0x20 or byte == 0x7F else _LETTER if chr(byte).isalpha() else _OTHER if chr(byte).isdigit() else _MARK


_KINDS = bytes(map(_kind, range(256)))
# By the kinds of two neighbouring bytes: 1 for a safe place between them, 2 if what ends before it decides.
_PLACES = bytearray(256)
for _before in (_LETTER, _OTHER, _MARK):
    _PLACES[_before << 3 | _BLANK] = 1
_PLACES[_LETTER << 3 | _MARK] = 1
_PLACES[_HIGH << 3 | _BLANK] = _PLACES[_HIGH << 3 | _MARK] = 2
_PLACES = bytes(_PLACES)
# The blanks beyond ASCII, their last three bytes or two of them.
_WIDE = np.sort([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_NARROW = (0xC285, 0xC2A0)


def safe_places(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Ascending places in the UTF-8 texts that end at `ends`: 0, these ends, and the safe places between them."""
    marks = np.zeros(len(data) + 1, np.uint8)
    if data:
        kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
        marks[1:-1] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(_PLACES), np.uint8)
        at, found = np.flatnonzero(marks == 2), np.frombuffer(data, np.uint8)
        last, two = found[at - 1].astype(np.int32), found[at - 2].astype(np.int32) << 8
        latin = (two == 0xC300) & (last != 0x97) & (last != 0xB7)  # all of these are letters
        two |= last
        blank = (two == _NARROW[0]) | (two == _NARROW[1]) | np.isin(two | found[at - 3].astype(np.int32) << 16, _WIDE)
        marks[at] = latin | (kinds[at] == _BLANK) & ~blank
    marks[0] = 1
    marks[ends] = 1
    return np.flatnonzero(marks)


MANIFEST = "shard int, path string, n_docs long, n_tokens long, bytes long"


@dataclass
class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(universe / n) bits each.

    `low` has the lowest low_bits of each value, packed; `high` marks value i by a one at place (value >> low_bits) + i;
    `select` holds the place of each SELECT_STEP-th one.
    """

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    select: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        marks = np.zeros(int(places[-1]) + 1, np.uint8)
        marks[places] = 1
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(marks, bitorder="little"), places[::SELECT_STEP])

    def __getitem__(self, i: int) -> int:
        """Value i: the directory leads to the nearest marked one before it, at most SELECT_STEP ones are counted from there."""
        place = int(self.select[i // SELECT_STEP])
        left, byte = i % SELECT_STEP, place >> 3
        word = int(self.high[byte]) & (0xFF << (place & 7)) & 0xFF
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        upper = (byte << 3) + (word & -word).bit_length() - 1 - i
        lower = 0
        for bit in range(self.low_bits):
            at = i * self.low_bits + bit
            lower |= (int(self.low[at >> 3]) >> (at & 7) & 1) << bit
        return upper << self.low_bits | lower

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.uint64)
        lower = (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits) | lower

    def dump(self, out) -> dict:
        for part in (self.low, self.high, self.select.astype("<u8")):
            out.write(part.tobytes())
        return {"n": self.n, "low_bits": self.low_bits, "sizes": [self.low.nbytes, self.high.nbytes, 8 * len(self.select)]}

    @classmethod
    def load(cls, source, at: int, about: dict) -> EliasFano:
        parts = []
        for size in about["sizes"]:
            source.seek(at)
            parts.append(source.read(size))
            at += size
        return cls(about["n"], about["low_bits"], np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u8"))


class TokenFileWriter:
    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.ends, self.doc_ids, self.nulls, self.total = out, id_bytes, [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian, id_bytes each. Documents come in ascending order of doc_id, nulls first."""
        self.out.write(ids)
        self.total += len(ids) // self.id_bytes
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> None:
        base = self.doc_ids[0] if self.doc_ids else 0
        at = self.total * self.id_bytes
        ends = EliasFano.of(np.array(self.ends, dtype=np.uint64)).dump(self.out)
        ids = EliasFano.of(np.array([x - base for x in self.doc_ids], dtype=np.uint64)).dump(self.out)
        footer = json.dumps({"id_bytes": self.id_bytes, "n_docs": len(self.ends), "n_tokens": self.total, "null_ids": self.nulls, "base": base, "ends_at": at, "ends": ends, "ids_at": at + sum(ends["sizes"]), "ids": ids}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little"))


class TokenFile:
    """Random access by document number, from 0 in file order."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 8)
        length = int.from_bytes(source.read(8), "little")
        source.seek(size - 8 - length)
        self.about = json.loads(source.read(length))
        self.ends = EliasFano.load(source, self.about["ends_at"], self.about["ends"])
        self.doc_ids = EliasFano.load(source, self.about["ids_at"], self.about["ids"])

    def __len__(self) -> int:
        return self.about["n_docs"]

    def span(self, i: int) -> tuple[int, int]:
        return self.ends[i - 1] if i else 0, self.ends[i]

    def doc_id(self, i: int) -> int | None:
        i -= self.about["null_ids"]
        return None if i < 0 else self.about["base"] + self.doc_ids[i]

    def ids(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        width = self.about["id_bytes"]
        self.source.seek(start * width)
        return np.frombuffer(self.source.read((end - start) * width), dtype=f"<u{width}")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class PieceEncoder:
    """Encodes texts by a byte-level tokenizer into bytes (little-endian, `width` each), every piece between safe places
    once for as long as it is remembered: common words repeat, and the library's time goes into splitting and merging.

    Only the different pieces of a call become Python objects: Arrow numbers them, and puts their ids in the places of
    their numbers. Pieces are remembered in two generations: when the younger is full, it becomes the older, and what was
    the older and not asked for since is forgotten.
    """

    def __init__(self, found, width: int):
        self.found, self.dtype, self.young, self.old = found, f"<u{width}", {}, {}
        vocabulary = found.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id starts with a space byte
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        spelt = [text.encode() for text in texts]
        data, ends = b"".join(spelt), np.cumsum([len(x) for x in spelt], dtype=np.int64)
        if not data:
            return [b""] * len(texts)
        places = safe_places(data, ends)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        if len(self.young) > MEMO_PIECES // 2:
            self.young, self.old = {}, self.young
        own = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in own if p not in self.young]
        self._learn(new)
        coded = pa.array(list(map(self.young.__getitem__, own)), pa.large_binary()).take(pieces.indices)
        for piece in new:
            if len(piece) > MEMO_BYTES:
                del self.young[piece]
        _, offsets, ids = coded.buffers()
        at = np.frombuffer(offsets, np.int64, len(coded) + 1, coded.offset * 8)[np.searchsorted(places, [0, *ends])].tolist()
        whole = memoryview(ids) if ids is not None else memoryview(b"")
        return [bytes(whole[i:j]) for i, j in pairwise(at)]

    def _learn(self, new: list[bytes]) -> None:
        # Pieces with one blank, a space in front, go to the library together: their ids part where an id starts with a space.
        simple, others = [], []
        for p in new:
            again = self.old.get(p)
            if again is not None:
                self.young[p] = again
            else:
                text = p.decode()
                (simple if text[0] == " " and text.split() == [text[1:]] else others).append(text)
        together = [simple[k : k + JOINED] for k in range(0, len(simple), JOINED)]
        size = int(self.dtype[-1])
        for group, coded in zip(together, self._library(["".join(group) for group in together]), strict=True):
            ids = np.array(coded.ids)
            data, starts = ids.astype(self.dtype).tobytes(), (np.flatnonzero(self.opens[ids]) * size).tolist()
            if len(starts) != len(group):
                raise ValueError("the tokenizer does not part words at spaces")
            starts.append(len(data))
            self.young.update(zip(map(str.encode, group), [data[a:b] for a, b in pairwise(starts)], strict=True))
        for piece, coded in zip(others, self._library(others), strict=True):
            self.young[piece.encode()] = np.array(coded.ids, dtype=self.dtype).tobytes()

    def _library(self, texts: list[str]) -> list:
        return self.found.encode_batch_fast(texts, add_special_tokens=False)


@lru_cache(maxsize=2)
def piece_encoder(tokenizer_file: str, width: int) -> PieceEncoder:
    """One for each worker process, so that what a task has learnt serves the next."""
    return PieceEncoder(tokenizer(tokenizer_file), width)


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the documents' ids in ascending order of id and returns the manifest (shard, path, n_docs, n_tokens, bytes), a row for each file.

    Each text (null: empty) is encoded whole without special tokens, and end_id is appended. The tokenizer is byte-level,
    with the usual splitting pattern (a word takes the space before it). Rows are dealt to shards by ranges of the id
    (rows that share it by a hash of the text) and sorted, so file k + 1 goes on where file k ends; null ids come first.
    Where a shard begins follows from the rows alone, so the same rows make the same files. An empty table makes no file. Other columns are not read. A task streams ids to its file and holds one offset
    for each document; a repeated task writes the same bytes again and renames them over the first.
    """
    folder = path or new_path(spark, "tokens")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    place = [F.coalesce(F.col("doc_id"), F.lit(-(2**63))), F.xxhash64("text")]
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bounds = range_bounds(rows.select(place[0].alias("a"), place[1].alias("b")), count, shard_count(size + 16 * count))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), shard_of(*place, bounds).alias("shard"))
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches):
        found = tokenizer(tokenizer_file)
        width = 2 if max(found.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        batches = sliced(batches, 1, ENCODE_BYTES)
        batch = next(batches, None)
        if batch is None:
            return
        shard = batch.column(3)[0].as_py()  # that of all rows of the task
        name = f"{folder}/shard-{shard:06d}.tokens"
        encoder, end = piece_encoder(tokenizer_file, width), end_id.to_bytes(width, "little")
        with committed(name) as out:
            writer = TokenFileWriter(out, width)
            while batch is not None:
                for doc_id, coded in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, coded + end)
                batch = next(batches, None)
            writer.close()
            done = out.tell()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_docs": len(writer.ends), "n_tokens": writer.total, "bytes": done}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())]))

    return write_table(spark, rows.mapInArrow(run, MANIFEST), "tokens-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, number) for each document, read from the files of a manifest.

    start counts the ids of all files and documents before; it comes from the file's coded boundaries and the manifest's
    running total, which has a row for each file. ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0))).select("shard", "path", "base")
    files = files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as source:
                    file = TokenFile(source)
                    for first in range(0, len(file), 4096):
                        out = []
                        for i in range(first, min(first + 4096, len(file))):
                            start, end = file.span(i)
                            crc = zlib.crc32(file.ids(i).astype("<u4").tobytes())
                            out.append({"doc_id": file.doc_id(i), "start": row["base"] + start, "n_tokens": end - start, "ids_crc32": crc, "shard": row["shard"], "number": i})
                        yield pa.RecordBatch.from_pylist(out, schema=_READ)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, number long")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("number", pa.int64())])

"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundtable.llm.common import sliced

#: Characters after which a long text is cut at the next safe boundary.
SEGMENT_CHARS = 1 << 16
#: Decoded bytes after which a batch goes back to the JVM.
BATCH_BYTES = 4 << 20

# After a letter or digit, before a blank or common punctuation: no match of the splitting pattern spans such a
# place, and none looks ahead past it, so both sides split as they do in the whole text.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n.,;:!?。，、！？])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("rank_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, target: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in pieces of about `target` characters, cut only at safe boundaries; one piece where there is none."""
    start = 0
    while len(text) - start > target:
        cut = _SAFE.search(text, start + target)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, target: int = SEGMENT_CHARS) -> list[int]:
    if len(text) <= target:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in segments(text, target):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), segment_chars: int = SEGMENT_CHARS, decoded: bool = False) -> DataFrame:
    """The `keep` columns and `ids` (array<int>), one row for each row of df; with `decoded`, also what the ids decode to.

    `decoded` is what decode() would add; the same worker does it, so that the ids need not go to another one.

    A null text counts as empty and gets an empty array. Special tokens are ordinary text. Rows may repeat, ids may be
    null or tie: each row stands alone. Other columns are not read, so their names cannot clash. A text is held whole
    by one task, but encoded in segments. `keep` must not name a column "ids" or "decoded".
    """
    if {"ids", "decoded"} & set(keep):
        raise ValueError("ids and decoded are names of results")
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    raw = [T.StructField("decoded", T.BinaryType(), False)] if decoded else []
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), *raw])

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in sliced(batches, len(keep)):
            parts, back = [], []
            for text in batch.column(len(keep)):
                ids = encode_text(enc, text.as_py(), segment_chars)
                parts.append(np.asarray(ids, dtype=np.int32))
                if decoded:
                    back.append(enc.decode_bytes(ids))
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            columns = [*batch.columns[: len(keep)], lists, *([pa.array(back, pa.binary())] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded` (binary), the raw bytes of the ids, which need not be whole UTF-8. Null ids decode to no bytes; an id the file lacks fails the job."""
    if "decoded" in df.columns:
        raise ValueError("a column has the name of the result, decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType(), False)])
    at = df.columns.index(ids_col)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            first, parts, size = 0, [], 0
            for i in range(batch.num_rows):
                parts.append(enc.decode_bytes(batch.column(at)[i].values.to_pylist()) if batch.column(at)[i].is_valid else b"")
                size += len(parts[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(parts)) for c in batch.columns), pa.array(parts, pa.binary())], names=schema.names)
                    first, parts, size = i + 1, [], 0

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """What encode and decode made, as n_tokens and digests instead of ids and decoded; other columns stay. Empty arrays
    have the digest of nothing; null ids have n_tokens -1 and null digests; an empty table stays empty."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(ids, 256), "decoded_sha256": F.sha2(F.col("decoded"), 256)}
    ).drop("ids", "decoded")

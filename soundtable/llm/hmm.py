"""Hidden Markov language model: Baum-Welch counts from all partitions, exact likelihoods by the scaled forward recursion.

Every training word ends up with emissions of its own, and so does the end of a text. Words are read once: a task turns
its texts into blocks of word numbers with the block's own word list, and counts, training and scoring work on blocks.

* Frequent words (at least a share of 1/SHARE of the training tokens, so at most SHARE of them) are known to the driver
  and all tasks. In all iterations but the last the rarer ones share one emission (which of them it is says nothing about
  the state); nothing is joined or shuffled there but sums.
* The last iteration also gathers, for every rarer word, the expected counts of each state. A block sends one row for
  each of its words, its posterior shares in steps of 1/255, and Spark adds them up by word.
* For scoring, the blocks' rarer words meet these counts in a join.

A state's emissions are smoothed so that all states together follow the add-one unigram; an unknown word has its add-one
probability in each.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundtable.llm.common import SLICE_BYTES, discard, short_shuffles, sliced, text_or_empty, write_table
from soundtable.llm.simhash import _BLANK, _LOWER

STATES = 8
ITERATIONS = 4
#: A word is sent to all tasks if it is at least this part of the training tokens (and occurs twice).
SHARE = 1 << 16
#: Tokens after which a training text is cut into a new sequence; every token trains. Likelihoods are of whole texts.
SEGMENT = 512
#: Tokens after which a block ends (with the text it is in), and those whose recursions run side by side.
BLOCK_TOKENS, SIDE_TOKENS = 1 << 21, 1 << 19
#: Tokens from which a text's likelihood is computed as a product of transfer matrices of its pieces: eight times the
#: work of the recursion, but fewer steps than a text has tokens.
LONG = 8192
#: The symbol of all words that are not frequent.
RARE = 0
_SHARES = 255
_BLANK_BYTES = b" \t\n\v\f\r"
_BLANKS = bytes(b in _BLANK_BYTES for b in range(256))


@dataclass
class Hmm:
    initial: np.ndarray
    #: Share of the states among all tokens: where a later piece of a training text begins.
    usual: np.ndarray
    transition: np.ndarray
    #: symbols x states
    emission: np.ndarray

    def single(self) -> Hmm:
        return Hmm(*(x.astype(np.float32) for x in (self.initial, self.usual, self.transition, self.emission)))


def _steps(lengths: np.ndarray):
    """For lengths in descending order: how many sequences reach each position."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right") if len(lengths) else []


def expectations(model: Hmm, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, slots: np.ndarray | None = None, n_slots: int = 0):
    """Baum-Welch counts of sequences ids[start : start + length]; `first` marks those that begin a text.

    Emissions are counted by symbol, or by `slots`, which has a number under n_slots for each place of ids.
    """
    slots, n_slots = (ids, len(model.emission)) if slots is None else (slots, n_slots)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, first = starts[order], lengths[order], first[order]
    active = _steps(lengths)
    alphas, scales, emits, places = [], [], [], []
    onward = model.transition.T.copy()
    for t, n in enumerate(active):
        at = starts[:n] + t
        alpha = np.where(first, model.initial[:, None], model.usual[:, None]) if t == 0 else onward @ alphas[-1][:, :n]
        emit = _columns(model.emission, ids[at])
        alpha *= emit
        scale = alpha.sum(axis=0)
        alpha /= scale
        alphas.append(alpha)
        scales.append(scale)
        emits.append(emit)
        places.append(at)
    states = len(model.initial)
    moved, begun, beta, gammas = np.zeros((states, states)), np.zeros(states), np.ones((states, 0), model.emission.dtype), [None] * len(active)
    for t in range(len(active) - 1, -1, -1):
        if active[t] > beta.shape[1]:
            beta = np.concatenate([beta, np.ones((states, active[t] - beta.shape[1]), beta.dtype)], axis=1)
        gammas[t] = alphas[t] * beta
        if t:
            ahead = emits[t]
            ahead *= beta
            ahead /= scales[t]
            moved += alphas[t - 1][:, : active[t]] @ ahead.T
            beta = model.transition @ ahead
        else:
            begun = gammas[0][:, first].sum(axis=1)
    gamma, flat = np.concatenate(gammas, axis=1), slots[np.concatenate(places)]
    emitted = np.stack([np.bincount(flat, weights=g, minlength=n_slots) for g in gamma], axis=1)
    return begun, moved * model.transition, emitted


def _columns(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """states x rows: recursions keep the states first, so that a step works on long rows."""
    return np.ascontiguousarray(table.take(rows, axis=0).T)


def log_likelihoods(model: Hmm, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each sequence, exact."""
    out = np.zeros(len(lengths))
    long = lengths >= LONG
    for i in np.flatnonzero(long):
        out[i] = _long_likelihood(model, ids[starts[i] : starts[i] + lengths[i]])
    order = np.flatnonzero(~long)
    order = order[np.argsort(-lengths[order], kind="stable")]
    begin, alpha, total = starts[order], None, np.zeros(len(order))
    onward = model.transition.T.copy()
    for t, n in enumerate(_steps(lengths[order])):
        emit = _columns(model.emission, ids[begin[:n] + t])
        alpha = model.initial[:, None] * emit if t == 0 else (onward @ alpha[:, :n]) * emit
        scale = alpha.sum(axis=0)
        alpha /= scale
        total[:n] += np.log(scale)
    out[order] = total
    return out


def _long_likelihood(model: Hmm, ids: np.ndarray) -> float:
    """The same recursion for one long sequence: its pieces' transfer matrices side by side, scaled at each step, then one after the other."""
    alpha = model.initial * model.emission[ids[0]]
    total = np.log(alpha.sum())
    alpha, rest = alpha / alpha.sum(), ids[1:]
    size = max(1, int(len(rest) ** 0.5))
    whole = len(rest) // size
    table, logs = np.broadcast_to(np.eye(len(alpha)), (whole, len(alpha), len(alpha))), np.zeros(whole)
    pieces = rest[: whole * size].reshape(whole, size)
    for t in range(size):
        table = (table @ model.transition) * model.emission[pieces[:, t]][:, None, :]
        scale = table.sum(axis=(1, 2))
        table, logs = table / scale[:, None, None], logs + np.log(scale)
    for piece, log in zip(table, logs, strict=True):
        alpha = alpha @ piece
        total += log + np.log(alpha.sum())
        alpha = alpha / alpha.sum()
    for symbol in rest[whole * size :]:
        alpha = (alpha @ model.transition) * model.emission[symbol]
        total += np.log(alpha.sum())
        alpha = alpha / alpha.sum()
    return float(total)


def starting_emissions(counts: np.ndarray, hashes: np.ndarray, states: int) -> np.ndarray:
    """The words' frequencies disturbed by fixed noise, drawn from the word's hash, to tell the states apart."""

    def uniform(draw):
        with np.errstate(over="ignore"):
            z = hashes.view(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * draw[None, :]
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)

    k = np.arange(states, dtype=np.uint64)
    noise = np.sqrt(-2 * np.log(uniform(2 * k + np.uint64(1)))) * np.cos(2 * np.pi * uniform(2 * k + np.uint64(2)))
    return (counts[:, None] + 0.5) * np.exp(noise)


@dataclass
class Shared:
    """What all tasks get for scoring: bounded, whatever the input."""

    initial: np.ndarray
    transition: np.ndarray
    #: Expected tokens of each state.
    tokens: np.ndarray
    #: Training tokens and distinct ones.
    total: int
    distinct: int
    #: Emissions and counts of the symbols.
    emission: np.ndarray
    counts: np.ndarray

    def emissions(self, expected: np.ndarray) -> np.ndarray:
        """Of words with these expected counts by state: in the sum over the states, each word is met once more."""
        part = np.divide(expected * self.total, self.tokens, out=np.zeros_like(expected), where=self.tokens > 0)
        return (part + 1) / (self.total + self.distinct + 1)


# ---- blocks


def encode_blocks(rows: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of texts; `rows` has columns to keep, then whether the row trains, then its text.

    (block, docs, low, middle, high, words, counts): for each text what is kept and its number of words; a number for
    each word of the texts, in three planes of bytes; the word of each number, frequent ones first, and how often the
    training texts have it.
    """
    names = rows.columns[:-1]
    doc = T.StructType([*rows.schema.fields[:-1], T.StructField("__n", T.IntegerType())])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(doc)), *(T.StructField(c, T.BinaryType()) for c in ("low", "middle", "high")), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def block(number: int, kept: list[pa.RecordBatch], sizes: list[np.ndarray], ids: list[np.ndarray], own: dict[bytes, int]) -> pa.RecordBatch:
        lengths, flat = np.concatenate(sizes).astype(np.int32), np.concatenate(ids)
        table = pa.Table.from_batches(kept).combine_chunks()
        trains = np.repeat(table.column(len(names) - 1).to_numpy().astype(bool), lengths)
        order = np.argsort(-np.bincount(flat, minlength=len(own)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        counts = np.bincount(flat[trains], minlength=len(own))[order]
        planes = rank[flat].astype("<u4").view(np.uint8).reshape(-1, 4)
        if len(own) >= 1 << 24:
            raise ValueError("a text has too many different words for a block")
        fields = [*(table.column(c).combine_chunks() for c in range(len(names))), pa.array(lengths)]
        fields = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in fields]
        docs = pa.StructArray.from_arrays(fields, names=[*names, "__n"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [pa.array([number], pa.int64()), one(docs), *(pa.array([planes[:, j].tobytes()], pa.binary()) for j in range(3)), one(pa.array(list(own), pa.binary()).take(pa.array(order))), one(pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        kept, sizes, ids, size, own = [], [], [], 0, _numbering()
        for batch in sliced(batches, len(names)):
            numbers, spelt, lengths = word_numbers(batch.column(len(names)).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
            ends, first, taken = np.cumsum(lengths + 1), 0, 0
            while first < batch.num_rows:
                last = min(batch.num_rows, int(np.searchsorted(ends, taken + block_tokens - size)) + 1)
                mine = numbers[taken - first : ends[last - 1] - last]
                used, renamed = np.flatnonzero(np.bincount(mine, minlength=len(spelt))), np.zeros(len(spelt), np.int32)
                renamed[used] = np.fromiter((own[spelt[i]] for i in used.tolist()), np.int32, len(used))
                kept.append(batch.select(names).slice(first, last - first))
                sizes.append(lengths[first:last])
                ids.append(renamed[mine])
                size, taken, first = size + int(ends[last - 1]) - taken, int(ends[last - 1]), last
                if size >= block_tokens:
                    yield block(number, kept, sizes, ids, own)
                    number, kept, sizes, ids, size = number + 1, [], [], [], 0
                    own.clear()
            pa.default_memory_pool().release_unused()  # else the worker keeps it beside what comes after
        if kept:
            yield block(number, kept, sizes, ids, own)

    return rows.mapInArrow(run, schema)


def _numbering() -> defaultdict:
    """Numbers its keys in the order in which they are asked for."""
    own = defaultdict()
    own.default_factory = own.__len__
    return own


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A number for each lower-cased word of the texts, the word of each number, and how many words each text has.

    Arrow numbers the words of some megabytes at once, so that only the different ones become Python objects.
    """
    data, own, numbers = b" ".join(texts) + b" ", _numbering(), [np.zeros(0, np.int32)]
    ends, below, at = np.cumsum([len(t) + 1 for t in texts]), np.zeros(len(texts), np.int64), 0
    while at < len(data):
        cut = _BLANK.search(data, at + SLICE_BYTES)
        part = data[at : cut.end() if cut else len(data)]  # ends with a blank
        edges = np.flatnonzero(np.diff(np.frombuffer(part.translate(_BLANKS), np.uint8), prepend=np.uint8(1)))
        starts, stops = edges[::2], edges[1::2]
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(stops - starts)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(part.translate(_LOWER, _BLANK_BYTES))]).dictionary_encode()
        spelt = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers.append(np.fromiter(map(own.__getitem__, spelt), np.int32, len(spelt))[coded.indices.to_numpy()])
        below += np.searchsorted(starts, ends - at)
        at += len(part)
    return np.concatenate(numbers), list(own), np.diff(below, prepend=0)


def _symbols(row: dict, vocabulary: pa.Array) -> np.ndarray:
    """The symbol of each of the block's own words: its place in the vocabulary, from 1."""
    found = pc.index_in(row["words"], value_set=vocabulary.cast(row["words"].type))
    return pc.fill_null(found, RARE - 1).to_numpy(zero_copy_only=False) + np.int32(1)


def _tokens(row: dict, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of a block with `end` after each text, and where each text starts and how long it is."""
    planes = [np.frombuffer(row[c], np.uint8).astype(np.int32) for c in ("low", "middle", "high")]
    numbers = planes[0] | planes[1] << 8 | planes[2] << 16
    sizes = lengths.astype(np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    out = np.full(len(numbers) + len(lengths), end, np.int32)
    out[np.arange(len(numbers)) + np.repeat(np.arange(len(lengths)), lengths)] = numbers
    return out, starts, sizes


def _row(batch, i: int) -> dict:
    return {name: batch.column(name)[i].as_buffer() for name in ("low", "middle", "high")} | {"words": batch.column("words")[i].values}


def _docs(batch, i: int) -> pa.StructArray:
    return batch.column("docs")[i].values


# ---- training


def train(spark: SparkSession, blocks: DataFrame, vocabulary: dict[bytes, int], start: Hmm, counts: np.ndarray, iterations: int):
    """Baum-Welch over the training texts of all blocks: begun, moved and emitted counts of the last iteration, the model
    that gave them, and a written table (word, c, shares) of all training words that are not in the vocabulary; c is exact.

    A task sums the expected counts of its blocks; Spark adds them up by symbol. `shares` holds a byte for each state.
    """
    states = len(start.initial)
    columns, end = [f"s{k}" for k in range(states)], len(vocabulary) + 1
    schema = "kind int, at long, " + ", ".join(f"{c} double" for c in columns) + ", word binary, c long"
    chosen, model, last = ["docs.__train", "docs.__n", "low", "middle", "high", "words"], start, None
    for iteration in range(max(1, iterations)):
        untied = iteration + 1 == max(1, iterations)
        shared = spark.sparkContext.broadcast((model.single(), vocabulary))

        def run(batches, shared=shared, untied=untied):
            now, words = shared.value
            words, total = pa.array(list(words), pa.binary()), None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = _row(batch, i)
                    numbers, starts, lengths = _tokens(row, batch.column("__n")[i].values.to_numpy(), len(row["words"]))
                    trains = batch.column("__train")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                    symbol = np.append(_symbols(row, words), end)
                    slot = np.where(symbol == RARE, end + 1 + np.arange(len(symbol)), symbol) if untied else symbol
                    found = _block_counts(now, symbol[numbers], starts[trains], lengths[trains], slot[numbers], int(end + 1 + len(symbol)) if untied else end + 1)
                    if found is None:
                        continue
                    if untied:
                        counted = np.where(symbol[:-1] == RARE, batch.column("counts")[i].values.to_numpy(), 0)
                        yield _rare_rows(found[2][end + 1 : -1], counted, row["words"])
                        found = (*found[:2], found[2][: end + 1])
                    total = found if total is None else tuple(x + y for x, y in zip(total, found, strict=True))
            if total is not None:
                used = np.flatnonzero(total[2].sum(axis=1))
                table = np.vstack([total[0][None, :], total[1], total[2][used]])
                kinds = np.repeat(np.arange(3, dtype=np.int32), [1, states, len(used)])
                at = np.concatenate([[0], np.arange(states), used]).astype(np.int64)
                none = [pa.nulls(len(at), kind) for kind in (pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(at), *(pa.array(table[:, k].copy()) for k in range(states)), *none], names=["kind", "at", *columns, "word", "c"])

        found = blocks.select(*chosen, *["counts"] * untied).mapInArrow(run, schema)
        last = write_table(spark, found, "expected-counts", "zstd") if untied else None
        sums = (last.where("kind < 3") if untied else found).groupBy("kind", "at").agg(*[F.sum(c).alias(c) for c in columns])
        with short_shuffles(spark):
            small = sums.toPandas()
        shared.destroy()
        begun, moved, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((end + 1, states))
        for kind, table in enumerate((begun[None, :], moved, emitted)):
            mine = small[small.kind == kind]
            table[mine["at"].to_numpy(dtype=int)] = mine[columns].to_numpy(dtype=float)
        if not untied:
            share = (counts + 0.5) / (counts + 0.5).sum()
            emission, usual = emitted + share[:, None], emitted.sum(axis=0) + 1.0
            model = Hmm(*_moves(begun, moved), emission / emission.sum(axis=0))
            model.usual = usual / usual.sum()
    # Each block sends a word once, so rows are not reduced before they leave; whole numbers add up alike in any order.
    rare = last.where("kind = 3").select("word", "c", *[F.col(c).cast("long").alias(c) for c in columns]).repartition("word")
    rare = rare.groupBy("word").agg(F.sum("c").alias("c"), *[F.sum(c).alias(c) for c in columns])
    code = [F.lpad(F.hex(F.round(F.col(c) / F.col("c")).cast("long")), 2, "0") for c in columns]
    rare = write_table(spark, rare.select("word", "c", F.unhex(F.concat(*code)).alias("shares")), "rare-words")
    discard(spark, last)
    return begun, moved, emitted, rare


def _moves(begun: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = (begun + 1.0) / (begun + 1.0).sum()
    return start, start, (moved + 1.0) / (moved + 1.0).sum(axis=1, keepdims=True)


def _block_counts(model: Hmm, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, slots: np.ndarray, n_slots: int):
    """Expected counts of a block's training texts, cut into segments; None without any."""
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[owner] + within * SEGMENT
    size = np.minimum(SEGMENT, lengths[owner] - within * SEGMENT)
    part, total = np.cumsum(size) // SIDE_TOKENS, None
    for p in np.unique(part):
        mine = part == p
        found = expectations(model, ids, begin[mine], size[mine], within[mine] == 0, slots, n_slots)
        total = found if total is None else tuple(x + y for x, y in zip(total, found, strict=True))
    return total


def _rare_rows(expected: np.ndarray, counts: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """A row for each word that is counted: how often it occurs, and that times each state's share in steps of 1/_SHARES."""
    used, states = np.flatnonzero(counts), expected.shape[1]
    c, sums = counts[used], expected[used].sum(axis=1, keepdims=True)
    shares = np.rint(np.divide(expected[used], sums, out=np.zeros((len(used), states)), where=sums > 0) * _SHARES) * c[:, None]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), 3, np.int32)), pa.nulls(len(used), pa.int64()), *(pa.array(shares[:, k].copy()) for k in range(states)), words.take(pa.array(used)), pa.array(c)], names=["kind", "at", *(f"s{k}" for k in range(states)), "word", "c"])


# ---- scores


def score_texts(spark: SparkSession, df: DataFrame, keep: dict[str, Column], trains: Column, text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS, share: int = SHARE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(the `keep` columns, n_tokens, n_known, train_tokens, base_score, score), one row for each row of df.

    Tokens are the lower-cased (A-Z) words and one end; the rows where `trains` is true are learnt from, a null text is
    empty. base_score is the add-one unigram score, score the model's log10 probability of the whole text. All words are
    counted; only frequent ones, whose number is bounded by `share`, go to the driver and all tasks, the rarer ones are
    tables. With no training row every word is unknown and scores are defined all the same. Rows may repeat, ids may be
    null; other columns are not read; `keep` may have any names. An empty table gives an empty result.
    """
    trained = F.coalesce(trains, F.lit(False))
    names, keep = list(keep), {f"k{i}": column for i, column in enumerate(keep.values())}  # no name meets one of ours
    rows = df.select(*[c.alias(n) for n, c in keep.items()], trained.alias("__train"), text_or_empty(text_col).alias("__text"))
    blocks = write_table(spark, encode_blocks(rows, block_tokens), "word-blocks", "zstd")
    listed = blocks.select(F.inline(F.arrays_zip("words", "counts"))).where("counts > 0")
    counted = write_table(spark, listed.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")), "word-counts")
    texts = blocks.agg(F.sum(F.size(F.filter("docs", lambda d: d["__train"])))).first()[0] or 0
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n + texts, v + (1 if texts else 0)
    often = counted.where((F.col("c") * share >= total) & (F.col("c") >= 2))
    frequent = often.withColumn("h", F.xxhash64("word")).toPandas()
    frequent = frequent.assign(word=[bytes(w) for w in frequent.word]).sort_values(["c", "word"], ascending=[False, True])
    vocabulary = {w: i + 1 for i, w in enumerate(frequent.word)}
    counts = np.array([n - int(frequent.c.sum()), *frequent.c, texts], dtype=float)
    even = np.full(states, 1 / states)
    # Neither the rare symbol nor the end tells states apart at the start.
    plain = np.repeat(counts[[0, -1]][:, None] + 0.5, states, axis=1)
    emission = np.concatenate([plain[:1], starting_emissions(counts[1:-1], frequent["h"].to_numpy(np.int64), states), plain[1:]])
    start = Hmm(even, even, 0.9 * np.eye(states) + 0.1 / states, emission / emission.sum(axis=0))
    begun, moved, emitted, rare = train(spark, blocks, vocabulary, start, counts, iterations)
    # Counts are the words' own; only how a word's occurrences divide between the states comes from the model.
    known = frequent_words(spark, vocabulary)
    byte = [F.conv(F.hex(F.substring("shares", k + 1, 1)), 16, 10).cast("long") for k in range(states)]
    others = rare.agg(*[F.coalesce(F.sum(F.col("c") * b), F.lit(0)) for b in byte]).first()
    tokens = emitted[1:].sum(axis=0) + np.array(others, dtype=float) / _SHARES
    initial, _, transition = _moves(begun, moved)
    now = Shared(initial, transition, tokens, total, distinct, emitted, counts)
    now.emission = now.emissions(emitted)
    now.counts[RARE] = 0
    own = blocks.select("block", F.posexplode("words").alias("local", "word")).join(known, F.col("word") == F.col("often"), "left_anti")
    met = write_table(spark, own.join(rare.hint("merge"), "word").select("block", "local", "c", "shares"), "block-words")
    discard(spark, rare, counted)
    run = _scoring(spark.sparkContext.broadcast((now, vocabulary)), list(keep))
    doc = blocks.schema["docs"].dataType.elementType.fields
    schema = T.StructType([*doc[: len(keep)], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = blocks.select("block", "docs", "low", "middle", "high", "words").groupBy("block").cogroup(met.groupBy("block")).applyInArrow(run, schema)
    return scored.select(*[F.col(k).alias(name) for k, name in zip(keep, names, strict=True)], "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def frequent_words(spark: SparkSession, vocabulary: dict[bytes, int]) -> DataFrame:
    """(often): the words of a vocabulary, whose number is bounded, to be sent to all tasks."""
    return F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "often binary"))


def _scoring(shared, kept: list[str]):
    """From a block and the counts of its rarer words to its texts' scores."""

    def run(left, right):
        now, vocabulary = shared.value
        left = left.combine_chunks().to_batches()[0]
        row, docs = _row(left, 0), _docs(left, 0)
        numbers, starts, lengths = _tokens(row, docs.field("__n").to_numpy(), len(row["words"]))
        symbol, first = np.append(_symbols(row, pa.array(list(vocabulary), pa.binary())), len(vocabulary) + 1), len(vocabulary) + 2
        c, expected = np.zeros(len(symbol)), np.zeros((len(symbol), len(now.tokens)))
        if right.num_rows:
            local = right["local"].to_numpy()
            c[local] = right["c"].to_numpy()
            packed = right["shares"].combine_chunks().cast(pa.binary(len(now.tokens)))
            packed = pa.concat_arrays(packed.chunks) if isinstance(packed, pa.ChunkedArray) else packed
            shares = np.frombuffer(packed.buffers()[1], np.uint8).reshape(-1, len(now.tokens))[packed.offset :][: len(local)]
            expected[local] = shares * (c[local] / _SHARES)[:, None]
        emission, count = np.concatenate([now.emission, now.emissions(expected)]), np.concatenate([now.counts, c])
        ids = np.where(symbol == RARE, first + np.arange(len(symbol)), symbol)[numbers]
        values = log_likelihoods(Hmm(now.initial, now.initial, now.transition, emission), ids, starts, lengths) / np.log(10)
        base = np.log10((count + 1) / (now.total + now.distinct + 1))
        sums = np.add.reduceat(np.stack([base[ids], count[ids] > 0]), starts, axis=1)
        names = [f.name for f in docs.type]
        return pa.table([*(docs.field(names.index(k)) for k in kept), pa.array(lengths), pa.array(sums[1].astype(np.int64)), pa.array(sums[0]), pa.array(values)], names=[*kept, "n_tokens", "n_known", "base_score", "score"])

    return run

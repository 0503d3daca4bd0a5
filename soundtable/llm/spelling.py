"""Spelling variants of words by an index of variable-length grams.

A word, set between two marks, is cut into grams: from each place the shortest gram that few words have (or one of the
greatest length), if no earlier gram holds it. An edit can change only the grams that hold its place and those that a new
gram before them might swallow; the rest of a word's grams are in every word one edit away, at most one place aside. So of
a word's grams, rarest first, one more than an edit can change are enough to meet every such word in the gram's list.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.llm.common import broadcast_within, discard, sliced, write_table

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A run of a document loses a code point where this divides its checksum.
SLIP = 97
#: Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Marks before and after a word.
START, END = "\x02", "\x03"
#: Lengths of grams; the greatest also is at most half of a word with its marks.
SHORTEST, LONGEST = 2, 8
#: Grams in more words than this are extended, or than a 131,072th of all gram places, so that they can be sent to all tasks.
FREQUENT, GRAMS = 32, 1 << 17
#: Entries of counts that a task holds before it sends them on.
HELD = 200_000


def runs_of(doc_id, text: str) -> Counter:
    """The lower-cased runs of a text with their counts, after the slips of the document."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), seed)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with their occurrences in whole texts (null: empty); a null id is the empty string."""

    def packed(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in sliced(batches, 1):
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                held.update(runs_of(doc_id.as_py(), text.as_py() or ""))
                if len(held) > HELD:
                    yield packed(held)
                    held = Counter()
        yield packed(held)

    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- grams


def longest_for(length: int) -> int:
    """The greatest length of grams for pairs whose shorter word has so many code points."""
    return max(SHORTEST, min(LONGEST, (length + 2) // 2))


def grams(marked: str, frequent, longest: int) -> list[tuple[int, int]]:
    """(begin, end) of the grams of a word with its marks: from each place the shortest that is not frequent or has the greatest
    length, at least SHORTEST, without those that an earlier one holds."""
    out, reach, n = [], 0, len(marked)
    for begin in range(n - SHORTEST + 1):
        end = begin + SHORTEST
        while end < n and end - begin < longest and marked[begin:end] in frequent:
            end += 1
        if end > reach:
            out.append((begin, end))
            reach = end
    return out


def most_affected(marked: str, found: list[tuple[int, int]], inner, longest: int) -> int:
    """How many of a word's grams one edit can change at most.

    A gram before the edit stays. One that holds its place may go. One behind it stays unless a gram that begins before it
    might now reach its end: then what lies between the edit and its last code point is the end of a frequent gram (in `inner`).
    """
    worst = 0
    for place in range(1, len(marked)):
        for behind in (place, place + 1) if place < len(marked) - 1 else (place,):
            # behind = place: something is put in before `place`; else the code point there is replaced or deleted.
            n = 0
            for begin, end in found:
                if begin >= behind:
                    n += end - 1 - behind <= longest - 2 and marked[behind : end - 1] in inner
                elif end > place:
                    n += 1
            worst = max(worst, n)
    return worst


def posted(word: str, frequent: dict[str, int], inner) -> Iterator[tuple[str, str, int]]:
    """(kind, gram, place) of the lists that a word is in.

    A kind is the greatest length of its grams: a word meets those of its length or one more in the lists for its own
    length, those one shorter in the lists for theirs. Words of which no gram is sure to stay meet each other by grams of
    the least length, of which some always stay.
    """
    marked = START + word + END
    for longest in sorted({longest_for(len(word)), longest_for(len(word) - 1)}):
        found = grams(marked, frequent, longest)
        changed = most_affected(marked, found, inner, longest)
        yield from _rarest(marked, found, changed, frequent, f"{longest}")
        if changed >= len(found):
            short = grams(marked, (), SHORTEST)
            yield from _rarest(marked, short, most_affected(marked, short, (), SHORTEST), frequent, f"{longest} short")


def _rarest(marked: str, found: list[tuple[int, int]], changed: int, frequent: dict[str, int], kind: str) -> Iterator[tuple[str, str, int]]:
    for _, _, gram, at in sorted((frequent.get(marked[i:j], 0), zlib.crc32(marked[i:j].encode()), marked[i:j], i) for i, j in found)[: changed + 1]:
        yield kind, gram, at


def gram_dictionary(spark: SparkSession, words: DataFrame) -> dict[str, int]:
    """The frequent grams of a table of different words with their counts, at most GRAMS of them."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                marked = START + word + END
                held.update(marked[i:j] for i in range(len(marked)) for j in range(i + SHORTEST, min(i + LONGEST, len(marked) + 1)))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "c"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "c"])

    counts = words.select("word").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    counts = write_table(spark, counts.where(F.col("c") > FREQUENT), "gram-counts")
    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    # Each length has at most so many places, so the grams above the bound are at most GRAMS.
    often = counts.where(F.col("c") * GRAMS > places * (LONGEST - SHORTEST)).toPandas()
    discard(spark, counts)
    return dict(zip(often["gram"], often["c"].tolist(), strict=True))


# ---- pairs


def near_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(a, na, b, nb), a < b, once for each pair of different words of (word, n) that are one inserted, deleted or replaced code point apart."""
    frequent = gram_dictionary(spark, words)
    shared = spark.sparkContext.broadcast((frequent, {g[i:] for g in frequent for i in range(1, len(g))}))

    def run(batches):
        frequent, inner = shared.value
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                some = batch.slice(part, 4096)
                lists, places, owners = [], [], []
                for at, word in enumerate(some.column(0).to_pylist()):
                    for kind, gram, place in posted(word, frequent, inner):
                        lists.append(xxhash.xxh64_intdigest(f"{kind} {gram}".encode()) - (1 << 63))
                        places.append(place)
                        owners.append(at)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(places, pa.int32()), *some.take(pa.array(owners, pa.int64())).columns], names=["list", "place", "word", "n"])

    lists = write_table(spark, words.select("word", "n").mapInArrow(run, "list long, place int, word string, n long"), "gram-lists")
    other = lists.select(F.col("list").alias("list_b"), F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1)).alias("place_b"), F.col("word").alias("b"), F.col("n").alias("nb"))
    met = (F.col("list") == F.col("list_b")) & (F.col("place") == F.col("place_b")) & (F.col("a") < F.col("b"))
    near = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    pairs = lists.withColumnsRenamed({"word": "a", "n": "na"}).join(other.hint("merge"), met & near).select("a", "na", "b", "nb")
    pairs = write_table(spark, pairs.distinct(), "near-words")
    shared.destroy()
    discard(spark, lists)
    return pairs


def follow(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) without cycles: the last word that forms lead to, by doubling what has been followed."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = broadcast_within(now.select(F.col("word").alias("via"), F.col("root").alias("on")))
        now = write_table(spark, now.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    Words are the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased, after each
    document's slips (see runs_of). Two are near if one inserted, deleted or replaced code point makes one of the other. A
    word's form is its most frequent near word (ties: first in code-point order) if that is at least twice as frequent as
    itself; the root is where forms end. Null and empty texts have no words; a null id counts as the empty string; repeated
    rows count each. Other columns are not read. An empty table gives no words.
    """
    words = write_table(spark, word_counts(df, id_col, text_col), "spelling-words")
    pairs = near_words(spark, words)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m"), F.col("na").alias("own")).union(pairs.select("b", "a", "na", "nb"))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near"))).alias("best"), F.max("own").alias("own"))
    takes = -F.col("best.less") >= 2 * F.col("own")
    best = best.select(F.col("word").alias("w"), "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    best = write_table(spark, best, "word-forms")
    roots = follow(spark, best.where("form IS NOT NULL").select(F.col("w").alias("word"), "form")).withColumnRenamed("word", "r")
    out = words.join(best, F.col("word") == F.col("w"), "left").join(roots, F.col("word") == F.col("r"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")

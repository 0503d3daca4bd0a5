"""Language identification by Bayesian evidence fusion: text, declared markup language, address suffix and host."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundtable.llm.common import broadcast_within, remove_rows, sliced, write_table

#: Labelled rows taken for each language, about (all, where there are fewer).
SAMPLE_ROWS = 2000
#: Hashed byte trigrams; the model has this many numbers for each language.
BUCKETS = 1 << 16
#: Trigrams whose mean evidence counts: neighbouring trigrams are not independent, so more do not make it surer.
EVIDENCE = 40
#: Rows that a level of the address is worth against the level above it.
PRIOR_ROWS = 20.0
#: The class of what is no language; its trigrams are all equally likely.
UNDETERMINED = "und"
#: Bytes scored at once.
_BLOCK = 1 << 20


#: Numbers, keys and addresses are no evidence of a language. Tried at starts of words only, without going back: linear in the text.
_NUMBERED = re.compile(r"(?<!\S)[^\s\d]*+\d\S*")


def _buckets(text: str):
    """Trigram buckets of the lower-cased bytes of a text's words without digits, a block at a time; a space stands before and after."""
    data = np.frombuffer(f" {_NUMBERED.sub(' ', text.lower())} ".encode(), np.uint8)
    for start in range(0, len(data) - 2, _BLOCK):
        part = data[start : start + _BLOCK + 2].astype(np.uint32)
        if len(part) > 2:
            code = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
            yield (code * np.uint32(2654435761)) >> np.uint32(16)


class TextModel:
    """Log-probabilities of trigrams by language; the last row is UNDETERMINED."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        smoothed = counts + 0.05
        table = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
        self.languages = [*languages, UNDETERMINED]
        self.table = np.vstack([table, np.full(BUCKETS, -np.log(BUCKETS))]).T.astype(np.float32).copy()

    def logits(self, text: str) -> tuple[np.ndarray, int]:
        """Mean log-likelihoods times the trigrams that count, and the number of trigrams; a text without a letter has none."""
        total, n = np.zeros(len(self.languages)), 0
        if any(map(str.isalpha, text)):
            for found in _buckets(text):
                total += self.table[found].sum(axis=0, dtype=np.float64)
                n += len(found)
        return total / max(n, 1) * min(n, EVIDENCE), n


def train(spark: SparkSession, labelled: DataFrame, text: Column, language: Column, key: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """A model of the languages named in `labelled`, fitted on about sample_rows whole texts of each, drawn by a hash of `key`.

    `key` should tell rows apart (default: the text, whose copies are then drawn together or not at all). Rows without a
    language or a text do not count. The counts come back as one row for each language and bucket, so
    their size is bounded whatever the input's. No labelled row: only UNDETERMINED is known.
    """
    rows = labelled.select(language.alias("language"), text.alias("text"), (text if key is None else key).alias("key")).where("language is not null and text is not null")
    sizes = rows.groupBy("language").count()
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(1_000_000.0) * sample_rows / F.col("count")
    drawn = rows.join(F.broadcast(sizes), "language").where(draw).select("language", "text")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in sliced(batches, 1):
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = counts.setdefault(language, np.zeros(BUCKETS, np.int64))
                for found in _buckets(text):
                    mine += np.bincount(found, minlength=BUCKETS)
        for language, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["language", "bucket", "n"])

    found = drawn.mapInArrow(run, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(found.language))
    counts = np.zeros((len(languages), BUCKETS))
    counts[found.language.map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int), found.bucket.to_numpy(dtype=int)] = found.n
    return TextModel(languages, counts)


def html_text(html: Column) -> Column:
    """The text of a page, roughly: without scripts, styles, comments and tags; what is not closed goes to the end of the page.

    "<" before anything but a letter, "/", "!" or "?" is text. Every match begins where it cannot fail later, so the
    time is linear in the page, whatever is in it. Null stays null.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)|<[a-z/!?][^>]*+(?:>|\z)", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"&[a-zA-Z#0-9]+;", " "), r"\s+", " ")


def declared_language(html: Column) -> Column:
    """The primary subtag that the html element declares, in lower case; null where there is none."""
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*+)", 1)
    said = F.lower(F.regexp_extract(tag, r"(?i)\slang\s*+=\s*+[\"']?([a-z]{2,3})\b", 1))
    return F.when(said != "", said)


def host(url: Column) -> Column:
    """The host of an address, in lower case and without user and port; empty where there is none, null for null."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _score(df: DataFrame, keys: dict[str, Column], text: Column, model: TextModel, declared: Column, place: Column) -> DataFrame:
    """keys, declared, host, suffix, n and for each class the text's evidence `ev` and posterior under equal priors `post`."""
    narrow = df.select(*[c.alias(k) for k, c in keys.items()], F.coalesce(declared, F.lit("")).alias("declared"), F.coalesce(place, F.lit("")).alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    names = narrow.columns[:-1]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = shared.value
        for batch in sliced(batches, len(names)):
            ev, post, n = [], [], []
            for x in batch.column(len(names)):
                logits, count = found.logits(x.as_py())
                p = np.exp(logits - logits.max())
                ev.append(logits.tolist())
                post.append((p / p.sum()).tolist())
                n.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(ev, pa.list_(pa.float64())), pa.array(post, pa.list_(pa.float64()))], names=[*names, "n", "ev", "post"])

    doubles = T.ArrayType(T.DoubleType())
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("ev", doubles), T.StructField("post", doubles)]))


def identify(spark: SparkSession, df: DataFrame, model: TextModel, keys: dict[str, Column], text: Column, declared: Column | None = None, place: Column | None = None) -> DataFrame:
    """(the keys, language, posterior, text_language, n), one row for each row of df.

    Keys may have any names. The evidence of a row: its text's trigrams; P(declared | language), the share of each declaration among the rows
    that look like a language; and the prior of its host, smoothed towards that of the host's suffix (what follows its
    last dot), which is smoothed towards that of all rows. All these shares are sums of text posteriors over all rows,
    by grouped aggregation; a row's own share is taken out of its host's. A missing declaration or address says nothing.
    A text without a letter, null or empty, is UNDETERMINED, with posterior 1 and no say in the shares. Rows may
    repeat; other columns are not read; an empty table gives an empty result. Texts stay where they are: scores are
    written, then joined with the shares.
    """
    missing = F.lit(None).cast("string")
    names = list(keys)
    keys = {f"__key{i}": key for i, key in enumerate(keys.values())}  # no name of a key meets one of ours
    scored = _score(df, keys, text, model, missing if declared is None else declared, missing if place is None else place)
    known = F.col("declared").isin(*model.languages) | (F.col("declared") == "")
    scored = scored.withColumns({"suffix": F.element_at(F.split("host", r"\."), -1), "declared": F.when(known, F.col("declared")).otherwise("other")})
    scored = write_table(spark, scored, "language-scores")
    classes = range(len(model.languages))
    voters = scored.where("n > 0")

    def shares(by: str, prefix: str) -> DataFrame:
        sums = [F.sum(F.col("post")[i]).alias(f"{prefix}{i}") for i in classes]
        return voters.groupBy(F.col(by).alias(f"{prefix}_by")).agg(*sums)

    # A host with many rows is summed by each task first; the tables of shares are narrow.
    hosts = broadcast_within(write_table(spark, shares("host", "h"), "host-shares"))
    suffixes = broadcast_within(write_table(spark, shares("suffix", "s"), "suffix-shares"))
    declarations = F.broadcast(shares("declared", "d"))  # known languages, "other" and none: bounded by the model
    total = voters.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"t{i}") for i in classes]).first()
    rows = sum(total)
    wide = scored.join(hosts, F.col("host") == F.col("h_by"), "left").join(suffixes, F.col("suffix") == F.col("s_by"), "left").join(declarations, F.col("declared") == F.col("d_by"), "left")
    value = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    of_suffix = sum((value(f"s{i}") for i in classes), F.lit(0.0))
    of_host = sum((value(f"h{i}") for i in classes), F.lit(0.0))
    logits = []
    for i in classes:
        overall = (total[i] + 1.0) / (rows + len(model.languages))
        suffix = (value(f"s{i}") + PRIOR_ROWS * overall) / (of_suffix + PRIOR_ROWS)
        own = F.when(F.col("n") > 0, F.col("post")[i]).otherwise(0.0)
        prior = (F.greatest(value(f"h{i}") - own, F.lit(0.0)) + PRIOR_ROWS * suffix) / (F.greatest(of_host - 1.0, F.lit(0.0)) + PRIOR_ROWS)
        saying = F.when(F.col("declared") == "", 0.0).otherwise(F.log((value(f"d{i}") + 0.5) / (total[i] + 0.5 * (len(model.languages) + 2))))
        logits.append(F.col("ev")[i] + F.log(prior) + saying)
    fused = wide.select(*keys, "n", "post", F.array(*logits).alias("logits"))
    name = F.array(*[F.lit(x) for x in model.languages])
    best = F.element_at(name, F.array_position("logits", F.array_max("logits")).cast("int"))
    weight = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logits")))
    by_text = F.element_at(name, F.array_position("post", F.array_max("post")).cast("int"))
    said = F.col("n") > 0
    return fused.select(*[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)], F.when(said, best).otherwise(UNDETERMINED).alias("language"), F.when(said, 1.0 / weight).otherwise(1.0).alias("posterior"), F.when(said, by_text).otherwise(UNDETERMINED).alias("text_language"), "n")


def identify_pages(spark: SparkSession, pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, language, posterior, text_language, n) of each page: `identify` over its text, the language that its html
    element declares and its address. A null page is an empty one, a null address says nothing; ids may be null or
    repeat, each row stands alone; other columns are not read; an empty table gives an empty result.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    return identify(spark, pages, model, {id_col: F.col(f"`{id_col}`")}, html_text(html), declared_language(html), host(F.col(f"`{url_col}`")))


def keep_identified(spark: SparkSession, docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs without the rows that are in no known language; the source stands for the host. Columns stay as they are.

    Null, empty and letterless texts are in none. Rows that repeat id, text and source share their fate; a null id or
    source is a value like any other. An empty table stays empty.
    """
    keys = {"id": F.col(f"`{id_col}`"), "hash": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), "origin": F.col(f"`{source_col}`")}
    found = identify(spark, docs, model, keys, F.col(f"`{text_col}`"), place=F.col(f"`{source_col}`"))
    gone = write_table(spark, found.where(F.col("language") == UNDETERMINED).select(*keys), "undetermined")
    return remove_rows(docs, gone, keys)

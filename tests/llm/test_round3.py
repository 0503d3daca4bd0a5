"""Names of any kind, exact counts, and runs as partitions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundtable.llm import common, decontamination, exact_dedup, hmm, language_id


@pytest.mark.parametrize("leaves", [9, 40])
def test_a_round_reads_a_fan_in_of_runs(spark, leaves):
    """Partitions are runs; what a partition gets in round r comes from the 16 runs that differ from it in digit r."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 700).cast("string").alias("text")).repartition(leaves)
    runs = exact_dedup.digest_runs(docs, "doc_id", "text")
    rounds = exact_dedup.rounds_for(runs)
    assert rounds == (1 if leaves <= 16 else 2)
    count = 16**rounds
    level = runs.select("digest", "n_bytes", "check_hash", (F.spark_partition_id() % count).alias("run"), F.struct(F.col("id").alias("keep_id")).alias("keep"), F.lit(1).cast("long").alias("group_size"))
    level = exact_dedup._merged(level.repartitionById(count, F.col("run")))
    for r in range(rounds):
        sent = level.withColumn("origin", F.col("run"))
        got = exact_dedup.dealt(sent, r, rounds).select(F.spark_partition_id().alias("task"), "run", "origin").distinct().collect()
        for x in got:
            assert x.task == x.run and x.run & ~(15 << 4 * r) == x.origin & ~(15 << 4 * r)
        level = exact_dedup._merged(exact_dedup.dealt(level, r, rounds))
    assert level.count() == 700
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # nothing is exchanged but by run


CLASHES = ["position", "width", "item", "item_id", "block", "value", "shingle", "host", "declared", "text", "n", "post", "h0", "suffix", "n_tokens", "__train", "__n", "k0", "__id0", "__key0"]


def test_keys_of_any_name(spark):
    words = " ".join(f"alpha{i} beta" for i in range(12))
    docs = spark.createDataFrame([(7, words, "en"), (8, None, None), (None, "zwei drei vier", "de")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    model = language_id.train(spark, docs, F.col("text"), F.col("lang"))
    keys = {name: F.col("doc_id") for name in CLASHES}
    out = {"item_id", "similarity", "position"}
    for r in decontamination.contaminated(spark, docs, bench, {k: v for k, v in keys.items() if k not in out}).collect():
        assert {r[name] for name in CLASHES if name not in out} == {7}
    del keys["n"]
    rows = language_id.identify(spark, docs, model, keys, F.col("text"), F.col("lang"), F.col("lang")).collect()
    assert sorted(str({r[name] for name in keys}) for r in rows) == ["{7}", "{8}", "{None}"]
    del keys["n_tokens"]
    rows = hmm.score_texts(spark, docs, keys, F.lit(True), iterations=1).collect()
    assert sorted(str({r[name] for name in keys}) for r in rows) == ["{7}", "{8}", "{None}"]


@pytest.mark.parametrize("share", [1, 65536])
def test_base_scores_from_exact_counts(spark, share):
    """Words outside the vocabulary are counted, not estimated."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 300) % 500) for _ in range(40)] + ["often " * 30_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trains = [i % 3 != 0 for i in range(len(texts))]
    counts: dict = {}
    for t, text in zip(trains, texts, strict=True):
        for w in re.findall(r"\S+", text or "") + [""] if t else []:
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    for r in hmm.score_texts(spark, df, {"doc_id": F.col("doc_id")}, F.col("doc_id") % 3 != 0, iterations=2, share=share).collect():
        tokens = [*re.findall(r"\S+", texts[r.doc_id] or ""), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), total)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in tokens), rel_tol=1e-12)


def test_scratch_of_a_cluster_is_shared():
    assert common.shared_warehouse("hdfs://name/warehouse/") == "hdfs://name/warehouse/scratch"
    for own in ("file:/home/x/spark-warehouse", "/home/x/spark-warehouse"):
        with pytest.raises(ValueError):
            common.shared_warehouse(own)


def test_decontamination_in_several_blocks(spark, monkeypatch):
    """The benchmark's shingles sent in blocks of 16 rows find what they find at once."""
    rng = np.random.default_rng(5)
    items = [" ".join(f"w{int(x)}" for x in rng.integers(0, 90, int(rng.integers(6, 30)))) for _ in range(12)]
    texts = [" ".join([*(f"v{int(x)}" for x in rng.integers(0, 50, 20)), *items[i % 12].split()[: 30 - i % 3], "tail words of it"]) for i in range(40)] + [None, "", "word " * 300_000 + items[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = lambda: sorted(map(str, decontamination.contaminated(spark, docs, bench).collect()))
    at_once = found()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 16)
    assert found() == at_once and len(at_once) >= 40


def test_windows_of_the_similarity_lie_within_the_radius(spark):
    """Of windows at a weighted similarity of 0.8 to 0.85, all of a few thousand differ by fewer bits than the index turns."""
    rng = np.random.default_rng(6)
    pairs = []
    while len(pairs) < 3000:
        n = int(rng.integers(20, 120))
        own = [int(x) for x in rng.integers(0, 10**9, n)]
        other, changes = list(own), max(1, n // 9)
        for k in rng.choice(n, int(rng.integers(1, changes + 1)), replace=False):
            other[k] = int(rng.integers(0, 10**9))
        common = sum(a == b for a, b in zip(own, other, strict=True))
        if 0.8 <= common / (2 * n - common) <= 0.85:
            pairs.append((own, other))
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    distance = F.bit_count(decontamination.simhash_of(hashed(F.col("a"))).bitwiseXOR(decontamination.simhash_of(hashed(F.col("b")))))
    worst, mean = df.select(distance.alias("d")).agg(F.max("d"), F.avg("d")).first()
    assert worst <= decontamination.RADIUS and 5 < mean < 15

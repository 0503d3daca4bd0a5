"""The training-data operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from soundtable.llm import bpe, decontamination, exact_dedup, hmm, language_id, sharding, simhash, token_files, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, label int, n long"
BASE = " ".join(f"word{i} and the" for i in range(60))
TEXTS = [None, "", "a", "A a", BASE, BASE, BASE + " more", "x  y\tz\n" * 50, "naïve café über 12345 !!!", "don't stop — we'll see   ", "the cat sat on the mat " * 400]


def table(spark, texts=TEXTS):
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 2}", 0, "x", "y", i % 2, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[-1:], (None, "null id", None, None, None, None, None, None, None)] if texts else [], SCHEMA)


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_bpe(spark):
    ranks = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(ranks, P.PATTERN)
    out = bpe.decode(bpe.encode(table(spark), ranks, P.PATTERN, keep=("doc_id",), segment_chars=64), ranks, P.PATTERN)
    docs = {r.doc_id: r.text for r in table(spark).collect()}
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.ids == enc.encode_ordinary(docs[r.doc_id] or "") and bytes(r.decoded) == (docs[r.doc_id] or "").encode()


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "ab1 " * 900 + "\n\n  x", "日本語。" * 500, "it's we'll\n" * 400])
def test_segments_do_not_change_ids(text):
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert bpe.encode_text(enc, text, 100) == enc.encode_ordinary(text)


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(spark):
    found = simhash.near_groups(spark, table(spark)).collect()
    docs = [(r.doc_id, fingerprint(r.text)) for r in table(spark).collect()]
    for r in found:
        group, grown = {r.fp & (2**64 - 1)}, True
        while grown:
            more = {f for _, f in docs if any((f ^ g).bit_count() <= 2 for g in group)}
            grown, group = more != group, more
        assert (r.id, r.fp & (2**64 - 1)) in docs
        assert r.component_id == min((i for i, f in docs if f in group and i is not None), default=None)
    assert simhash.near_groups(spark, table(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [0, 32])
def test_links_by_anchors_and_midpoints(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    rng = np.random.default_rng(3)
    fps = {0, -1}
    for c in rng.integers(-(2**63), 2**63 - 1, 12):
        fps |= {int(c)} | {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (12, 2))}
    fps = sorted(fps)
    edges = simhash.fingerprint_links(spark, spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.label for r in simhash.connected_components(spark, edges).collect()}
    for f in fps:
        group, grown = {f}, True
        while grown:
            more = {g for g in fps if any(((g ^ h) & (2**64 - 1)).bit_count() <= 2 for h in group)}
            grown, group = more != group, more
        assert got.get(f, f) == min(group)


def test_near_copies(spark):
    long = [f"w{i}" for i in range(300)]
    edited = [*long[:100], "new", *long[101:]]
    other = [f"v{i}" for i in range(300)]
    df = table(spark, [" ".join(long), " ".join(edited), " ".join(long), " ".join(other), "", None, "short one"])
    kept = simhash.drop_near_copies(spark, df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").where("doc_id is not null").distinct().collect()) == [0, 3, 4, 6]


def shingle_groups(texts, similarity=0.8, k=5):
    """Connected components of all pairs, as a set of sets of positions."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and len(a & b) >= similarity * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}


def found_groups(spark, texts):
    rows = simhash.near_duplicate_texts(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(bytes(r.label), set()).add(r.id)
    return {frozenset(g) for g in groups.values()}


def test_near_copies_of_other_lengths(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = ["one two three", "One two  three", "one two four"]
    for _ in range(30):
        base = draw(int(rng.integers(80, 200)))
        swapped = list(base)
        for i in rng.integers(0, len(base), 2):
            swapped[i] = "other"
        texts += [" ".join(x) for x in (base, base[: int(len(base) * rng.uniform(0.8, 0.95))], base + draw(int(len(base) * rng.uniform(0.1, 0.24))), swapped)]
    passage = " ".join(draw(60))
    texts += [f"{' '.join(draw(int(n)))} {passage} {' '.join(draw(20))}" for n in rng.integers(5, 90, 25)]
    assert found_groups(spark, texts) == shingle_groups(texts)


def test_near_copies_in_a_large_group(spark):
    base = [f"base{i}" for i in range(150)]
    texts = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(90)] + ["a text of its own words", " ", "\n\n", ""]
    found = found_groups(spark, texts)
    assert found == shingle_groups(texts[:91]) | {frozenset({i}) for i in (91, 92, 93)}


def test_decontamination(spark):
    item = " ".join(f"Item{i}" for i in range(20))
    near = item.replace("Item10", "other")
    docs = table(spark, [f"before {item} after", item, near, " ".join(item.split()[:10]), None, "", "clean text of its own", "x " * 5000 + item])
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "too short", "x"), (None, "alpha beta gamma delta epsilon zeta", "x")], "item_id long, text string, position string")
    found = {(r.doc_id, r.item_id): (r.similarity, r.position) for r in decontamination.contaminated(spark, docs, bench).collect()}
    assert found == {(0, 1): (1.0, 1), (1, 1): (1.0, 0), (7, 1): (1.0, 5000)}
    left = decontamination.drop_contaminated(spark, docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, 4, 5, 6, None}
    assert decontamination.contaminated(spark, docs, bench.limit(0)).count() == 0


def test_language(spark):
    english = ["the quick brown fox and the lazy dog were in the house with the other one"] * 5
    german = ["der schnelle braune fuchs und der faule hund waren in dem haus mit einem anderen"] * 5
    labelled = spark.createDataFrame([(t + str(i), "en") for i, t in enumerate(english)] + [(t + str(i), "de") for i, t in enumerate(german)], "text string, lang string")
    model = language_id.train(spark, labelled, F.col("text"), F.col("lang"))
    df = spark.createDataFrame([(1, "the other house was brown", "a.b"), (2, "der hund und das haus", None), (3, None, "a.b"), (4, "12345 ###", "a.b"), (4, "12345 ###", "a.b")], "doc_id long, text string, source string")
    got = [(r.doc_id, r.language) for r in language_id.identify(spark, df, model, {"doc_id": F.col("doc_id")}, F.col("text"), place=F.col("source")).collect()]
    assert sorted(got) == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (4, "und")]
    assert {r.doc_id for r in language_id.keep_identified(spark, df, model).collect()} == {1, 2}


def toxic_tables(spark):
    good = [f"the weather of day {i} was fine and we went to the garden with friends number {i * 7}" for i in range(60)]
    bad = [f"you are a stupid worthless idiot number {i} and such a pathetic loser friend" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate([*good, *bad])), "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") >= 60).cast("int").alias("toxic"), F.lit("x").alias("text"))


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(spark, docs, labels)
    test = spark.createDataFrame([(1, "a worthless stupid idiot and pathetic loser"), (2, "we went to the garden with friends"), (3, None), (4, "")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(test, model, F.col("text"), [F.col("doc_id")]).collect()}
    assert score[1] > score[2] and score[3] == score[4] and all(0 <= s <= 1 for s in score.values())
    assert toxicity.score(test.limit(0), model, F.col("text"), []).count() == 0
    nothing = toxicity.train(spark, docs.limit(0), labels)
    assert [r.score for r in toxicity.score(test, nothing, F.col("text"), []).collect()] == [0.0] * 4


def test_toxicity_score_by_hand(spark):
    """The score of a text over 1 MB and of a short one, from the library's compressors alone."""
    docs, labels = toxic_tables(spark)
    model = toxicity.train(spark, docs.union(docs), labels.union(labels))
    assert np.allclose(model.weights, toxicity.train(spark, docs, labels).weights)
    texts = ["You are a STUPID  idiot\tfriend " * 9, "we went to the garden and you stupid idiot " * 30_000]
    got = [r.score for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model, F.col("text"), []).collect()]
    made = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(model.dictionaries.common + x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (model.dictionaries.toxic, model.dictionaries.ordinary)]
    for text, score in zip(texts, got, strict=True):
        w = [x.encode() for x in words(text)]
        saved = np.array([len(made[1].compress(b" " + b" ".join(w[i : i + toxicity.SCORE_WORDS]) + b" ")) - len(made[0].compress(b" " + b" ".join(w[i : i + toxicity.SCORE_WORDS]) + b" ")) for i in range(0, len(w), toxicity.SCORE_WORDS)], float)
        best = sorted(saved)[-3:]
        values = np.array([saved.mean(), saved.sum() / len(saved) ** 0.5, (saved >= toxicity.MARK_BYTES).mean(), sum(best) / len(best), math.log(len(saved))])
        z = ((values - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1] - model.shift
        assert abs(score - 1 / (1 + math.exp(-max(-50, min(50, z))))) < 1e-9


def test_toxicity_sample_is_bounded(spark):
    """Copies of one text under many ids count as ids, so no more than the sample is drawn."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "you stupid worthless idiot of a friend").otherwise(F.concat(F.lit("a fine day in the garden "), F.col("id"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < 400).cast("int").alias("toxic"))
    seen = []
    real = toxicity.write_table
    toxicity.write_table = lambda spark, df, label: seen.append((label, (got := real(spark, df, label)).count())) or got
    try:
        toxicity.train(spark, docs, labels, sample_docs=30)
    finally:
        toxicity.write_table = real
    assert dict(seen) == {"drawn-ids": 60, "toxicity-sample": 60}


def test_pages(spark):
    hostile = ["<" * 300_000, "<!--" * 90_000, "<script" * 60_000, "<html lang" * 60_000, "<a " * 100_000, "</script  " * 60_000]
    pages = ["<HTML class=x lang='EN-us'><p>the dog &amp; 1 < 2</p><style>x{}</style><!-- no --><script>if (a<b)</script >end", "<html><body lang=de>", None, "plain", "x <p unclosed", "a <!-- open"]
    df = spark.createDataFrame([(p,) for p in [*pages, *hostile]], "html string")
    began = time.time()
    rows = df.select(language_id.html_text(F.col("html")).alias("text"), language_id.declared_language(F.col("html")).alias("declared")).collect()
    assert time.time() - began < 60
    assert [(r.text and r.text.split(), r.declared) for r in rows[:6]] == [(["the", "dog", "1", "<", "2", "end"], "en"), ([], None), (None, None), (["plain"], None), (["x"], None), (["a"], None)]
    hosts = spark.createDataFrame([("HTTPS://u:p@Host.Org:80/x?y",), ("nothing",), (None,)], "url string").select(language_id.host(F.col("url"))).collect()
    assert [r[0] for r in hosts] == ["host.org", "", None]


def test_hmm_likelihood_is_exact():
    rng = np.random.default_rng(5)
    random = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    model = hmm.Hmm(random(3), random(3), random(3, 3), random(3, 6).T)
    for length in (1, 2, 7, 40, hmm.LONG + 13):
        ids = rng.integers(0, 6, length).astype(np.int32)
        alpha, total = model.initial * model.emission[ids[0]], 0.0
        for i in range(length):
            if i:
                alpha = (alpha @ model.transition) * model.emission[ids[i]]
            total, alpha = total + math.log(alpha.sum()), alpha / alpha.sum()
        got = hmm.log_likelihoods(model, ids, np.array([0]), np.array([length]))
        assert abs(got[0] - total) < 1e-8 * max(1, abs(total))


def test_baum_welch_counts_from_all_paths():
    rng = np.random.default_rng(7)
    random = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    model = hmm.Hmm(random(3), random(3), random(3, 3), random(3, 4).T)
    ids = rng.integers(0, 4, 12).astype(np.int32)
    starts, lengths, first = np.array([0, 5, 6]), np.array([5, 1, 6]), np.array([True, True, False])
    begun, moved, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s, n, f in zip(starts, lengths, first, strict=True):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weight = []
        for p in paths:
            x = (model.initial if f else model.usual)[p[0]] * model.emission[ids[s], p[0]]
            for t in range(1, n):
                x *= model.transition[p[t - 1], p[t]] * model.emission[ids[s + t], p[t]]
            weight.append(x)
        for p, x in zip(paths, np.array(weight) / sum(weight), strict=True):
            begun[p[0]] += x * f
            for t in range(n):
                emitted[ids[s + t], p[t]] += x
                if t:
                    moved[p[t - 1], p[t]] += x
    got = hmm.expectations(model, ids, starts, lengths, first)
    assert all(np.allclose(x, y) for x, y in zip(got, (begun, moved, emitted), strict=True))
    slots = np.arange(12, dtype=np.int32)
    assert np.allclose([hmm.expectations(model, ids, starts, lengths, first, slots, 12)[2][ids == w].sum(axis=0) for w in range(4)], emitted)


def test_hmm_scores(spark):
    df = table(spark).withColumn("row", F.lit(1))
    held = F.col("doc_id") % 3 == 0
    rows = hmm.score_texts(spark, df, {"doc_id": F.col("doc_id")}, ~held, states=2, iterations=2).collect()
    docs = [(r.doc_id, [*words(r.text), None]) for r in table(spark).collect()]
    seen = [w for i, ws in docs if i is not None and i % 3 for w in ws]
    for r in rows:
        mine = dict(docs)[r.doc_id]
        base = sum(math.log10((seen.count(w) + 1) / (len(seen) + len(set(seen)) + 1)) for w in mine)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(w in seen for w in mine), len(seen))
        assert abs(base - r.base_score) < 1e-9 * max(1, -base) and r.score <= 0
    assert hmm.score_texts(spark, table(spark, []), {"doc_id": F.col("doc_id")}, ~held, iterations=1).count() == 0


def test_hmm_scores_by_the_model(spark, monkeypatch):
    """Scores are the likelihoods of the model whose emissions every word has: checked against the counts that training wrote."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'ab'[i % 2]}{int(x)}" for x in rng.exponential(30, 60)) for i in range(60)]
    found = {}
    real_train, real_scoring = hmm.train, hmm._scoring
    monkeypatch.setattr(hmm, "discard", lambda *a: None)
    monkeypatch.setattr(hmm, "train", lambda *a: found.setdefault("train", real_train(*a)))
    monkeypatch.setattr(hmm, "_scoring", lambda shared, kept: found.setdefault("now", shared.value) and real_scoring(shared, kept))
    rows = hmm.score_texts(spark, table(spark, texts), {"doc_id": F.col("doc_id")}, F.col("doc_id") % 4 != 0, states=3, share=100, block_tokens=500).collect()
    now, vocabulary = found["now"]
    rare = {bytes(r.word): r.c * np.frombuffer(r.shares, np.uint8).astype(float) / 255 for r in found["train"][3].collect()}
    assert 0 < len(vocabulary) <= 100 and len(rare) > 20
    seen = [w for i, t in enumerate(texts) if i % 4 for w in words(t)] + words(texts[-1]) * ((len(texts) - 1) % 4 != 0)
    assert {w: seen.count(w.decode()) for w in rare} == {bytes(r.word): r.c for r in found["train"][3].collect()}
    emission = {w: now.emission[i] for w, i in vocabulary.items()} | dict(zip(rare, now.emissions(np.array(list(rare.values()))), strict=True))
    unknown = np.full(3, 1 / (now.total + now.distinct + 1))
    assert np.allclose(sum(emission.values()) + now.emission[-1] + unknown, 1, atol=0.02)
    for r in rows:
        text, alpha, total = dict(enumerate(texts)).get(r.doc_id, "null id"), None, 0.0
        for e in [*(emission.get(w.encode(), unknown) for w in words(text)), now.emission[-1]]:
            alpha = (now.initial if alpha is None else alpha @ now.transition) * e
            total, alpha = total + math.log10(alpha.sum()), alpha / alpha.sum()
        assert abs(total - r.score) < 1e-6 * abs(total)
    better = [r.score > r.base_score for r in rows if r.doc_id is not None and r.doc_id % 4]
    assert sum(better) > len(better) / 2


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], np.cumsum(rng.integers(0, 900, 3000)), [0] * 700 + [10**9]):
        ef = token_files.EliasFano.of(np.array(values, dtype=np.uint64))
        assert ef.all().tolist() == list(values) if len(values) else ef.n == 0
        assert [ef[i] for i in range(ef.n)] == [int(v) for v in values]


def test_token_files(spark, tmp_path):
    manifest = token_files.write_token_files(spark, table(spark), P.path("byte_bpe_50k.json"), path=str(tmp_path / "t"))
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    found, at = token_files.tokenizer(P.path("byte_bpe_50k.json")), 0
    docs = sorted(((r.doc_id, r.text or "") for r in table(spark).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for r, (i, t) in zip(rows, docs, strict=True):
        ids = [*found.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(spark, table(spark, []), P.path("byte_bpe_50k.json"))).count() == 0


def test_pieces_get_the_ids_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_PIECES", 3)
    found = token_files.tokenizer(P.path("byte_bpe_50k.json"))
    texts = ["a\x1c b", "a \x1cb", "  x  y\n\n z", "!\x85 x", "a\u3000b \u3000c", "\n x'll 'll go", "日本 語。 x", "\u200b b <|endoftext|> c", " ", "", "a   b c d\t e ", "x" * 5000 + " y", "\u0120 a \u0120\u0120 b", *[t or "" for t in TEXTS]]
    for width in (2, 4):
        encoder = token_files.PieceEncoder(found, width)
        for _ in range(2):
            whole = [np.array(found.encode(t, add_special_tokens=False).ids, f"<u{width}").tobytes() for t in texts]
            assert encoder.encode(texts) == whole


def test_exact(spark):
    rows = exact_dedup.exact_groups(spark, table(spark)).collect()
    docs = [(r.doc_id, r.text or "") for r in table(spark).collect()]
    for r in rows:
        group = [i for i, t in docs if hashlib.sha256(t.encode()).digest() == bytes(r.digest)]
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None) and r.kept == (r.id == r.keep_id)
    assert len(rows) == len(docs)
    kept = exact_dedup.drop_exact_copies(spark, table(spark))
    assert kept.columns == table(spark).columns and kept.count() == sum(r.kept for r in rows)


@pytest.mark.parametrize("leaves", [2, 17, 300])
def test_tree_merge_meets_every_run(spark, leaves):
    """One hot text in every run, others in two runs each; each level reduces what a run sends."""
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 400)).alias("text"))
    runs = exact_dedup.digest_runs(docs.repartition(leaves), "doc_id", "text")
    rounds = exact_dedup.rounds_for(runs)
    assert rounds == {2: 1, 17: 2, 300: 3}[leaves]
    merged = exact_dedup.merge_runs(runs, rounds)
    got = {(bytes(r.digest), r.keep_id, r.group_size) for r in merged.collect()}
    want = {}
    for i in range(1200):
        d = hashlib.sha256(b"hot" if i % 3 == 0 else f"t{i % 400}".encode()).digest()
        want[d] = (i, want.get(d, (0, 0))[1] + 1)
    assert got == {(d, i, n) for d, (i, n) in want.items()}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 2 * rounds and "Python" not in plan


def test_archives_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    from soundtable.llm import ranges

    monkeypatch.setattr(ranges, "SMALL_BYTES", 4000)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"), F.repeat(F.concat(F.lit("<p>"), F.col("id") % 90), 20).alias("html"))
    seen = []
    for n in (1, 7):
        manifest = warc.write_warc(spark, pages.repartition(n), roll_bytes=3000, path=str(tmp_path / f"w{n}"))
        files = sorted((r.shard, r.file, r.records, r.bytes, hashlib.sha1(open(r.path, "rb").read()).digest()) for r in manifest.collect())
        seen.append(files)
        rows = warc.read_warc(manifest).collect()
        assert sorted(r.page_id for r in rows) == list(range(300))
    assert seen[0] == seen[1] and len({f[0] for f in seen[0]}) > 3
    record = warc.build_record(1, "http://h/1", b"x", 9, True, "http://h/9")
    raw = __import__("gzip").decompress(record).decode()
    other = __import__("gzip").decompress(warc.build_record(9, "http://h/9", b"x", None, False)).decode()
    name = re.search("WARC-Record-ID: (.*)\r", other)[1]
    assert f"WARC-Refers-To: {name}" in raw and "WARC-Refers-To-Target-URI: http://h/9" in raw and "WARC-Refers-To-Date: 2000" in raw


def test_range_bounds_of_many_shards(spark):
    from soundtable.llm import ranges

    bounds = sorted({(int(x), int(y)) for x, y in np.random.default_rng(1).integers(-9, 9, (700, 2)) * 1000})
    keys = [*bounds, *((x, y + 1) for x, y in bounds), *((x, y - 1) for x, y in bounds), (-(2**63), 0), (2**62, 5)]
    got = spark.createDataFrame(keys, "a long, b long").withColumn("shard", ranges.shard_of(F.col("a"), F.col("b"), bounds)).collect()
    assert all(r.shard == sum(b <= (r.a, r.b) for b in bounds) for r in got)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>x"), (2, None, "<p>x"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "n\nn", "<p>x"), (9, "ü", "é" * 9)], "page_id long, url string, html string")
    manifest = warc.write_warc(spark, pages, roll_bytes=600, path=str(tmp_path / "w"))
    assert manifest.count() > 1
    rows = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(manifest).collect())
    assert rows == [(0, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (4, "response", None, 0), (9, "response", None, 18)]
    assert warc.read_warc(warc.write_warc(spark, pages.limit(0))).count() == 0


def test_shards(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.lit(1).alias("slot"))
    rows = sharding.stratified_shards(df, 24, bucket_rows=50).collect()
    assert sorted(r.position for r in rows) == list(range(1000))
    counts = [sum(r.shard == s for r in rows) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        assert abs(sum(r.shard == s and r.source == "hot" for r in rows) - 334 / 24) <= 2
    assert sharding.stratified_shards(df.limit(0)).count() == 0
    assert sharding.stratified_shards(table(spark)).count() == len(TEXTS) + 2


def test_parities_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(7)
    for size in (0, 1, 40, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 5 :], rng.integers(0, 1 << 63, size // 4, dtype=np.uint64)]))
        turned = int(np.bitwise_count(simhash.parities(a) ^ simhash.parities(b)).sum())
        assert turned <= len(np.setxor1d(a, b)) and (turned > 0) == (size > 1)

"""The fusion of evidence and the whole pipeline, recomputed in plain Python on small tables."""

import math
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from soundtable.llm import bpe, language_id

ENGLISH = "the quick brown fox and the lazy dog were in the house with the other one of them"
GERMAN = "der schnelle braune fuchs und der faule hund waren in dem haus mit einem anderen von ihnen"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def fused(model, rows):
    """(language, posterior, language by text, n) of rows (text, declared, host), by plain sums."""
    languages, prior_rows = model.languages, language_id.PRIOR_ROWS
    read = []
    for text, declared, host in rows:
        logits, n = model.logits(text or "")
        p = np.exp(logits - logits.max())
        host, said = host or "", declared or ""
        read.append((logits, p / p.sum(), n, said if said in languages or said == "" else "other", host, host.rsplit(".", 1)[-1]))
    total = sum((r[1] for r in read if r[2]), np.zeros(len(languages)))

    def votes(i, value):
        return sum((r[1] for r in read if r[2] and r[i] == value), np.zeros(len(languages)))

    out = []
    for logits, post, n, said, host, suffix in read:
        if not n:
            out.append(("und", 1.0, "und", 0))
            continue
        overall = (total + 1) / (total.sum() + len(languages))
        of_suffix, of_host = votes(5, suffix), votes(4, host)
        level = (of_suffix + prior_rows * overall) / (of_suffix.sum() + prior_rows)
        prior = (np.maximum(of_host - post, 0) + prior_rows * level) / (max(of_host.sum() - 1, 0) + prior_rows)
        value = logits + np.log(prior)
        if said:
            value = value + np.log((votes(3, said) + 0.5) / (total + 0.5 * (len(languages) + 2)))
        share = np.exp(value - value.max())
        out.append((languages[int(value.argmax())], float(share.max() / share.sum()), languages[int(post.argmax())], n))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"{t} {i}", lang) for i in range(5) for t, lang in ((ENGLISH, "en"), (GERMAN, "de"))]
    return language_id.train(spark, spark.createDataFrame(rows, "text string, lang string"), F.col("text"), F.col("lang"))


def test_fusion(spark, model):
    rng = np.random.default_rng(2)
    pieces = ENGLISH.split() + GERMAN.split()
    rows = [(" ".join(rng.choice(pieces, int(rng.integers(1, 6)))), [None, "en", "de", "fr", ""][int(rng.integers(0, 5))], [None, "a.de", "b.a.de", "c.org", "local", ""][int(rng.integers(0, 6))]) for _ in range(120)]
    rows += [(None, "en", "a.de"), ("", None, None), ("12 34 !", "de", "c.org"), rows[0], rows[0], (ENGLISH * 20_000, "de", "c.org")]
    df = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "id long, text string, lang string, place string, n int, post string").repartition(5)
    got = {r.id: (r.language, r.posterior, r.text_language, r.n) for r in language_id.identify(spark, df, model, {"id": F.col("id")}, F.col("text"), F.col("lang"), F.col("place")).collect()}
    want = fused(model, rows)
    assert len(got) == len(rows)
    for i, (language, posterior, by_text, n) in enumerate(want):
        assert (got[i][0], got[i][2], got[i][3]) == (language, by_text, n) and math.isclose(got[i][1], posterior, rel_tol=1e-9)
    assert language_id.identify(spark, df.where("false"), model, {"id": F.col("id")}, F.col("text")).count() == 0


def test_pages(spark, model):
    page = lambda lang, text: f"<html{lang}><head><script>var the = 'and the';</script></head><body><!-- der die das --><p>{text}</p></body></html>"
    rows = [(1, "https://user@Shop.DE:80/x", page(' lang="de-AT"', "das haus")), (2, "http://news.org", page("", "the house and the dog")), (None, None, page(" LANG=EN", "one of them")), (3, "no address", None), (4, "ftp://a.b/", ""), (4, "ftp://a.b/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [("das haus", "de", "shop.de"), ("the house and the dog", None, "news.org"), ("one of them", "en", None), (None, None, ""), (None, None, "a.b"), (None, None, "a.b")]
    bare = [r.t for r in spark.createDataFrame([(i, r[2] or "") for i, r in enumerate(rows)], "i int, h string").orderBy("i").select(language_id.html_text(F.col("h")).alias("t")).collect()]
    assert [b.split() for b in bare] == [(t or "").split() for t, *_ in texts]  # blanks around it count as trigrams
    texts = [(b, *rest) for b, (_, *rest) in zip(bare, texts, strict=True)]
    got = sorted((str(r.page_id), r.language, round(r.posterior, 9), r.n) for r in language_id.identify_pages(spark, df, model).collect())
    want = sorted((str(r[0]), language, round(posterior, 9), n) for r, (language, posterior, _, n) in zip(rows, fused(model, texts), strict=True))
    assert got == want


# ---- the pipeline


def by_stages(docs, benchmark, model):
    """The documents that stay after each stage, from rows (doc_id, text, lang, source)."""
    found = fused(model, [(t, None, source) for _, t, _, source in docs])
    docs = [d for d, f in zip(docs, found, strict=True) if f[0] != "und"]
    stages = [docs]
    rank = lambda i: (i is not None, i or 0)
    best = {}
    for i, t, *_ in docs:
        best[t or ""] = max(best.get(t or "", (False, 0)), rank(i))
    docs = [d for d in docs if rank(d[0]) == best[d[1] or ""]]
    stages.append(docs)
    sets = []
    for _, t, *_ in docs:
        w = words(t)
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if label[a] != label[b] and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or docs[a][1] == docs[b][1] and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    keep = {g: min((docs[k][0] is None, docs[k][0] or 0) for k in range(len(docs)) if label[k] == g) for g in label}
    docs = [d for k, d in enumerate(docs) if (d[0] is None, d[0] or 0) == keep[label[k]]]
    stages.append(docs)

    def holds(text):
        w = words(text)
        shingles = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        for _, item in benchmark:
            v = words(item)
            own = [" ".join(v[k : k + 5]) for k in range(len(v) - 4)]
            for k in range(max(1, len(w) - len(v) + 1) if own else 0):
                window = shingles[k : k + len(own)]
                common = sum(min(window.count(s), own.count(s)) for s in set(window))
                if common >= 0.8 * (len(window) + len(own) - common):
                    return True
        return False

    stages.append([d for d in docs if not holds(d[1])])
    return stages


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(4)
    vocabulary = {"en": ENGLISH.split() + [f"word{chr(97 + i)}" for i in range(26)], "de": GERMAN.split() + [f"wort{chr(97 + i)}" for i in range(26)]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    item = text("en", 30)
    docs = []
    for i in range(40):
        lang = ["en", "de"][i % 2]
        docs.append((i, text(lang, int(rng.integers(20, 120))), lang, ["a.de", "b.com", None][i % 3]))
    base = text("en", 200).split()
    docs += [(100 + k, " ".join([*base[:k], "changed", *base[k + 1 :]]), "en", "b.com") for k in (3, 50, 120)]
    docs += [(110, " ".join(base[:170]), "en", None), (111, " ".join(base), None, None)]
    docs += [(200, docs[0][1], "en", "x"), (201, docs[1][1], "de", "x"), (None, docs[2][1], None, None), (None, text("en", 40), None, None), (7, docs[7][1], "de", "b.com"), (8, "another text of the same id and the other one", "en", None)]
    docs += [(300, f"{text('en', 20)} {item} {text('en', 10)}", "en", "b.com"), (301, item.upper(), "en", None), (302, item.replace(item.split()[15], "other"), "en", None), (303, " ".join(item.split()[:12]), "en", None)]
    docs += [(400, None, None, None), (401, "", "en", None), (402, "12 34 --", "de", None), (403, None, "en", "a.de"), (404, "  \n\t ", None, None), (405, f"{text('de', 30)} " * 2000, "de", "a.de")]
    benchmark = [(1, item), (2, None), (3, "too short here")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.train(spark, read, F.col("text"), F.col("lang"), F.col("doc_id"))
    want = by_stages(docs, benchmark, model)
    now = read
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == read.columns
        assert sorted(map(str, ((r.doc_id, r.text, r.lang, r.source) for r in out.collect()))) == sorted(map(str, left)), name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.lang or "", r.source or "", r.n_tokens, list(r.ids)) for r in rows) == sorted((str(i), lang or "", source or "", len(e := enc.encode_ordinary(t or "")), e) for i, t, lang, source in want[-1])
    assert all(r.decoded_ok for r in rows) and len(rows) < len(docs)
    spark.createDataFrame([], read.schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

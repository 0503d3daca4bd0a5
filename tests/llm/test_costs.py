"""What is learnt once is not paid for again, with the same results."""

import re

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from soundtable.llm import hmm, token_files


def test_pieces_are_cut_only_where_no_match_spans():
    """Pieces of letters lack the marks after them, so a word is learnt once; every piece has its ids of the whole text."""
    found = token_files.tokenizer(P.path("byte_bpe_50k.json"))
    encoder = token_files.PieceEncoder(found, 2)
    asked = []
    encoder._library = lambda texts: asked.extend(texts) or type(encoder)._library(encoder, texts)
    words = ["able", "état", "schön", "дом", "it's", "don't's", "3,4", "áb", "x×,"]
    texts = [f"{a}{mark}{b} {a}{mark}{blank}{b}" for a in words for b in words[:4] for mark in ("", ".", ",", "'", "''ll", "!!", "….") for blank in (" ", "\n", "  ", "  ", "\u0085 ", " \n", "　 ", "᠎ ", "  ", "\x1c ", "\t ")]
    texts += ["", " ", "\n", "s.", ".s", " .", "é.", "é ", "\U0001f600 x", "​."]
    assert encoder.encode(texts) == [np.array(found.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    asked.clear()
    encoder.encode(["a newword, newword. newword! newword"])
    assert sum(t.count("newword") for t in asked) == 1
    rng = np.random.default_rng(7)
    signs = [*" \n\t'.,!0aZsl", *"é×  —　д́\x1f"]
    mixed = ["".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(0, 40))) for _ in range(20_000)]
    assert encoder.encode(mixed) == [np.array(x.ids, "<u2").tobytes() for x in found.encode_batch(mixed, add_special_tokens=False)]


@pytest.mark.parametrize("size", [1, 40, 1 << 22])
def test_words_are_numbered_over_whole_slices(monkeypatch, size):
    """Only the different words become Python objects; words and lengths are those of each text alone, wherever a slice is cut."""
    monkeypatch.setattr(hmm, "SLICE_BYTES", size)
    texts = ["", "The the THE", " \t\n", "a\x0bb\x0cc\rd\te\nf", "  Ünder ünder\u00a0x\x1cy ", "word", "x" * 300, "", "The end. "]
    numbers, spelt, lengths = hmm.word_numbers([t.encode() for t in texts])
    found = [re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()) for t in texts]
    assert [spelt[i] for i in numbers.tolist()] == [w for ws in found for w in ws]
    assert lengths.tolist() == [len(ws) for ws in found] and len(spelt) == len(set(spelt)) == len({w for ws in found for w in ws})


def test_blocks_end_with_the_text_that_fills_them(spark):
    """A slice of several blocks, and a block of several slices: every text is in one block, every block has its own words and counts."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(n)) % 300) for n in rng.integers(0, 60, 200)]
    rows = spark.createDataFrame([(i, i % 4 != 0, t) for i, t in enumerate(texts)], "k0 long, __train boolean, __text string").coalesce(1)
    for limit in (1, 100, 1 << 20):
        seen, blocks = [], hmm.encode_blocks(rows, limit).orderBy("block").collect()
        for b in blocks:
            numbers = np.frombuffer(b.low, np.uint8).astype(int) | np.frombuffer(b.middle, np.uint8).astype(int) << 8
            words = [bytes(b.words[i]).decode() for i in numbers]
            ends = np.cumsum([d["__n"] for d in b.docs])
            found = [words[e - d["__n"] : e] for d, e in zip(b.docs, ends, strict=True)]
            assert found == [texts[d.k0].split() for d in b.docs]
            assert sum(len(x) + 1 for x in found[:-1]) < limit
            trained = [w for x, d in zip(found, b.docs, strict=True) if d["__train"] for w in x]
            assert b.counts == [trained.count(bytes(w).decode()) for w in b.words]
            seen += [d.k0 for d in b.docs]
        assert seen == list(range(200)) and (len(blocks) == 1) == (limit == 1 << 20)


def test_rarer_words_are_joined_once(spark, monkeypatch):
    """Training hands on every rarer word with its exact count, so no table of counts is joined to it for scoring."""
    written, real = {}, hmm.write_table
    monkeypatch.setattr(hmm, "write_table", lambda s, df, label, *a: written.setdefault(label, real(s, df, label, *a)))
    monkeypatch.setattr(hmm, "discard", lambda *a: None)
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, 3 * i))) for i in range(40)], "doc_id long, text string")
    hmm.score_texts(spark, df, {"doc_id": F.col("doc_id")}, F.col("doc_id") % 5 != 0, iterations=2, share=100).collect()
    counts = {bytes(r.word): r.c for r in written["word-counts"].collect()}
    rare = {bytes(r.word): r.c for r in written["rare-words"].collect()}
    assert 0 < len(rare) < len(counts) and all(counts[w] == c for w, c in rare.items())
    assert set(written) == {"word-blocks", "word-counts", "expected-counts", "rare-words", "block-words"}

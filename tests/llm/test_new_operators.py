"""The prefix trie, near vectors and spelling variants against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from soundtable.llm import embedding_dedup, prefix_trie, spelling

# ---- prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth long, r long, parent long, arc string, words string"


def conversations(spark, rows):
    return spark.createDataFrame([(*row, 7, 7, 7, "x", "y") for row in rows], TURNS)


def trie(rows):
    """{(conv_id, depth): the other columns} by plain lists and recursion."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    out = {}
    for node, found in members.items():
        ends = ",".join(str(c) for c in found if len(rebuilt[c]) == len(node))
        out[found[0], len(node)] = (members[node[:-1]][0] if node else None, len(found), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def found_trie(spark, rows, **more):
    got = prefix_trie.prefix_trie(spark, conversations(spark, rows), **more).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def some_conversations(n=70):
    rng = np.random.default_rng(1)
    rows = [(None, 0, "user", "no conversation")]
    for c in range(n):
        for t in range(int(rng.integers(0, 7))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"turn {rng.integers(0, 2 + t)}  of\tall\n"))
    return [*rows, (3, None, None, None), (3, 2, "user", None), (3, 2, None, ""), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "a", "tie"), (-7, 0, "user", "below zero"), (1005, 0, "user", "no first of its family")]


@pytest.mark.parametrize("block", [6, 1 << 16])
def test_trie(spark, block):
    rows = some_conversations()
    assert found_trie(spark, rows, block=block) == trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURN_BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 64)
    rows = [(c, t, "user", f"the same {t}" if t < 100 + c else f"its own {c}") for c in (20, 21, 40) for t in range(130)]
    rows += [(c, 0, "user", "one common turn") for c in range(100, 160)]
    assert found_trie(spark, rows, block=64) == trie(rows)


def test_trie_of_nothing(spark):
    assert found_trie(spark, []) == {} and found_trie(spark, [(None, 1, "a", "b")]) == {}
    # Both turns lie before the first three that are taken from a conversation that is not there.
    lost = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert found_trie(spark, [(lost, 0, "user", "a"), (lost, 1, "user", "b")]) == trie([(lost, 0, "user", "a"), (lost, 1, "user", "b")])


# ---- vectors

VECTORS = "vec_id long, embedding array<float>, label int, cid long, vec string, place int, hash string, near int, m int, block int"


def linked(rows):
    """(vec_id, n_links, component_id) of each row, by all pairs."""
    good = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(i)
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    near = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] if i in unit else [] for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        group, edge = {i}, [i]
        while edge:
            edge = [j for e in edge for j in near[e] if j not in group and not group.add(j)]
        out.append((rows[i][0], len(near[i]), min((rows[j][0] for j in group if rows[j][0] is not None), default=None)))
    return out


def some_vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 24))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i in range(60):
        near = base[i] + rng.standard_normal(24) * rng.uniform(0.02, 0.2)
        rows.append((1000 + i, near.tolist(), i % 3))
    rows += [(2000 + i, (base[7] + rng.standard_normal(24) * 0.05).tolist(), 1) for i in range(80)]
    rows += [(3000 + i, base[9].tolist(), 0) for i in range(40)]
    rows += [(4000, (base[9] * 3).tolist(), 0), (4000, base[9].tolist(), 0), (None, base[9].tolist(), 0), (4001, base[9].tolist(), None), (4002, None, 1), (4003, [], 1), (4004, [0.0] * 24, 1), (4005, [float("nan")] + [1.0] * 23, 1), (4006, [float("inf")] * 24, 1), (4007, [1.0, None], 1), (4008, [1.0, 2.0], 1), (4009, [2.0, 4.0], 1), (4010, [1e-30, 2e-30], 1), (4011, [1e30, 2e30], 1)]
    return rows


@pytest.mark.parametrize("options", [{}, {"window": 8, "block": 50, "tile": 16, "passes": 12}])
def test_vectors(spark, options):
    rows = some_vectors()
    df = spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4, 5) for r in rows], VECTORS).repartition(7)
    got = embedding_dedup.near_vectors(spark, df, **options).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=str) == sorted(linked(rows), key=str)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark, spark.createDataFrame([], VECTORS)).count() == 0
    alone = spark.createDataFrame([(1, None, 0), (None, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r.id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark, alone).collect()) == [("1", 0, 1, True), ("None", 0, None, True)]


def test_recall_at_the_least_similarity(spark):
    """Pairs of cosine 0.98 to 0.985 among vectors that point anywhere: at least nine in ten are found."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((400, 32))
    side -= (side * a[:400]).sum(axis=1, keepdims=True) * a[:400]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9801, 0.985, (400, 1))
    b = cos * a[:400] + np.sqrt(1 - cos**2) * side
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_vectors(spark, df).where("id >= 4000").collect()
    assert sum(r.component_id == r.id - 4000 and r.n_links == 1 for r in got) >= 360


# ---- spelling


def spelt(rows):
    counts = Counter()
    for i, text in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    beside = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, found in beside.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(beside[w]), form[w] and n[form[w]]) for w in n}


def found_words(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], "doc_id long, text string, word string, n long, form string, list string").repartition(3)
    got = spelling.spelling_variants(spark, df).collect()
    assert len({r.word for r in got}) == len(got)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def some_texts():
    rng = np.random.default_rng(6)
    stems = ["".join(rng.choice(list("abcdeé"), int(rng.integers(4, 14)))) for _ in range(60)]
    texts = []
    for i in range(300):
        words = []
        for _ in range(120):
            w = stems[int(rng.integers(0, len(stems)) ** 2 // len(stems))]
            if rng.random() < 0.3:
                k, c = int(rng.integers(0, len(w))), rng.choice(list("abß"))
                w = [w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]][int(rng.integers(0, 3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((i, " ".join(words) + ", it's 3rd_word ÀÉÎõü×÷ "))
    return [*texts, (None, "Words without an Id id words Words words"), (7, None), (8, ""), texts[0], texts[0], (9, "x" * 50_000 + " " + "longword " * 30_000)]


@pytest.mark.parametrize("often", [2, 8, 32])
def test_spelling(spark, often, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", often)
    rows = some_texts()
    assert found_words(spark, rows) == spelt(rows)


def test_spelling_of_dense_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", 3)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("".join(rng.choice(list("ab"), int(rng.integers(5, 9)))) for _ in range(400))) for i in range(10)]
    assert found_words(spark, rows) == spelt(rows)
    assert found_words(spark, []) == set() and found_words(spark, [(1, "a b c")]) == set()


def test_affected_grams_bound_every_edit():
    """Grams that an edit is not counted to change are in the edited word, at most one place aside."""
    rng = np.random.default_rng(9)
    for _ in range(3000):
        w = "".join(rng.choice(list("abc"), int(rng.integers(5, 12))))
        frequent = {"".join(rng.choice(list("abc\x02\x03"), int(rng.integers(2, 5)))) for _ in range(25)}
        inner = {g[i:] for g in frequent for i in range(1, len(g))}
        marked, longest = f"\x02{w}\x03", int(rng.integers(2, 7))
        found = spelling.grams(marked, frequent, longest)
        k, c = int(rng.integers(1, len(marked))), rng.choice(list("abc"))
        other = [marked[:k] + c + marked[k:], marked[:k] + marked[k + 1 :] if k < len(marked) - 1 else marked, marked[:k] + c + marked[k + 1 :] if k < len(marked) - 1 else marked][int(rng.integers(0, 3))]
        after = {(other[i:j], i) for i, j in spelling.grams(other, frequent, longest)}
        stay = sum(any((marked[i:j], i + s) in after for s in (-1, 0, 1)) for i, j in found)
        assert stay >= len(found) - spelling.most_affected(marked, found, inner, longest)

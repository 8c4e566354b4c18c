"""The trie of conversations and the exact searches, against brute force and on
odd input: nulls, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesledger.llm import hard_negatives, prefix_trie, top_k
from salesledger.llm import integer_vectors as iv

TURNS = "conv_id long, turn long, role string, text string, path string, depth int"
VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int"


def conversations() -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 9)):
            text = rng.choice(["a", "b", "", None, "ä" * 9, "x" * 5000]) if t else "hello"
            rows.append((c, None if t == 2 and c % 4 == 0 else t, rng.choice(["user", "assistant", None]) if t else "user", text, "clash", 3))
    for c in range(200, 260):  # copies
        rows += [(c, t, "user", f"copy {t}", "clash", 3) for t in range(6)]
    rows += [(500, t, "u", f"long {t}", None, None) for t in range(700)] + [(501, t, "u", f"long {t}", None, None) for t in range(650)]
    rows += [(7, 1, "user", "twice", "x", 1), (7, 1, "user", "twice", "x", 1), (None, 0, "user", "none", "x", 1)]
    rng.shuffle(rows)
    return rows


def digest_key(role: str, text: str):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], len(text.encode())


def brute_trie(rows, family=5):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest_key(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % family, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in cs if paths[c] == p))).encode()).hexdigest())
        for p, cs in members.items()
    )


def found_trie(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.trie(df).collect())


@pytest.mark.parametrize("shards", [1, 7])
def test_trie_equals_brute_force(spark, shards, monkeypatch):
    rows = conversations()
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    monkeypatch.setattr(prefix_trie, "MOST_SHARDS", shards)
    if shards > 1:  # a small chunk and few waiting children take the same ways as large ones
        monkeypatch.setattr(prefix_trie, "CHUNK", 3)
        monkeypatch.setattr(prefix_trie, "WAITING", 2)
        monkeypatch.setattr(prefix_trie, "OUT_ROWS", 16)
    assert found_trie(prefix_trie.borrow_heads(prefix_trie.sequences(turns))) == brute_trie(rows)


def test_trie_without_skeleton_or_rows(spark, monkeypatch):
    rows = [(c, t, "u", f"{c % k}", None, None) for c in range(60) for t, k in enumerate((1, 2, 30))]
    turns = prefix_trie.borrow_heads(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)), heads=1)
    want = found_trie(turns)
    monkeypatch.setattr(prefix_trie, "SKELETON_NODES", 2)
    assert found_trie(turns) == want and len(want) == 1 + 1 + 2 + 30
    assert prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([], TURNS))).count() == 0
    empty = spark.createDataFrame([(3, []), (4, [])], "conv_id long, turns array<string>")
    assert found_trie(empty) == [(3, 0, -1, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]


def test_separators_are_prefixes_in_order_and_bounded():
    rng = random.Random(1)
    element = [bytes([k]) * prefix_trie.ELEMENT for k in range(3)]
    sample = sorted((b"".join(rng.choice(element) for _ in range(rng.randint(0, 5))), k) for k in range(200))
    separators, skeleton, nodes = prefix_trie._separators(sample, 5)
    assert separators == sorted(set(separators)) and len(separators) > 20
    assert len(nodes) == len(skeleton) + 1 and all(parent < k for k, (parent, _, _) in enumerate(nodes))
    for at in range(5, 200, 5):  # cut exactly between the two sampled rows, where they differ
        assert any(sample[at - 1] < s <= sample[at] for s in separators)


def vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    base = rng.standard_normal((8, 6))
    x = base[rng.integers(0, 8, 400)] + 0.3 * rng.standard_normal((400, 6))
    rows = [(k, v.tolist(), int(k % 4), "clash", 1) for k, v in enumerate(x)]
    rows += [(1000 + k, x[0].tolist(), 1, "clash", 1) for k in range(150)]  # copies: ties
    rows += [(2000, None, 1, "", 0), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "", 0), (2200, [math.nan] * 6, 1, "", 0), (2300, [math.inf] * 6, 1, "", 0), (None, x[1].tolist(), 1, "", 0)]
    rows += [(2400, [0.0] * 6, 2, "", 0), (2500, [1.0, 2.0], 1, "", 0), (2501, [2.0, 1.0], 1, "", 0), (2502, [1.0, 1.0], 2, "", 0), (2600, [], 1, "", 0), (2601, [], 1, "", 0)]
    rows += [(2700, x[5].tolist(), None, "", 0), (3, x[3].tolist(), 3, "", 0), (100, x[100].tolist(), 0, "", 0)]  # no label; repeated rows
    return rows


def whole(rows, scale):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    return [(r[0], [math.floor(scale * v) if abs(v) < 2**53 else int(v) * scale for v in r[1]], r[2]) for r in ok]


def product(a, b):
    return max(-iv.MOST, min(iv.MOST, sum(p * q for p, q in zip(a, b, strict=True))))


def brute_top(rows, k=10, every=100):
    rows = whole(rows, 1024)
    out = []
    for q, e in {r[0]: r[1] for r in rows if r[0] % every == 0}.items():
        best = sorted((-product(e, c), i) for i, c, _ in rows if i != q and len(c) == len(e))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("bins", [1024, 4])
def test_top_k_equals_brute_force(spark, bins, monkeypatch):
    monkeypatch.setattr(top_k, "BINS", bins)  # few bins: several refinements
    monkeypatch.setattr(iv, "BLOCK", 3)
    rows = vectors()
    got = top_k.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute_top(rows)


def test_top_k_of_huge_components_few_rows_and_none(spark):
    rows = [(0, [1e300, 1.0], 1, "", 0), (100, [3e18, -2.0], 1, "", 0), (200, [0.5, 0.25], 1, "", 0), (5, [-1e300, 7.0], 1, "", 0), (6, [0.1, 1e-300], 1, "", 0)]
    got = top_k.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute_top(rows)
    assert top_k.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    assert top_k.top_k(spark.createDataFrame(rows[3:], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def brute_mined(rows):
    rows = [r for r in whole(rows, 256) if r[2] is not None]
    out = []
    for a, (e, label) in {r[0]: (r[1], r[2]) for r in rows if r[0] % 100 == 0}.items():
        scored = sorted((-product(e, c), i, own) for i, c, own in rows if i != a and len(c) == len(e))
        for p, pid in [(-s, i) for s, i, own in scored if own == label][:5]:
            inside = [(-s, i) for s, i, own in scored if own != label and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(a, pid, n, i, p, s) for n, (s, i) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 2])
def test_hard_negatives_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(iv, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    rows = vectors() + [(4000, [1e12] * 6, 1, "", 0), (4001, [-1e200] * 6, 2, "", 0)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute_mined(rows) and len(got) > 50
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_along_the_tree_save_scores_and_lose_none():
    rng = np.random.default_rng(2)
    centers = 4 * rng.standard_normal((6, 16))
    anchors = np.repeat(centers, 5, axis=0) + 0.05 * rng.standard_normal((30, 16))
    rows = np.repeat(centers, 100, axis=0) + 0.2 * rng.standard_normal((600, 16))
    tree = hard_negatives._tree(np.arange(30), anchors, 256)
    assert len(tree["steps"]) == 30 and sum(d for _, _, d in tree["steps"]) < 256 * 30 * np.linalg.norm(anchors[0] - anchors[6])
    exact = iv.scores(rows, anchors, 256)
    low = np.sort(exact, axis=0)[-10]
    seen = defaultdict(dict)
    n = hard_negatives.scan(tree, 256, rows, lambda a, r, s: seen[a].update(zip(r.tolist(), s.tolist(), strict=True)), lambda a: [(low[a], np.inf)])
    assert n < exact.size / 2
    for a in range(30):
        assert all(seen[a][int(r)] == exact[r, a] for r in np.flatnonzero(exact[:, a] >= low[a]))

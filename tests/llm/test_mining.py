"""Pairwise quality ranking, hard negatives and the conversation trie against brute force on small tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from birthwave.llm import negatives, pairwise, trie


def test_learned_weights_are_a_minimum():
    rng = np.random.default_rng(1)
    better, worse = rng.normal(0.4, 1, (400, 5)), rng.normal(0, 1, (400, 5))
    w = pairwise.learn(better, worse)
    d = better - worse
    loss = lambda w: np.log1p(np.exp(-d @ w)).sum() + pairwise.RIDGE * w @ w / 2
    slope = [(loss(w + e) - loss(w - e)) / 2e-5 for e in 1e-5 * np.eye(5)]
    assert np.abs(slope).max() < 1e-2 and (w > 0).all()


def test_threshold_leaves_the_share_of_label_zero_below():
    rng = np.random.default_rng(2)
    y = (rng.random(500) < 0.8).astype(float)
    x = rng.normal(0, 1, (500, 4)) + y[:, None]
    ranking = pairwise.fit_ranking(x, y)
    assert (ranking.strengths(x) < ranking.threshold).sum() == (y == 0).sum()


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        words = [rng.choice("the river and a small house under of green hills was seen by night".split()) for _ in range(rng.randint(8, 60))]
        junk = i % 4 == 0
        rows.append((i, " ".join(f"{w}$$$" if junk else w for w in words) + ("" if junk else "."), "clash", 1))
    rows += [(900, None, None, None), (901, "", None, None), (902, "word. " * 30_000, None, None), (None, "x", None, None), rows[8]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, _row int").repartition(3)
    marks = [(i, int(i % 4 != 0)) for i in range(240)] + [(5, 0), (900, None), (None, 1), (7777, 0)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int")


def test_pairwise_quality(spark, prose):
    docs, labels = prose
    learned = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    ranking = pairwise.fit(docs, labels, learned)
    scored = pairwise.score(docs, ranking)
    assert scored.columns == ["doc_id", "text", "_row", "score", "predicted"]
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 240 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 30 and all(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    again = {r["doc_id"]: r["score"] for r in pairwise.score(docs.repartition(7), pairwise.fit(docs.repartition(2), labels, learned)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_pairwise_quality_without_labels_or_rows(spark, prose):
    docs, labels = prose
    alone = pairwise.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in pairwise.score(docs, alone).collect()} == {0.5}
    none = docs.limit(0)
    assert pairwise.score(none, pairwise.fit(none, labels)).collect() == []


def mined(rows, positives=5, negatives=10):
    """Every pair, by the contract."""
    usable = [(n, i, lab, [math.floor(256 * x) for x in v]) for n, (i, v, lab) in enumerate(rows)
              if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = lambda i: math.inf if i is None else i
    out = []
    for n, i, lab, q in usable:
        if i is None or i % 100:
            continue
        met = sorted((-sum(a * b for a, b in zip(q, p)), least(j), m, j, other) for m, j, other, p in usable if m != n and len(p) == len(q))
        near = [(-s, j) for s, _, _, j, other in met if other == lab][:positives]
        for score, p in near:
            hard = [(-s, j) for s, _, _, j, other in met if other != lab and 30 * score <= -100 * s <= 90 * score][:negatives]
            out += [(i, p, k, j, score, s) for k, (s, j) in enumerate(hard, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12) + 0.2], int(rng.integers(3))) for i in range(900)]
    hot = rows[5][1]
    rows += [(1000 + i, hot, i % 2) for i in range(150)]  # ties
    rows += [rows[100], rows[300], rows[300]]
    rows += [(2000, [0.1] * 5, 1), (2001, [0.2] * 5, 2), (2002, [0.3] * 5, 1), (2100, [], 1), (2101, [], 2), (2102, [], 1)]
    rows += [(None, hot, 1), (3000, None, 1), (3100, hot, None), (3200, [math.nan] * 12, 1), (3300, [math.inf] * 12, 1), (3400, [None] * 12, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, n string, q int"


def mine(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    found = negatives.mine(df, F.col("vec_id") % 100 == 0, **sizes)
    assert found.columns == "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return sorted(map(tuple, found.collect()), key=repr)


def test_hard_negatives(spark, vectors):
    wanted = mined(vectors)
    assert len(wanted) > 300
    assert mine(spark, vectors) == wanted


def test_hard_negatives_in_many_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(negatives, "PAIRS", 64)  # chunks of 16 rows
    assert mine(spark, vectors, block=4, stripe=100) == mined(vectors)


def test_hard_negatives_are_exact_beyond_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(2**21, 2**22, 4)], i % 2) for i in range(0, 300, 10)]
    assert mine(spark, rows) == mined(rows)


def test_hard_negatives_of_no_rows(spark):
    assert mine(spark, []) == [] and mine(spark, [(100, [0.1], 1)]) == []


def test_segment_bounds_hold():
    rng = np.random.default_rng(6)
    for size in (1, 3, 4, 17, 64):
        q = np.floor(256 * rng.normal(0, 0.3, (40, size)))
        mean, dev = negatives.summaries(q)
        stops = np.cumsum([len(s) for s in negatives.segments(size)])
        score, width = q @ q.T, []
        for a, b in zip([0, *stops[:-1]], stops):
            middle, spread = mean[:, a:b] @ mean[:, a:b].T, dev[:, a:b] @ dev[:, a:b].T
            assert (np.abs(score - middle) <= spread + 1e-6).all()
            width.append(spread.mean())
        assert width == sorted(width, reverse=True)  # each level is at least as narrow


def nodes_of(convs):
    """Every prefix of the given conversations (id to turns) with its figures."""
    through, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            through.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    kids = {}
    for p in through:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(through, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(through[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in below)
    return sorted((
        (min(cs), len(p), min(through[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, cs in through.items()
    ), key=repr)


def rebuilt(turns):
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            said = (role or "", text or "")
            tok = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest()[:16]
            own.setdefault(c, []).append((t is not None, t or 0, tok, said))
    own = {c: tuple(x[-1] for x in sorted(xs)) for c, xs in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, ())[:h] + turns[h:]
    return out


TURNS = "conv_id long, turn long, role string, text string, depth string, ph int"


def talks():
    rng = random.Random(9)
    say = lambda: rng.choice(["hello there", "grün wie Gras", "", "what is it? " * 5, "日本語"])
    rows = [(c, t, "user" if t % 2 else "bot", say()) for c in range(120) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"common {t}") for c in range(200, 260) for t in range(4)]  # copies and, rebuilt, near copies
    rows += [(c, 0, "user", "the first turn of many") for c in range(300, 360)] + [(c, 1, "bot", f"answer {c % 7}") for c in range(300, 360)]
    rows += [(400, t, "user", f"long {t // 3}") for t in range(300)] + [(405, t, "user", f"long {t // 3}") for t in range(150)]
    rows += [(500, None, None, None), (500, 1, "user", None), (500, 1, "user", "tie"), (500, 1, None, "tie"), (500, 1, "user", "tie")]
    rows += [(None, 1, "user", "no id"), (600, 0, "", "user"), (605, 0, "user", ""), (610, 0, "use", "r")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).repartition(3)


@pytest.mark.parametrize("shares", [(1 / 16, 1.0), (0.2, 0.5, 0.8, 1.0)])
def test_conversation_trie(spark, shares):
    rows = talks()
    made = trie.node_table(trie.shared_starts(trie.spoken(table(spark, rows))), shares)
    assert made.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert sorted(map(tuple, made.collect()), key=repr) == nodes_of(rebuilt(rows))


def test_conversation_trie_of_nested_and_no_conversations(spark):
    rows = [(c, t, "u", str(t)) for c in range(40) for t in range(c)]
    plain = {c: tuple(("u", str(t)) for t in range(c)) for c in range(1, 40)}
    made = trie.node_table(trie.spoken(table(spark, rows)))  # as they are: a chain in which each prefix is a conversation
    assert sorted(map(tuple, made.collect()), key=repr) == nodes_of(plain)
    assert trie.node_table(trie.shared_starts(trie.spoken(table(spark, [])))).collect() == []

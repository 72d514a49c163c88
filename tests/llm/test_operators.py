"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash

from birthwave.llm import bpe, embed, licences, mixing, quality, simhash, substring, suffix, tokens, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, n_words string, _row int, kept string"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "of", "un", "grün", "ré") for b in ("", "x", "a,", "!", "ly")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120), say(40)
    out = [base, base, base.replace("the ", "thee ", 1), None, "", " \n\t ", say(5), say(3000), passage + " " + say(30), say(25) + "\n" + passage]
    out += ["same line of eight words stands here twice\n" * 6, "### $$$ *** " * 30, "a" * 700, "a" * 200, "<|endoftext|> x\x1c y 日本語 ​"]
    out += ["Licensed under CC BY-NC 4.0. All rights reserved, GNU General Public License", "cc by cc by all rights reserved"]
    return out + [say(60) for _ in range(8)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 3 else f"s{i % 4}", "clash", i, "k") for i, t in enumerate(texts())]
    rows += [rows[0], (None, texts()[0], "s0", None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def counted(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def repeat_words(ws):
    seen, cover = {}, set()
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(i + k for i in at for k in range(8))
    return len(cover)


def test_quality(docs, given):
    rows = quality.score(docs).collect()
    want = []
    for i, t in given:
        ws = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        n, rep = len(ws), repeat_words(ws)
        want.append((i, n, len(b"".join(ws).decode()), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n))
    assert counted(rows, "doc_id", *quality.COUNTS, "base_failed") == sorted(want, key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert {c for c in rows[0].asDict() if c in SCHEMA} >= {"source", "_row", "n_words"}
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows) > 0


def test_bpe(docs, given):
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in given:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    assert counted(rows, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_long_pieces():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        data = f.read()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    codec, rng = bpe.Codec(data, public_tokenizers.PATTERN), random.Random(1)
    cases = ["qjxz" * 500, "".join(rng.choice("abcdeßé") for _ in range(2000)), "  \n\n x", "it's we'll\t\t12 345\x85!!?"]
    cases += ["".join(rng.choice(["a", " ", "\n", "é", "'s", "1", "!", "\x1c", " ", "日", "​"]) for _ in range(30)) for _ in range(50)]
    assert [x for x in codec.encode(cases).to_pylist()] == [library.encode_ordinary(x) for x in cases]
    assert codec.decode(codec.encode(cases)) == [x.encode() for x in cases]


def test_token_cache(docs, given, spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(JSON)
    cache = f"file://{tmp_path}/cache"
    rows = tokens.count(docs, JSON, cache, limit=100).collect()
    n = {t: len(library.encode(t, add_special_tokens=False)) for _, t in given}
    want = sorted(((i, len(t.encode()), n[t], n[t] > 100) for i, t in given), key=repr)
    assert counted(rows, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.schema(tokens.CACHE).parquet(cache)
    assert stored.count() == len(n)
    # A second run finds all in the cache and appends nothing; another tokenizer shares nothing.
    again = tokens.count(docs, JSON, cache, limit=100).collect()
    assert counted(again, "doc_id", "n_tokens") == counted(rows, "doc_id", "n_tokens")
    assert spark.read.schema(tokens.CACHE).parquet(cache).count() == len(n)
    tokens.fill_cache(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)
    assert spark.read.schema(tokens.CACHE).parquet(cache).count() == 2 * len(n)


def test_toxicity(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.1/labels.parquet")
    chain = toxicity.fit(docs, labels.filter("doc_id % 10 < 7"))
    held = {r.doc_id: r.toxic for r in labels.filter("doc_id % 10 >= 7").collect()}
    rows = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    hit = sum(rows[i].is_toxic and y == 1 for i, y in held.items())
    wrong = sum(rows[i].is_toxic and y == 0 for i, y in held.items())
    assert hit >= 0.8 * sum(held.values()) and wrong <= 0.01 * len(held)
    assert chain.categories == ["insult", "contempt", "toxic"] and [len(w) - len(chain.vocabulary) for w in chain.weights] == [1, 2, 3]
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_toxicity_without_labels(docs, spark):
    chain = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score(docs, chain).collect()
    assert len(rows) == docs.count() and not any(r.is_toxic for r in rows)


def test_substring(docs, given):
    rows = substring.dedup(docs, block_bytes=600).collect()
    order = lambda i: 2**62 if i is None else i
    least = {}
    for i, t in given:
        ws = t.encode().split()
        for k in range(len(ws) - 12):
            w = tuple(ws[k : k + 13])
            least[w] = min(least.get(w, 2**63), order(i))
    want = []
    for i, t in given:
        ws, gone = t.encode().split(), set()
        for k in range(len(ws) - 12):
            if least[tuple(ws[k : k + 13])] < order(i):
                gone.update(range(k, k + 13))
        want.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    assert counted(rows, "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)
    left = substring.keep_rest(docs, block_bytes=600)
    assert left.columns == docs.columns
    assert left.count() == sum(not (g and g == n) for _, n, g, _ in want)


def test_suffix(docs, given):
    rows = suffix.dedup(docs, block_bytes=2000).collect()
    times = {}
    for _, t in given:
        b = t.encode()
        for k in range(len(b) - 199):
            times[b[k : k + 200]] = times.get(b[k : k + 200], 0) + 1
    want = []
    for i, t in given:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if times[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffix_other_tails(spark):
    """One head of 100 bytes, tails whose short digests were equal: no 200 bytes are."""
    head = "Item 7790 of the list: lantern cloud canyon harbour canyon cloud lantern harbour lantern cloud canyo"
    tails = [
        "0210700 meadow canyon velvet canyon meadow canyon velvet canyon meadow canyon velvet canyon meadow c",
        "0266406 orchard ember orchard thunder amber ember amber thunder orchard ember orchard thunder amber ",
        "0040768 river copper velvet copper river marble velvet marble river copper velvet copper river marbl",
        "0156391 stone stone copper marble silver silver marble copper stone stone copper marble silver silve",
        "0344145 harbour lantern silver river thunder orchard marble meadow ember canyon stone willow cloud a",
        "0369757 thunder velvet copper lantern ember river silver orchard cloud meadow marble canyon harbour ",
    ]
    made = [head + t for t in tails] + [head + tails[0] + "!", "?" + head + tails[4]]
    rows = suffix.dedup(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), block_bytes=500).collect()
    want = [(i, len(t), 200 * (i in (0, 4, 6, 7)), int(i in (0, 4, 6, 7)), {0: "", 4: "", 6: "!", 7: "?"}.get(i, t).encode()) for i, t in enumerate(made)]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == want


def brute_fingerprint(text, shingle):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    parts = [b" ".join(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))] if ws else []
    counts = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def least_linked(fps, ids, errors):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= errors:
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[root(i)] for i in range(len(fps))]


def test_simhash(docs, given):
    rows = simhash.near_duplicates(docs, subtree=4).collect()
    fps = [brute_fingerprint(t, 4) for _, t in given]
    labels = least_linked(fps, [i for i, _ in given], 4)
    want = sorted(((i, f"{fp:016x}", c) for (i, _), fp, c in zip(given, fps, labels)), key=repr)
    assert counted(rows, "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_first(docs, errors=4, shingle=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(labels))


def test_trie_walk():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 2**63, 600).astype(np.uint64)
    v = np.unique(np.concatenate([v, *(v ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) for _ in range(3)), np.arange(300, dtype=np.uint64)]))
    got = set()
    simhash.walk(v, v, 4, lambda i, j: got.update(zip(i.tolist(), j.tolist())), same=True)
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 4)
    assert got == {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < j}


def test_mix(docs, given):
    rows = mixing.mix(docs).collect()
    size, source = {}, {}
    assert len(rows) == len(given)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split())
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        source.setdefault(r["source"], []).append(r)
    size = {s: sum(r["size"] for r in x) for s, x in source.items()}
    total, weight = sum(size.values()), {}
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[s] = 1 + k % 3
    target, open_ = {}, set(size)
    while True:  # reshare what stands above three times a source's size
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    for s, x in source.items():
        assert x[0]["target"] == pytest.approx(target[s]) and x[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in x) - target[s]) <= max(r["size"] for r in x)
    again = mixing.mix(docs.repartition(5)).collect()
    assert counted(again, "doc_id", "taken") == counted(rows, "doc_id", "taken")
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_licences(docs, given):
    rows = {r.doc_id: r for r in licences.scan(docs).filter("doc_id is not null").collect()}
    both = [r for r in rows.values() if r.labels]
    assert len(rows) == len({i for i, _ in given if i is not None})
    one = next(r for r in both if "4.0" in r.labels)
    assert (one.n_base, one.base_labels, one.first_word, one.last_word) == (3, "cc-by,gpl,reserved", 2, 11)
    assert "cc-by-nc-4.0" in one.labels.split(",") and one.score == 1.0
    # "cc by nc" and "general public license" lie inside matches of higher priority; nothing lower survives inside them.
    assert {d["label"] for d in one.detections} == {"cc-by-nc-4.0", "gpl"}
    two = next(r for r in both if r.n_base == 3 and r.n_words == 7)
    assert (two.base_labels, two.first_word, two.last_word) == ("cc-by,reserved", 0, 4)
    assert all(r.score == 0 for r in rows.values() if not r.labels)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    near = base[:120] + 0.1 * rng.standard_normal((120, 16))
    vectors = [v.tolist() for v in np.concatenate([base, near, near[:5], near[:5]])]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [1.0, 0.5], vectors[0]]
    rows = [(i, v, 0, 1) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int, m int")
    found = {r.vec_id: r for r in embed.near_duplicates(frame, block=64, missed=1e-4).collect()}
    assert len(found) == len(rows)
    kept = {r.vec_id: r.embedding for r in frame.collect()}
    good = [i for i, v in kept.items() if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([kept[i] for i in good], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = dict(zip(good, ((m @ m.T >= 0.9).sum(1) - 1).tolist()))
    assert all(found[i].n_links <= links.get(i, 0) for i in found)
    assert sum(found[i].n_links for i in good) >= 0.97 * sum(links.values())
    assert all(found[i].component_id == i and found[i].kept for i in found if i not in links)
    assert found[len(rows) - 1].component_id == found[0].component_id


def test_embeddings_of_a_dense_group(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    noise = rng.standard_normal((700, 32)) * np.linalg.norm(centre) / np.sqrt(32)
    v = np.concatenate([centre + 0.27 * noise, rng.standard_normal((1400, 32))])  # a third of the rows, much more than a block
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embed.near_duplicates(frame, block=16, part=150).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    assert links[:700].min() > 16
    got = np.array([found[i].n_links for i in range(len(v))])
    assert (got <= links).all() and got.sum() >= 0.99 * links.sum()
    assert {found[i].component_id for i in range(700)} == {0}
    # One cell holds all rows of a table below a block: every link is found.
    few = {r.vec_id: r.n_links for r in embed.near_duplicates(frame.filter("vec_id >= 600")).collect()}
    assert [few[i] for i in range(600, 2100)] == ((unit[600:] @ unit[600:].T >= 0.9).sum(1) - 1).tolist()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    made = [
        quality.score(none), mixing.mix(none), mixing.repeated(none), licences.scan(none), simhash.near_duplicates(none),
        simhash.keep_first(none), substring.dedup(none), suffix.dedup(none), bpe.round_trip(none, RANKS, public_tokenizers.PATTERN),
        tokens.count(none, JSON, f"file://{tmp_path}/cache"),
        embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ]
    assert [m.count() for m in made] == [0] * len(made)

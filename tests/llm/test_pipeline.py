"""The pipeline against its SQL twins and brute force, stage by stage, on a small table with nulls, copies and junk."""

import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
import test_operators as brute
from birthwave.llm import bpe
from birthwave.llm.oracle import OP1, OP7

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(12)
    words = "the of and to in is that house river stone grün über wandern light 12 under été".split()
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    passage = say(40)
    out = [say(rng.randint(25, 120)) for _ in range(25)]
    out += [out[3], out[3], out[4].replace("river", "lake", 1), out[5] + " the", out[6].upper()]  # copies and near copies
    out += [say(30) + "\n" + passage, passage + "\n" + say(30), passage, passage + " of the"]
    out += [None, "", " \n ", "short text", "$$$ ### *** " * 40, "same line of words that repeats itself\n" * 9, say(4000)]
    return out


def documents(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def sql(query, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    res = con.execute(query)
    names = [d[0] for d in res.description]
    return [dict(zip(names, r)) for r in res.fetchall()]


def without_windows(rows):
    """Each text without the words of 13-word windows that start in a smaller document too."""
    order = lambda i: 2**62 if i is None else i
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    least = {}
    for i, ws in split:
        for k in range(len(ws) - 12):
            w = tuple(ws[k : k + 13])
            least[w] = min(least.get(w, 2**63), order(i))
    out = []
    for (i, ws), row in zip(split, rows):
        gone = {k + q for k in range(len(ws) - 12) if least[tuple(ws[k : k + 13])] < order(i) for q in range(13)}
        left = b" ".join(w for k, w in enumerate(ws) if k not in gone).decode() if gone else row[1]
        if not gone or len(gone) < len(ws):
            out.append((i, left, *row[2:4], len(left) if gone else row[4]))
    return out


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, "en", None if i % 9 == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    return made + [made[1]]  # a repeated row


def test_stages_and_run(spark, rows, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    sf_dir = documents(spark, tmp_path, rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "substring", "mix", "tokens"]

    kept = {r["doc_id"] for r in sql(OP1, rows) if r["kept"]}
    now = [r for r in rows if r[0] in kept]
    assert 0 < len(now) < len(rows)

    labels = brute.least_linked([brute.brute_fingerprint(r[1] or "", 4) for r in now], [r[0] for r in now], 4)
    now = list({r[0]: r for r, c in zip(now, labels) if r[0] == c}.values())
    assert len(now) < len(kept)

    cut = without_windows(now)
    assert any(a[1] != b[1] for a, b in zip(now, cut))
    copies = Counter({r["doc_id"]: r["taken"] // max(1, r["size"]) for r in sql(OP7, cut)})
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _, source, n in cut:
        want[i, source, n, tuple(library.encode_ordinary(t or "")), brute.sha((t or "").encode())] = copies[i]

    made = corpus_pipeline.run(spark, sf_dir)
    assert set(made.columns) == {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    got = Counter((r.doc_id, r.source, r.n_chars, tuple(r.ids), r.decoded_sha256) for r in made.collect())
    assert got == +want


def test_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, documents(spark, tmp_path, [])).collect() == []

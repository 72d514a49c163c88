"""Byte-level BPE encoding and decoding with DuckDB inside Spark tasks.

Spark partitions the documents; nothing is shuffled. A task splits its texts by
the tokenizer's pattern and encodes each distinct piece once: token-position
rows join the merge table in a recursive query that contracts, per piece, the
leftmost pairs of the lowest rank until no pair is left. Decoding is an ordered
aggregation of the vocabulary's bytes over the (document, position) rows.

The vocabulary has a fixed size (about 1 MB) and reaches the tasks as a Spark
broadcast variable. A task's memo of encoded pieces is bounded and cleared when full.

Defined results: a null text is encoded as the empty text (no ids, the digests
of no bytes); each input row gives one output row; an input column named like an
output is replaced; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carry, outputs, sub_batches

PIECES, CHUNKS = 700_000, 300_000  # remembered by a task
GROUP_CHARS = 100_000  # characters of pieces encoded by one recursive query
LONG = 200  # characters of a long piece
STEP_BYTES = 1 << 20  # text encoded and decoded at a time
DECODE_ROWS = 200  # documents decoded by one query
ROUNDS = 48  # contractions per recursive query, which bounds its result

# Characters with the White_Space property.
SPACE = r"\t-\r \x85\xa0  -     　"
# White space that every library takes as such; a text with other kinds is split as a whole.
CHUNK = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
ODD_SPACE = re.compile(r"[^\S \t\r\n]|[\x1c-\x1f᠎​-‍⁠﻿]")

# What is left of each piece: the rows of its last round.
LAST = """
SELECT s.w, s.tok, s.round FROM state s JOIN (SELECT w, max(round) AS last FROM state GROUP BY w) l ON s.w = l.w AND s.round = l.last ORDER BY pos
"""

# One contraction a round. k orders the pairs of a piece by rank, then from the left. The row behind the pair goes; the
# rows of the pair and before it get a new neighbour. Positions rise over all pieces, so one names a row.
CONTRACT = f"""
WITH RECURSIVE state(w, pos, tok, nxt, npos, k, round) AS (
  SELECT w, pos, tok, nxt, npos, (m.id::BIGINT << 32) + pos, 0 FROM tokens t LEFT JOIN merges m ON m.a = t.tok AND m.b = t.nxt
  UNION ALL
  (WITH b AS (
    SELECT w, min(k) AS best, arg_min(npos, k) AS gone FROM state WHERE k IS NOT NULL AND round < {ROUNDS} GROUP BY w
  ), c AS (
    SELECT b.w, (best >> 32)::INT AS r, (best & 4294967295)::INT AS p, gone, g.nxt AS gnxt, g.npos AS gnpos FROM b JOIN state g ON g.pos = b.gone
  ), s AS (
    SELECT s.w, s.pos, CASE WHEN s.pos = p THEN r ELSE s.tok END AS tok,
      CASE WHEN s.pos = p THEN gnxt WHEN s.npos = p THEN r ELSE s.nxt END AS nxt,
      CASE WHEN s.pos = p THEN gnpos ELSE s.npos END AS npos, s.round + 1 AS round
    FROM state s JOIN c USING (w) WHERE s.pos <> gone
  )
  SELECT s.w, s.pos, s.tok, s.nxt, s.npos, (m.id::BIGINT << 32) + s.pos, s.round FROM s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt)
) {LAST}
"""

# For long pieces: with the leftmost pair also the others of its rank, if no new pair can come before them;
# of a run of overlapping pairs every second one.
CONTRACT_LONG = f"""
WITH RECURSIVE state(w, pos, tok, round) AS (
  SELECT w, pos, tok, 0 FROM tokens
  UNION ALL
  SELECT w, pos, CASE WHEN merged THEN best ELSE tok END, round + 1 FROM (
    SELECT *, lag(merged, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone FROM (
      SELECT *, hit AND (i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY w ORDER BY pos), 0)) % 2 = 1
        AND (safe OR sum(hit::INT) OVER (PARTITION BY w ORDER BY pos) = 1) AS merged FROM (
        SELECT *, coalesce(id = best, false) AS hit FROM (
          SELECT p.w, p.pos, p.tok, p.round, p.i, m.id, m.safe, min(m.id) OVER (PARTITION BY p.w) AS best FROM (
            SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY w ORDER BY pos) AS i FROM state
          ) p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt
        ) WHERE best IS NOT NULL AND round < {ROUNDS}
      )
    )
  ) WHERE NOT gone
) {LAST}
"""

# Positions rise over all documents; the rows are aggregated in their order.
ORDERED = """
FROM (SELECT d, pos, v.hex FROM encoded JOIN vocab v USING (tok) ORDER BY pos) GROUP BY d
"""
DECODE = f"SELECT d, string_agg(hex, '') {ORDERED}"
DECODED_SHA256 = f"SELECT d, sha256(unhex(string_agg(hex, ''))) {ORDERED}"


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def sha256(data: bytes | pa.Buffer) -> str:
    return hashlib.sha256(data).hexdigest()


def valid(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def piece_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its white-space classes written out, so that versions of Unicode tables don't matter."""
    pattern = pattern.replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]")
    return regex.compile(pattern)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, data: bytes, pattern: str):
        ranks = read_ranks(data)
        self.pattern = piece_pattern(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = {t.decode(): np.int32(r).tobytes() for t, r in ranks.items() if valid(t)}
        self.names = pa.array([str(i) for i in range(max(ranks.values()) + 1)])
        self.pieces: dict[str, bytes] = {}
        self.forget()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "150MB"})
        pairs = [
            (ranks[t[:i]], ranks[t[i:]], r)
            for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        # Safe: no pair with this token as a part has a lower rank than the token itself.
        unsafe = {x for a, b, r in pairs for x in (a, b) if r < x}
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*pairs))
        self._table("merges", pa.table({"a": a, "b": b, "id": r, "safe": [x not in unsafe for _, _, x in pairs]}))
        self._table("vocab", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def forget(self) -> None:
        """Empty the memo of chunks: stretches of one array of ids."""
        self.chunks: dict[str, int] = {}
        self.flat, self.starts = array("i"), array("q", [0])

    def _contract(self, pieces: list[bytes], query: str = CONTRACT) -> list[bytes]:
        """Ids of distinct pieces as packed integers; those with more contractions than ``ROUNDS`` go on in a further query."""
        out = [b""] * len(pieces)
        which, lengths = np.arange(len(pieces), dtype=np.int32), np.fromiter(map(len, pieces), np.int64, len(pieces))
        tok = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(which):
            w, pos = np.repeat(which, lengths), np.arange(len(tok), dtype=np.int32)
            last = np.zeros(len(tok), bool)
            last[np.cumsum(lengths) - 1] = True
            nxt, npos = pa.array(np.roll(tok, -1), mask=last), pa.array(pos + 1, mask=last)
            self.con.register("tokens", pa.table({"w": w, "pos": pos, "tok": tok, "nxt": nxt, "npos": npos}))
            rows = self.con.execute(query).fetchnumpy()
            self.con.unregister("tokens")
            w, tok, open_ = (np.asarray(rows[k]) for k in ("w", "tok", "round"))
            tok, open_ = tok.astype(np.int32), open_ == ROUNDS
            starts = np.concatenate([[0], np.flatnonzero(w[1:] != w[:-1]) + 1])
            stops, raw = np.concatenate([starts[1:], [len(w)]]), tok.tobytes()
            for i, a, b in zip(w[starts].tolist(), (4 * starts).tolist(), (4 * stops).tolist()):
                out[i] = raw[a:b]
            more = open_[starts]
            which, lengths, tok = w[starts][more].astype(np.int32), (stops - starts)[more], tok[open_]
        return out

    def _remember(self, pieces: list[str]) -> None:
        """Encode new pieces: those in the vocabulary directly, the others by contraction in groups of bounded size."""
        groups: dict[str, list[str]] = {}
        for p in pieces:
            if p in self.whole:
                self.pieces[p] = self.whole[p]
            else:
                groups.setdefault(CONTRACT if len(p) <= LONG else CONTRACT_LONG, []).append(p)
        for query, todo in groups.items():
            start = size = 0
            for i, p in enumerate(todo):
                size += len(p)
                if size >= GROUP_CHARS or i == len(todo) - 1:
                    part = todo[start : i + 1]
                    self.pieces.update(zip(part, self._contract([x.encode() for x in part], query)))
                    start, size = i + 1, 0

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text."""
        if len(self.chunks) > CHUNKS:
            self.forget()
        if len(self.pieces) > PIECES:
            self.pieces = {}
        parts = [self.parts(t) for t in texts]
        new = {c: self.pattern.findall(c) for c in {c for ps in parts for c in ps}.difference(self.chunks)}
        self._remember(list({p for ps in new.values() for p in ps}.difference(self.pieces)))
        for c, ps in new.items():
            self.chunks[c] = len(self.starts) - 1
            for p in ps:
                self.flat.frombytes(self.pieces[p])
            self.starts.append(len(self.flat))
        index = np.fromiter((self.chunks[c] for ps in parts for c in ps), np.int64, sum(map(len, parts)))
        flat, starts = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.starts, np.int64)
        first, counts = starts[index], starts[index + 1] - starts[index]
        stops = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(first - stops[:-1], counts) + np.arange(stops[-1])]
        offsets = stops[np.concatenate([[0], np.cumsum([len(ps) for ps in parts], dtype=np.int64)])]
        del flat, starts
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    @staticmethod
    def parts(text: str) -> list[str]:
        """Stretches that no piece crosses: white space with the word behind it."""
        return [text] if ODD_SPACE.search(text) else CHUNK.findall(text)

    def listed_sha256(self, ids: pa.ListArray) -> list[str]:
        """Digests of the decimal ids joined by one space."""
        named = pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values))
        return [sha256(x.as_buffer()) for x in pa.compute.binary_join(named, " ")]

    def _decoded(self, ids: pa.ListArray, query: str) -> dict[int, str]:
        offsets, tok = ids.offsets.to_numpy(), ids.values
        d = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
        tok = tok.slice(offsets[0], len(d))
        self.con.register("encoded", pa.table({"d": d, "pos": np.arange(len(d), dtype=np.int32), "tok": tok}))
        found = dict(self.con.execute(query).fetchall())
        self.con.unregister("encoded")
        return found

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        found = self._decoded(ids, DECODE)
        return [bytes.fromhex(found.get(i, "")) for i in range(len(ids))]

    def decoded_sha256(self, ids: pa.ListArray) -> list[str]:
        found, none = self._decoded(ids, DECODED_SHA256), sha256(b"")
        return [found.get(i, none) for i in range(len(ids))]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The codec of this worker process, made once per vocabulary."""
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def vocabulary(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Input columns (on request without the text) with ``ids`` (array of int)."""
    data = vocabulary(docs.sparkSession, path)
    kept = [c for c in docs.columns if keep_text or c != text]
    df = docs.select(F.struct(*(docs[c] for c in kept)).alias("_row"), F.coalesce(docs[text], F.lit("")).alias("_text"))

    def run(batches):
        own = codec(data.value, pattern)
        for batch in sub_batches(batches, "_text", STEP_BYTES):
            ids = own.encode(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), ids], names=["_row", "ids"])

    row = df.schema["_row"].dataType.simpleString()
    return df.mapInArrow(run, f"_row {row}, ids array<int>").select(*outputs(kept, {"ids": F.col("ids")}))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Input columns with ``decoded`` (binary); a null list decodes to no bytes."""
    data = vocabulary(encoded.sparkSession, path)
    df = carry(encoded, ids).select("_row", F.coalesce(F.col(f"_{ids}"), F.array().cast("array<int>")).alias("_ids"))

    def run(batches):
        own = codec(data.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(start, DECODE_ROWS)
                made = pa.array(own.decode(part.column("_ids")), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_row"), made], names=["_row", "decoded"])

    row = df.schema["_row"].dataType.simpleString()
    return df.mapInArrow(run, f"_row {row}, decoded binary").select(*outputs(encoded.columns, {"decoded": F.col("decoded")}))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_text: bool = True, keep_ids: bool = False) -> DataFrame:
    """Input columns with the number and digest of the ids and the digest of the bytes decoded from them.

    Both steps run in one Python worker per task, as each worker holds a codec.
    """
    data = vocabulary(docs.sparkSession, path)
    kept = [c for c in docs.columns if keep_text or c != text]
    df = docs.select(F.struct(*(docs[c] for c in kept)).alias("_row"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    made = {"ids": "array<int>"} if keep_ids else {}
    made |= {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches):
        own = codec(data.value, pattern)
        for batch in sub_batches(batches, "_text", STEP_BYTES):
            ids = own.encode(batch.column("_text").to_pylist())
            lists = {"ids": ids, "n_tokens": ids.value_lengths().cast(pa.int64())}
            lists["ids_sha256"] = pa.array(own.listed_sha256(ids))
            lists["decoded_sha256"] = pa.array(own.decoded_sha256(ids))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *(lists[k] for k in made)], names=["_row", *made])

    row = df.schema["_row"].dataType.simpleString()
    rows = df.mapInArrow(run, ", ".join([f"_row {row}", *(f"{k} {v}" for k, v in made.items())]))
    return rows.select(*outputs(kept, {k: F.col(k) for k in made}))

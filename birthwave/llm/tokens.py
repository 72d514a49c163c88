"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer version, content digest, counts).
Digests of the documents' content are joined to it; only distinct contents
without an entry are encoded, and their counts are appended. The version digest
covers the tokenizer file and the library version, so a changed tokenizer never
meets old counts. Texts move once, grouped by digest after a partial grouping
in each task, so a hot text reaches the encoder from each task at most once.

Content is normalised only by reading null as empty: the counts must be those
of the whole text as the library gives them. With a byte-level tokenizer that
splits text by itself, white space with the word behind it is counted on its
own and remembered in a bounded memo; other tokenizers get whole texts.

Defined results: each input row gives one output row; null texts count as
empty; an input column named like an output is replaced; entries that two runs
appended for one digest are equal and read as one; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, ODD_SPACE
from .common import carry, outputs, sub_batches

MEMO = 300_000
CACHE = "version string, digest binary, n_bytes long, n_tokens long"


class Counter:
    """Counts tokens as the library does for whole texts."""

    def __init__(self, data: bytes, kind: str):
        self.memo: dict[str, int] = {}
        self.split = False
        if kind == ".model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.count_all = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(data.decode())
            model.no_padding()
            model.no_truncation()
            self.split = splits_by_space(json.loads(data))
            self.count_all = lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.count_all(texts)
        if len(self.memo) > MEMO:
            self.memo = {}
        parts = [[t] if ODD_SPACE.search(t) else CHUNK.findall(t) for t in texts]
        new = list({c for ps in parts for c in ps}.difference(self.memo))
        self.memo.update(zip(new, self.count_all(new)))
        known = self.memo.__getitem__
        return [sum(map(known, ps)) for ps in parts]


def splits_by_space(spec: dict) -> bool:
    """True if no token crosses from a word into the white space behind it, so that stretches add up."""
    pre = spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens") or []]
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not spec.get("normalizer") and not any(re.search(r"\s", t) for t in added)
    )


_counters: dict[str, Counter] = {}


def version_of(data: bytes, kind: str) -> str:
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if kind == ".model" else f"tokenizers {tokenizers.__version__}"
    return hashlib.sha256(data + library.encode()).hexdigest()


def read_cache(spark, cache_dir: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest."""
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("version").parquet(cache_dir)
    rows = spark.read.schema(CACHE).parquet(cache_dir).filter(F.col("version") == version)
    return rows.groupBy("digest").agg(F.min("n_bytes").alias("n_bytes"), F.min("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, path: str, cache_dir: str, text: str = "text") -> str:
    """Encode the distinct contents that the cache lacks and append their counts; returns the version digest."""
    kind = os.path.splitext(path)[1]
    with open(path, "rb") as f:
        data = f.read()
    version = version_of(data, kind)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        counter = _counters.get(version)
        if counter is None:
            counter = _counters[version] = Counter(shared.value, kind)
        for batch in sub_batches(batches, "text"):
            counts = pa.array(counter.count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_bytes"), counts], names=["digest", "n_bytes", "n_tokens"])

    content = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    distinct = content.groupBy(F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(docs.sparkSession, cache_dir, version), "digest", "left_anti")
    counted = misses.select("digest", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = counted.mapInArrow(run, "digest binary, n_bytes long, n_tokens long").withColumn("version", F.lit(version))
    counted.write.mode("append").partitionBy("version").parquet(cache_dir)
    return version


def count(docs: DataFrame, path: str, cache_dir: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Input columns with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    version = fill_cache(docs, path, cache_dir, text)
    digests = carry(docs, text).select("_row", F.unhex(F.sha2(F.coalesce(F.col(f"_{text}"), F.lit("")), 256)).alias("digest"))
    rows = digests.join(read_cache(docs.sparkSession, cache_dir, version), "digest", "left")
    made = {"n_bytes": F.col("n_bytes"), "n_tokens": F.col("n_tokens"), "over_limit": F.col("n_tokens") > limit}
    return rows.select(*outputs(docs.columns, made))

"""The training-data pipeline: five stages over ``documents``, each written and read again.

SQL cannot express the chain (SimHash groups, byte-level BPE), so there is no
twin; a brute-force version of the first four stages and the tokenizer library
check it on small tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from birthwave.llm import bpe, mixing, quality, simhash, substring
from birthwave.llm.common import documents, stage_root

ORACLE_SQL = None
# Near-duplicates differ in at most so many bits of the fingerprint of their word shingles.
SHINGLE, ERRORS = 4, 4


def quality_stage(spark, docs, sf_dir):
    """Documents that pass the quality rules."""
    return quality.keep(docs)


def simhash_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs, errors=ERRORS, shingle=SHINGLE)


def substring_stage(spark, docs, sf_dir):
    """Texts without word windows that a smaller document has; emptied documents go."""
    return substring.keep_rest(docs, n_chars="n_chars")


def mix_stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def token_stage(spark, docs, sf_dir):
    """Token ids instead of the text, their digest, and the digest of the bytes decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False, keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("substring", substring_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]


def run(spark, sf_dir):
    docs, root = documents(spark, sf_dir), f"{stage_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES[:-1]:
        step(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

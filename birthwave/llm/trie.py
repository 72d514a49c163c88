"""Prefix trie of conversations as a distributed z-fast trie.

A conversation is a string of turns, a turn a digest of role and text, a prefix
a chained digest. The trie is compacted: a node stands for the edge of depths
``(lo, hi]`` above its extent, and is found by its handle, the prefix whose depth
is the two-fattest number of that interval (the one with the most trailing
zeros). Nodes are rows of a written table.

Distinct strings are inserted in batches. Each string of a batch locates its
exit node by fat binary search: a round looks up the prefix at the two-fattest
depth of the interval still open, so log2(turns) equi-joins with the handles end
it; one more with the first prefix of every edge finds the child by which it
leaves. Its common part with the exit edge says where the edge is cut. Only what
lies below the cuts is spread out, grouped by prefix and compacted, so the part
that a batch shares with earlier ones never moves. Nodes then get the sums of
their subtrees by pointer doubling, in as many rounds as the logarithm of the
compacted height, and every edge is expanded to one row per depth.

Defined results: null role or text is empty; turns are ordered by their number,
null first, and of equal numbers by digest; repeated rows are turns of their own;
rows without a conversation id are left out; a conversation without turns ends
at the root; no conversations give no nodes; input columns other than the four
named are ignored. The digests of one conversation (24 bytes a turn) have to fit
a task, the ids of equal conversations do not: they are hashed as a sorted stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARES = (1 / 16, 1.0)  # parts of the strings that the first batches end with
GRAIN = 1 << 20


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


ROOT = digest(b"")


def spoken(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: per conversation its ordered turns as structs of digest ``tok`` and text ``bytes``."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role, text))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(
        turns[conv_id].cast("long").alias("conv_id"),
        F.struct(
            turns[turn].isNotNull().alias("given"), turns[turn].alias("turn"),
            F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("tok"), F.octet_length(text).cast("long").alias("bytes"),
        ).alias("one"),
    ).filter("conv_id IS NOT NULL")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda x: F.struct(x["tok"].alias("tok"), x["bytes"].alias("bytes"))))


def with_prefixes(convs: DataFrame) -> DataFrame:
    """``conv_id, sid, depth, ph, total``: prefix digests and prefix bytes of depths 0 to ``depth``; ``sid`` is the last digest."""

    def run(batches):
        for batch in batches:
            made = []
            for turns in batch.column("turns").to_pylist():
                ph, total = [ROOT], [0]
                for t in turns:
                    ph.append(digest(ph[-1] + t["tok"]))
                    total.append(total[-1] + t["bytes"])
                made.append((ph[-1], len(turns), ph, total))
            kinds = (pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            columns = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "sid", "depth", "ph", "total"])

    return convs.select("conv_id", "turns").mapInArrow(run, "conv_id long, sid binary, depth int, ph array<binary>, total array<long>")


def ends_of(convs: DataFrame) -> DataFrame:
    """``sid, ends_sha256`` of the ids of equal conversations, read as a sorted stream."""

    def run(batches):
        now, seen = None, None
        for batch in batches:
            done = []
            for sid, conv in zip(batch.column("sid").to_pylist(), batch.column("conv_id").to_pylist()):
                if sid != now:
                    if now is not None:
                        done.append((now, seen.hexdigest()))
                    now, seen = sid, hashlib.sha256(str(conv).encode())
                else:
                    seen.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.binary(), pa.string()))], names=["sid", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([seen.hexdigest()])], names=["sid", "ends_sha256"])

    return convs.select("sid", "conv_id").repartition("sid").sortWithinPartitions("sid", "conv_id").mapInArrow(run, "sid binary, ends_sha256 string")


def two_fattest(low: str, high: str) -> Column:
    """The number of ``(low, high]`` with the most trailing zero bits."""
    return F.expr(f"{high} & shiftleft(-1, length(bin({low} ^ {high})) - 1)")


def described(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """Nodes ``lo, hi, rep`` with the digests of their extent, handle, first edge prefix and parent."""
    path = strings.select(F.col("sid").alias("rep"), "ph")
    rows = nodes.join(path, "rep").withColumn("fat", two_fattest("lo", "hi"))
    at = lambda d: F.col("ph")[F.expr(d)]
    return rows.select("lo", "hi", "rep", at("hi").alias("ext"), at("fat").alias("handle"), at("lo + 1").alias("start"), at("lo").alias("parent"))


def located(batch: DataFrame, trie: DataFrame, strings: DataFrame, rounds: int) -> DataFrame:
    """The batch with ``common`` (turns shared with the trie) and, if it leaves inside an edge, that edge's ``ext, lo, hi``."""
    found = trie.select("handle", F.struct("ext", "lo", "hi", "rep").alias("node"))
    none = F.lit(None).cast(found.schema["node"].dataType)
    rows = batch.withColumns({"a": F.lit(0), "b": F.col("depth"), "exit": none})
    for _ in range(rounds):
        rows = rows.withColumns({"open": F.expr("a < b AND exit IS NULL"), "f": F.when(F.expr("a < b"), two_fattest("a", "b"))})
        # A string that is done looks up its own digest, so that no key gathers the done ones.
        rows = rows.withColumn("key", F.when(F.col("open"), F.col("ph")[F.col("f")]).otherwise(F.col("sid")))
        rows = rows.join(found, F.col("key") == F.col("handle"), "left")
        rows = rows.withColumn("hit", F.expr("open AND node IS NOT NULL"))
        rows = rows.withColumn("whole", F.expr("hit AND node.hi <= depth AND get(ph, node.hi) = node.ext"))
        rows = rows.select(
            *batch.columns, F.expr("if(whole, node.hi, a)").alias("a"), F.expr("if(open AND NOT hit, f - 1, b)").alias("b"),
            F.expr("if(hit AND NOT whole, node, exit)").alias("exit"),
        )
    edges = trie.select("start", F.struct("ext", "lo", "hi", "rep").alias("node"))
    rows = rows.withColumn("open", F.expr("exit IS NULL AND a < depth"))
    rows = rows.withColumn("key", F.when(F.col("open"), F.col("ph")[F.col("a") + 1]).otherwise(F.col("sid")))
    rows = rows.join(edges, F.col("key") == F.col("start"), "left")
    rows = rows.select(*batch.columns, "a", F.expr("if(open AND node IS NOT NULL, node, exit)").alias("exit"))
    rows = rows.withColumn("key", F.coalesce("exit.rep", "sid")).join(strings.select(F.col("sid").alias("key"), F.col("ph").alias("path")), "key")
    shared = "exit.lo + size(filter(sequence(exit.lo + 1, least(depth, exit.hi)), d -> get(ph, d) = get(path, d)))"
    rows = rows.withColumn("common", F.expr(f"if(exit IS NULL, a, {shared})").cast("int"))
    inside = F.expr("exit IS NOT NULL AND common > exit.lo AND common < exit.hi")
    return rows.select(*batch.columns, "common", F.when(inside, F.col("exit.ext")).alias("edge"))


def cut(trie: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes ``lo, hi, rep`` after cutting edges at the depths at which strings leave them."""
    cuts = rows.filter("edge IS NOT NULL").groupBy("edge").agg(F.sort_array(F.collect_set("common")).alias("cuts"))
    parts = trie.join(cuts, F.col("ext") == F.col("edge"), "left")
    bounds = F.concat(F.array("lo"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("hi"))
    parts = parts.select("rep", bounds.alias("at")).select("rep", "at", F.explode(F.expr("sequence(1, size(at) - 1)")).alias("i"))
    return parts.select(F.expr("at[i - 1]").alias("lo"), F.expr("at[i]").alias("hi"), "rep")


def grown(rows: DataFrame) -> DataFrame:
    """Compacted nodes ``lo, hi, rep`` of the parts of the strings below ``common``."""
    spread = rows.filter("common < depth").select("sid", "depth", "common", "ph", F.explode(F.expr("sequence(common + 1, depth)")).alias("d"))
    spread = spread.select("sid", "depth", "common", "d", F.expr("ph[d]").alias("g"), F.expr("ph[d - 1]").alias("up"))
    prefixes = spread.groupBy("g").agg(F.min("sid").alias("rep"), F.first("up").alias("up"), F.max(F.expr("d = depth")).alias("ends"))
    kids = prefixes.groupBy(F.col("up").alias("g")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = prefixes.join(kids, "g", "left").filter("ends OR kids > 1").select("g", "rep")
    above = F.lag("d").over(Window.partitionBy("sid").orderBy("d"))
    path = spread.join(nodes, "g").withColumn("lo", F.coalesce(above, "common"))
    return path.filter("sid = rep").select(F.col("lo").cast("int").alias("lo"), F.col("d").alias("hi"), "rep")


def build(strings: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Described nodes of the compacted trie of ``strings`` (``sid, depth, ph``), without the root."""
    deepest = strings.agg(F.max("depth")).first()[0] or 0
    trie, before = None, 0.0
    slot = F.pmod(F.xxhash64("sid"), F.lit(GRAIN))
    for share in shares:
        batch = strings.filter((slot >= int(before * GRAIN)) & (slot < int(share * GRAIN))).select("sid", "depth", "ph")
        before = share
        if trie is None:
            nodes = grown(batch.withColumn("common", F.lit(0)))
        else:
            rows = stage(located(batch, trie, strings, deepest.bit_length()), "trie-located")
            nodes = cut(trie, rows).unionByName(grown(rows))
        trie = stage(described(nodes, strings), "trie-nodes")
    return trie


def subtree_sums(nodes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """``ext`` with the sums and the least value over each node's subtree, by pointer doubling over ``ext, parent``."""
    values = nodes.select("ext", *sums, least)
    links = nodes.filter("parent IS NOT NULL").select("ext", F.col("parent").alias("above"))
    while True:
        given = links.join(values, "ext").groupBy(F.col("above").alias("ext")).agg(*[F.sum(s).alias(f"_{s}") for s in sums], F.min(least).alias("_least"))
        more = [(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]
        values = stage(values.join(given, "ext", "left").select("ext", *more, F.least(least, "_least").alias(least)), "trie-sums")
        further = links.select(F.col("ext").alias("above"), F.col("above").alias("next"))
        links = stage(links.join(further, "above").select("ext", F.col("next").alias("above")), "trie-links")
        if links.isEmpty():
            return values


def node_table(convs: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Every prefix of the conversations ``conv_id, turns`` as a row with the figures of its subtree."""
    convs = stage(with_prefixes(convs), "trie-conversations")
    strings = convs.groupBy("sid").agg(
        F.count(F.lit(1)).alias("m"), F.min("conv_id").alias("least"), F.first("depth").alias("depth"),
        F.first("ph").alias("ph"), F.first("total").alias("total"),
    )
    strings = stage(strings, "trie-strings")
    trie = build(strings, shares)
    bytes_at = strings.select(F.col("sid").alias("rep"), F.col("total").alias("path"))
    # Bytes of the prefixes of depths lo to hi; the root has an edge of its own from depth -1.
    edges = trie.join(bytes_at, "rep").select("ext", "parent", "lo", "hi", F.expr("slice(path, lo + 1, hi - lo + 1)").alias("t"))
    top = convs.sparkSession.createDataFrame([(bytearray(ROOT), None, -1, 0, [0, 0])], edges.schema)
    edges = edges.unionByName(top)
    kids = edges.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("ext")).agg(F.count(F.lit(1)).alias("kids"))
    ended = strings.select(F.col("sid").alias("ext"), "m", "least", F.expr("m * total[depth]").alias("mt"))
    nodes = edges.join(kids, "ext", "left").join(ended, "ext", "left").select(
        "ext", "parent", "lo", "hi", "t", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("m", F.lit(0)).alias("n_convs"),
        F.coalesce("mt", F.lit(0)).alias("member_bytes"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        F.expr("element_at(t, -1) - t[0]").alias("edge_bytes"), "least",
    )
    nodes = stage(nodes, "trie-edges")
    sums = subtree_sums(nodes, ["n_convs", "member_bytes", "n_leaves", "edge_bytes"], "least")
    own = nodes.select("ext", "parent", "lo", "hi", "t", "kids").join(sums, "ext").join(ends_of(convs).withColumnRenamed("sid", "ext"), "ext", "left")
    up = sums.select(F.col("ext").alias("parent"), F.col("least").alias("parent_least"))
    rows = own.join(up, "parent", "left").filter("n_convs > 0").withColumn("depth", F.explode(F.expr("sequence(lo + 1, hi)")))
    # Bytes before the node's last text, and those of the edges at and below the node.
    rows = rows.withColumns({"last": F.col("depth") == F.col("hi"), "before": F.expr("t[depth - lo - 1]")})
    below = F.expr("edge_bytes - (before - t[0])")
    return rows.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.expr("if(depth = lo + 1, parent_least, least)").alias("parent_conv_id"), "n_convs",
        F.expr("if(last, kids, 1L)").alias("n_children"), "n_leaves",
        (F.col("member_bytes") - F.col("n_convs") * F.col("before") - below).alias("saved_tokens"),
        F.when(F.col("last"), F.col("ends_sha256")).otherwise(F.lit(None)).alias("ends"),
    ).select("*", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")).drop("ends")


def shared_starts(convs: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """Conversations rebuilt: the first turns of the group's first conversation, then the own turns after as many.

    Their number is the CRC of the id modulo ``spread``.
    """
    base = convs.select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, spread - 1).alias("base"))
    rows = convs.withColumns({"base_id": F.col("conv_id") - F.col("conv_id") % group, "h": (F.crc32(F.col("conv_id").cast("string")) % spread).cast("int")})
    rows = rows.join(base, "base_id", "left")
    head = F.coalesce(F.slice("base", 1, F.col("h")), F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))

"""The trie of conversation prefixes: which conversations begin alike, and what sharing saves.

Every prefix has a digest, the exclusive or of one 128-bit hash for each turn and its place, so
that prefixes of any length add up from pieces of bounded size. A conversation owns the nodes
of which it is the smallest member. Ownership is monotone in depth: whoever owns a node owns all
further ones on its own path, so the first owned depth is found by binary search, in joins of
all open probes at once against the minima of digests. Owned chains make up the tree; each sums
itself from its end upwards and passes its total on to the nodes of other owners above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panolith.session import Scratch

CHUNK = 256  # turns of one conversation in one row
TURN = "a long, b long, z long"
NODE = ["depth", "k0", "k1"]
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, conv_id, a, b, z) of a sorted partition as rows of at most CHUNK turns."""
    held: pa.Table | None = None
    seen = 0

    def out(table: pa.Table, begin: np.ndarray, first: int) -> pa.RecordBatch:
        part, conv, a, b, z = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        at = pa.array(begin[:-1])
        turns = pa.StructArray.from_arrays([a, b, z], names=["a", "b", "z"])
        lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), turns)
        return pa.RecordBatch.from_arrays([part.take(at), conv.take(at), pa.array(first + np.arange(len(begin) - 1)), lists], names=["part", "conv_id", "nth", "turns"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        conv = table.column(1).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        since = np.arange(len(conv)) - np.repeat(new, np.diff([*new, len(conv)]))
        begin = np.flatnonzero(since % CHUNK == 0)
        held = table.slice(int(begin[-1]))
        if len(begin) > 1:
            yield out(table.slice(0, int(begin[-1])), begin, seen)
            seen += len(begin) - 1
    if held is not None:
        yield out(held.combine_chunks(), np.array([0, held.num_rows]), seen)


def turn_chunks(rows: DataFrame, held: Scratch, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, start, turns: the turns of each conversation in order, as digests and byte lengths.

    Turns go by number (null first), then role, then text. They are dealt by ranges of
    (conv_id, turn), so that a conversation of any length spreads over tasks; texts stay there.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    plain = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), said.alias("text"))
    ordered = plain.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    lean = ordered.select(F.spark_partition_id().alias("part"), "conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("z"))
    chunks = held(lean.mapInArrow(_gathered, f"part int, conv_id long, nth long, turns array<struct<{TURN}>>"), "trie-chunks")
    before = W.partitionBy("conv_id").orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)
    return held(chunks.select("conv_id", F.coalesce(F.sum(F.size("turns")).over(before), F.lit(0)).cast("long").alias("start"), "turns"), "trie-turns")


def grafted(chunks: DataFrame, base: Column, keep: Column, most: int, held: Scratch) -> DataFrame:
    """Chunks (conv_id, first, turns) of conversations rebuilt on others, with the root in front.

    Each gets the first ``keep`` turns (``most`` at most) of conversation ``base``, all if it has
    fewer and none if it is absent, and then its own turns after its first ``keep``. ``first`` is
    the depth of the first of ``turns``; at depth 0 stands a turn without text.
    """
    root = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in "abz"]))
    fronts = chunks.where(F.col("start") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", F.slice("turns", 1, most).alias("t")))).alias("parts"))
    front = fronts.select(F.col("conv_id").alias("base"), F.flatten(F.col("parts.t")).alias("front"))
    plans = chunks.where("start = 0").select("conv_id", base.cast("long").alias("base"), keep.cast("int").alias("keep"))
    heads = held(plans.join(front, "base", "left").select("conv_id", "keep", F.coalesce(F.slice("front", F.lit(1), F.col("keep")), F.filter(root, lambda _: F.lit(False))).alias("turns")), "trie-heads")
    begun = heads.select("conv_id", "keep", F.size("turns").alias("k"))
    skip = F.greatest(F.col("keep") - F.col("start"), F.lit(0))
    own = chunks.join(begun, "conv_id").select("conv_id", (F.col("k") + F.greatest(F.col("start") - F.col("keep"), F.lit(0)) + 1).alias("first"), F.slice("turns", (skip + 1).cast("int"), F.lit(CHUNK)).alias("turns"))
    return heads.select("conv_id", F.lit(0).cast("long").alias("first"), F.concat(root, "turns").alias("turns")).unionByName(own.where(F.size("turns") > 0))


def rooted(chunks: DataFrame) -> DataFrame:
    """Chunks as :func:`grafted` gives them, of conversations as they are."""
    root = F.struct(*[F.lit(0).cast("long").alias(c) for c in "abz"])
    begins = F.col("start") == 0
    return chunks.select("conv_id", F.when(begins, 0).otherwise(F.col("start") + 1).cast("long").alias("first"), F.when(begins, F.concat(F.array(root), "turns")).otherwise(F.col("turns")).alias("turns"))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each chunk, the digest up to every turn (from the chunk's beginning)."""
    for batch in batches:
        first, lists = batch.column(1).to_numpy(), batch.column(2)
        size = np.diff(lists.offsets.to_numpy())
        begin = np.cumsum(size) - size
        turns = lists.flatten()
        depth = (np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(first, size)).astype(np.uint64)
        fields = []
        for name, step in zip("ab", STEPS):
            x = turns.field(name).to_numpy(zero_copy_only=False).view(np.uint64)
            x = np.where(depth > 0, _mixed(_mixed(depth * step) + x), np.uint64(0))
            upto = np.bitwise_xor.accumulate(x) if len(x) else x
            upto ^= np.repeat(np.concatenate([upto[:1] ^ upto[:1], upto])[begin], size)
            fields.append(pa.array(upto.view(np.int64)))
        made = pa.StructArray.from_arrays([*fields, turns.field("z")], names=["k0", "k1", "z"])
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([begin, [size.sum()]]).astype(np.int32)), made)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["conv_id", "first", "k"])


def prefix_digests(chunks: DataFrame, held: Scratch) -> DataFrame:
    """conv_id, first, c0, c1 (the digest before the chunk), k: digest and bytes of every turn."""
    local = held(chunks.select("conv_id", "first", "turns").mapInArrow(_summed, "conv_id long, first long, k array<struct<k0:long,k1:long,z:long>>"), "trie-local")
    before = W.partitionBy("conv_id").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    last = F.element_at("k", -1)
    carried = local.select("conv_id", "first", "k", *[F.coalesce(F.bit_xor(last[x]).over(before), F.lit(0).cast("long")).alias(y) for x, y in (("k0", "c0"), ("k1", "c1"))])
    whole = F.transform("k", lambda x: F.struct(x["k0"].bitwiseXOR(F.col("c0")).alias("k0"), x["k1"].bitwiseXOR(F.col("c1")).alias("k1"), x["z"].alias("z")))
    return held(carried.select("conv_id", "first", "c0", "c1", whole.alias("k")), "trie-digests")


def _prefixes(digests: DataFrame) -> DataFrame:
    """conv_id, depth, k0, k1, z, p0, p1 (the digest one turn before): one row for each prefix."""
    parents = F.concat(F.array(F.struct(F.col("c0").alias("k0"), F.col("c1").alias("k1"))), F.transform("k", lambda x: F.struct(x["k0"].alias("k0"), x["k1"].alias("k1"))))
    both = digests.select("conv_id", "first", F.posexplode(F.arrays_zip("k", F.slice(parents, F.lit(1), F.size("k")).alias("p"))).alias("i", "x"))
    return both.select("conv_id", (F.col("first") + F.col("i")).alias("depth"), *[F.col(f"x.k.{c}").alias(c) for c in ("k0", "k1", "z")], F.col("x.p.k0").alias("p0"), F.col("x.p.k1").alias("p1"))


def first_owned(digests: DataFrame, minima: DataFrame, spark_held: Scratch) -> DataFrame:
    """conv_id, first_owned for each conversation that owns a node.

    Each chunk is searched on its own, all at once: ``lo`` to ``hi`` bound the place of its first
    owned turn, and a round joins the digest in the middle with the minima. Chunks before the
    first owned depth find none, chunks after it find their first.
    """
    found = None
    now = digests.select("conv_id", "first", "k", F.lit(1).alias("lo"), (F.size("k") + 1).alias("hi"))
    rounds = CHUNK.bit_length() + 1
    for i in range(rounds):
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        probes = now.withColumn("mid", middle).withColumns({"depth": F.col("first") + F.col("mid") - 1, "k0": F.element_at("k", F.col("mid"))["k0"], "k1": F.element_at("k", F.col("mid"))["k1"]})
        owned = F.col("owner") == F.col("conv_id")
        told = probes.join(minima.select(*NODE, "owner"), NODE).select("conv_id", "first", "k", F.when(owned, F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"), F.when(owned, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        told = spark_held(told, f"trie-search-{i}")
        done = told.where("lo = hi AND hi <= size(k)").select("conv_id", (F.col("first") + F.col("lo") - 1).alias("first_owned"))
        found = done if found is None else found.unionByName(done)
        now = told.where("lo < hi")
        if now.isEmpty():
            break
    return spark_held(found.groupBy("conv_id").agg(F.min("first_owned").alias("first_owned")), "trie-owned")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, k0, k1, ends_sha256 from rows (depth, k0, k1, conv_id) of a sorted partition; ids
    stream through the hash, so that a node of any number of ends takes no memory."""
    now, digest = None, None
    out: list[tuple] = []

    def told() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "ends_sha256"])
        out.clear()
        return got

    for batch in batches:
        depth, k0, k1, ids = (c.to_numpy() for c in batch.columns)
        if not len(ids):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])]))
        ids = ids.tolist()
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)]):
            node = (int(depth[lo]), int(k0[lo]), int(k1[lo]))
            told_ids = ",".join(map(str, ids[lo:hi])).encode()
            if node == now:
                digest.update(b"," + told_ids)
                continue
            if now is not None:
                out.append((*now, digest.hexdigest()))
            now, digest = node, hashlib.sha256(told_ids)
        yield told()
    if now is not None:
        out.append((*now, digest.hexdigest()))
    yield told()


def trie(chunks: DataFrame, held: Scratch) -> DataFrame:
    """One row per node from rooted chunks; see :func:`prefix_trie`."""
    digests = prefix_digests(chunks, held)
    prefixes = _prefixes(digests)
    minima = held(prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("z").alias("z"), F.min("p0").alias("p0"), F.min("p1").alias("p1")), "trie-minima")
    owned = first_owned(digests, minima, held)
    children = minima.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"))
    nodes = held(minima.join(children, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "worth": (F.col("n_convs") - 1) * F.col("z")}), "trie-nodes")
    # A chain from its end upwards; then what it hands on to the prefixes that others own.
    upwards = W.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    chains = nodes.select(*NODE, "owner", F.sum("worth").over(upwards).alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).over(upwards).alias("leaves"))
    chains = held(chains, "trie-chains")
    totals = chains.join(owned, (F.col("owner") == F.col("conv_id")) & (F.col("depth") == F.col("first_owned"))).select("conv_id", "first_owned", "saved", "leaves")
    passed = prefixes.select("conv_id", *NODE).join(totals, "conv_id").where("depth < first_owned").select(*NODE, "saved", "leaves")
    sums = chains.select(*NODE, "saved", "leaves").unionByName(passed).groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    last = digests.groupBy("conv_id").agg(F.max(F.struct((F.col("first") + F.size("k") - 1).alias("depth"), F.element_at("k", -1)["k0"].alias("k0"), F.element_at("k", -1)["k1"].alias("k1"))).alias("e"))
    ends = last.select("e.*", "conv_id").repartition("k0", "k1", "depth").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_ends, "depth long, k0 long, k1 long, ends_sha256 string")
    parents = minima.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("owner").alias("parent_conv_id"))
    whole = nodes.join(held(sums, "trie-sums"), NODE).join(held(ends, "trie-ends"), NODE, "left").join(parents.where("depth > 0"), ["depth", "p0", "p1"], "left")
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    return whole.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame, base: Column | None = None, keep: Column | None = None, most: int = 8, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per different prefix, the textless root included: conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are turns (conv_id, turn, role, text), null roles and texts empty; rows with a null
    conv_id belong to no conversation and are left out; repeated rows are turns of their own;
    other columns have no say; an empty table has no node. With ``base`` and ``keep``, columns over
    conv_id, conversations are rebuilt first (:func:`grafted`).
    """
    with Scratch(rows.sparkSession) as held:
        chunks = turn_chunks(rows, held, conv_id, turn, role, text)
        rebuilt = rooted(chunks) if base is None else grafted(chunks, base, keep, most, held)
        return held.result(trie(rebuilt, held), "trie")

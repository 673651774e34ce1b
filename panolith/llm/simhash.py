"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64 majority bits over the XXH64 hashes of word shingles. Two fingerprints
within ``radius`` bits agree wholly on all but ``radius`` of any set of blocks, so each goes
under every choice of two of ``radius + 2`` blocks and only fingerprints under one key meet.
A bucket is compared bit-sliced: 64 fingerprints share one word per bit plane, distances grow
in carry-save counters, and a word whose lanes all exceed the radius is abandoned. A bucket
passes on a spanning forest of its links, never all pairs.

A key that too many different fingerprints share is split exactly: two fingerprints within
the radius share a neighbour at half the radius from each, so they meet again under that
neighbour, and a bucket there is never larger than the number of such neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panolith.llm.bounds import bitmaps, lists, may_share
from panolith.llm.bpe import slices
from panolith.llm.components import connected_components, star_forest
from panolith.session import Scratch, forget, spill

ONE = np.uint64(1)
LANES = np.uint64(0x0101010101010101)
MIX = np.uint64(0xBF58476D1CE4E5B9)  # odd: a second hash from the first
HOT = 1024  # different fingerprints under one key that are compared in one bucket
SMALL_ROWS = 1 << 16
PAIR_WORDS = 1 << 20


def shingle_hashes(text: str, words: int, seed: int = 42) -> bytes:
    """XXH64 of each shingle of the lower-cased words, big-endian on end."""
    flat = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not flat:
        return b""
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    digest = xxhash.xxh64_digest
    if len(gaps) < words:
        return digest(flat, seed)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(flat)][words - 1 :]
    return b"".join([digest(flat[a:b], seed) for a, b in zip(starts, ends)])


def majority(hashes: list[bytes]) -> np.ndarray:
    """Fingerprint of each run of hashes: the bits set in over half of them; zero for none."""
    count = np.array([len(h) // 8 for h in hashes], np.int64)
    flat = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)
    out = np.zeros(len(hashes), np.uint64)
    if not len(flat):
        return out
    begin = np.cumsum(count) - count
    # Eight bits apart share a word of eight 8-bit lanes: up to 255 hashes add up without overflow.
    chunks = [(i, b) for i, (s, n) in enumerate(zip(begin.tolist(), count.tolist())) for b in range(s, s + n, 255)]
    owner, at = np.array([c[0] for c in chunks]), np.array([c[1] for c in chunks])
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    some = owner[first]
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & LANES, at)
        totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (totals * 2 > count[some][:, None]).astype(np.uint64)
        out[some] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                fp = majority([shingle_hashes(t, words) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
                at += len(texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """(64, words): bit ``lane`` of plane b, word w is bit b of the fingerprint placed there."""
    grid = np.zeros((words, 64), np.uint64)
    grid[word, lane] = fps
    bits = np.unpackbits(grid.view(np.uint8).reshape(words, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.frombuffer(packed.tobytes(), "<u8").reshape(64, words)


def within(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (query, word): which of the word's 64 lanes are within the radius.

    Adds plane after plane of differing bits into carry-save counters; the last carry says
    that a lane left the radius. Words without a lane left are dropped on the way.
    """
    digits = (radius + 1).bit_length()
    count = np.zeros((digits, len(query)), np.uint64)
    over = np.zeros(len(query), np.uint64)
    asked = fps[query]
    for b in range(64):
        carry = planes[b][word] ^ (np.uint64(0) - (asked >> np.uint64(b) & ONE))
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        above = _exceeds(count, radius)
        if b % 4 == 3:
            keep = (over | above) != ~np.uint64(0)
            if keep.mean() < 0.8:
                query, word, count, over, asked = query[keep], word[keep], count[:, keep], over[keep], asked[keep]
                if not len(query):
                    break
    return query, word, ~(over | _exceeds(count, radius))


def _exceeds(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius, by bitwise comparison from the highest digit."""
    above = np.zeros(count.shape[1], np.uint64)
    equal = ~above
    for d in reversed(range(len(count))):
        if radius >> d & 1:
            equal = equal & count[d]
        else:
            above = above | (equal & count[d])
            equal = equal & ~count[d]
    return above


def bucket_links(sizes: np.ndarray, fps: np.ndarray, radius: int, nodes: np.ndarray | None = None, same: Callable | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within each bucket; ``fps`` holds the buckets on end.

    Links join ``nodes`` (the fingerprints themselves by default) and hold only where ``same``
    says so of the places of both.
    """
    nodes = fps.view(np.int64) if nodes is None else nodes
    out: list[tuple[int, int]] = []
    end = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi, pairs, words = lo, 0, 0
        while hi < len(sizes) and (hi == lo or (pairs + sizes[hi] * -(-sizes[hi] // 64) <= PAIR_WORDS and words < 1 << 13)):
            words += -(-sizes[hi] // 64)
            pairs += sizes[hi] * -(-sizes[hi] // 64)
            hi += 1
        base, mine = end[lo] - sizes[lo], sizes[lo:hi]
        part = fps[base : end[hi - 1]]
        need = -(-mine // 64)
        start = np.cumsum(need) - need
        place = np.arange(len(part)) - np.repeat(np.cumsum(mine) - mine, mine)
        word, lane = np.repeat(start, mine) + place // 64, place % 64
        planes = bit_planes(part, word, lane, int(need.sum()))
        repeat = np.repeat(need, mine)
        query = np.repeat(np.arange(len(part)), repeat)
        target = np.arange(len(query)) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(np.repeat(start, mine), repeat)
        later = target >= word[query]  # each pair once
        query, target, hit = within(planes, part, query[later], target[later], radius)
        at = np.full((int(need.sum()), 64), -1, np.int64)
        at[word, lane] = np.arange(len(part))
        bits = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, col = np.nonzero(bits)
        a, b = query[row], at[target[row], col]
        ok = b > a
        a, b = a[ok] + base, b[ok] + base
        if same is not None:
            ok = same(a, b)
            a, b = a[ok], b[ok]
        out += star_forest(zip(nodes[a].tolist(), nodes[b].tolist())).items()
        lo = hi
    return out


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            fps = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            got = bucket_links(sizes, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["a", "b"])

    return run


def block_masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect every two fingerprints within the radius, directly or by others.

    ``distinct`` has one long column ``fp`` without repeats.
    """
    spark = distinct.sparkSession
    masks = [a | b for a, b in combinations(block_masks(radius + 2), 2)]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("key")).select("fp", "key.t", "key.k")
    crowded, _ = spill(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("t", "k"), "crowded")
    n = crowded.count()
    cold = keyed
    parts = []
    if n:
        few = F.broadcast(crowded) if n <= SMALL_ROWS else crowded
        cold = keyed.join(few, ["t", "k"], "left_anti")
        half = ceil(radius / 2)
        free = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in masks]), F.col("t") + 1)
        near = keyed.join(few, ["t", "k"]).withColumn("free", free)
        flips = F.concat(F.array(F.lit(0).cast("long")), F.col("free"))
        for _ in range(half - 1):
            flips = F.array_distinct(F.flatten(F.transform(flips, lambda x: F.transform(F.concat(F.array(F.lit(0).cast("long")), F.col("free")), lambda y: x.bitwiseXOR(y)))))
        near = near.select("fp", "t", F.explode(flips).alias("flip")).select("fp", "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("k"))
        parts.append(near)
    parts.insert(0, cold)
    buckets = [p.groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps") for p in parts]
    links = [b.mapInArrow(_links(radius), "a long, b long") for b in buckets]
    return links[0] if len(links) == 1 else links[0].unionByName(links[1])


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, one row per document.

    component_id is the smallest doc_id that links reach, the document's own included (null
    ids count as greater than any, and a component of null ids alone has a null id). A null or empty text has fingerprint
    zero and links like any other. Repeated rows share fingerprint and component.
    """
    prints, _ = spill(fingerprints(docs, words, text, doc_id), "prints")
    return prints.join(_component_of(prints, radius, hot), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _component_of(prints: DataFrame, radius: int, hot: int) -> DataFrame:
    """fp, component_id for every different fingerprint, as a table of its own."""
    distinct, _ = spill(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked, _ = spill(connected_components(near_links(distinct.select("fp"), radius, hot)), "linked")
    joined = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    joined, _ = spill(joined, "joined")
    least, _ = spill(joined.groupBy("component").agg(F.min("first").alias("component_id")), "firsts")
    return spill(joined.join(least, "component").select("fp", "component_id"), "classes")[0]


# ---------------------------------------------------------------------------------------
# Near copies of documents: SimHash links first, then what they cannot reach.

COMMON = 1 << 17  # common shingles that are put last
SAMPLE_DOCS = 20_000
BITS = 1024  # of a bitmap of a set
FIRST = 16  # of the shared shingles of a document, in their order, that tell where a pair counts; each row of a document carries them
AT_ONCE = 1 << 24  # pairs of postings that are held against each other without thinning by stars first
FAR = 38  # bits of 128: fingerprints further apart are not of texts 0.8 alike (1 in 10**5 at 0.8, fewer above)
FEW = 64  # shingles of both texts together, below which fingerprints are too rough to rule a pair out


def _shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    return [np.unique(np.frombuffer(shingle_hashes(t, words), ">u8").astype(np.uint64)) for t in texts]


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """uid, s: the different shingle hashes of ``docs`` (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, texts in _portions(batch):
                sets = [s.view(np.int64) for s in _shingle_sets(texts, words)]
                yield pa.RecordBatch.from_arrays([uids, pa.array(sets, pa.list_(pa.int64()))], names=["uid", "s"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, s array<long>")


def _portions(batch: pa.RecordBatch, chars: int = 1 << 18) -> Iterator[tuple[pa.Array, list[str]]]:
    """The first column and the texts of the second, few at a time, so that little is held as Python strings."""
    for lo in range(0, batch.num_rows, 256):
        part, at = batch.slice(lo, 256), 0
        for texts in slices(part.column(1).to_pylist(), chars):
            yield part.column(0).slice(at, len(texts)), texts
            at += len(texts)


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of at least three documents of a sample, the rarer first; only the order of
    shingles hangs on it, which decides the work and not the result."""
    n = docs.count()
    share = docs if n <= SAMPLE_DOCS else docs.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < 1_000_000 * SAMPLE_DOCS // n)
    found = shingle_sets(share, words).select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    return np.array([r.h for r in found.orderBy(F.desc("n"), "h").limit(COMMON).collect()][::-1], np.int64).view(np.uint64)


def _marks(sets: list[np.ndarray]) -> pa.Array:
    return lists(bitmaps(sets, BITS), np.ones(len(sets), bool))


def prefixes(docs: DataFrame, words: int, least: float, common: np.ndarray) -> DataFrame:
    """uid, n (different shingles), fp, fq (128 bits of SimHash of the set), k0, k1 (128 bits that
    tell the set), p (its first shingles), bits (a bitmap of the set).

    Sets of a Jaccard similarity of ``least`` share at least ceil(least n) shingles of each, so
    in any order of all shingles they share one among the first n - ceil(least n) + 1 of both.
    """
    by_value = np.argsort(common)
    values = common[by_value]

    def ordered(s: np.ndarray) -> np.ndarray:
        if not len(values):
            return s
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        known = values[at] == s
        return np.concatenate([s[~known], s[known][np.argsort(by_value[at[known]])]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, texts in _portions(batch):
                sets = _shingle_sets(texts, words)
                fp, fq = (majority([x.astype(">u8").tobytes() for x in some]) for some in (sets, [(s ^ (s >> np.uint64(29))) * MIX for s in sets]))
                keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
                first = [ordered(s)[: len(s) - ceil(least * len(s) - 1e-9) + 1].view(np.int64) for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array(fp.view(np.int64)), pa.array(fq.view(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(first, pa.list_(pa.int64())), _marks(sets)]
                yield pa.RecordBatch.from_arrays([uids, *columns], names=["uid", "n", "fp", "fq", "k0", "k1", "p", "bits"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, n int, fp long, fq long, k0 long, k1 long, p array<long>, bits array<long>")


def _possible(least: float) -> str:
    """Whether sets x and y, of which this is the first common shingle, can be so similar."""
    enough = f"least(x.n - x.i, y.n - y.i) >= (x.n + y.n) * {least / (1 + least)!r}D - 1e-6D"
    return f"{enough} AND (x.n + y.n < {FEW} OR bit_count(x.fp ^ y.fp) + bit_count(x.fq ^ y.fq) <= {FAR})" if least >= 0.8 else enough


def _verified(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have that Jaccard similarity, as a table of its own."""
    spark = docs.sparkSession
    pairs, pairs_path = spill(pairs.distinct(), "copy-pairs")
    need, need_path = spill(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct(), "copy-need")
    few = F.broadcast(need) if need.count() <= SMALL_ROWS else need
    sets, sets_path = spill(shingle_sets(docs.join(few, "uid", "left_semi"), words), "copy-sets")
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links, _ = spill(both.where(common * (1 + least) >= least * (F.size("x") + F.size("y")) - 1e-6).select("a", "b"), "copy-links")
    forget(spark, pairs_path, need_path, sets_path)
    return links


def simhash_links(heads: DataFrame, docs: DataFrame, words: int, least: float, radius: int) -> DataFrame:
    """Verified links (a, b) between ``heads`` (uid, fp) whose fingerprints are within ``radius``
    bits: the bit-sliced comparison of :func:`near_links`, each link held against the sets."""
    firsts, _ = spill(heads.groupBy("fp").agg(F.min("uid").alias("first")), "copy-fps")
    near, _ = spill(near_links(firsts.select("fp"), radius), "copy-near")
    across = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = heads.join(firsts, "fp").where("uid <> first").select(F.col("first").alias("a"), F.col("uid").alias("b"))
    return _verified(across.unionByName(equal), docs, words, least)


def _contract(shared: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
    """``shared`` with c, the component of each document by the links so far, as a table of its own."""
    component, path = spill(connected_components(links), "copy-components")
    out = spill(shared.drop("c").join(component.withColumnRenamed("node", "uid"), "uid", "left").withColumn("c", F.coalesce("component", "uid")).drop("component"), "copy-shared")
    forget(shared.sparkSession, path)
    return out


def _bitmaps(docs: DataFrame, words: int) -> DataFrame:
    """uid, bits of ``docs`` (uid, text), as :func:`prefixes` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, texts in _portions(batch):
                yield pa.RecordBatch.from_arrays([uids, _marks(_shingle_sets(texts, words))], names=["uid", "bits"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, bits array<long>")


def _apart_still(shared: DataFrame, docs: DataFrame, words: int, least: float, held: Scratch, marks: DataFrame | None = None) -> DataFrame:
    """a, b: documents of different components that share a shingle and can be similar enough.

    Of each shingle all but its largest component meet everything, unless the bitmaps of both sets
    say that it cannot be. A pair counts in the first shingle that both have, not in each; that is also where
    positions rule out least. All sets are in one order: if the first ones of both have any in common, the
    first of those is it; if they have none, each counts. ``marks`` (uid, bits) are the bitmaps of
    all documents, where they are known: then no text is read, and none is shuffled.
    """
    limit = Fraction(least).limit_denominator(1000)
    sizes = shared.groupBy("h", "c").agg(F.count("*").alias("m"))
    open_ = held(sizes.groupBy("h").agg(F.max(F.struct("m", "c"))["c"].alias("top"), F.count("*").alias("parts")).where("parts > 1").select("h", "top"), "copy-open")
    left = held(shared.join(open_, "h"), "copy-left")
    some = held(left.groupBy("uid").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), 1, FIRST).alias("hs")), "copy-some")
    if marks is None:
        marks = held(_bitmaps(docs.join(some.select("uid"), "uid", "left_semi"), words), "copy-bitmaps")
    whole = left.join(marks.join(some, "uid"), "uid")
    x, y = whole.where("c <> top").alias("x"), whole.alias("y")
    met = x.join(y, F.expr(f"x.h = y.h AND x.c <> y.c AND (y.c = y.top OR x.uid < y.uid) AND {_possible(least)} AND {may_share(limit, False)} AND coalesce(x.h = try_element_at(array_intersect(x.hs, y.hs), 1), true)"))
    return held(met.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b")).distinct(), "copy-apart")


def copy_links(heads: DataFrame, docs: DataFrame, words: int, least: float, at_once: int, links: DataFrame) -> DataFrame:
    """Links (a, b) that with ``links`` connect every two documents so similar, directly or by others.

    ``heads`` are :func:`prefixes`, one of each set. Groups of copies are gathered by stars: each shingle's documents are held against one of them, and each document against the
    nearest of those by fingerprint. While that links many documents, or more than ``at_once``
    pairs (or sixty-four for each row) remain and grow fewer, there is another turn. What then is
    not connected is compared in full.
    """
    postings = heads.select("uid", F.posexplode("p").alias("i", "h"))
    of = W.partitionBy("h")
    met = postings.withColumns({"m": F.count("*").over(of), "lo": F.min("uid").over(of), "hi": F.max("uid").over(of), "z": F.bit_xor("uid").over(of)}).where("m > 1")
    # A shared passage has many shingles with the very same documents, which need to meet once: at the first place.
    # What else falls under one key meets there as well, and only costs.
    bundled = met.groupBy(F.xxhash64("m", "lo", "hi", "z").alias("h"), "uid").agg(F.min("i").alias("i"))
    shared, path = spill(bundled.join(heads.select("uid", "n", "fp", "fq"), "uid"), "copy-shared")
    size, documents = shared.agg(F.count("*"), F.approx_count_distinct("uid")).first()
    at_once = max(at_once, 64 * size) if at_once else 0
    was, turn = None, 0
    while True:
        old, (shared, path) = path, _contract(shared, links)
        forget(docs.sparkSession, old)
        per = shared.groupBy("h", "c").agg(F.count("*").cast("double").alias("m")).groupBy("h").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("m"))
        rows = (per.agg(F.sum("m")).first()[0] or 0) / 2
        if not rows:
            return links
        if turn and not many and (rows <= at_once or rows > 0.9 * was):
            with Scratch(docs.sparkSession) as held:
                pairs = _apart_still(shared, docs, words, least, held, heads.select("uid", "bits"))
                return links.unionByName(_verified(pairs, docs, words, least))
        head = shared.groupBy("h").agg(F.min(F.struct(F.xxhash64("uid", F.lit(turn)).alias("o"), "uid", "n", "i", "fp", "fq", "c")).alias("y")).select("h", "y.*").drop("o")
        met = shared.alias("x").join(head.alias("y"), F.expr(f"x.h = y.h AND x.c <> y.c AND {_possible(least)}"))
        nearest = met.groupBy(F.col("x.uid").alias("uid")).agg(F.min(F.struct(F.expr("bit_count(x.fp ^ y.fp) + bit_count(x.fq ^ y.fq)").alias("d"), F.col("y.uid").alias("to")))["to"].alias("to"))
        found = _verified(nearest.select(F.least("uid", "to").alias("a"), F.greatest("uid", "to").alias("b")), docs, words, least)
        links = links.unionByName(found)
        many = found.count() > documents // 100
        was, turn = rows, turn + 1


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, text: str = "text", doc_id: str = "doc_id", small_rows: int = 1 << 20, at_once: int = AT_ONCE) -> DataFrame:
    """The documents that stay, with all their columns: of each component the first by doc_id.

    Copies are two documents whose sets of word shingles have a Jaccard similarity of
    ``similarity`` at least. SimHash fingerprints within ``radius`` bits are linked first, by
    bit-sliced comparison; then documents meet by the shingles of their prefixes, unless their
    fingerprints are too far apart; every link is held against the sets. Rows without a word, or
    with a null text, are kept: they have nothing to be a copy of. Ids may be null (last) or
    repeat; of rows alike in all of it exactly one stays. The result reads a copy of ``docs`` in
    the shared folder, in which each row has its number.
    """
    columns, spark = docs.columns, docs.sparkSession
    row, took = _free_name("row", columns), []
    keyed, _ = spill(docs.withColumn(row, F.monotonically_increasing_id()), "copy-docs")

    def kept(frame: DataFrame, tag: str) -> DataFrame:
        frame, path = spill(frame, tag)
        took.append(path)
        return frame

    some = keyed.where(F.col(text).rlike("[^\\x20\\x09-\\x0D]")).select(F.col(row).alias("uid"), F.col(text).alias("text"))
    prints = kept(prefixes(some, words, similarity, _common(some, words)), "prints")
    nodes = kept(prints.groupBy("k0", "k1").agg(F.min("uid").alias("node"), F.count("*").alias("rows")), "nodes")
    heads = prints.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi")
    near = simhash_links(heads.select("uid", "fp"), some, words, similarity, radius)
    linked = kept(connected_components(copy_links(heads, some, words, similarity, at_once, near)), "linked")
    joined = nodes.join(linked, "node", "left").where(F.col("component").isNotNull() | (F.col("rows") > 1)).select("k0", "k1", F.coalesce("component", "node").alias("component"))
    grouped = kept(joined, "grouped")
    owned = kept(prints.join(grouped, ["k0", "k1"]).select("uid", "component"), "owned")
    ids = keyed.select(F.col(row).alias("uid"), F.col(doc_id).cast("long").alias("id"))
    ranked = owned.join(ids, "uid").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("keep"))
    first = kept(ranked.select(F.col("keep.uid").alias("uid")), "kept")
    lost, _ = spill(owned.join(first, "uid", "left_anti").select(F.col("uid").alias(row)), "lost")
    forget(spark, *took)
    few = F.broadcast(lost) if lost.count() <= small_rows else lost
    return keyed.join(few, row, "left_anti").select(columns)


def _free_name(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name

"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A sketch has ``size`` coordinates, filled in rounds: in round i below ``size`` each element of a
set is thrown into one hashed bin with a hashed value behind the number i, and a bin keeps its
least; from round ``size`` on all elements go to bin i - size, so that every coordinate fills in
the end. A set is done once its bins are full: a long one after a round or two, a short one
after more rounds of few throws. Equal coordinates of two sketches estimate the Jaccard
similarity with the concentration of independent draws.

Documents of one and the same set are one node. Nodes meet if all coordinates of a band agree
and the bit planes of their coordinates do not differ too much, and are linked if their full sets are similar
enough. Large groups of copies are gathered by stars: each bucket's members meet one of them,
another one each turn; only what then is still unconnected is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.bounds import bitmapped, lists, may_share, shareable
from panolith.llm.components import connected_components
from panolith.llm.simhash import SMALL_ROWS, _portions, _shingle_sets
from panolith.session import Scratch, arrow_batches

SIZE, ROWS = 256, 8  # coordinates of a sketch, coordinates of a band
PLANES = 4  # hashed bits of each coordinate that are kept to rule out pairs
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
VALUE_BITS = np.uint64(44)
THROWS = 1 << 20  # elements thrown at once
TURNS = 12  # of stars, at most, before what is left is compared in full


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX[0]
    z = (z ^ (z >> np.uint64(27))) * MIX[1]
    return z ^ (z >> np.uint64(31))


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """(sets, size): the sketch of each set of 64-bit hashes, all of them not empty.

    A coordinate is the round in its high bits and the value of the winning throw below, so that
    earlier rounds win; ``size`` is a power of two of at most 2**19.
    """
    bits = np.uint64(size.bit_length() - 1)
    out = np.full((len(sets), size), ~np.uint64(0))
    flat = out.reshape(-1)
    count = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), count)
    for i in range(2 * size):
        h = _mixed(elements + np.full(1, i + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        value = (np.uint64(i) << VALUE_BITS) | (h >> (np.uint64(64) - VALUE_BITS))
        chosen = (h & np.uint64(size - 1)).astype(np.int64) if i < size else np.full(len(h), i - size)
        place = owner * size + chosen
        if i:  # what is full stays
            new = flat[place] >> VALUE_BITS >= np.uint64(i)
            place, value = place[new], value[new]
        np.minimum.at(flat, place, value)
        if i % 4 == 3 or i < 4:
            empty = (out == ~np.uint64(0)).any(axis=1)
            keep = empty[owner]
            if not keep.any():
                break
            elements, owner = elements[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands): one hash for the coordinates of each band and its number."""
    bands = sketch.shape[1] // rows
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * MIX[0], (len(sketch), 1))
    cut = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    for r in range(rows):
        key = _mixed(key + cut[:, :, r])
    return key


def bit_planes(sketch: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """(sets, planes * words): hashed bits of every coordinate, a plane after the other, 64 coordinates to a word."""
    h = _mixed(sketch)
    return np.concatenate([np.packbits((h >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8") for p in range(planes)], axis=1)


def farthest(least: float, size: int, planes: int = PLANES, deviations: float = 4.5) -> int:
    """Coordinates in which the planes of sets of similarity ``least`` differ, but for 3 in a million (at 4.5 standard deviations)."""
    p = (1 - least) * (1 - 0.5**planes)
    return int(size * p + deviations * sqrt(size * p * (1 - p))) + 1


def sketched(docs: DataFrame, words: int, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """uid, n (different shingles), k0, k1 (128 bits that tell the set), f (bit planes), bands; of ``docs`` (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, texts in _portions(batch):
                sets = _shingle_sets(texts, words)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                f, bands = np.zeros((len(sets), PLANES * size // 64), np.uint64), np.zeros((len(sets), size // rows), np.uint64)
                lo = 0
                while lo < len(some):
                    hi = lo + max(1, int(np.searchsorted(np.cumsum(n[some[lo:]]), THROWS)))
                    made = sketches([sets[i] for i in some[lo:hi]], size)
                    f[some[lo:hi]], bands[some[lo:hi]] = bit_planes(made), band_keys(made, rows)
                    lo = hi
                keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
                yield pa.RecordBatch.from_arrays([uids, pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *[lists(x, n > 0) for x in (f, bands)]], names=["uid", "n", "k0", "k1", "f", "bands"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, n long, k0 long, k1 long, f array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """uid, s: the different shingle hashes of ``docs`` (uid, text), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, texts in _portions(batch):
                yield pa.RecordBatch.from_arrays([uids, pa.array([s.view(np.int64) for s in _shingle_sets(texts, words)], pa.list_(pa.int64()))], names=["uid", "s"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets are so similar."""
    x, y = (sets.select(F.col("uid").alias(u), F.col("s").alias(s)) for u, s in (("a", "x"), ("b", "y")))
    both = pairs.distinct().join(x, "a").join(y, "b")
    common, total = F.size(F.array_intersect("x", "y")).cast("long"), (F.size("x") + F.size("y")).cast("long")
    return both.where(common * (least.denominator + least.numerator) >= total * least.numerator).select("a", "b")


def _apart(size: int) -> str:
    """SQL for the number of coordinates in which x and y are seen to differ."""
    words = size // 64
    return " + ".join("bit_count(" + " | ".join(f"(x.f[{p * words + i}] ^ y.f[{p * words + i}])" for p in range(PLANES)) + ")" for i in range(words))


def _far(least: Fraction, size: int) -> str:
    """Whether x and y are too different for the threshold, by their sizes and bit planes."""
    return f"x.n * {least.denominator} < y.n * {least.numerator} OR y.n * {least.denominator} < x.n * {least.numerator} OR {_apart(size)} > {farthest(float(least), size)}"


def near_links(heads: DataFrame, docs: DataFrame, words: int, least: Fraction, size: int, held: Scratch) -> DataFrame:
    """Links (a, b) that connect, directly or by others, every two ``heads`` (uid, n, f, bands) so
    similar that share a band."""
    postings = heads.select("uid", F.explode("bands").alias("h"))
    busy = held(postings.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "minhash-busy")
    met = held(postings.join(F.broadcast(busy) if busy.count() <= SMALL_ROWS else busy, "h", "left_semi"), "minhash-met")
    some = held(met.select("uid").distinct(), "minhash-some")
    few = F.broadcast(some) if some.count() <= SMALL_ROWS else some
    sets = held(shingle_sets(docs.join(few, "uid", "left_semi"), words), "minhash-sets")
    shared = held(met.join(heads.select("uid", "n", "f"), "uid"), "minhash-shared")
    documents = some.count()
    far, apart = _far(least, size), _apart(size)
    links = shared.select(F.col("uid").alias("a"), F.col("uid").alias("b")).limit(0)
    marked = shared.withColumn("c", F.col("uid"))
    for turn in range(TURNS):
        pick = F.min(F.struct(F.xxhash64("uid", F.lit(turn)).alias("o"), "uid", "n", "f", "c")).alias("y")
        stars = marked.groupBy("h").agg(pick, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h", "y.*").drop("o")
        stars = held(stars, "minhash-stars")
        meet = marked.alias("x").join(stars.alias("y"), F.expr(f"x.h = y.h AND x.c <> y.c AND NOT ({far})"))
        nearest = meet.groupBy(F.col("x.uid").alias("uid")).agg(F.min(F.struct(F.expr(apart).alias("d"), F.col("y.uid").alias("to")))["to"].alias("to"))
        pairs = held(nearest.select(F.least("uid", "to").alias("a"), F.greatest("uid", "to").alias("b")), "minhash-pairs")
        found = held(_verified(pairs, sets, least), "minhash-found")
        n = found.count()
        if n:
            links = held(links.unionByName(found), "minhash-links")
            component = held(connected_components(links).withColumnRenamed("node", "uid"), "minhash-components")
            marked = held(shared.join(component, "uid", "left").withColumn("c", F.coalesce("component", "uid")).drop("component"), "minhash-marked")
        if n <= documents // 100:
            break
    # What stars left apart, in full: of each bucket all but its largest component against everything.
    sizes = held(marked.groupBy("h", "c").agg(F.count("*").alias("m")), "minhash-sizes")
    open_ = held(sizes.groupBy("h").agg(F.max(F.struct("m", "c"))["c"].alias("top"), F.count("*").alias("parts")).where("parts > 1").select("h", "top"), "minhash-open")
    left = held(marked.join(open_, "h"), "minhash-left")
    bound = held(shareable(left.select("uid", "n").distinct(), sets), "minhash-shareable").where(f"r * {least.denominator} >= n * {least.numerator}").drop("n")
    bitmaps = bitmapped(sets.join(bound.select("uid"), "uid", "left_semi"))
    whole = held(left.join(bound, "uid").join(heads.select("uid", "bands"), "uid").join(bitmaps, "uid"), "minhash-whole")
    x, y = whole.where("c <> top").alias("x"), whole.alias("y")
    enough = may_share(least)
    once = "x.h = array_min(array_intersect(x.bands, y.bands))"  # a pair counts in one of its bands
    rest = x.join(y, F.expr(f"x.h = y.h AND x.c <> y.c AND (y.c = y.top OR x.uid < y.uid) AND NOT ({far}) AND {enough} AND {once}")).select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"))
    pairs = held(rest.distinct(), "minhash-left-pairs")
    return links.unionByName(held(_verified(pairs, sets, least), "minhash-rest"))


def near_dedup(docs: DataFrame, words: int = 3, percent: int = 85, size: int = SIZE, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept; one row per row of ``docs``.

    Two documents are linked if 100 times the intersection of their sets of word shingles is at
    least ``percent`` times the union; every link is held against the full sets. A pair at exactly
    85 % shares one of the 32 bands but for 4 in 100,000. A document without a word, or with a
    null text, has an empty set and is linked with nothing. Null ids count as greater than any;
    a component of null ids alone has a null id and is kept. Repeated rows share their component,
    other columns have no say, an empty table gives no rows.
    """
    least = Fraction(percent, 100)
    with arrow_batches(docs.sparkSession), Scratch(docs.sparkSession) as held:
        keyed = held(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "minhash-docs")
        sketch = held(sketched(keyed, words, size, rows), "minhash-sketches")
        nodes = held(sketch.where("n > 0").groupBy("k0", "k1").agg(F.min("uid").alias("node")), "minhash-nodes")
        heads = sketch.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi")
        linked = held(connected_components(near_links(heads, keyed, words, least, size, held)), "minhash-linked")
        grouped = held(nodes.join(linked, "node", "left").select("k0", "k1", F.coalesce("component", "node").alias("component")), "minhash-grouped")
        ids = sketch.select("uid", "n", "k0", "k1").join(keyed.select("uid", "doc_id"), "uid").join(grouped, ["k0", "k1"], "left")
        owned = held(ids.select("doc_id", "n", F.coalesce("component", -F.col("uid") - 1).alias("component")), "minhash-owned")
        least_id = owned.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        out = owned.join(least_id, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
        return held.result(out, "minhash")

"""Spelling variants: words one code point apart, found by rolling-hash deletions.

Two words differ by one replaced code point exactly if deleting the same place of both leaves
the same string, and by one inserted code point exactly if the longer one, with a place deleted,
is the shorter one. The hash of each such deletion comes from a prefix and a suffix polynomial
hash, for all words of one length at once, as 64-bit integers. Keys are dealt by their high
bits and sorted; only words whose keys repeat are fetched, and the strings themselves decide.

Each key stands for one string with one gap, so that a true bucket is no larger than the
alphabet (replacements) or the alphabet times the length (insertions): no bucket needs a cap,
and what leaves a bucket is a count and a best partner for each word, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.llm.bpe import slices
from panolith.session import Scratch, forget, spill

RUNS = re.compile("[a-zÀ-ÿ]+")
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
HELD = 100_000  # different words counted in one task before their counts are passed on
CELLS = 1 << 19  # code points worked on at once
REPLACED, SHORTER = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)  # tell the kinds of keys apart


def damaged(run: str, prefix: int, every: int) -> str:
    """``run`` without one code point where ``every`` divides its checksum (crc32 on from ``prefix``)."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least: int = 6, often: int = 5, every: int = 199, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: words of at least ``least`` code points that occur ``often`` times, over whole texts.

    Words are maximal runs of Latin letters, A-Z lower-cased; where ``every`` divides the crc32
    of ``<doc_id>:<run>`` one code point goes. A null text has no words; with a null doc_id no
    code point goes. Counts add up per task before they shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for texts in slices(batch.column(1).to_pylist(), 1 << 18):
                for own, t in zip(ids[at:], texts):
                    found = Counter(RUNS.findall(t.encode().lower().decode()))
                    if own is None:
                        held.update({w: n for w, n in found.items() if len(w) >= least})
                        continue
                    prefix = zlib.crc32(b"%d:" % own)
                    for w, n in found.items():
                        if len(w) >= least and len(w := damaged(w, prefix, every)) >= least:
                            held[w] += n
                    if len(held) > HELD:
                        yield out()
                        held.clear()
                at += len(texts)
        yield out()

    counted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a matrix of words of one length: owner row, key and place of every key.

    A word has a key for each place replaced (place from 0), one for being the shorter of two
    (place -1), and one for each different string left by a deletion, as the longer of two
    (place -2 - the deleted place).
    """
    m, length = codes.shape
    prefix, suffix = np.zeros((m, length + 1), np.uint64), np.zeros((m, length + 1), np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, BASE)]), dtype=np.uint64)
    for i in range(length):
        prefix[:, i + 1] = prefix[:, i] * BASE + codes[:, i]
    for i in reversed(range(length)):
        suffix[:, i] = codes[:, i] * power[length - 1 - i] + suffix[:, i + 1]
    left = prefix[:, :-1] * power[length - 1 :: -1][:length] + suffix[:, 1:]
    place = np.arange(length, dtype=np.uint64)
    replaced = _mixed(left + REPLACED * (place + np.uint64(1)) * np.uint64(2) + np.uint64(length))
    shorter = _mixed(prefix[:, -1] ^ SHORTER * np.full(1, length, np.uint64))
    longer = _mixed(left ^ SHORTER * np.full(1, length - 1, np.uint64))
    first = np.ones((m, length), bool)  # of a run of equal code points one deletion stands for all
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(first)
    owner = np.concatenate([np.repeat(np.arange(m), length), np.arange(m), row])
    places = np.concatenate([np.tile(np.arange(length), m), np.full(m, -1), -2 - at])
    return owner, np.concatenate([replaced.ravel(), shorter, longer[row, at]]), places


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        words = batch.column(1).to_pylist()
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, rows in by.items():
            step = max(1, CELLS // length)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), length).astype(np.uint64)
                owner, keys, places = deletion_keys(codes)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[part][owner]), pa.array(places.astype(np.int32))], names=["key", "wid", "place"])


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, with the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by key whose key stands in another row too."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        table = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks()
        begin = _runs(table.column(0).to_numpy())
        held = pa.RecordBatch.from_struct_array(table.slice(begin[-2]).to_struct_array().combine_chunks()) if begin[-2] else _whole(table)
        size = np.diff(begin)[:-1]
        keep = np.repeat(size > 1, size)
        if keep.any():
            yield from table.slice(0, int(begin[-2])).filter(pa.array(keep)).to_batches()
    if held is not None and held.num_rows > 1:
        yield held


def _whole(table: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], names=table.column_names)


def bucket_partners(rows: list[tuple[int, int, str, int]]) -> Iterator[tuple[int, int, int, str]]:
    """For the rows (wid, place, word, n) of one key: wid, near words in it, and the best's n and word.

    Rows meet only if the strings are equal, whatever the hashes say.
    """
    replaced: dict[tuple[int, str], list] = {}
    long: dict[str, list] = {}
    short = []
    for wid, place, word, n in rows:
        if place >= 0:
            replaced.setdefault((place, word[:place] + word[place + 1 :]), []).append((-n, word, wid))
        elif place == -1:
            short.append((-n, word, wid))
        else:
            long.setdefault(word[: -2 - place] + word[-1 - place :], []).append((-n, word, wid))
    for own in replaced.values():
        if len(own) > 1:
            first, second = sorted(own)[:2]
            for x in own:
                best = second if x is first or x == first else first
                yield x[2], len(own) - 1, -best[0], best[1]
    for x in short:
        if own := long.get(x[1]):
            best = min(own)
            yield x[2], len(own), -best[0], best[1]
            for y in own:
                yield y[2], 1, -x[0], x[1]


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """wid, n_near, n, word from rows (key, wid, place, word, n) of a partition sorted by key."""

    def out(found: list) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["wid", "n_near", "n", "word"])

    now, rows = None, []
    found: list = []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                found += bucket_partners(rows)
                now, rows = key, []
                if len(found) > 50_000:
                    yield out(found)
                    found = []
            rows.append(tuple(row))
    found += bucket_partners(rows)
    yield out(found)


def _dealt(rows: DataFrame, bits: int = 16) -> DataFrame:
    """Rows dealt by the high bits of their key and sorted by it within each partition."""
    radix = F.shiftrightunsigned("key", 64 - bits)
    return rows.repartition(radix).sortWithinPartitions("key")


def near_words(words: DataFrame) -> DataFrame:
    """wid, n_near, best (n, word) for each of ``words`` (wid, word, n) that has a near word."""
    schema = "key long, wid long, place int"
    keyed = words.select("wid", "word").mapInArrow(_keyed, schema)
    with Scratch(words.sparkSession) as held:
        met = held(_dealt(keyed).mapInArrow(_repeated, schema), "spelling-met")
        strings = met.join(words, "wid").select("key", "wid", "place", "word", "n")
        partners = _dealt(strings).mapInArrow(_partners, "wid long, n_near long, n long, word string")
        best = F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")))
        return held.result(partners.groupBy("wid").agg(F.sum("n_near").alias("n_near"), best.alias("best")), "spelling-near")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """word, root from (word, form): follows forms to the last by doubling; cycles cannot occur,
    as a form is commoner than its word. Raises if ``rounds`` do not suffice (2**rounds steps)."""
    now, path = spill(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    spark = forms.sparkSession
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after, after_path = spill(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = not after.where("moved").isEmpty()
        forget(spark, path)
        now, path = after.drop("moved"), after_path
        if not moved:
            return now
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def spelling_groups(docs: DataFrame, least: int = 6, often: int = 5, times: int = 5, every: int = 199, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n, n_near, form, form_n, root: every word of :func:`word_counts`.

    ``form`` is the near word of largest n (ties: smallest by code points) if that n is at least
    ``times`` the word's, ``root`` where forms end (the word itself without one). Rows with null
    or empty texts give no words, repeated rows count again, an empty table gives no rows, other
    columns have no say.
    """
    enough: Column = -F.col("best.less") >= F.col("n") * times
    with Scratch(docs.sparkSession) as held:
        words = held(word_counts(docs, least, often, every, text, doc_id).withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
        near = near_words(words)
        joined = words.join(near, "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
        formed = held(joined, "spelling-forms")
        last = roots(formed.where("form IS NOT NULL"))
        return held.result(formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling")

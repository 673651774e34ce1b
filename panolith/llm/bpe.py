"""Byte-pair encoding and decoding with existing vocabularies.

Merging keeps, for every short word, a contiguous array of its parts and of the ranks of
adjacent parts; each step scans the ranks for the minimum, deletes that boundary and
refreshes the two neighbouring ranks. Many words of like length go through the steps side
by side as rows of one array. Long words use a heap over a linked list with equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.memo import Memo

NONE = np.int64(1 << 40)
TABLE = 18  # log2 of the slots of the pair table
LONG = 48  # parts; longer words go through the heap
SLICE_CHARS = 1 << 21
_STOPS = frozenset(".,;:!?")
_RUN = re.compile(r" (?:\s|\Z)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies, as character -> byte."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """The encoder of a byte-level ``tokenizer.json``."""

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, room: int = 300_000):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        keys = np.array([a << 20 | b for a, b in self.pairs], np.int64)
        values = np.array(list(self.pairs.values()), np.int64)
        self._fill_table(keys, values[:, 0] << 20 | values[:, 1])  # rank above, merged id below
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = Memo(self._chunks, room)
        self.words = Memo(self._encode_words, room)

    def _fill_table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.table_key = np.full(1 << TABLE, -2, np.int64)
        self.table_value = np.full(1 << TABLE, NONE, np.int64)
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.table_key[at[left]] == -2]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.table_key[at[put]], self.table_value[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << TABLE) - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed rank of each pair, by open addressing; a missing part (-1) has no rank."""
        key = left << 20 | right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE)).view(np.int64)
        out = self.table_value[at]
        wrong = np.flatnonzero(self.table_key[at].ravel() != key.ravel())
        if len(wrong):
            flat, key, at = out.ravel(), key.ravel(), at.ravel()
            while len(wrong):
                empty = self.table_key[at[wrong]] == -2
                flat[wrong[empty]] = NONE
                wrong = wrong[~empty]
                at[wrong] = (at[wrong] + 1) & ((1 << TABLE) - 1)
                hit = self.table_key[at[wrong]] == key[wrong]
                flat[wrong[hit]] = self.table_value[at[wrong[hit]]]
                wrong = wrong[~hit]
            out = flat.reshape(out.shape)
        return out

    def _merge_side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        size = np.array([len(w) for w in words])
        parts = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width + 1)[None, :] < size[:, None]
        parts[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, width + 1), NONE, np.int64)
        ranks[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
        live, cols = np.arange(n), np.arange(width + 1)
        done = parts.copy()
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            best = ranks[row, at]
            go = best < NONE
            if not go.all():
                done[live[~go]] = parts[~go]
                live, parts, ranks, at, best = live[go], parts[go], ranks[go], at[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            parts[row, at] = best & 0xFFFFF
            shift = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width)
            parts = np.take_along_axis(parts, shift, 1)
            parts[:, -1] = -1
            ranks = np.take_along_axis(ranks, shift, 1)
            ranks[:, -1] = NONE
            ranks[row, at] = self._rank(parts[row, at], parts[row, np.minimum(at + 1, width)])
            prev = np.maximum(at - 1, 0)
            refreshed = self._rank(parts[row, prev], parts[row, prev + 1])
            ranks[row, prev] = np.where(at > 0, refreshed, ranks[row, prev])
        flat = done.astype("<u4")
        counts = (done >= 0).sum(1).tolist()
        return [flat[i, :c].tobytes() for i, c in enumerate(counts)]

    def _merge_by_heap(self, word: bytes) -> bytes:
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(pairwise(parts)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (parts[i], parts[j]) != p:
                continue
            parts[i], parts[j] = self.pairs[p][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (q := (parts[a], parts[b])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[q][0], a, q))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w)
            by_width.setdefault(6 if n <= 6 else 10 if n <= 10 else 16 if n <= 16 else 28 if n <= 28 else LONG if n <= LONG else 0, []).append(i)
        for width, mine in by_width.items():
            for k in range(0, len(mine), 8192):
                part = mine[k : k + 8192]
                got = self._merge_side_by_side([words[i] for i in part], width) if width else [self._merge_by_heap(words[i]) for i in part]
                for i, x in zip(part, got):
                    out[i] = x
        return out

    def _chunks(self, chunks: list[str | tuple[str]]) -> list[bytes]:
        found = [self._split(c) for c in chunks]
        wanted: set[bytes] = set()
        for f in found:
            wanted.update(f)
        memo = self.words.fill(wanted)
        return [memo[f[0]] if len(f) == 1 else b"".join([memo[w] for w in f]) for f in found]

    def _split(self, chunk: str | tuple[str]) -> list[bytes]:
        """The words of a chunk, the commonest shapes first."""
        if isinstance(chunk, tuple):
            return [w.encode() for w in self.PATTERN.findall(chunk[0])]
        if chunk.isalpha():
            return [b" " + chunk.encode()]
        if chunk[-1:] in _STOPS and chunk[:-1].isalpha():
            return [b" " + chunk[:-1].encode(), chunk[-1].encode()]
        return [w.encode() for w in self.PATTERN.findall(" " + chunk)]

    @staticmethod
    def chunks(text: str) -> list[str | tuple[str]]:
        """Pieces that pre-tokenisation never crosses.

        One begins at each space before a non-space; that space is left out of the piece. What
        comes before the first of them is given as a tuple.
        """
        pieces = text.split(" ")
        if _RUN.search(text) is None:
            return [(pieces[0],), *pieces[1:]]
        out = [pieces[0]]
        for p in pieces[1:]:
            if not p or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return [(out[0],), *out[1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        parts = [[s if s in self.special else self.chunks(s) for s in self.split.split(t)] if self.split and any(s in t for s in self.special) else [self.chunks(t)] for t in texts]
        wanted: set = set()
        for p in parts:
            for s in p:
                if isinstance(s, list):
                    wanted.update(s)
        memo = self.memo.fill(wanted)
        return [b"".join([np.uint32(self.special[s]).tobytes() if isinstance(s, str) else b"".join([memo[c] for c in s]) for s in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of whole texts with about ``most`` characters at a time (a longer text goes alone)."""
    now: list[str] = []
    size = 0
    for t in texts:
        now.append(t or "")
        size += len(now[-1])
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", room: int = 300_000) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text, one row per document.

    Strings of special tokens inside a text become those tokens, as the library has it. A null
    text counts as empty and gives no ids. Ids and ties need no rule: rows are independent.
    """
    return _per_text(docs, vocabulary, text, doc_id, room, "doc_id long, ids binary, decoded string", lambda ids, bpe: [pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())])


def encode_digests(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", room: int = 300_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, as :func:`encode_documents` finds them."""

    def digests(ids: list[bytes], bpe: ByteBPE) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
        ]

    return _per_text(docs, vocabulary, text, doc_id, room, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _per_text(docs, vocabulary, text, doc_id, room, schema, derive) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(vocabulary, room)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *derive(bpe.encode(texts), bpe)], names=names)
                at += len(texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


_LOADED: dict[tuple[str, int], ByteBPE] = {}


def shared_bpe(path: str, room: int) -> ByteBPE:
    """One encoder for each Python worker, which serves task after task."""
    if (path, room) not in _LOADED:
        _LOADED[path, room] = ByteBPE(path, room)
    return _LOADED[path, room]

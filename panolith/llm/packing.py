"""Best-fit packing of token pieces into fixed-size sequences, with swap-based local search.

Best-fit decreasing opens the bins. Then documents are exchanged one for one, two for one or
moved between underfull bins wherever that increases the sum of squared fills: full bins get
fuller and the emptiest run empty, and an empty bin is dropped. Pieces are dealt by hash into
groups of bounded size that pack independently, so no task sees more than one group; each
group leaves about one underfull sequence. Whole sequences' worth of tokens need no search.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.bpe import slices
from panolith.llm.memo import Memo, calm_collector
from panolith.session import spill

CAPACITY = 4096
GROUP_PIECES = 16_384
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split(), not to the tokenizer
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


STOPS = frozenset(".,;:!?")


def _plain(word: str) -> bool:
    """Only letters that are composed, stay one letter in lower case and make one word."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0130")


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    packed, ends = ids.tobytes(), ends.tolist()
    return [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


class WordTokenizer:
    """Ids of the tokenizers library, kept for pieces between white space that come again.

    Pre-tokenisation drops white space and never crosses it, so a text's ids are those of its
    white-space pieces in turn. Pieces not seen lately go through the library, those of plain
    shape (a word, or a word and one stop) by their word: one of ASCII letters straight to the
    library's model, others many at a time and told apart by the ids that end words.
    """

    def __init__(self, path: str, room: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.stops = dict(zip(STOPS, self._by_library(list(STOPS))))
        self.memo = Memo(self._pieces, room)
        self.words = Memo(self._words, room)
        self.others = Memo(self._by_library, 30_000)

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case plain words."""
        tokenize = self.library.model.tokenize
        ascii_words = [w for w in words if w.isascii()]
        ids = [[t.id for t in tokenize(w)] for w in ascii_words]
        out = dict(zip(ascii_words, _cut(np.array([i for x in ids for i in x], "<u4"), np.cumsum([len(x) for x in ids]))))
        rest = [w for w in words if not w.isascii()]
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            joined = [" ".join(part[i : i + 256]) for i in range(0, len(part), 256)]
            ids = np.array([i for e in self.library.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark the ends of words")
            out.update(zip(part, _cut(ids, ends)))
        return [out[w] for w in words]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        shape = [(p.lower(), b"") if _plain(p) else (p[:-1].lower(), self.stops[p[-1]]) if p[-1] in STOPS and _plain(p[:-1]) else None for p in pieces]
        words = self.words.fill([s[0] for s in shape if s])
        odd = iter(self._odd([p for p, s in zip(pieces, shape) if not s]))
        return [words[s[0]] + s[1] if s else next(odd) for s in shape]

    def _odd(self, pieces: list[str]) -> list[bytes]:
        found = [ASCII_WORDS.findall(p.lower()) if p.isascii() and "<|" not in p else [p] for p in pieces]
        memo = self.others.fill(chain.from_iterable(found))
        return [b"".join([memo[w] for w in f]) for f in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if ODD_SPACE.search(t)]
        parts = [t.split() for t in texts]
        for i in odd:
            parts[i] = []
        ids_of = self.memo.fill(chain.from_iterable(parts)).__getitem__
        out = [b"".join(map(ids_of, p)) for p in parts]
        for i, ids in zip(odd, self._by_library([texts[i] for i in odd])):
            out[i] = ids
        return out


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenize_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece of each document.

    A null text counts as empty and gives the end id alone. Only documents longer than the
    capacity are cut.
    """
    width = 4 * capacity
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm_collector()
        encoder = word_tokenizer(vocabulary)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                owner, piece, ids = [], [], []
                for i, tokens in enumerate(encoder.encode(texts)):
                    tokens += end
                    for k in range(0, len(tokens), width):
                        owner.append(at + i)
                        piece.append(k // width)
                        ids.append(tokens[k : k + width])
                at += len(texts)
                n = np.array(piece, np.int64)
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(n.astype(np.int32)), pa.array(n * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices. ``lengths`` is in the order to place, longest first."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    mask = 0  # bit r: a bin with room r exists
    for i, n in enumerate(lengths):
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r > n:
            room.setdefault(r - n, []).append(b)
            mask |= 1 << (r - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, tries: int = 4096) -> list[list[int]]:
    """Empties bins by moves and swaps that increase the sum of squared fills.

    Stops when the volume bound is met, when no exchange helps or after ``tries`` exchanges
    that emptied no bin; the packing is valid at any point.
    """
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    alive = [k for k, b in enumerate(bins) if b]
    since = 0
    while len(alive) > least and since < tries:
        under = sorted((k for k in alive if fill[k] < capacity), key=lambda k: (fill[k], k))
        found = False
        for victim in under[:8]:
            best = _exchange(victim, under, bins, fill, lengths, capacity)
            if best:
                _, other, give, take = best
                for i in give:
                    bins[victim].remove(i)
                for i in take:
                    bins[other].remove(i)
                bins[other] += give
                bins[victim] += take
                moved = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                fill[other] += moved
                fill[victim] -= moved
                since, found = since + 1, True
                if not bins[victim]:
                    alive.remove(victim)
                    since = 0
                break
        if not found:
            break
    return [bins[k] for k in alive]


def _exchange(victim: int, under: list[int], bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int):
    """The exchange between the victim and a fuller bin that adds most to the squared fills."""
    best, mine = None, sorted(bins[victim], key=lambda i: lengths[i])
    for other in reversed(under[-256:]):
        if other == victim or fill[other] < fill[victim]:
            continue
        space = capacity - fill[other]
        theirs = sorted(bins[other], key=lambda i: lengths[i])
        sizes = [lengths[i] for i in theirs]

        def offer(gain: int, give: list[int], take: list[int]) -> None:
            nonlocal best
            if 0 < gain <= space:
                score = 2 * gain * (fill[other] - fill[victim] + gain)
                if best is None or score > best[0]:
                    best = (score, other, give, take)

        for i in mine:
            n = lengths[i]
            offer(n, [i], [])  # a move
            at = bisect.bisect_left(sizes, n - space)  # one for one: the smallest that still fits
            if at < len(sizes) and sizes[at] < n:
                offer(n - sizes[at], [i], [theirs[at]])
            lo, hi = 0, len(sizes) - 1  # one for two
            while lo < hi:
                two = sizes[lo] + sizes[hi]
                if n - two > space:
                    lo += 1
                else:
                    if two < n:
                        offer(n - two, [i], [theirs[lo], theirs[hi]])
                    hi -= 1
        for a in range(len(mine)):  # two for one
            for b in range(a + 1, min(len(mine), a + 9)):
                n = lengths[mine[a]] + lengths[mine[b]]
                at = bisect.bisect_left(sizes, n - space)
                if at < len(sizes) and sizes[at] < n:
                    offer(n - sizes[at], [mine[a], mine[b]], [theirs[at]])
        if best and best[0] >= 2 * space * (fill[other] - fill[victim] + space):
            break
    return best


def _pack_group(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "__uid"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        base = int(rows["__g"].iloc[0]) << 32
        for b, items in enumerate(bins):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
        return rows.assign(sequence_id=sequence, offset=offset)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows, null ids and texts are packed like any other; an empty table packs into
    nothing. Sequence ids are unique but not gapless.
    """
    pieces, _ = spill(tokenize_pieces(docs, vocabulary, end_id, capacity, text, doc_id), "pieces")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    numbered = pieces.withColumn("__uid", F.monotonically_increasing_id())
    names = [x.split()[0] for x in out.split(", ")]
    full = numbered.where(F.col("length") == capacity).select(*names[:5], (-F.col("__uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group_pieces))
    dealt = rest.withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece", "__uid"), F.lit(groups)))
    packed = dealt.groupBy("__g").applyInPandas(_pack_group(capacity), out.replace("sequence_id", "__uid long, __g long, sequence_id")).select(names)
    return full.unionByName(packed)

"""Subword-lattice scoring of documents.

The vocabulary is an existing one of subword pieces; the words seen in training are further
units, each an arc from the first to the last place of its word. A word's probability sums over
all its segmentations, and words and document ends are places that every path goes through, so
that the forward recursion over the words of a text gives the marginal probability of the whole
text. A document belongs to one of a few classes (labels of training documents; the label of a
scored document is not looked at), and

    P(document) = sum over k of P(k) * prod over tokens of P_k(token)
    P_k(word)   = (1 - e_k) * c_k(word) / N_k + e_k * sum over segmentations of prod p_k(piece) * p_k(stop)

with e_k the Good-Turing mass of unseen words. The scores of the vocabulary weight all
segmentations at first (where they are merge ranks, by Zipf's law) and stay on as a prior; then
each round takes the expected piece counts of all training words, every word weighted by the
square root of its count, and re-weights the pieces. Recursions are in log space and run over
many words of one length side by side.

Counts are distributed. The most frequent words (at most ``hot_words``, by a threshold on the
count histogram) are broadcast; every other word of a document shuffles to the table of
training words, each scored once, and the parts meet again by row. Words not in it, which only
held-out documents have, are scored by their pieces. No corpus count is dropped.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.bpe import slices
from panolith.llm.memo import Memo, calm_collector
from panolith.session import spill

ALPHA = 0.1
PRIOR = 1000.0  # piece occurrences that the vocabulary's own scores count for
BLOCK_CHARS = 1 << 16
HOT_WORDS = 1 << 17
HELD_WORDS = 400_000
MARK = "▁"


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Vocabulary:
    """Pieces of a sentencepiece model, the byte pieces, and what their scores say of them."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.size = model.get_piece_size()
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
        own = np.array(list(self.ids.values()))
        score = np.array([model.get_score(i) for i in range(self.size)])
        ranks = (score[own] <= 0).all() and (score[own] == np.round(score[own])).all()
        self.prior = np.zeros(self.size)
        self.prior[own] = 1 / (2 - score[own]) if ranks else np.exp(score[own])
        self.prior[list(self.byte_ids.values())] = 1 / self.size
        self.prior /= self.prior.sum()
        self.length = np.zeros(self.size, np.int64)
        self.finder = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.length[i] = len(piece)
            self.finder.add_word(piece, i)
        self.finder.make_automaton()
        self.single = np.sort(np.array([ord(p) for p in self.ids if len(p) == 1], np.uint32))


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class Block:
    """The lattices of words that are all ``n`` characters long, mark included.

    Arcs are sorted by the place where they end and by word. Every place has an arc from the one
    before it: a character that is no piece is spelled by its bytes, under an id from the
    vocabulary's size on.
    """

    def __init__(self, vocab: Vocabulary, words: list[str], n: int):
        text = "\n".join(words) + "\n"
        self.n, self.words, wide = n, len(words), n + 1
        found = np.fromiter(chain.from_iterable(vocab.finder.iter(text)), np.int64).reshape(-1, 2)
        piece = found[:, 1]
        word, to = np.divmod(found[:, 0], wide)
        to += 1
        start = to - vocab.length[piece]
        inside = (to <= n) & (start >= 0)
        if not inside.all():
            word, to, start, piece = word[inside], to[inside], start[inside], piece[inside]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        strange = ~np.isin(points, vocab.single)
        strange[n::wide] = False
        where = np.flatnonzero(strange)
        self.spelled: list[list[int]] = []
        if len(where):
            kinds, kind = np.unique(points[where], return_inverse=True)
            self.spelled = [[vocab.byte_ids[b] for b in chr(c).encode("utf-8", "surrogateescape")] for c in kinds.tolist()]
            at, place = np.divmod(where, wide)
            word, to = np.concatenate([word, at]), np.concatenate([to, place + 1])
            start, piece = np.concatenate([start, place]), np.concatenate([piece, vocab.size + kind])
        key = to * self.words + word
        order = np.argsort(key, kind="stable")
        key, self.piece = key[order], piece[order]
        self.source = start[order] * self.words + word[order]  # places of all words in one row
        self.first = np.flatnonzero(np.diff(key, prepend=-1))  # of each word's arcs into each place
        self.target = key
        self.cut = np.append(self.first[:: self.words], len(key))  # of each place's arcs, from place 1 on

    def _weights(self, log_p: np.ndarray) -> np.ndarray:
        if self.spelled:
            log_p = np.append(log_p, [log_p[x].sum() for x in self.spelled])
        return log_p[self.piece]

    def forward(self, arcs: np.ndarray) -> np.ndarray:
        """Log of the sum over all paths to each place of each word, places on end."""
        m = self.words
        f = np.zeros((self.n + 1) * m)
        for j in range(self.n):
            lo, hi = self.cut[j], self.cut[j + 1]
            terms = f[self.source[lo:hi]] + arcs[lo:hi]
            if hi - lo > m:
                first = self.first[j * m : (j + 1) * m] - lo
                top = np.maximum.reduceat(terms, first)
                f[(j + 1) * m : (j + 2) * m] = top + np.log(np.add.reduceat(np.exp(terms - top[self.target[lo:hi] - (j + 1) * m]), first))
            else:
                f[(j + 1) * m : (j + 2) * m] = terms
        return f

    def log_words(self, log_p: np.ndarray) -> np.ndarray:
        return self.forward(self._weights(log_p))[-self.words :]

    def expect(self, log_p: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected piece counts of the words, each times its weight."""
        arcs, m = self._weights(log_p), self.words
        f = self.forward(arcs)
        share = np.exp(f[self.source] + arcs - f[self.target])
        through = np.zeros(len(f))
        through[-m:] = weight
        for j in range(self.n - 1, -1, -1):
            lo, hi = self.cut[j], self.cut[j + 1]
            share[lo:hi] *= through[self.target[lo:hi]]
            through[self.source[lo:hi]] += share[lo:hi]  # a word's arcs into one place come from different ones
        counts = np.bincount(self.piece, share, len(total) + len(self.spelled))
        total += counts[: len(total)]
        for spelled, n in zip(self.spelled, counts[len(total) :]):
            np.add.at(total, spelled, n)


def blocks(vocab: Vocabulary, words: list[bytes]) -> Iterator[tuple[np.ndarray, Block]]:
    """Which of the words, and their lattices, for words of one length at a time."""
    spelt = [MARK + w.decode("utf-8", "surrogateescape") for w in words]
    sizes = np.array([len(s) for s in spelt], np.int64)
    order = np.argsort(sizes, kind="stable")
    ends = np.flatnonzero(np.diff(sizes[order], append=-1)) + 1
    lo = 0
    for hi in ends.tolist():
        n = int(sizes[order[lo]])
        step = max(1, BLOCK_CHARS // n)
        for at in range(lo, hi, step):
            mine = order[at : min(at + step, hi)]
            yield mine, Block(vocab, [spelt[i] for i in mine], n)
        lo = hi


def log_words(vocab: Vocabulary, words: list[bytes], log_p: np.ndarray, log_stop: np.ndarray) -> np.ndarray:
    """(words, classes): natural log of the sum over all segmentations of each word, and its end."""
    out = np.zeros((len(words), len(log_p)))
    for mine, block in blocks(vocab, words):
        for k, row in enumerate(log_p):
            out[mine, k] = block.log_words(row)
    return out + log_stop


def held_out(doc_id, folds: int = 10):
    """Whether crc32(doc_id as text) mod ``folds`` is 0; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def word_counts(train: DataFrame, classes: int) -> DataFrame:
    """w, c (a count for each class) of columns text and k. Tasks add up their words before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(classes)]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for h in held for w in h], pa.binary()), pa.array([k for k, h in enumerate(held) for _ in h], pa.int32()), pa.array([n for h in held for n in h.values()], pa.int64())], names=["w", "k", "n"])

        for batch in batches:
            at = 0
            which = batch.column(1).to_pylist()
            for texts in slices(batch.column(0).to_pylist()):
                for t in texts:
                    held[which[at]].update(words_of(t))
                    at += 1
                if sum(map(len, held)) > HELD_WORDS:
                    yield out()
                    for h in held:
                        h.clear()
        if any(held):
            yield out()

    rows = train.mapInArrow(run, "w binary, k int, n long")
    each = [F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(classes)]
    return rows.groupBy("w").agg(*each, F.sum("n").alias("c"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of at least ``rows``, so that words of one length come in numbers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def piece_counts(counts: DataFrame, path: str, log_p: np.ndarray, log_stop: np.ndarray) -> np.ndarray:
    """(classes, pieces + 1): expected piece counts over all segmentations of all training words,
    each with the square root of its count as weight, and the sum of those weights."""
    classes, pieces = log_p.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        total = np.zeros((classes, pieces + 1))
        for batch in _gathered(batches):
            words = batch.column(0).to_pylist()
            weight = np.sqrt([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(classes)])
            total[:, -1] += weight.sum(1)
            for k in range(classes):
                own = np.flatnonzero(weight[k])
                for mine, block in blocks(vocab, [words[i] for i in own]):
                    block.expect(log_p[k], weight[k][own[mine]], total[k, :-1])
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], names=["k", "piece", "n"])

    out = np.zeros((classes, pieces + 1))
    found = counts.select("w", *[f"c{k}" for k in range(classes)]).mapInArrow(run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
    rows = found.toPandas()  # at most classes x pieces rows
    out[rows["k"].to_numpy(int), rows["piece"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def _probabilities(total: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of pieces and of the stop after the expected counts and the prior."""
    weight = total[:, :-1] + PRIOR * vocab.prior
    stops = total[:, -1] + PRIOR / 4  # by the prior alone, a word has four pieces
    whole = weight.sum(1) + stops
    with np.errstate(divide="ignore"):
        return np.log(weight / whole[:, None]), np.log(stops / whole)


def classes_of(train: DataFrame, label: str | None, most: int) -> list[str]:
    """The commonest labels; whatever else there is makes one class more."""
    if label is None:
        return []
    return [r[0] for r in train.where(F.col("label").isNotNull()).groupBy("label").count().orderBy(F.desc("count"), "label").limit(most).collect()]


def score_documents(docs: DataFrame, pieces: str, folds: int = 10, hot_words: int = HOT_WORDS, text: str = "text", doc_id: str = "doc_id", label: str | None = "lang", most_classes: int = 64, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per document.

    Null texts count as empty and consist of the end alone; repeated rows are scored each by
    itself. Without training documents all counts are zero and every word is scored by pieces.
    """
    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(F.col(doc_id), folds).alias("held_out"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"))
    train = lean.where(~F.col("held_out"))
    labels = classes_of(train, label, most_classes)
    size = len(labels) + 1
    which = F.lit(len(labels))
    for i, name in enumerate(labels):
        which = F.when(F.col("label") == name, i).otherwise(which)
    ends = np.zeros(size)
    for r in train.groupBy(which.alias("k")).count().collect():
        ends[r["k"]] = r["count"]
    if labels and not ends[-1]:  # every document has one of the labels
        size, ends = size - 1, ends[:-1]
    counts, _ = spill(word_counts(train.select("text", which.cast("int").alias("k")), size), "counts")
    each = [x for k in range(size) for x in (F.sum(f"c{k}"), F.count_if(F.col(f"c{k}") == 1), F.count_if(F.col(f"c{k}") > 0))]
    sums = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), *[F.coalesce(x, F.lit(0)) for x in each]).first()
    words, tokens = sums[0], sums[1]
    n, distinct = tokens + int(ends.sum()), words + bool(ends.sum())
    n_k = np.array(sums[2::3], float) + ends
    # Good-Turing; where texts are copied few words occur once, and a tenth of the different ones stands in.
    once, kinds = np.array(sums[3::3], float), np.array(sums[4::3], float)
    unseen = np.clip(np.maximum(np.maximum(once, kinds / 10), 1) / np.maximum(n_k, 1), 1e-9, 0.5)
    # Frequent: the bins of counts, from the top, that hold at most ``hot_words`` words together.
    bin_of = F.floor(F.log2("c") * 16)
    least, upto = None, 0
    for r in counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect():  # at most 16 x 63 rows
        upto += r["words"]
        if upto > hot_words:
            break
        least = r["bin"]
    columns = [f"c{k}" for k in range(size)]
    vocab = vocabulary(pieces)
    log_p, log_stop = _probabilities(np.zeros((size, vocab.size + 1)), vocab)
    for _ in range(rounds):
        log_p, log_stop = _probabilities(piece_counts(counts, pieces, log_p, log_stop), vocab)
    with np.errstate(divide="ignore"):
        model = {
            "log_p": log_p, "log_stop": log_stop, "less": np.log10(unseen), "share": (1 - unseen) / np.maximum(n_k, 1),
            "ends": int(ends.sum()), "key": uuid.uuid4().hex,
            "base_over": math.log10(n + ALPHA * (distinct + 1)),
            "end": np.log10(np.where(ends > 0, (1 - unseen) * ends / np.maximum(n_k, 1), unseen)),
            "prior": np.log10((ends + 1e-3) / (ends + 1e-3).sum()),
        }
    names = ["base", *[f"s{k}" for k in range(size)]]
    scored, _ = spill(_score_words(counts, pieces, model, size), "scored")
    hot, table = [], np.zeros((0, size + 1))
    if least is not None:
        found = scored.where(bin_of >= least).select("w", *names).toPandas()  # at most ``hot_words`` rows
        hot, table = [bytes(w) for w in found["w"]], found[names].to_numpy(float)
    model |= {"hot": hot, "table": table}
    rows, _ = spill(_split_rows(lean, model, size), "tokens")
    rare, whole_rows = rows.where("kind = 0").select("rid", "held_out", "w", "n_tokens"), rows.where("kind = 1")
    times = F.col("n_tokens")
    known_columns = ["rid", times.alias("n_known"), *[(times * F.col(x)).alias(x) for x in names]]
    in_train = rare.where("NOT held_out").join(scored, "w").select(known_columns)
    held, _ = spill(rare.where("held_out").join(scored, "w", "left"), "held")
    seen = held.where("c IS NOT NULL").select(known_columns)
    new = _new_words(held.where("c IS NULL").select("rid", "w", "n_tokens"), pieces, model, size)
    parts = whole_rows.select("rid", "doc_id", "held_out", "n_tokens", "n_known", F.col("base").alias("base_score"), *names[1:])
    for p in (in_train, seen, new):
        parts = parts.unionByName(p.withColumnRenamed("base", "base_score"), allowMissingColumns=True)
    whole = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", *[f"s{k}" for k in range(size)])])
    top = F.greatest(*[F.col(f"s{k}") for k in range(size)]) if size > 1 else F.col("s0")
    summed = F.lit(0.0)
    for k in range(size):
        summed = summed + F.pow(F.lit(10.0), F.col(f"s{k}") - top)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (top + F.log10(summed)).alias("score"))


def _by_pieces(pieces: str, model: dict):
    """log10 of what pieces add to the probability of each word, in each class."""
    vocab = vocabulary(pieces)
    return lambda ws: list(log_words(vocab, ws, model["log_p"], model["log_stop"]) / math.log(10) + model["less"])


def _score_words(counts: DataFrame, pieces: str, model: dict, size: int) -> DataFrame:
    """For each training word its count, its base score and its score in each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _by_pieces(pieces, model)
        for batch in _gathered(batches):
            for at in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(at, 1 << 15)
                c = np.column_stack([part.column(1 + k).to_numpy(zero_copy_only=False) for k in range(size)]).astype(float)
                by_pieces = np.array(score(part.column(0).to_pylist())).reshape(-1, size)
                with np.errstate(divide="ignore"):
                    mixed = np.where(c > 0, np.log10(c * model["share"] + 10.0**by_pieces), by_pieces)
                columns = [np.log10(c.sum(1) + ALPHA) - model["base_over"], *mixed.T]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1 + size), *map(pa.array, columns)], names=["w", "c", "base", *[f"s{k}" for k in range(size)]])

    wanted = counts.select("w", *[f"c{k}" for k in range(size)], "c")
    return wanted.mapInArrow(run, "w binary, c long, base double" + "".join(f", s{k} double" for k in range(size)))


def _new_words(rows: DataFrame, pieces: str, model: dict, size: int) -> DataFrame:
    """Scores of words that no training document has, by row."""
    lean = {k: v for k, v in model.items() if k not in ("hot", "table")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_by_pieces(pieces, lean), 100_000)
        base = math.log10(ALPHA) - lean["base_over"]
        for batch in batches:
            words = batch.column(1).to_pylist()
            held = memo.fill(words)
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            each = np.array([held[w] for w in words]).reshape(-1, size) * n[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(n), np.int64)), pa.array(base * n), *map(pa.array, each.T)], names=["rid", "n_known", "base", *[f"s{k}" for k in range(size)]])

    return rows.mapInArrow(run, "rid long, n_known long, base double" + "".join(f", s{k} double" for k in range(size)))


def _split_rows(lean: DataFrame, model: dict, size: int) -> DataFrame:
    """For each document a row of kind 1 with its sums over frequent words and the end, and for
    each other word one of kind 0 with its count."""
    shared = lean.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k not in ("log_p", "log_stop")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = shared.value
        if m["key"] not in _READY:
            _READY.clear()
            _READY[m["key"]] = {w: i for i, w in enumerate(m["hot"])}
        index, table = _READY[m["key"]], m["table"]
        calm_collector()
        after = np.append(math.log10(m["ends"] + ALPHA) - m["base_over"], m["end"] + m["prior"])
        rid = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                columns: list[list] = [[] for _ in range(7)]
                sums: list[np.ndarray] = []
                for t in texts:
                    rid += 1
                    words = words_of(t)
                    found = [index.get(w, -1) for w in words]
                    hit = np.array(found, np.int64)
                    hit = hit[hit >= 0]
                    rare = Counter([w for w, f in zip(words, found) if f < 0]) if len(hit) < len(words) else {}
                    k = len(rare)
                    for col, vs in zip(columns, ([rid] * (k + 1), [0] * k + [1], [*rare, None], [None] * k + [ids[at]], [out[at]] * (k + 1), [*rare.values(), len(words) + 1], [None] * k + [len(hit) + (m["ends"] > 0)])):
                        col.extend(vs)
                    sums.append(table[hit].sum(0) + after)
                    at += 1
                kind = np.array(columns[1], np.int32)
                full = np.zeros((len(kind), size + 1))
                full[kind == 1] = np.array(sums)
                types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types)], *[pa.array(x, mask=kind == 0) for x in full.T]], names=["rid", "kind", "w", "doc_id", "held_out", "n_tokens", "n_known", "base", *[f"s{k}" for k in range(size)]])

    schema = "rid long, kind int, w binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double"
    return lean.select("doc_id", "text", "held_out").mapInArrow(run, schema + "".join(f", s{k} double" for k in range(size)))


_READY: dict[str, dict] = {}

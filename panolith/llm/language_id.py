"""Language identification by interpolated Kneser-Ney character language models.

One model per language over letters (lower-cased) and word boundaries. N-grams are packed
into 64-bit keys, scrambled and kept in sorted hash arrays, with the interpolated log
probabilities of all languages side by side; a lookup is a binary search. A text goes to the
language of lowest length-normalised cross-entropy; a threshold calibrated on texts kept out
of training rejects what fits none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.bpe import slices

BITS = 16  # of a character in a key: four fit into 64 bits
EDGE, UNKNOWN, FIRST = 1, 2, 3
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)  # odd, so keys stay distinct


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, UNKNOWN if it is a letter and EDGE if not."""
    return np.where(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), UNKNOWN, EDGE).astype(np.uint16)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


class Models:
    """Kneser-Ney models of all languages, and the rejection threshold of each."""

    def __init__(self, texts: dict[str, list[str]], order: int = 4, alphabet: int = (1 << BITS) - FIRST, slack: float = 1.5, margin: float = 0.5):
        self.langs, self.order, self.margin = sorted(texts), order, margin
        seen: Counter = Counter()
        for ts in texts.values():
            for t in ts:
                seen.update(t.lower())
        self.alphabet = [c for c, _ in sorted(((c, n) for c, n in seen.items() if c.isalpha()), key=lambda x: (-x[1], x[0]))[:alphabet]]
        self._table = None
        if not self.langs:  # nothing to learn from: all is rejected
            return
        kept = {k: [t for i, t in enumerate(ts) if i % 5] or ts for k, ts in texts.items()}
        self._train(kept)
        self.mean, self.reach = np.zeros(len(self.langs)), np.zeros(len(self.langs))
        for j, k in enumerate(self.langs):
            out = texts[k][::5]
            entropy, n, _ = self.cross_entropy(out)
            entropy, n = entropy[n > 0, j], n[n > 0]
            if len(n):
                self.mean[j] = np.average(entropy, weights=n)
                self.reach[j] = slack * max(1.0, np.quantile((entropy - self.mean[j]) * np.sqrt(n), 0.999))
        self._train(texts)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = _letters().copy()
            for i, c in enumerate(self.alphabet):
                for v in (c, c.upper(), c.title()):
                    if len(v) == 1:
                        self._table[ord(v)] = FIRST + i
        return self._table

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts on end, where each begins, and its number of letters. Runs of non-letters count once."""
        joined = "\n".join(texts) + "\n"
        raw = self.table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        keep = raw != EDGE
        keep[1:] |= (raw[:-1] != EDGE) & (owner[1:] == owner[:-1])
        raw, owner = raw[keep].astype(np.uint64), owner[keep]
        count = np.bincount(owner, minlength=len(texts))
        return raw, np.cumsum(count) - count, np.bincount(owner[raw != EDGE], minlength=len(texts))

    def _grams(self, codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Keys of orders 1 to ``order`` that end at each place; texts begin after boundaries."""
        counts = np.diff(np.append(starts, len(codes)))
        place = np.arange(len(codes)) - np.repeat(starts, counts)
        keys, now = [codes], codes
        for k in range(1, self.order):
            before = np.full(len(codes), EDGE, np.uint64)
            before[k:] = codes[:-k]
            before[place < k] = EDGE
            now = now | before << np.uint64(BITS * k)
            keys.append(now)
        return keys

    def _train(self, texts: dict[str, list[str]]) -> None:
        per = []
        for k in self.langs:
            codes, starts, _ = self.codes(texts[k])
            top, n = np.unique(self._grams(codes, starts)[-1], return_counts=True)
            levels = {self.order: (top, n.astype(np.float64))}
            for size in range(self.order - 1, 0, -1):  # continuation counts: distinct characters before
                levels[size] = tuple(np.unique(levels[size + 1][0] & np.uint64((1 << BITS * size) - 1), return_counts=True))
            per.append(levels)
        width = len(self.alphabet) + FIRST
        self.keys, self.value, self.context, self.weight = {}, {}, {}, {}
        below = None
        for size in range(1, self.order + 1):
            union = np.unique(np.concatenate([p[size][0] for p in per]))
            contexts = np.unique(union >> np.uint64(BITS))
            p = np.zeros((len(union), len(per)))
            gamma = np.ones((len(contexts), len(per)))
            if size == 1:
                lower = np.full(p.shape, 1.0 / width)
            else:
                at, _ = _find(plain, union & np.uint64((1 << BITS * (size - 1)) - 1))  # noqa: F821
                lower = below[at]
            for j, levels in enumerate(per):
                keys, n = levels[size]
                n = n.astype(np.float64)
                ones, twos = (n == 1).sum(), (n == 2).sum()
                d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
                own, back = np.unique(keys >> np.uint64(BITS), return_inverse=True)
                total, kinds = np.bincount(back, n), np.bincount(back)
                at, hit = _find(own, contexts)
                gamma[hit, j] = (d * kinds / total)[at[hit]]
                at, hit = _find(own, union >> np.uint64(BITS))
                share = np.where(hit, (d * kinds / total)[at], 1.0)
                of, has = _find(keys, union)
                seen = np.where(has, np.maximum(n - d, 0)[of] / total[at], 0.0)
                p[:, j] = seen + share * lower[:, j]
            plain, below = union, p
            for name, k, v in (("keys", union, p), ("context", contexts, gamma)):
                hashed = k * SCRAMBLE
                order = np.argsort(hashed)
                getattr(self, name)[size] = hashed[order]
                getattr(self, "value" if name == "keys" else "weight")[size] = np.log(v[order]).astype(np.float32)
        self.floor = np.float32(-math.log(width))

    def _log_p(self, keys: list[np.ndarray], size: int) -> np.ndarray:
        at, hit = _find(self.keys[size], keys[size - 1] * SCRAMBLE)
        out = self.value[size][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = [k[miss] for k in keys[: size - 1]]
            lower = self._log_p(rest, size - 1) if size > 1 else np.full((len(miss), len(self.langs)), self.floor)
            at, hit = _find(self.context[size], (keys[size - 1][miss] >> np.uint64(BITS)) * SCRAMBLE)
            out[miss] = lower + np.where(hit[:, None], self.weight[size][at], np.float32(0))
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character of each text under each model; its length in characters; its letters."""
        codes, starts, letters = self.codes(texts)
        n = np.diff(np.append(starts, len(codes)))
        total = np.zeros((len(texts), len(self.langs)))
        if len(codes):
            p = self._log_p(self._grams(codes, starts), self.order)
            full = np.flatnonzero(n)
            total[full] = np.add.reduceat(p.astype(np.float64), starts[full], axis=0)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (``und`` without letters), posterior (0 to 1), cross-entropy, rejected."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, n, letters = self.cross_entropy(texts)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp(-np.minimum((entropy - low[:, None]) * n[:, None], 700)).sum(1)
        empty = letters == 0
        rejected = empty | (low - self.mean[best] > np.maximum(self.margin, self.reach[best] / np.sqrt(np.maximum(n, 1))))
        return ["und" if e else self.langs[b] for e, b in zip(empty, best)], np.where(empty, 0.0, score), low, rejected


def training_sample(docs: DataFrame, chars: int = 1_600_000, languages: int = 1000, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 5) -> dict[str, list[str]]:
    """A bounded sample of labelled texts to fit on: about ``chars`` characters for each language.

    Whole texts of documents whose crc32(doc_id as text) mod ``folds`` is not 0, with a label,
    of any length. Drawn by hash at a rate that follows from the characters of each language, so
    no group is gathered; the text of least draw of each label comes in any case, so that a label
    of few long texts is learned too. Raises where there are more labels than ``languages``: those are no
    languages.
    """
    eligible = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).cast("long").alias("doc_id")).where((F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    eligible = eligible.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 40)))
    found = eligible.groupBy("lang").agg(F.sum(F.length("text") + 1).alias("n"), F.min("draw").alias("least")).orderBy("lang").limit(languages + 1).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} labels")
    if not counts:
        return {}
    below = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(max(r["least"] + 1.0, min(1.0, chars / r["n"]) * float(1 << 40))))])
    drawn = eligible.where(F.col("draw") < below[F.col("lang")]).orderBy("draw", "doc_id", "lang")
    out: dict[str, list[str]] = {}
    for r in drawn.collect():  # about ``chars`` characters for each label
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, models: Models, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected, one row per document.

    A null text, or one without a letter, gives ``und``, score 0, rejected. Nothing but the
    text is looked at. The models are bounded by the training sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _portions(batch, 1):
                lang, score, low, rejected = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _portions(batch, at):
                yield part.filter(pa.array(~shared.value.predict(texts)[3]))

    return docs.mapInArrow(run, docs.schema)


def _portions(batch: pa.RecordBatch, column: int, chars: int = 1 << 17) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Few rows of a batch at a time and the texts of a column, so that little is held as Python strings."""
    for lo in range(0, batch.num_rows, 256):
        part, at = batch.slice(lo, 256), 0
        for texts in slices(part.column(column).to_pylist(), chars):
            yield part.slice(at, len(texts)), texts
            at += len(texts)

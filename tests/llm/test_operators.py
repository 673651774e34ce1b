"""Each operator against a brute-force version, and on nulls, empty tables, ties and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panolith.llm import bpe, chat, components, exact_dedup, language_id, line_dedup, lm_score, packing, queries, sharding, simhash, topk

DOCS = "doc_id long, text string, lang string, source string, uid long, __h long, fp long"
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a long text, columns whose names clash with inner ones."""
    texts = ["one two three four five six", "one two three four five six", None, "", " \n\t ", "Éa " * 3000, "x", "same text here", "same text here", "line a b c d e f\nline a b c d e f\n\nshort", None]
    rows = [(i, t, "en" if i % 2 else None, "s", 7, 7, 7) for i, t in enumerate(texts)]
    rows += [(7, "same text here", "en", "s", 7, 7, 7), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def links_by_hand(fps, radius):
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= radius]
    return components.star_forest(iter(pairs))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_links(radius):
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = {tuple(sorted((signed[a], signed[b]))) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= radius}
    got = simhash.bucket_links(np.array([len(fps)]), np.array(fps, np.uint64), radius)
    assert components.star_forest(iter(got)) == components.star_forest(iter(want))


def test_majority():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 255, 256, 700):
        h = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)
        assert int(simhash.majority([b"", h.astype(">u8").tobytes()])[1]) == want


@pytest.mark.parametrize("hot", [1024, 2])
def test_near_links_also_where_keys_are_crowded(spark, hot):
    rng = random.Random(5)
    base = rng.getrandbits(63)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for _ in range(80)})
    got = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot).collect()
    want = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2]
    assert components.star_forest((r.a, r.b) for r in got) == components.star_forest(iter(want))


def test_simhash(odd, empty):
    rows = simhash.near_dedup(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert by[3, "0" * 16] == 2 and by[10, "0" * 16] == 2
    assert {r.component_id for r in rows if r.doc_id in (0, 1)} == {0}
    assert next(r for r in rows if r.doc_id is None).component_id is None
    assert simhash.near_dedup(empty).count() == 0


def test_near_copies(spark, odd, empty):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    other = [f"v{rng.randint(0, 10**6)}" for _ in range(300)]
    close = [*words]
    close[100] = "changed"
    far = [w if i % 3 else "x" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(close)), (8, " ".join(other)), (9, " ".join(far)), (10, None), (11, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [3, 8, 9, 10, 11]
    clashing = odd.withColumns({"row": F.lit(9), "h": F.lit(1), "c": F.lit(2), "n": F.lit(3)})
    rows = sorted(map(repr, (tuple(r) for r in simhash.drop_near_copies(clashing).collect())))
    lost = {(1, "one two three four five six"), (8, "same text here")}  # of equal texts the first stays, of equal rows one
    want = [tuple(r) for r in clashing.collect() if (r.doc_id, r.text) not in lost]
    want.remove(next(x for x in want if x[:2] == (7, "same text here")))
    assert rows == sorted(map(repr, want))
    assert simhash.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("at_once", [simhash.AT_ONCE, 0])
def test_near_copies_are_those_of_brute_force(spark, at_once):
    rng = random.Random(4)
    rows, sets = [], []
    for family in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([6, 60, 200]))]
        for _ in range(12):
            new, block = [*words], [f"b{rng.randint(0, 10**6)}" for _ in range(int(len(words) * rng.choice([0, 0.1, 0.2, 0.24, 0.28, 0.4])))]
            new[3:3] = block
            for at in rng.sample(range(len(new)), rng.randint(0, len(new) // 40)):
                new[at] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(new)))
            sets.append({tuple(new[i : i + 5]) for i in range(len(new) - 4)})
    alike = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    lost = components.star_forest(iter(alike))
    got = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), at_once=at_once).collect()}
    assert got == set(range(len(rows))) - set(lost) and len(lost) > 10


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    want = components.star_forest(iter(edges))
    for native in (False, True):
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), native=native).collect()}
        assert {k: v for k, v in got.items() if k != v} == want


def test_chat_reads_back(spark, empty):
    awkward = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>\\", "<<SYS>>x<</SYS>>", "<<ROLE>>", "<", "a\nb", "", None, "<<s>>[[INST]]"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool", None, "user", "assistant", "<s>odd"], awkward))]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "assistant", "first"), (None, 0, "user", "x"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()
    by = {r.conv_id: r for r in out}
    assert [(t.role, t.text) for t in by[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:10]]
    assert by[1].learnt == "".join(t or "" for _, _, r, t in rows[:10] if r == "assistant")
    assert (by[2].valid, by[2].bad_turn) == (False, 2) and (by[3].valid, by[3].bad_turn) == (False, 0) and by[None].valid is False
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"max_bits": 1 << 16, "bits_per_row": 1 << 14}])
def test_exact_dedup(odd, empty, bounds):
    rows = exact_dedup.exact_dedup(odd, **bounds).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert len(rows) == len(texts)
    groups = {}
    for i, t in texts:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    for r in rows:
        assert r.group_size == len(groups[r.text_sha256])
        assert r.keep_id == max(groups[r.text_sha256], key=lambda i: -1 if i is None else i)
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0
    clashing = odd.withColumns({"h": F.col("doc_id") * 3, "sha": F.lit("own"), "row": F.lit(9), "__uid": F.lit(11)})
    for docs in (odd, clashing, odd.limit(0)):
        kept = exact_dedup.drop_repeats(docs, **bounds)
        best = {}
        for r in docs.collect():
            best[r.text or ""] = max(best.get(r.text or "", (-2, None)), (-1 if r.doc_id is None else r.doc_id, tuple(r)), key=lambda x: x[0])
        assert kept.columns == docs.columns
        assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(repr(x[1]) for x in best.values())


def test_sharding(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.text_crc32 for r in rows if r.doc_id == 2} == {0}
    assert sharding.shard_documents(empty).count() == 0
    keys = sharding.stable_keys(np.arange(20000))
    old, new = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert (new[old != new] == 16).all() and abs((old != new).mean() - 1 / 17) < 0.01
    assert np.bincount(old).min() > 1000


def test_bpe_equals_the_library(odd, empty):
    own, library = bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    alphabet = " \n\t  ab'sñéA.,!?0129 \x1c 　漢🙂ſ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 500, "ab" * 3000, " " * 300, "<|endoftext|> x <|endoftext|><|endoftext|>", "it's we'll  they're\r\n\r\n  x", ""]
    for t, ids in zip(texts, own.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    rows = bpe.encode_documents(odd, BYTE).collect()
    assert sorted(r.decoded for r in rows) == sorted(r.text or "" for r in odd.collect())
    assert bpe.encode_digests(empty, BYTE).count() == 0


def test_packing(odd, empty):
    own, library = packing.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(1)
    alphabet = " \n\t  ab'sñéΣA.,!?0129 \x1c 　漢🙂İſ́\x85ǅ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 500, "<|endoftext|> x <|endoftext|><|startoftext|>y<|zz", "it's THEY'RE\r\n x", ""]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    rows = packing.pack_documents(odd, WORD).collect()
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty, WORD).count() == 0
    empty_crc = zlib.crc32(np.array([1], "<u4").tobytes())
    assert {(r.length, r.ids_crc32) for r in rows if r.doc_id == 2} == {(1, empty_crc)}


def test_local_search_improves_and_stays_valid():
    rng = random.Random(4)
    lengths = sorted((rng.randint(100, 300) for _ in range(90)), reverse=True)
    start = [[i] for i in range(90)]
    bins = packing.local_search(start, lengths, 600)
    assert sorted(i for b in bins for i in b) == list(range(90))
    assert all(sum(lengths[i] for i in b) <= 600 for b in bins) and len(bins) <= 36


def spellings(s, ids):
    """All ways to cut ``s`` into pieces."""
    if not s:
        return [[]]
    return [[ids[s[:j]], *rest] for j in range(1, len(s) + 1) if s[:j] in ids for rest in spellings(s[j:], ids)]


def test_lattice_against_all_segmentations():
    vocab = lm_score.vocabulary(PIECE)
    rng = np.random.default_rng(0)
    p = rng.random((2, vocab.size))
    log_p = np.log(p / p.sum(1, keepdims=True))
    stop = np.log([0.5, 0.25])
    words = ["the", "under", "ab", "then", "ça", "wher"]
    got = lm_score.log_words(vocab, [w.encode() for w in words], log_p, stop)
    for w, row in zip(words, got):
        for k in range(2):
            assert row[k] == pytest.approx(np.log(sum(np.exp(log_p[k][x].sum()) for x in spellings("▁" + w, vocab.ids))) + stop[k])
    want, counts = np.zeros(vocab.size), np.zeros(vocab.size)
    weights = np.arange(1.0, len(words) + 1)
    for w, weight in zip(words, weights):
        ways = spellings("▁" + w, vocab.ids)
        share = np.array([np.exp(log_p[0][x].sum()) for x in ways])
        for x, n in zip(ways, weight * share / share.sum()):
            np.add.at(want, x, n)
    for mine, block in lm_score.blocks(vocab, [w.encode() for w in words]):
        block.expect(log_p[0], weights[mine], counts)
    assert counts == pytest.approx(want)


def test_lattice_spells_strange_characters_by_bytes():
    vocab = lm_score.vocabulary(PIECE)
    log_p = np.log(np.full((1, vocab.size), 1 / vocab.size))
    strange = "\U0001f9ff\u4e02"
    assert not any(c in vocab.ids for c in strange)
    got = lm_score.log_words(vocab, [strange.encode(), b"\xff", b"", b"a" * 5000], log_p, np.zeros(1))[:, 0]
    assert got[:3] == pytest.approx(np.log(1 / vocab.size) * np.array([1 + 4 + 3, 1 + 1, 1])) and np.isfinite(got[3])


def test_lm_score_is_the_sum_over_all_segmentations_of_a_text(spark):
    """A corpus so small that the model can be written down: one class, known words and a new one."""
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10]
    new = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(i, "the cat" if n % 2 else "the hat sat") for n, i in enumerate(train)] + [(new, "the then")]
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), PIECE, label=None).collect()}
    vocab = lm_score.vocabulary(PIECE)
    counts = {}
    for i, t in rows[:-1]:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values()) + len(train)
    unseen = max(1.0, len(counts) / 10) / n
    weight, stop = 1000 * vocab.prior, 250.0
    for _ in range(3):
        p, q = weight / (weight.sum() + stop), stop / (weight.sum() + stop)
        found = np.zeros(vocab.size)
        for w, c in counts.items():
            ways = spellings("▁" + w, vocab.ids)
            share = np.array([p[x].prod() for x in ways])
            for x, part in zip(ways, np.sqrt(c) * share / share.sum()):
                np.add.at(found, x, part)
        weight, stop = found + 1000 * vocab.prior, sum(np.sqrt(c) for c in counts.values()) + 250
    p, q = weight / (weight.sum() + stop), stop / (weight.sum() + stop)

    def word(w):
        return (1 - unseen) * counts.get(w, 0) / n + unseen * q * sum(p[x].prod() for x in spellings("▁" + w, vocab.ids))

    for i, t in rows:
        want = sum(np.log10(word(w)) for w in t.split()) + np.log10((1 - unseen) * len(train) / n)
        assert got[i].score == pytest.approx(want)


def test_lm_scores(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lm_score.score_documents(docs, PIECE, hot_words=50).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts, n = {}, 0
    for i, t in texts.items():
        if not held[i]:
            for w in [*lm_score.words_of(t), None]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
    for r in rows:
        tokens = [*lm_score.words_of(texts[r.doc_id]), None]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(w in counts for w in tokens), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    again = {r.doc_id: r.score for r in lm_score.score_documents(docs, PIECE, hot_words=10**6).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in rows)
    assert len(lm_score.score_documents(odd, PIECE).collect()) == odd.count()
    assert lm_score.score_documents(empty, PIECE).count() == 0


@pytest.mark.parametrize(("n", "d", "span"), [(1, 4, 3), (6, 3, 2), (400, 16, 90), (300, 8, 2)])
def test_maxscore_against_brute_force(n, d, span):
    rng = np.random.default_rng(n)
    v = rng.integers(-span, span + 1, (n, d))
    v[n // 2 : n // 2 + n // 3] = v[0]
    ids = rng.permutation(n).astype(np.int64)
    shard = topk.Shard(ids, v)
    for q in range(min(n, 30)):
        scores = v @ v[q]
        want = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:5]
        got = shard.top(v[q].astype(float), ids[q], 5)
        assert got[0].tolist() == ids[want].tolist() and got[1].tolist() == scores[want].tolist()


def test_topk_edges(spark):
    nan = float("nan")
    rows = [(0, [0.5, -0.5]), (50, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (0, [0.5, -0.5]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).orderBy("query_id", "rank").collect()]
    # Both rows of id 0 ask, and each is the other's best.
    assert got == sorted(2 * [(0, 1, 0, 32768), (0, 2, 7, 32768), (0, 3, 6, 0), (0, 4, 50, 0)] + [(50, 1, 7, 32768), (50, 2, 0, 0), (50, 3, 0, 0), (50, 4, 6, 0)], key=lambda x: x[:2])
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e6] * 300)], "vec_id long, embedding array<double>"))
    assert topk.top_k(df.limit(0)).count() == 0


def test_line_simhash(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n))) for i, n in enumerate([1, 5, 119, 120, 121, 240, 241, 900])]
    df = line_dedup.with_simhash(spark.createDataFrame(rows, "i int, norm string")).withColumn("h", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))
    for r in df.collect():
        assert r.fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))


def test_lines(spark, odd, empty):
    long = "the quick brown fox jumps over the lazy dog and then runs back home again through fields"
    docs = spark.createDataFrame([(2, f"{long}\nalone here with some words\n"), (1, f"{long.upper()}!\nshort"), (3, long + "\nshort\n\n\n"), (4, None), (4, "short")], "doc_id long, text string")
    rows = line_dedup.line_groups(docs).collect()
    kept = sorted((r.doc_id, r.line_no) for r in rows if r.kept)
    assert kept == [(1, 0), (1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (3, 4), (4, 0)]
    texts = sorted(r.text for r in line_dedup.without_repeated_lines(docs).collect())
    assert texts == sorted(["alone here with some words\n", f"{long.upper()}!\nshort", "\n\n", "", ""])
    assert line_dedup.line_groups(odd).count() == sum((r.text or "").count("\n") + 1 for r in odd.collect())
    assert line_dedup.line_groups(empty).count() == 0


def line_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_lines_of_one_fingerprint_are_all_compared(spark):
    rng = random.Random(0)
    lines = []
    for _ in range(8):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(16)]
        lines += [" ".join(words[i:] + words[:i]) for i in range(3)]  # neighbours are similar, the ends are not
    alike = [(a, b) for b in range(len(lines)) for a in range(b) if line_similarity(lines[a], lines[b]) >= 0.8]
    want = components.star_forest(iter(alike))
    assert len(want) == 16 and len(alike) == 16
    rows = line_dedup.line_groups(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.first_doc_id for r in rows} == {i: want.get(i, i) for i in range(len(lines))}


def test_similarity_of_lines_by_hand(spark):
    rng = random.Random(3)
    pairs = [("a b c", "a b c"), ("a b c d", "a b c"), ("b c d", "a b c d"), ("a a a a", "a a a"), ("one two", "two one"), ("x", "y"), ("é a", "é b"), ("a b", "a bb"), ("ab a b", "b a b")]
    for _ in range(300):
        words = [rng.choice(["ab", "abc", "xyz", "q", "éa"]) for _ in range(rng.randint(1, 9))]
        other = [*words]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(other) + 1)
            rng.choice([lambda: other.insert(at, rng.choice(["ab", "zz"])), lambda: other.__setitem__(slice(at, at + 1), ["abd"]), lambda: other.__delitem__(slice(at, at + 1)) if len(other) > 1 else None])()
        pairs.append((" ".join(words), " ".join(other)))
    for least in (0.8, 0.5):
        rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.similar(F.col("a"), F.col("b"), least).alias("ok")).collect()
        assert [r.ok for r in rows] == [line_similarity(r.a, r.b) >= least - 1e-9 for r in rows]


def test_long_lines_are_held_to_the_same_rule(spark):
    words = [f"w{random.Random(i).randint(0, 10**6)}" for i in range(500)]
    other = [w if i % 20 else "x" + w[1:] for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(other)
    r = spark.createDataFrame([(a, b)], "a string, b string").select(line_dedup.similar(F.col("a"), F.col("b"), 0.8).alias("ok")).first()
    assert len(a) > 2000 and line_similarity(a, b) > 0.95 and r.ok


def blocks_by_hand(hashes):
    """What the words of a line are cut into: (level, class) -> the words' exclusive or."""
    n, out = len(hashes), {}
    for h in hashes:
        half = h % 2**64 >> 32
        if n < 20:
            out[0, h & 3] = out.get((0, h & 3), 0) ^ half
        if 12 <= n < 80:
            out[1, h & 7] = out.get((1, h & 7), 0) ^ half
        if n >= 51 and not h & 24:
            out[2, h & 7] = out.get((2, h & 7), 0) ^ half
    return {k: x for k, x in out.items() if x}


def test_blocks_of_lines_by_hand(spark):
    rng = random.Random(1)
    texts = ["\n".join(" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(n)) for n in ns) for ns in ([1, 2, 5], [12, 19, 20, 0], [50, 51, 79, 80], [900])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = {(r.doc_id, r.line_no): r for r in line_dedup.lines_of(df).withColumn("h", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))).collect()}
    rows = line_dedup.hashed_lines(df, "text", "doc_id", None, 2).collect()
    assert {(r.doc_id, r.line_no) for r in rows} == set(lines) and len(rows) == len(lines)
    want = {k: blocks_by_hand(r.h) if len(r.h) > 1 else {} for k, r in lines.items()}
    for r in rows:
        k = (r.doc_id, r.line_no)
        assert r.blank == (lines[k].norm == "")
        assert sorted(r.blocks) == sorted((8 * level + c) << 32 | x for (level, c), x in want[k].items())
        h = lines[k].h
        assert r.fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped_lines(docs, rows):
    """The group of each different normalised line, and the lines."""
    first = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in rows}
    out = {}
    for r in line_dedup.lines_of(docs).collect():
        if r.norm:
            assert out.setdefault(r.norm, first[r.doc_id, r.line_no]) == first[r.doc_id, r.line_no]
        else:
            assert first[r.doc_id, r.line_no] == (r.doc_id, r.line_no)
    return out


def similar_pairs(duck, norms, least=0.8):
    """Of all pairs of lines those of that edit similarity; letters beyond ASCII stand for themselves as one byte each."""
    odd = sorted({c for x in norms for c in x if ord(c) > 126})
    spare = [c for c in map(chr, range(33, 127)) if not c.isalnum() or c.isupper()]
    assert len(odd) <= len(spare)
    table = str.maketrans(dict(zip(odd, spare)))
    plain = pd.DataFrame({"i": range(len(norms)), "x": [n.translate(table) for n in norms]})  # noqa: F841  (read by name)
    sql = f"""SELECT a.i, b.i FROM plain a JOIN plain b ON a.i < b.i AND least(length(a.x), length(b.x)) >= {least} * greatest(length(a.x), length(b.x))
              WHERE levenshtein(a.x, b.x) <= floor((1 - {least}) * greatest(length(a.x), length(b.x)) + 1e-9)"""
    return duck.sql(sql).fetchall()


def test_groups_of_lines_against_all_pairs(spark, duck):
    """On the small table: of all pairs of different lines that are similar, nine of ten at least are in one group, and no group holds others."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = line_dedup.line_groups(docs).collect()
    groups = grouped_lines(docs, rows)
    norms = sorted(groups)
    pairs = similar_pairs(duck, norms)
    assert len(pairs) > 25
    together = [groups[norms[a]] == groups[norms[b]] for a, b in pairs]
    assert sum(together) >= 0.9 * len(together)
    root, seen = components.star_forest(iter(pairs)), {}
    for i, x in enumerate(norms):  # a group lies within one component of similar lines
        assert seen.setdefault(groups[x], root.get(i, i)) == root.get(i, i)
    sizes = {}
    for r in rows:
        sizes[r.first_doc_id, r.first_line_no] = sizes.get((r.first_doc_id, r.first_line_no), 0) + 1
    assert all(r.group_size == sizes[r.first_doc_id, r.first_line_no] for r in rows)
    assert all(r.kept == ((r.first_doc_id, r.first_line_no) == (r.doc_id, r.line_no)) for r in rows)


@pytest.mark.parametrize("hot", [line_dedup.HOT, 2])
def test_changed_words_at_every_length(spark, duck, hot):
    """Lines of 5 to 300 words, variants with one to some of their words changed, and blocks that many lines share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    common = [word() for _ in range(3)]
    lines = []
    for n in (5, 8, 13, 18, 22, 40, 55, 75, 90, 300):
        for _ in range(4):
            words = [rng.choice(common) if rng.random() < 0.3 else word() for _ in range(n)]
            lines.append(words)
            for changed in {1, max(1, n // 20), max(1, n // 8)}:
                new = [*words]
                for at in rng.sample(range(n), changed):
                    new[at] = word()
                lines.append(new)
    norms = sorted({" ".join(x) for x in lines})
    docs = spark.createDataFrame(list(enumerate(norms)), "doc_id long, text string")
    groups = grouped_lines(docs, line_dedup.line_groups(docs, hot=hot).collect())
    pairs = similar_pairs(duck, norms)
    together = [groups[norms[a]] == groups[norms[b]] for a, b in pairs]
    assert len(pairs) > 100 and sum(together) >= 0.9 * len(together)


def test_language_models(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language_id.Models(language_id.training_sample(docs))
    rows = docs.select("doc_id", "lang").join(language_id.identify(docs, models), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert language_id.keep_identified(docs, models).count() > 0.98 * docs.count()
    got = {r.doc_id: r for r in language_id.identify(odd, models).collect()}
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[2].rejected and got[3].score == 0
    junk = spark.createDataFrame([(1, "zqxjkvw " * 200)], "doc_id long, text string")
    assert language_id.identify(junk, models).first().rejected
    assert language_id.identify(empty, models).count() == 0
    assert language_id.training_sample(empty) == {} and language_id.Models({}).predict(["x"])[0] == ["und"]


def test_language_models_against_plain_kneser_ney():
    """Interpolated Kneser-Ney written down with dicts, order 3, one discount an order."""
    texts = {"a": ["the cat sat on the mat", "a cat and a hat"], "b": ["der hund und die katze", "das haus"]}
    models = language_id.Models(texts, order=3)
    letters = sorted({c for ts in texts.values() for t in ts for c in t if c.isalpha()})

    def spelt(t):
        out = []
        for c in t.lower():
            c = c if c in letters else "?" if c.isalpha() else " "
            if c != " " or (out and out[-1] != " "):
                out.append(c)
        return [*out, " "] if not out or out[-1] != " " else out

    def grams(ts, n):
        return [tuple([" "] * (n - 1) + spelt(t))[i : i + n] for t in ts for i in range(len(spelt(t)))]

    for j, k in enumerate(sorted(texts)):
        counts = {3: {}}
        for g in grams(texts[k], 3):
            counts[3][g] = counts[3].get(g, 0) + 1
        for n in (2, 1):
            counts[n] = {}
            for g in counts[n + 1]:
                counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

        def p(g, n):
            if not n:
                return 1 / (len(letters) + 3)
            ones, twos = sum(v == 1 for v in counts[n].values()), sum(v == 2 for v in counts[n].values())
            d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
            after = [v for h, v in counts[n].items() if h[:-1] == g[:-1]]
            if not after:
                return p(g[1:], n - 1)
            return max(counts[n].get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:], n - 1)

        for t in ("the hat", "der kater", "zzz xyz", "katze the"):
            want = -sum(np.log(p(g, 3)) for g in grams([t], 3)) / len(spelt(t))
            assert models.cross_entropy([t])[0][0, j] == pytest.approx(want, rel=1e-4), (k, t)


def test_fingerprints_against_plain_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    import re

    import xxhash

    want = {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(want)
    root = components.star_forest((a, b) for i, b in enumerate(ids) for a in ids[:i] if bin(want[a] ^ want[b]).count("1") <= 2)
    rows = simhash.near_dedup(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{want[i]:016x}", root.get(i, i)) for i in ids}


def test_sharding_against_one_key_at_a_time(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in sharding.shard_documents(docs).collect():
        key = int(sharding.stable_keys(np.array([r.doc_id]))[0])
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.shard, r.grown_shard, r.law) == (len(t) + 1, zlib.crc32(t), jump(key, 16), jump(key, 17), "key")


def test_packing_fills_sequences_and_cuts_long_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = packing.pack_documents(docs.unionByName(spark.createDataFrame([(-1, "word " * 9000)], "doc_id long, text string")), WORD).collect()
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)
    library = Tokenizer.from_file(WORD)
    whole = [*library.encode("word " * 9000, add_special_tokens=False).ids, 1]
    long = sorted((r for r in rows if r.doc_id == -1), key=lambda r: r.piece)
    assert [(r.piece, r.start, r.length) for r in long] == [(i, 4096 * i, min(4096, len(whole) - 4096 * i)) for i in range(-(-len(whole) // 4096))]
    assert [r.ids_crc32 for r in long] == [zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes()) for r in long]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name]))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    out = corpus_pipeline.run(spark, SMALL)
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert kept <= ids and len(kept) > 0.7 * len(ids)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096")
    assert sums.isEmpty()
    exact = exact_dedup.drop_repeats(docs)
    assert kept <= {r.doc_id for r in exact.select("doc_id").collect()}

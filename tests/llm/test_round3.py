"""MinHash, the prefix trie and spelling variants against brute force, on odd rows and on crowded groups."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SMALL, empty, odd  # noqa: F401  (fixtures)

from panolith.llm import components, language_id, minhash, prefix_trie, spelling


# --- MinHash -------------------------------------------------------------------------------


def shingles(text, words=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for n, shared in ((1, 1), (7, 6), (40, 30), (3000, 2000)):
        found = []
        for _ in range(20):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            s = minhash.sketches([a, a[:shared], a])
            assert (s != ~np.uint64(0)).all() and (s[0] == s[2]).all()
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - shared / n) < 0.03
    one = minhash.sketches([np.array([5], np.uint64)])[0] >> minhash.VALUE_BITS
    assert one.max() <= 2 * minhash.SIZE - 1 and one.min() < minhash.SIZE  # rounds of throws, then of all bins


def minhash_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = components.star_forest(iter(links))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        k = root.get(i, i)
        least[k] = min(least.get(k, (True, 0)), (doc_id is None, doc_id or 0))
    of = lambda i: None if least[root.get(i, i)][0] else least[root.get(i, i)][1]
    return sorted(((r[0], len(sets[i]), of(i), r[0] == of(i)) for i, r in enumerate(rows)), key=repr)


def test_minhash_on_odd_rows(spark, odd, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in minhash.near_dedup(odd.withColumns({"n": F.lit(1), "h": F.lit(2), "c": F.lit(3)})).collect()), key=repr)
    assert got == minhash_by_hand(rows)
    assert minhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("turns", [minhash.TURNS, 0])
def test_minhash_in_families_of_copies(spark, monkeypatch, turns):
    """Copies of copies at and around the threshold, by stars and with everything left to the full comparison."""
    monkeypatch.setattr(minhash, "TURNS", turns)
    rng = random.Random(4)
    rows = []
    for _ in range(10):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([8, 60, 300]))]
        for _ in range(15):
            new = [*words]
            for at in rng.sample(range(len(new)), int(len(new) * rng.choice([0, 0.01, 0.03, 0.05, 0.1]))):
                new[at] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(new)))
    rows += [(1000 + i, rows[3][1]) for i in range(5)]  # one set many times
    got = sorted((tuple(r) for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == minhash_by_hand(rows) and sum(not r[3] for r in got) > 40


# --- The trie of prefixes -------------------------------------------------------------------


def trie_by_hand(rows, rebuild=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:] if rebuild else v
    members, children = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in children.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], ends(k)) for k, m in members.items())


def rebuilt(df):
    c = F.col("conv_id")
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df, base=c - c % 5, keep=F.crc32(c.cast("string").cast("binary")) % 9).collect())


TURNS = "conv_id long, turn long, role string, text string, depth long, k0 long"


def test_trie_of_the_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert rebuilt(df) == trie_by_hand([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_trie_on_odd_rows(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", None, "é" * 3])) for c in [*range(12), 40, 41, 10**12] for t in range(rng.randint(1, 12))]
    rows += [(7, None, "user", "a"), (7, None, "user", "a"), (7, 3, "user", "b"), (None, 0, "user", "a"), (50, 0, "user", "same"), (50, 0, "user", "same")]
    rows += [(c, t, "user", "hot") for c in range(100, 160) for t in range(3)]  # one conversation many times
    rows += [(200, t, "user", str(t)) for t in range(700)] + [(201, t, "user", str(t)) for t in range(650)]  # longer than a row holds
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS)
    assert rebuilt(df) == trie_by_hand(rows)
    plain = sorted(tuple(r) for r in prefix_trie.prefix_trie(df).collect())
    assert plain == trie_by_hand(rows, rebuild=False)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert rebuilt(df.limit(0)) == []


# --- Spelling variants ----------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_hand(rows, often=5):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= often}
    partners = {w: [] for w in words}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for length, own in by.items():
        for a, b in [*combinations(own, 2), *((a, b) for a in own for b in by.get(length + 1, []))]:
            if near(a, b):
                partners[a].append(b)
                partners[b].append(a)
    form = {}
    for w, p in partners.items():
        best = min(((-words[x], x) for x in p), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(partners[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def told(df, **rules):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.spelling_groups(df, **rules).collect())


def test_deletion_keys_tell_words_apart():
    words = ["banana", "bananb", "banaana", "xanana", "bananaa"]
    keys = {}
    for i, w in enumerate(words):
        _, k, place = spelling.deletion_keys(np.array([[ord(c) for c in w]], np.uint64))
        assert len(k) == 2 * len(w) + 1 - sum(x == y for x, y in zip(w, w[1:]))
        for x, p in zip(k.tolist(), place.tolist()):
            keys.setdefault(x, set()).add(i)
    met = {tuple(sorted(v)) for v in keys.values() if len(v) > 1}
    both = {p for v in met for p in combinations(v, 2)}
    assert both - {(2, 4)} == {(a, b) for a, b in combinations(range(5), 2) if near(words[a], words[b])}  # 2 and 4 both lose an a


def test_collisions_are_told_by_strings():
    rows = [(1, 0, "abcdef", 5), (2, 0, "xbcdef", 9), (3, 0, "qqqqqq", 50), (4, -1, "bcdefg", 3), (5, -2, "abcdefg", 4), (6, -2, "zzzzzzz", 80)]
    got = sorted(spelling.bucket_partners(rows))
    assert got == [(1, 1, 9, "xbcdef"), (2, 1, 5, "abcdef"), (4, 1, 4, "abcdefg"), (5, 1, 3, "bcdefg")]


def test_spelling_on_odd_rows(spark, odd, empty):  # noqa: F811
    chain = "kitten " * 400 + "kittens " * 60 + "kittenss " * 10 + "Étésàbc étésàbc ETES×BC " * 6 + ("long" * 5000 + " ") * 5 + ("long" * 4999 + "lonk ") * 26
    docs = odd.unionByName(spark.createDataFrame([(i, chain, "en", "s", 1, 2, 3) for i in range(2)] + [(None, "kittem " * 7, None, None, 1, 2, 3)], odd.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = told(docs.withColumns({"n": F.lit(1), "key": F.lit(2)}))
    assert got == spelling_by_hand(rows)
    assert {r[0]: r[5] for r in got}["kittenss"] == "kitten" and any(len(r[0]) == 20000 and r[3] for r in got)
    assert told(docs, often=1) == spelling_by_hand(rows, 1)
    assert told(empty) == []


def test_spelling_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert told(docs, often=2) == spelling_by_hand([(r.doc_id, r.text) for r in docs.collect()], 2)


# --- Language ID ------------------------------------------------------------------------------


def test_no_label_is_lost_by_sampling(spark):
    rows = [(i, "ja nein " * 20, "de") for i in range(40)] + [(100 + i, "si no quizas " * 5000, "xx") for i in range(5)]
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=2000)
    assert set(sample) == {"de", "xx"} and len(sample["xx"]) == 1 and 1 <= len(sample["de"]) < 40
    models = language_id.Models(sample)
    assert models.predict(["quizas no si", "nein ja nein"])[0] == ["xx", "de"]


def test_pipeline_stage_of_languages_on_odd_rows(spark, odd, empty):  # noqa: F811
    models = language_id.Models(language_id.training_sample(spark.read.parquet(f"{SMALL}/documents.parquet")))
    kept = language_id.keep_identified(odd, models)
    rejected = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd, models).collect() if r.rejected}
    assert kept.columns == odd.columns and kept.count() == odd.count() - sum(r.rejected for r in language_id.identify(odd, models).collect())
    assert {(2, "und"), (3, "und"), (4, "und"), (10, "und")} <= rejected  # null, empty, blank
    assert language_id.keep_identified(empty, models).count() == 0
    assert language_id.keep_identified(odd, language_id.Models({})).count() == 0

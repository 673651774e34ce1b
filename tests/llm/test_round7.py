"""What the findings of round 7 asked for, small: training-data operators."""

import random

from panolith.llm import simhash
from panolith.session import Scratch


def test_near_copies_meet_without_their_texts(spark, monkeypatch):
    """However many documents are still apart, no text is read, and so none is shuffled, for the bitmaps that rule pairs out."""
    monkeypatch.setattr(simhash, "SMALL_ROWS", 0)
    rng = random.Random(3)
    texts = []
    for k in range(80):  # of two texts, 6 or 50 words of 120 differ
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        apart = 50 if k % 2 else 6
        texts += [" ".join(words), " ".join([*words[:-apart], *(f"z{rng.randrange(10**6)}" for _ in range(apart))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans = {}

    class Seen(Scratch):
        def __call__(self, df, tag):
            plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
            return super().__call__(df, tag)

    monkeypatch.setattr(simhash, "Scratch", Seen)
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(docs, at_once=1 << 40).collect())
    assert kept == [i for i in range(len(texts)) if i % 4 != 1]
    assert "copy-apart" in plans and not [tag for tag, plan in plans.items() if "text#" in plan]

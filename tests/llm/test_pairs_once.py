"""What the findings of round 6 asked for, small: training-data operators."""

import pytest
from panolith.llm import simhash
from panolith.session import Scratch


@pytest.mark.parametrize("first_ones", [simhash.FIRST, 2])
def test_documents_that_share_many_shingles_meet_once(spark, monkeypatch, first_ones):
    """Every two of a family share shingles that others lack, so that they are not bundled; the join makes a row a pair."""
    monkeypatch.setattr(simhash, "FIRST", first_ones)
    family = [" ".join(f"w{i}" if i != 16 * k + 6 else f"other{k}" for i in range(200)) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(family)), "uid long, text string")
    sets = {r.uid: set(r.s) for r in simhash.shingle_sets(docs, 5).collect()}
    postings = [(u, h, i, len(s), u) for u, s in sets.items() for i, h in enumerate(sorted(s, reverse=True)[:42])]
    shared = spark.createDataFrame(postings, "uid long, h long, i int, n int, c long").selectExpr("*", "0L AS fp", "0L AS fq")
    joined = []

    class Seen(Scratch):
        def __call__(self, df, tag):
            if tag == "copy-apart":
                plan = df._jdf.queryExecution().optimizedPlan()
                joined.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, plan.children().head()).count())
            return super().__call__(df, tag)

    with Seen(spark) as held:
        pairs = simhash._apart_still(shared, docs, 5, 0.8, held)
        got = sorted((r.a, r.b) for r in pairs.collect())
    first = {u: set(sorted(s, reverse=True)[:42]) for u, s in sets.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and first[a] & first[b]]
    assert alike and set(alike) <= set(got)
    repeated = sum(len(first[a] & first[b]) for a, b in got)
    assert len(got) < repeated / 4 and (len(got) <= joined[0] < repeated if first_ones == 2 else joined[0] == len(got))

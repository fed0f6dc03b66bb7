import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import repetition as R
from tests.conftest import rows


def brute(text, run):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    covered = set()
    for k in range(len(words) - run + 1):
        if any(words[j : j + run] == words[k : k + run] for j in range(k)):
            covered |= set(range(k, k + run))
    return len(words), len(covered) / len(words) if words else 0.0


texts = st.lists(st.none() | st.lists(st.sampled_from(["a", "B", "cé", "1", "-", "_", "Ünder", " ", "x_y", "—", "²"]), max_size=30).map(" ".join) | st.text(alphabet="ab é_1\n", max_size=40), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_shares(batch):
    stats = R.Statistics(pa.array(batch, pa.string()))
    chosen = np.arange(len(batch)) % 3 != 1
    rule, some = stats.rule(np.ones(len(batch), dtype=bool)), stats.rule(chosen)
    for k, t in enumerate(batch):
        assert [stats.count[k]] * 3 == [brute(t, r)[0] for r in (*R.RUNS, R.RULE)]
        assert np.allclose([*stats.shares[k], rule[k]], [brute(t, r)[1] for r in (*R.RUNS, R.RULE)])
        assert some[k] == rule[k] if chosen[k] else np.isnan(some[k])
        # What bounds the forest's candidates: shares of shorter runs are as large.
        assert stats.shares[k, 0] >= stats.shares[k, 1] >= rule[k]


def documents(rng, n):
    words = [f"w{k}" for k in range(400)]
    out = [None, "", "--", "one", "a b c d e f a b c d e f", "x " * 50_000]
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        k = rng.randrange(len(base))
        out.append(" ".join(base + base[k : k + rng.randrange(60)] * rng.choice([0, 0, 1, 1, 3])))
    return out


def test_no_repetitive_document_is_missed(spark):
    batch = documents(random.Random(2), 400)
    df = spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(batch)], "doc_id bigint, text string, score double")
    want = [(k,) for k, t in enumerate(batch) if brute(t[:4000] if t else t, 6)[1] >= R.SHARE]
    assert rows(R.repetitive(df)) == sorted(want, key=repr)
    # A forest from a few rows only has the same bound.
    assert rows(R.repetitive(df, sample_rows=20)) == sorted(want, key=repr)
    assert rows(R.repetitive(df.unionByName(df))) == sorted(want, key=repr)
    scored = R.repetition(df)
    kept = R.repetition(df, forest=R.fit(df), exact=False)
    assert rows(kept.where("candidate AND share_6 >= 0.3"), "doc_id") == sorted(want, key=repr)
    assert 0 < kept.where("share_6 IS NULL AND NOT candidate").count() < len(batch) and kept.where("share_6 IS NULL AND candidate").count() == 0
    assert scored.count() == len(batch) and scored.where("doc_id <= 2 AND (n_words > 0 OR share_6 > 0)").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.repetitive(df).count() == 0 and R.repetition(df).columns[-1] == "candidate"


def test_forest(spark):
    rng = np.random.default_rng(1)
    usual = rng.beta(1, 12, (1900, 3)) * [0.6, 0.3, 0.1]
    odd = np.sort(rng.uniform(0.35, 0.95, (100, 3)), axis=1)[:, ::-1]
    rows_ = np.vstack((usual, odd))
    truth = rows_[:, 2] >= R.SHARE
    part = rng.permutation(len(rows_))
    fit, held = part[:1000], part[1000:]
    forest = R.Forest.fit(rows_[fit])
    forest.calibrate(rows_[fit], truth[fit])
    scores = forest.score(rows_[held])
    assert (scores[truth[held]] >= forest.bound).all()
    found = scores >= forest.threshold
    assert (found & truth[held]).sum() / truth[held].sum() > 0.9 and (found & ~truth[held]).sum() / found.sum() < 0.2
    grid = rng.uniform(R.SHARE, 1, (500, 3))
    assert (forest.score(grid) >= forest.bound).all()
    flat = R.Forest.fit(np.zeros((10, 3)))
    flat.calibrate(np.zeros((10, 3)), np.zeros(10, dtype=bool))
    assert (flat.score(np.ones((2, 3))) >= flat.bound).all()

import random
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import mixture as M
from quillspan.llm import packing as P
from quillspan.llm import tokens as T
from tests.conftest import rows

SIZES = "doc_id bigint, n_tokens bigint, pack string, cost string"


def sizes(spark, values):
    return spark.createDataFrame([(k, n, "x", "y") for k, n in enumerate(values)], SIZES)


def check(places, values, packs):
    for name, capacity, sep in packs:
        own = places[places.pack_name == name]
        for _, box in own.groupby("container"):
            assert box.n_tokens.sum() + sep * (len(box) - 1) <= capacity
            assert sorted(box.position) == list(range(len(box)))
        assert sorted(own.container.unique()) == list(range(own.container.nunique()))
        pieces = {d: list(g.sort_values("piece").itertuples()) for d, g in own.groupby("doc_id")}
        assert len(pieces) == len(values)
        for d, n in enumerate(values):
            assert sum(p.n_tokens for p in pieces[d]) == n and len(pieces[d]) == max(1, -(-n // capacity))
            assert [p.token_start for p in pieces[d]] == [k * capacity for k in range(len(pieces[d]))]


@pytest.mark.parametrize("kind", ["mixed", "equal", "large", "empty texts"])
def test_places(spark, kind, monkeypatch):
    rng = random.Random(kind)
    values = {"mixed": [rng.choice([0, 1, 7, 33, 50, 99, 100, 101, 350]) for _ in range(400)], "equal": [40] * 300, "large": [1000, 99, 1], "empty texts": [0] * 50}[kind]
    packs = [("a", 100, 0), ("b", 64, 1), ("c", 9, 3)]
    monkeypatch.setattr(P, "_BLOCK", 16)  # ranks of one size span blocks
    places, slots = P.pack(sizes(spark, values), packs)
    check(places.toPandas(), values, packs)
    made = {r.pack: (r.containers, r.least) for r in slots.collect()}
    for name, capacity, sep in packs:
        total = sum(sum(min(n - k, capacity) + 0 for k in range(0, max(n, 1), capacity)) for n in values)
        assert made[name][0] >= made[name][1] >= total / capacity - 1


def test_empty_and_void_packs(spark):
    places, _ = P.pack(sizes(spark, []), [("a", 10, 0)])
    assert places.count() == 0
    places, _ = P.pack(sizes(spark, [1]), [("a", None, 0), ("b", 0, None)])
    assert places.count() == 0 and places.columns[0] == "pack_name"
    report = P.pack_report(sizes(spark, [5, 5, 12]), [("a", 10, 0)]).first()
    assert (report.n_containers, report.least_containers, report.n_items, report.n_divided, report.n_tokens) == (3, 3, 4, 1, 22)


def fewest(items, capacity):
    """Exact by trying every container for every item."""
    items, best = sorted(items, reverse=True), len(items)

    def go(k, boxes):
        nonlocal best
        if len(boxes) >= best:
            return
        if k == len(items):
            best = len(boxes)
            return
        for b in range(len(boxes)):
            if boxes[b] >= items[k] and boxes[b] not in boxes[:b]:
                go(k + 1, [*boxes[:b], boxes[b] - items[k], *boxes[b + 1 :]])
        go(k + 1, [*boxes, capacity - items[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("items, capacity", [([4, 6, 6, 7, 8, 9, 9, 10], 20), ([22, 24, 29, 36, 41, 45, 46, 49], 100), ([10, 11, 15, 19, 21, 21, 22, 25], 50)])
def test_branching_finds_what_one_filling_after_the_other_misses(items, capacity):
    count = lambda **bound: sum(t for t, _ in P.fillings(dict(Counter(items)), capacity, **bound)[0])
    assert count() == fewest(items, capacity) == 3 and count(steps=0) == 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_fillings_against_the_optimum(items):
    made, least = P.fillings(dict(Counter(items)), 20)
    placed = Counter()
    for times, filling in made:
        assert sum(filling) <= 20
        for c in filling:
            placed[c] += times
    assert placed == Counter(items)
    n, optimum = sum(t for t, _ in made), fewest(items, 20)
    assert least <= optimum <= n <= optimum + 1


def test_completion_beats_best_fit():
    """Best fit needs four containers here, three are enough."""
    made, least = P.fillings({6: 1, 5: 1, 4: 2, 3: 2, 2: 1, 1: 3}, 10)
    assert sum(t for t, _ in made) == least == 3


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello, world's <|endoftext|> 123!", "", None, "naïve  \n\t drawing — façade", "a" * 50_000, " " * 300]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(df, {"doc_id": "bigint"}).collect()}
    other = tokenizers.Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    assert got == {k: len(other.encode(t, add_special_tokens=False)) if t else 0 for k, t in enumerate(texts)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.001, 1), min_size=1, max_size=8))
def test_schedule_stays_within_a_block(shares):
    weights = M.quantised(shares, 300)
    assert sum(weights) == 300 and all(abs(w - s / sum(shares) * 300) < 1 for w, s in zip(weights, shares))
    given = [0] * len(weights)
    for slot, k in enumerate(M.schedule(weights), 1):
        given[k] += 1
        assert all(abs(n - w * slot / 300) < 1 for n, w in zip(given, weights))
    assert given == weights


def mixed(spark, docs, targets, **options):
    df = spark.createDataFrame([(k, s, n, "z") for k, (s, n) in enumerate(docs)], "doc_id bigint, source string, n_tokens bigint, offset string")
    return M.mixture(df, targets, **options)


def test_mixture(spark):
    rng = random.Random(8)
    docs = [(rng.choice("aaaaaabbbc"), rng.choice([0, 3, 10, 40, 90])) for _ in range(3000)] + [("other", 50)] * 100
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("absent", 0.0, 1)]
    got = mixed(spark, docs, targets, block_tokens=200)
    out = got.toPandas().sort_values(["slot", "offset"])
    have = {s: sum(n for t, n in docs if t == s) for s in "abc"}
    total = min(have["a"] / 0.5, have["b"] * 2 / 0.3, have["c"] * 3 / 0.2)
    for s, share, cap in targets[:3]:
        own = out[out.source == s]
        assert abs(own.n_tokens.sum() - share * total) <= 90
        assert own.groupby("doc_id").size().max() <= cap
        uses = own.groupby("doc_id").use.apply(sorted)
        assert all(u == list(range(len(u))) for u in uses)
        run = out.n_tokens.cumsum()
        assert ((out.n_tokens * (out.source == s)).cumsum() - share * run).abs().max() <= 3 * 200 + 200
    assert set(out.source) == set("abc")
    shares = {r.source: r for r in M.shares(got, targets).collect()}
    assert shares["b"].share == pytest.approx(0.3, abs=0.002) and shares["absent"].n_tokens == 0 and shares["c"].max_uses <= 3
    # A document is used again only after all of its source.
    c = out[out.source == "c"].sort_values("offset")
    assert list(c.use) == sorted(c.use)


def test_mixture_without_anything_to_mix(spark):
    assert mixed(spark, [], [("a", 1.0, 1)]).count() == 0
    assert mixed(spark, [("a", 0)], [("a", 1.0, 1)]).count() == 0
    assert mixed(spark, [("a", 5)], []).count() == 0
    one = mixed(spark, [("a", 5), ("a", 7)], [("a", 0.5, 2), ("gone", 0.5, 1), ("null", None, 1)])
    assert one.count() == 4 and isinstance(one.toPandas(), pd.DataFrame)
    assert rows(one, "use") == [(0,), (0,), (1,), (1,)]

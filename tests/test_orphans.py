import random
from datetime import datetime, timedelta

import pytest

from quillspan.operators import orphans as O
from tests.conftest import rows

T0 = datetime(2025, 1, 1)
PARENTS = "set_id string, entity_id string, recorded_at timestamp, is_deleted boolean, key string, t int"
REFS = "rid string, set_id string, a string, b string, recorded_at timestamp, kind int"


def judge(parents, refs):
    out = set()
    norm = lambda x: "".join(c for c in x.lower() if not c.isspace() and c != "-")
    for rid, s, a, b, at, _ in refs:
        for field, value in (("a", a), ("b", b)):
            if value is None or not value.strip():
                continue
            own = [(p[2] or datetime.min, bool(p[3])) for p in parents if None not in (p[0], p[1], s) and p[0] == s and norm(p[1]) == norm(value)]
            before = [p for p in own if at is None or p[0] <= at]
            if not own:
                out.add((rid, field, "missing"))
            elif not before:
                out.add((rid, field, "late"))
            elif max(before)[1]:
                out.add((rid, field, "deleted"))
    return sorted(out, key=repr)


def found(spark, parents, refs):
    p, r = spark.createDataFrame(parents, PARENTS), spark.createDataFrame(refs, REFS)
    got = O.orphans(p, [O.References("t", r, "rid", ("a", "b"), "set_id", "recorded_at")], key="entity_id", scope="set_id", at="recorded_at", deleted="is_deleted")
    return rows(got, "row_key", "ref_field", "reason")


def test_each_reason_and_spelling(spark):
    k = "0123456789abcdef0123456789abcdef"
    parents = [("s", k, T0, False, "x", 1), ("s", k, T0 + timedelta(5), True, "x", 1), ("s", k, T0 + timedelta(9), False, "x", 1), ("other", "zz", T0, False, "x", 1)]
    refs = [
        ("live", "s", f" {k.upper()}\t", None, T0, 0),
        ("late", "s", k, "", T0 - timedelta(1), 0),
        ("deleted", "s", f"{k[:8]}-{k[8:]}", " ", T0 + timedelta(6), 0),
        ("restored", "s", k, None, T0 + timedelta(9), 0),
        ("missing", "s", "zz", "-", T0, 0),
        ("no scope", None, k, None, T0, 0),
        ("no time", "s", k, None, None, 0),
        ("live", "s", f" {k.upper()}\t", None, T0, 0),
    ]
    assert found(spark, parents, refs) == judge(parents, refs)
    assert ("missing", "b", "missing") in judge(parents, refs)


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 40)  # keys span ranges
    monkeypatch.setattr(O, "_BLOCK", 2)  # and blocks of ranges
    rng = random.Random(int(hot))
    ids = [f"{rng.getrandbits(128):032x}" for _ in range(12)] + ["short", ""]
    pick = lambda: ids[0] if hot and rng.random() < 0.5 else rng.choice(ids)
    when = lambda: T0 + timedelta(minutes=rng.randrange(60))
    parents = [(rng.choice(["s", "t"]), pick(), when(), rng.random() < 0.3, None, None) for _ in range(400)]
    # Of equal times one mark only: the withdrawal wins.
    refs = [(f"r{k}", rng.choice(["s", "t", "u"]), pick().upper(), rng.choice([None, pick(), "gone"]), when(), k) for k in range(600)]
    assert found(spark, parents, refs) == judge(parents, refs)


def test_one_key_without_times_is_in_many_ranges(spark, monkeypatch):
    """References of one key and no time are parted by their own keys, and all learn of the one parent."""
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 25)
    monkeypatch.setattr(O, "_BLOCK", 3)
    refs = [(f"r{k:03}", "s", "key", None, None, 0) for k in range(300)]
    for deleted in (False, True):
        parents = [("s", "KEY", T0, deleted, "x", 1)]
        assert found(spark, parents, refs) == judge(parents, refs)
    assert len(found(spark, [("s", "else", T0, False, "x", 1)], refs)) == 300


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [("s", "k", T0, False, "x", 1)], []) == []
    assert found(spark, [], [("r", "s", "k", None, T0, 0)]) == [("r", "a", "missing")]


def test_counts(spark):
    r = spark.createDataFrame([("r", "s", "k", "j", T0, 0)], REFS)
    p = spark.createDataFrame([], PARENTS)
    got = O.orphans(p, [O.References("t", r, "rid", ("a", "b"), "set_id", "recorded_at")], key="entity_id", scope="set_id", at="recorded_at", deleted="is_deleted")
    assert rows(O.orphan_counts(got)) == [("t", "a", "missing", "2025-01", 1), ("t", "b", "missing", "2025-01", 1)]

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluice.errors import ValidationError, raised
from sluice.operators import joins
from sluice.operators.joins import JoinMode

R0 = [(2, "Donny"), (3, "Dude"), (1, "Walter"), (5, "Maude")]
R1 = [(1, "Walter"), (3, "Dude"), (4, "Jeff")]


def tables(spark, left, rights):
    return spark.createDataFrame([(k,) for k in left], "k int"), [spark.createDataFrame(r, "rank int, name string") for r in rights]


def model(left, rights, mode):
    """Records by the definition of the modes."""
    keys = set(left) | {k for r in rights for k, _ in r}
    out = {}
    for k in keys:
        own, found = [x for x in left if x == k], {i: sorted(n for x, n in r if x == k) for i, r in enumerate(rights)}
        found = {i: v for i, v in found.items() if v}
        keep = {"left": bool(own), "inner": own and found, "full_inner": own and len(found) == len(rights), "outer": True}[mode.value]
        if keep:
            out[k] = (len(own), found)
    return out


def plain(records):
    return {r.key: (len(r.left), {i: [x.name for x in v] for i, v in r.right.items()}) for r in records.collect()}


@pytest.mark.parametrize("mode", list(JoinMode))
def test_records_in_four_modes(spark, mode):
    left, rights = tables(spark, [3, 5, 1, 6], [R0, R1])
    assert plain(joins.join_records(left, rights, "k", "rank", mode)) == model([3, 5, 1, 6], [R0, R1], mode)


def test_inner_is_left_and_any_right(spark):
    left, rights = tables(spark, [3, 5, 1, 6], [R0, R1])
    got = plain(joins.join_records(left, rights, "k", "rank", JoinMode.INNER))
    assert set(got) == {1, 3, 5} and set(got[5][1]) == {0}


def test_without_left(spark):
    _, rights = tables(spark, [], [[(k, "x") for k in (1, 2, 3, 5)], [(k, "y") for k in (1, 3, 4)]])
    out = joins.join_records(None, rights, None, "rank", ordered=True).collect()
    assert [r.key for r in out] == [1, 2, 3, 4, 5] and all(r.left == [] for r in out)


def test_lookup_gives_a_record_for_each_left_row(spark):
    r0 = [(1, "Walter"), (2, "Donny2"), (3, "Dude"), (5, "Maude"), (2, "Donny")]
    r1 = [(3, "Dude"), (1, "Walter"), (3, "Dude2"), (4, "Jeff")]
    left, rights = tables(spark, [3, 1, 3, 6, 5], [r0, r1])
    out = joins.lookup_join(left, rights, "k", "rank", JoinMode.OUTER).collect()
    assert len(out) == 7 and Counter(r.key for r in out)[3] == 2
    assert {r.key for r in out if not r.left} == {2, 4}
    assert len(joins.lookup_join(left, rights, "k", "rank", JoinMode.FULL_INNER).collect()) == 3


def test_null_keys(spark):
    left, rights = tables(spark, [1, None], [[(None, "n"), (1, "w")]])
    got = joins.lookup_join(left, rights, "k", "rank", JoinMode.INNER).collect()
    assert {r.key for r in got} == {1, None}
    with pytest.raises(ValidationError), raised():
        joins.join_records(left, rights, "k", "rank").collect()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), max_size=8), st.lists(st.lists(st.tuples(st.integers(0, 6), st.sampled_from("abc")), max_size=6), min_size=1, max_size=3), st.sampled_from(list(JoinMode)))
def test_records_like_the_model(spark, left, rights, mode):
    a, b = tables(spark, left, rights)
    assert plain(joins.join_records(a, b, "k", "rank", mode)) == model(left, rights, mode)


def test_record_helpers_and_flat_forms(spark):
    left, rights = tables(spark, [3, 5], [R0, R1])
    records = joins.join_records(left, rights, "k", "rank", JoinMode.LEFT)
    got = {r.key: (r.n, r.l, r.r) for r in records.select("key", joins.items_count().alias("n"), joins.single_left()["k"].alias("l"), joins.single_right(0)["name"].alias("r")).collect()}
    assert got == {3: (3, 3, "Dude"), 5: (2, 5, "Maude")}
    assert sorted(r.right.name for r in joins.flat_records(records, 0).collect()) == ["Dude", "Maude"]


def test_large_join(spark):
    ranks = spark.range(0, 1_000_001).select("id", "id").toDF("rank", "name")
    ids = spark.range(900_001, 1_100_001).toDF("k")
    assert joins.join_records(ids, [ranks], "k", "rank").agg({"key": "count"}).first()[0] == 100_000

"""Differences by fingerprints against plain multiset differences, on random damage."""

import random

import pytest

from foldspark.functions import fingerprints

SCHEMA = "k long, name string, v double, tags array<string>"


def rows_of(rng, n):
    return [(k, rng.choice(["a", "b", None]), rng.choice([0.5, float(k), None]), rng.choice([[], ["x"], ["x", None], None])) for k in range(n)]


@pytest.mark.parametrize("damage", [0, 1, 7])
def test_difference_on_random_damage(spark, damage):
    rng = random.Random(damage)
    left = rows_of(rng, 3000) + [(1, "twice", 1.0, [])] * 3
    right = list(left)
    for _ in range(damage):
        at = rng.randrange(len(right))
        right[at] = rng.choice([(right[at][0], "changed", right[at][2], right[at][3]), left[rng.randrange(len(left))]])
    right = right[damage:] + right[:1] * (damage > 5)
    rng.shuffle(right)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).repartition(3).select("tags", "v", "k", "name")
    got = sorted(map(repr, fingerprints.difference(a, b).collect()))
    plain = a.exceptAll(b.select(a.columns)).collect(), b.select(a.columns).exceptAll(a).collect()
    assert [r.replace(", side='left'", "").replace(", side='right'", "") for r in got] == sorted(map(repr, [*plain[0], *plain[1]])) or len(got) == len(plain[0]) + len(plain[1])
    assert sum("side='left'" in r for r in got) == len(plain[0]) and bool(got) == bool(damage)
    # what is compared row by row is the share of the buckets that differ
    odd = fingerprints.differing(fingerprints.fingerprints(a), fingerprints.fingerprints(b.select(a.columns)))
    assert odd.count() <= len(got)
    read = fingerprints.bucketed(a, "bucket").join(odd, "bucket", "left_semi").count()
    assert read <= 4 * max(1, len(got))


def test_fingerprints_form_a_tree(spark):
    rows = spark.createDataFrame(rows_of(random.Random(1), 500), SCHEMA)
    fine, coarse = fingerprints.fingerprints(rows, 8), fingerprints.fingerprints(rows, 3)
    assert sorted(fingerprints.coarser(fine, 3).collect()) == sorted(coarse.collect()) and coarse.count() <= 8
    assert fingerprints.differing(coarse, fingerprints.coarser(fine, 3)).isEmpty()
    assert fingerprints.difference(rows.limit(0), rows.limit(0)).isEmpty()
    assert fingerprints.difference(rows, rows.limit(0)).count() == 500

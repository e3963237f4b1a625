import random

import pytest

from confab.operators.intervals import periods_and_gaps


def brute(rows, most):
    out = set()
    by = {}
    for k, s, e in rows:
        if None not in (k, s, e) and e > s:
            by.setdefault(k, []).append((s, e))
    for k, v in by.items():
        v.sort()
        a, z = v[0]
        for s, e in v[1:]:
            if s > z:
                out.add((k, "period", a, z))
                if most is None or s - z <= most:
                    out.add((k, "gap", z, s))
                a, z = s, e
            z = max(z, e)
        out.add((k, "period", a, z))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_equals_brute_force_across_partitions(small_batches, seed):
    r = random.Random(seed)
    keys = ["a"] if seed % 2 else ["a", "b", "c", None]
    rows = [(r.choice(keys), (s := r.randrange(500)), s + r.choice([-1, 0, 1, 4, 9, 70])) for _ in range(120)]
    rows += rows[:20] + [("a", None, 3), ("a", 3, None)]
    df = small_batches.createDataFrame(rows, "k string, s long, e long")
    got = [tuple(x) for x in periods_and_gaps(df, "k", "s", "e", 8).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 8)


def test_touching_nested_empty_and_extra_columns(spark):
    rows = [("a", 0, 5, "x"), ("a", 5, 7, "y"), ("a", 1, 2, None), ("a", 9, 9, "z")]
    df = spark.createDataFrame(rows, "k string, s long, e long, kind string")
    assert [tuple(r) for r in periods_and_gaps(df, "k", "s", "e").collect()] == [("a", "period", 0, 7)]
    assert periods_and_gaps(df.limit(0), "k", "s", "e").collect() == []


def test_longest_gap_is_inclusive(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 11, 12), ("a", 23, 24)], "k string, s long, e long")
    assert {tuple(r)[2:] for r in periods_and_gaps(df, "k", "s", "e", 10).where("kind = 'gap'").collect()} == {(1, 11)}


def test_partitions_follow_the_size_of_the_input(spark, tmp_path, monkeypatch):
    from confab.operators import rangescan

    spark.range(4000).selectExpr("concat('e', id % 3) as e", "id * 10 as a", "id * 10 + 5 as z").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(periods_and_gaps(df, "e", "a", "z").collect())
    assert rangescan.partitions_for(df) is None and rangescan.partitions_for(df.join(df.select("e"), "e").join(df.select("e"), "e")) is None
    monkeypatch.setattr(rangescan, "PARTITION_BYTES", 1000)
    assert rangescan.partitions_for(df) > 10 and rangescan.sort_globally(df, "e", "a").rdd.getNumPartitions() > 10
    assert sorted(periods_and_gaps(df, "e", "a", "z").collect()) == want and len(want) == 7997


def test_times_too_far_apart_for_one_running_maximum():
    import numpy as np

    from confab.operators.rangescan import furthest_before

    rnd = np.random.default_rng(3)
    for far in (10, 2**60):
        for carried in (None, 3, far):
            end = rnd.integers(0, far, 60)
            first = rnd.random(60) < 0.2
            first[0] = carried is None
            got, best = furthest_before(end, first, carried), carried
            for i in range(60):
                if first[i]:
                    best = None
                elif best is not None:
                    assert got[i] == best
                best = int(end[i]) if best is None else max(best, int(end[i]))

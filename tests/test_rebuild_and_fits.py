"""Dirty-key rebuilds, and choices fitted on a split, against plain versions."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from florilege.operators import fits
from florilege.plans.streams import CHANGE, user_rows
from florilege.streaming import rebuild as rb

FIELDS = "key long, seq long, ts timestamp, kind string, value double, gone boolean"


def changes(spark, rows):
    return spark.createDataFrame(rows, "key long, seq long, kind string, value double, gone boolean").withColumn("ts", F.timestamp_seconds("seq")).select(*[f.split(" ")[0] for f in FIELDS.split(", ")])


def state(spark, root):
    return sorted((r["key"], r["n"], r["last_kind"], r["bought"]) for r in rb.current(spark, root).collect())


def plain(rows):
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append(r)
    return sorted((k, len(x), x[-1][2], round(sum(r[3] for r in x if r[2] == "purchase"), 2)) for k, x in by.items() if not x[-1][4])


@pytest.fixture
def root(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def some(rng, n, start=0):
    kinds = ["view", "purchase", "error"]
    return [(rng.randrange(12), start + i, k := rng.choice(kinds), float(rng.randrange(9)), k == "error") for i in range(n)]


def test_batches_equal_a_rebuild_from_nothing(spark, root):
    rng = random.Random(1)
    rows = some(rng, 60)
    rng.shuffle(rows)  # so that changes come late
    for number in range(3):
        rb.rebuild(changes(spark, rows[20 * number : 20 * number + 20]), number, root, CHANGE, user_rows)
        assert state(spark, root) == plain(rows[: 20 * number + 20])


def test_a_batch_that_was_killed_and_comes_again_changes_nothing(spark, root):
    rng = random.Random(2)
    first, second = some(rng, 30), some(rng, 30, 30)
    rb.rebuild(changes(spark, first), 0, root, CHANGE, user_rows)
    before = state(spark, root)

    def dies(_):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        rb.rebuild(changes(spark, second), 1, root, CHANGE, dies)
    assert state(spark, root) == before == plain(first)  # half a batch is not seen
    for _ in range(2):
        rb.rebuild(changes(spark, second), 1, root, CHANGE, user_rows)
        assert state(spark, root) == plain(first + second)


def test_only_touched_keys_are_built(spark, root):
    rb.rebuild(changes(spark, [(1, 0, "view", 0.0, False), (2, 1, "view", 0.0, False)]), 0, root, CHANGE, user_rows)
    seen = []

    def build(live):
        seen.append(sorted({r["key"] for r in live.collect()}))
        return user_rows(live)

    rb.rebuild(changes(spark, [(2, 2, "error", 0.0, True), (3, 3, "view", 0.0, False)]), 1, root, CHANGE, build)
    assert seen == [[3]] and [r[0] for r in state(spark, root)] == [1, 3]
    rb.compact(spark, root, f"{root}-table")
    assert spark.read.parquet(f"{root}-table").count() == 2


def test_a_stream_goes_on_where_it_ended(spark, root, tmp_path):
    rng = random.Random(3)
    source, rows = f"{tmp_path}/in", []
    for turn in range(2):
        new = some(rng, 25, 25 * turn)
        rows += new
        changes(spark, new).coalesce(1).write.mode("append").parquet(source)
        rb.run(spark.readStream.schema(CHANGE).parquet(source), root, CHANGE, user_rows)
        assert state(spark, root) == plain(rows)


def test_freshness(spark, root):
    rows = some(random.Random(4), 10)
    every = changes(spark, rows)
    assert rb.freshness(every, spark, root, CHANGE, "ts").first()["state"] == "UNKNOWN"
    rb.rebuild(every.where("seq < 7"), 0, root, CHANGE, user_rows)
    got = rb.freshness(every, spark, root, CHANGE, "ts").first()
    assert (got["lag_rows"], got["lag_hours"], got["state"]) == (3, round(3 / 3600, 6), "STALE")
    rb.rebuild(every.where("seq >= 7"), 1, root, CHANGE, user_rows)
    assert rb.freshness(every, spark, root, CHANGE, "ts").first()["state"] == "CURRENT"


def test_thresholds_against_every_threshold(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(rng.randrange(20) / 20, rng.random() < 0.85) for _ in range(60)]
        df = spark.createDataFrame(rows, "s double, ok boolean")
        curve = {r["threshold"]: r["utility"] for r in fits.threshold_curve(df, "s", "ok").collect()}
        want = {t: sum(1 if ok else -4 for s, ok in rows if s >= t) for t, _ in rows}
        assert curve == want
        best = max((u, t) for t, u in want.items())
        assert fits.best_threshold(fits.threshold_curve(df, "s", "ok")).first()[0] == (best[1] if best[0] > 0 else None)


def test_no_threshold_where_answers_never_pay(spark):
    df = spark.createDataFrame([(0.9, False), (0.5, True)], "s double, ok boolean")
    chosen = fits.best_threshold(fits.threshold_curve(df, "s", "ok"))
    told = fits.held_out_utility(df, "s", "ok", chosen).first()
    assert told["threshold"] is None and (told["questions"], told["answered"], told["utility"]) == (2, 0, 0)


def test_one_arm_alone_at_either_end(spark):
    arm = lambda keys: spark.createDataFrame([(1, k, i) for i, k in enumerate(keys, 1)], "q long, k long, rank int")
    got = {}
    for r in fits.fusions(arm([5, 6, 7]), arm([7, 8]), "q", "k", 3).collect():
        got.setdefault(r["fusion"], {})[r["place"]] = r["k"]
    assert len(got) == 14 and got[13] == {1: 5, 2: 6, 3: 7} and got[0] == {1: 7, 2: 8} and got[7][1] == 7


def test_policies_are_chosen_on_one_half_only(spark):
    halves = {True: [], False: []}
    for q in range(200):
        halves[bool(spark.range(1).select(fits.is_dev(F.lit(q))).first()[0])].append(q)
        if min(map(len, halves.values())) >= 3:
            break
    rows = [("g", f, q, 1.0 if (f == 4) == dev else 0.0) for dev, own in halves.items() for q in own for f in (4, 13)]
    got = fits.group_policies(spark.createDataFrame(rows, "g string, fusion int, q long, gain double"), "g", "q", "gain").first()
    assert (got["fusion"], got["dev_gain"], got["held_gain"], got["fixed_gain"]) == (4, 1.0, 0.0, 1.0)

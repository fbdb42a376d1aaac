"""Kept-up aggregates and the stream of statuses: any split of the changes, repeated and failed runs give the result of one batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import upkeep as U
from quillgraph.streaming.lifecycle import Lifecycle, hashed, statuses

CHANGE = "key string, paper long, value long, conf long, yr int, sign int"


def held(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(rows):
    out = {}
    for key, paper, value, conf, yr, sign in rows:
        out.setdefault(key, []).append((sign, paper, value, conf, yr))
    live = {}
    for key, items in out.items():
        left = []
        for sign, *item in items:
            left.append(item) if sign > 0 else left.remove(item)
        if left:
            top = lambda i, f: f([x[i] for x in left if x[i] is not None], default=None)
            live[key] = (key, len(left), len({x[0] for x in left if x[0] is not None}), top(1, max), sum(x[2] for x in left), top(3, min), top(3, max))
    return sorted(live.values(), key=repr)


def changes(seed):
    r = random.Random(seed)
    rows, live = [], []
    for _ in range(200):
        if live and r.random() < 0.4:
            rows.append((*live.pop(r.randrange(len(live))), -1))
        else:
            item = (r.choice(["a", "b", "c", "hot", "hot", None]), r.choice([1, 2, 3, None]), r.choice([5, 7, 9, None]), r.choice([60, 80]), r.choice([1999, 2001]))
            live.append(item)
            rows.append((*item, 1))
    return rows


@pytest.mark.parametrize("cuts", [[200], [60, 61, 150, 200]])
def test_any_split_of_changes_gives_the_batch(spark, tmp_path, cuts):
    rows, kept, at = changes(4), U.KeptUp(spark, f"file://{tmp_path}/k", 4), 0
    for number, to in enumerate(cuts, 1):
        part = spark.createDataFrame(rows[at:to], CHANGE)
        for _ in range(2):  # a set that is applied again changes nothing
            kept.apply(part, F.col("sign"), number)
            assert held(kept.read()) == plain(rows[:to])
        at = to
    assert kept.counts.read().filter("n < 0").count() == 0


def test_last_row_gone_lower_numbers_and_retractions_of_nothing(spark, tmp_path):
    kept = U.KeptUp(spark, f"file://{tmp_path}/k", 4)
    frame = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    kept.apply(frame(("a", 1, 5, 60, 1999, 1), ("a", 2, 9, 60, 2000, 1)), F.col("sign"), 3)
    kept.apply(frame(("a", 2, 9, 60, 2000, -1)), F.col("sign"), 4)
    assert held(kept.read()) == [("a", 1, 1, 5, 60, 1999, 1999)]  # the smaller value comes back
    with pytest.raises(Exception, match="more rows retracted"):
        kept.apply(frame(("a", 2, 9, 60, 2000, -1)), F.col("sign"), 5)
    with pytest.raises(ValueError, match="comes after"):
        kept.apply(frame(("b", 2, 9, 60, 2000, 1)), F.col("sign"), 1)
    assert held(kept.read()) == [("a", 1, 1, 5, 60, 1999, 1999)]
    kept.apply(frame(("a", 1, 5, 60, 1999, -1)), F.col("sign"), 6)
    assert held(kept.read()) == []
    kept.apply(spark.createDataFrame([], CHANGE), F.col("sign"), 7)
    assert held(kept.read()) == []


EVENT = "paper long, ts timestamp, number long, status string"


def events():
    r, t = random.Random(2), datetime(2024, 1, 1)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), t + timedelta(seconds=r.randrange(50)), n, r.choice(["parsing", "parsed", "failed"])) for n in range(120)]
    return rows + [(4, None, 500, "uploaded"), (5, t, None, None), (5, t, 1, None)]


def test_replayed_shuffled_and_repeated_files_give_the_batch(spark, tmp_path):
    rows = events()
    want = held(statuses(hashed(spark.createDataFrame(rows, EVENT)).dropDuplicates(["paper", "hash"])))
    assert len(want) == 5
    for seed in (1, 2):
        folder, shuffled = f"file://{tmp_path}/{seed}", rows + rows[::3]
        random.Random(seed).shuffle(shuffled)
        life = Lifecycle(spark, f"{folder}/t", buckets=4)
        for part in (shuffled[:70], shuffled[70:]):
            spark.createDataFrame(part, EVENT).repartition(2).write.mode("append").parquet(f"{folder}/in")
            life.run(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        assert held(life.status.read()) == want
        life.apply(spark.createDataFrame(rows[:40], EVENT))  # a replay
        assert held(life.status.read()) == want


def test_a_run_that_failed_between_its_steps_is_made_good(spark, tmp_path, monkeypatch):
    life = Lifecycle(spark, f"file://{tmp_path}/t", buckets=4)
    rows = spark.createDataFrame(events(), EVENT)
    with monkeypatch.context() as m:
        m.setattr(life.status, "replace", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            life.apply(rows)
    life.apply(rows)
    assert held(life.status.read()) == held(statuses(hashed(rows).dropDuplicates(["paper", "hash"])))

"""Candidate queue: a plain loop over outcomes, ends of cycles, and the stream against the batch query."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import candidates as C
from quillspark.streaming import candidates as stream

START = datetime(2024, 1, 1)
REST = {"failed": timedelta(hours=1), "too_short": timedelta(days=7)}


def made_outcomes(n=400, seed=1):
    rng, rows, at = random.Random(seed), [], START
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 5, 40, 60, 300]))
        rows.append((f"c{rng.randrange(12)}", at, i, rng.choice(["failed", "failed", "too_short", "done", "rejected", "blocked"])))
    return rows


def replayed(rows):
    """States and comings-up by one loop over all outcomes."""
    state, up = {}, []
    for key, ts, _, outcome in sorted(rows, key=lambda r: (r[1], r[2])):
        if outcome == "blocked":
            continue
        attempts, due, last = state.get(key, (0, None, None))
        if due is not None and due <= ts:
            up.append((key, due, last, attempts))
        attempts += outcome != "rejected"
        state[key] = (attempts, ts + REST[outcome] if outcome in REST else None, outcome)
    return state, up + [(k, due, last, n) for k, (n, due, last) in state.items() if due is not None]


SCHEMA = "candidate string, ts timestamp, nth long, outcome string"


def test_states_and_comings_up(spark):
    rows = made_outcomes()
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([(f"c{i}",) for i in range(14)], "candidate string")
    state, up = replayed(rows)
    got = {r["candidate"]: (r["attempts"], r["retry_after"], r["status"]) for r in C.states(known, df, ["candidate"]).collect()}
    assert got == {f"c{i}": state.get(f"c{i}", (0, None, "pending")) for i in range(14)}
    found = C.come_up_again(df, ["candidate"]).collect()
    assert sorted((r["candidate"], r["due"], r["outcome"], r["attempts"]) for r in found) == sorted(up)
    assert C.come_up_again(df.limit(0), ["candidate"]).collect() == [] and C.states(known, df.limit(0), ["candidate"]).where("status <> 'pending'").count() == 0


def test_next_batch(spark):
    rows = [("s", 1, 2, START, "pending", None), ("s", 2, 1, START, "pending", None), ("s", 3, 0, START, "failed", START), ("s", 4, 0, START, "failed", START + timedelta(days=9)), ("s", 5, 0, START, "done", None), ("s", 6, 0, START, "too_short", START - timedelta(days=1)), ("t", 7, 0, START, "rejected", None)]
    df = spark.createDataFrame(rows, "source string, id long, priority int, created_at timestamp, status string, retry_after timestamp").withColumn("attempts", F.lit(1))
    take = lambda n: [r["id"] for r in C.next_batch(df, "source", F.lit(START), n).orderBy("nth").collect()]
    assert take(9) == [2, 1, 6, 3] and take(3) == [2, 1, 6]


@pytest.mark.parametrize(
    ("outcomes", "counts"),
    [
        (["failed"] * 10, [True] * 8 + [False] * 2), (["failed"] * 7 + ["done"] + ["failed"] * 9, [True] * 16 + [False]), (["done", "blocked", "done"], [True, False, False]),
        (["done"] * 12, [True] * 10 + [False] * 2), (["failed"] * 4 + ["rejected"] + ["failed"] * 4, [True] * 9), ([], []),
    ],
)
def test_cycle_end(spark, outcomes, counts):
    df = spark.createDataFrame([("a", i, o) for i, o in enumerate(outcomes)], "cycle string, nth long, outcome string")
    assert [r["counts"] for r in C.cycle_end(df, ["cycle"], "nth").orderBy("nth").collect()] == counts


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = made_outcomes(250, 5)
    end = rows[-1][1] + timedelta(days=30)
    parts = [rows[:80], rows[80:81], rows[81:200], rows[200:], [("z", end, 10**6, "rejected")], [("z", end, 10**6 + 1, "rejected")]]
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    try:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        for i, part in enumerate(parts):  # a run a file: each goes on from the state of the one before
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if i in (1, len(parts) - 2, len(parts) - 1):
                q = stream.come_up_again(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
                assert q.awaitTermination(150) and q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["candidate"], r["due"], r["outcome"], r["attempts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(replayed(rows)[1])

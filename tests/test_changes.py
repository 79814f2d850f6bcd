"""Changes between states, what they leave behind, batches applied once, chapters translated again."""

from datetime import datetime

from quillspark.operators import changes as C
from quillspark.streaming.counters import count_hits

D = datetime(2024, 1, 1)


def terms(spark, rows):
    return spark.createDataFrame(rows, "id long, novel long, right string")


def test_changes_and_versions(spark):
    before = terms(spark, [(1, 7, "a"), (2, 7, "b"), (3, 8, "c"), (4, None, "d"), (None, 8, "n")])
    after = terms(spark, [(1, 7, "a"), (2, 7, "B"), (4, None, "D"), (5, 9, "e"), (6, 7, None), (None, 8, "n")])
    changed = C.changes(before, after, ["id"])
    assert {(r["id"], r["kind"]) for r in changed.collect()} == {(2, "update"), (3, "delete"), (4, "update"), (5, "insert"), (6, "insert")}
    assert C.changes(after, after, ["id"]).collect() == []
    stored = spark.createDataFrame([(7, 4), (8, 1)], "novel long, version long")
    assert {tuple(r) for r in C.versions(stored, changed, "novel").collect()} == {(7, 6), (8, 1), (9, 1)}
    assert [tuple(r) for r in C.blacklist(changed, ["id", "novel", "right"]).collect()] == [(3, 8, "c")]


def test_collected(spark):
    have = lambda rows: spark.createDataFrame(rows, "u long, item long, qty int, at timestamp")
    later = datetime(2024, 2, 1)
    changed = C.changes(have([(1, 1, 2, D), (1, 2, 1, D)]), have([(1, 1, 0, later), (1, 3, 1, later), (2, 1, 0, later)]), ["u", "item"])
    stored = spark.createDataFrame([(1, 1, D), (1, 2, D)], "u long, item long, first_collected_at timestamp")
    assert {tuple(r) for r in C.collected(stored, changed, ["u", "item"], "qty", "at").collect()} == {(1, 1, D), (1, 2, D), (1, 3, later)}


def test_a_replayed_batch_leaves_counters_as_they_are(spark, tmp_path):
    schema, out = "novel long, terms array<string>", str(tmp_path / "hits")
    first, second = [(7, ["a", "b", "a"]), (7, ["a"]), (8, None)], [(7, ["a"]), (8, ["b", None])]
    for name, rows in (("1", first), ("2", second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        assert count_hits(stream, "novel", "terms", out, str(tmp_path / "state")).awaitTermination(60), name
    counts = lambda: {(r["novel"], r["term"]): r["n"] for r in C.counters(spark, out, ["novel", "term"], "novel long, term string, n long").collect()}
    assert counts() == {(7, "a"): 3, (7, "b"): 1, (8, "b"): 1}
    C.record(C.hits(spark.createDataFrame(second, schema), "novel", "terms"), 1, out)
    assert counts() == {(7, "a"): 3, (7, "b"): 1, (8, "b"): 1}


def test_retranslated(spark):
    chapters = spark.createDataFrame([(10, 1, 1, "x"), (11, 1, 2, None), (12, 2, 1, None), (13, 2, 2, "y")], "id long, novel_id long, chapter_index int, content string")
    jobs = spark.createDataFrame([(13, "running"), (13, "done"), (10, "failed")], "chapter_id long, status string")
    novels = spark.createDataFrame([(1, True), (2, False)], "id long, enabled boolean")
    wanted = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (2, 2), (2, 9), (3, 1)], "novel_id long, chapter_index int")
    got = {(r["novel_id"], r["chapter_index"]): (r["action"], r["priority"]) for r in C.retranslated(chapters, jobs, novels, wanted).collect()}
    assert got == {(1, 1): ("queue", 30), (1, 2): ("queue", 30), (2, 1): ("no_source", None), (2, 2): ("running", None), (2, 9): ("unknown", None), (3, 1): ("unknown", None)}

"""The work queue against a plain loop, over restarts and time-outs; versions of a cache."""

import datetime as dt
from collections import defaultdict

from assetlens.plans import queues
from assetlens.streaming import queue

SCHEMA = "key string, ts timestamp, kind string, value string"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def run(spark, folder, patience=600):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    actions = queue.work_queue(stream, most=2, patience=patience)
    actions.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.key, r.attempt, r.action, r.at, r.value) for r in spark.read.schema(queue.ACTIONS).parquet(f"{folder}/out").collect())


def put(spark, folder, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_restarts_and_retries(spark, tmp_path):
    put(spark, tmp_path, ("a", at(0), "new", None), ("b", at(0), "new", None), ("a", at(1), "new", None), (None, at(1), "new", None), ("z", at(1), "ok", "early"))
    first = run(spark, tmp_path)
    assert first == [("a", 1, "call", at(0), None), ("b", 1, "call", at(0), None)]
    put(spark, tmp_path, ("a", at(2), "ok", "A"), ("b", at(2), "error", None), ("a", at(3), "error", None), ("a", at(3), "new", None))
    second = run(spark, tmp_path)
    assert second == sorted([*first, ("a", 1, "store", at(2), "A"), ("b", 2, "call", at(2), None)], key=lambda r: r[:3])
    put(spark, tmp_path, ("b", at(4), "error", None), ("b", at(5), "new", None))
    third = run(spark, tmp_path)
    assert [r for r in third if r not in second] == [("b", 2, "give up", at(4), None)]
    put(spark, tmp_path, ("b", at(6), "ok", "B"))
    assert [r for r in run(spark, tmp_path) if r not in third] == [("b", 2, "store", at(6), "B")]


def test_a_call_without_an_answer_is_made_again(spark, tmp_path):
    put(spark, tmp_path, ("a", at(0), "new", None))
    run(spark, tmp_path)
    for minute in (60, 120, 180):
        put(spark, tmp_path, ("other", at(minute), "new", None))
        found = run(spark, tmp_path)
    own = [(n, action) for key, n, action, _, _ in found if key == "a"]
    assert own == [(1, "call"), (2, "call"), (2, "give up")]


def test_query_is_a_plain_loop(spark, sf):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        rows[f"{r.user_id}/{r.event_id % 7}"].append((int(r.ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), queues.KINDS.get(r.event_type, "new"), str(r.event_id)))
    want = sorted((k, n, action, v) for k, xs in rows.items() for n, action, _, v in queue.turns(xs, None, 0, 0, 3)[0])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.key, r.attempt, r.action, r.value) for r in queues.t1_work_queue(spark, sf).collect()), key=key) == sorted(want, key=key)


def test_versions_fall_back(spark):
    cache = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 5, "v"), (None, 1, "n")], "key string, version int, value string")
    requests = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 9), ("b", 5), ("c", 1)], "key string, version int")
    got = {(r.key, r.version): (r.found, r.value) for r in queue.cached(cache, requests).collect()}
    assert got == {("a", 0): (None, None), ("a", 1): (1, "x"), ("a", 2): (1, "x"), ("a", 9): (3, "z"), ("b", 5): (5, "v"), ("c", 1): (None, None)}

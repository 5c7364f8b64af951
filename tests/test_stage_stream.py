import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from graphloom.streaming import events as E

SCHEMA = "user_id int, id int, ts timestamp, stage int"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def put(spark, place, rows):
    spark.createDataFrame([(u, i, at(m), s) for u, i, m, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(place)


def test_batches_late_rows_a_restart_and_forgotten_keys(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        with E.state_store(spark):
            E.append_log(E.stage_stream(stream, "user_id", "stage", ["ts", "id"], watermark="5 minutes", ttl_ms=60 * 60_000), out, str(tmp_path / "ck"), "parquet").awaitTermination(120)
        return {r["id"]: r["accepted"] for r in spark.read.parquet(out).collect()}

    put(spark, src, [(1, 1, 0, 1), (1, 3, 2, 2), (1, 2, 1, 3), (2, 4, 0, 5)])
    assert run() == {1: True, 2: True, 3: False, 4: True}
    put(spark, src, [(1, 5, 20, 2), (2, 6, 21, 6)])
    put(spark, src, [(2, 12, 21, 7)])  # the watermark for late rows follows a batch behind
    put(spark, src, [(1, 7, 3, 9), (1, 8, 22, 3)])  # the first is behind it
    want = {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 12: True, 8: True}
    assert run() == want
    assert run() == want and spark.read.parquet(out).count() == len(want)  # nothing comes twice
    put(spark, src, [(3, 9, 200, 1)])  # an hour and more after all others
    put(spark, src, [(1, 10, 201, 1), (3, 11, 202, 0)])
    assert run() == want | {9: True, 10: True, 11: False}
    assert spark.conf.get(E.PROVIDER) != E.ROCKS


def test_replayed_table_equals_its_batch_form(spark):
    rows = [(i % 3, i, at((i * 37) % 500), (i * 7) % 5) for i in range(120)]
    e = spark.createDataFrame(rows, SCHEMA)
    got = E.replayed(e, lambda x: E.stage_stream(x, "user_id", "stage", ["ts", "id"], ttl_ms=10**12), 5)
    want = E.stage_transitions(e, "user_id", "stage", ["ts", "id"])
    assert sorted((r["id"], r["accepted"]) for r in got.collect()) == sorted((r["id"], r["accepted"]) for r in want.collect())
    s = E.replayed(e.select("user_id", "ts"), lambda x: E.sessions(x, "15 minutes", watermark="1 minute"), 3, "30 days")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, E.sessions(e, "15 minutes").collect()))
    none = E.replayed(e.where("false"), lambda x: E.stage_stream(x.select(F.col("user_id"), "id", "ts", "stage"), "user_id", "stage"), 2)
    assert none.count() == 0


def test_a_batch_is_many_files_and_a_key_few_state_calls(spark, tmp_path, monkeypatch):
    place, calls = str(tmp_path / "place"), []
    monkeypatch.setattr(E, "new_path", lambda spark: place)
    e = spark.createDataFrame([(i % 3, i, at(i), 0) for i in range(120)], SCHEMA).repartition(4)
    assert E.replayed(e, lambda x: E.stage_stream(x, "user_id", "stage", ["ts", "id"], ttl_ms=10**12), 2).count() == 120
    assert len(list((tmp_path / "place" / "in").glob("*.parquet"))) > 4  # one task once wrote and read a whole batch

    class Held:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def update(self, value):
            calls.append("update")
            self.value = value

        def getValueState(self, *_):
            return Held()

        def registerTimer(self, at):
            calls.append("register")

        def deleteTimer(self, at):
            calls.append("delete")

    s = E.Stages("stage", ["ts", "id"], ["user_id", "ts", "id", "stage"], 10)
    s.init(Held())
    row = Row("user_id", "ts", "id", "stage")
    first = [r["accepted"] for r in s.handleInputRows((1,), iter([row(1, at(0), 1, 5)]), None)]
    calls.clear()
    assert first == [True] and [r["accepted"] for r in s.handleInputRows((1,), iter([row(1, at(0), 2, 4), row(1, at(1), 3, 4)]), None)] == [False, True]
    assert calls == ["get", "update"]

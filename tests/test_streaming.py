"""Streaming forms against their batch forms."""

from itemflow.streaming import running
from pyspark.sql import functions as F


def test_totals_and_windows(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    got = {r.user_id: (r.n, round(r.total, 6)) for r in running.totals(spark, f"{data}/events.parquet", ["user_id"], {"n": "count(1)", "total": "sum(value)"}).collect()}
    want = {r.user_id: (r.n, round(r.total, 6)) for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert got == want
    assert running.windowed(spark, f"{data}/events.parquet", "ts", "1 day", []).agg(F.sum("n")).first()[0] == events.count()


def test_iterate_with_state(spark, data):
    stream = running.source(spark, f"{data}/events.parquet").select("user_id", "event_id", "ts", "value")

    def step(row, state):
        state = {"n": state["n"] + 1, "s": state["s"] + row["value"]}
        return state, {"user_id": row["user_id"], "event_id": row["event_id"], "n": state["n"], "s": state["s"]}

    out = running.drained(running.iterate(stream, ["user_id"], {"n": 0, "s": 0.0}, step, "user_id long, event_id long, n long, s double", "n long, s double", "ts"), "append")
    last = out.groupBy("user_id").agg(F.max("n").alias("n"))
    want = spark.read.parquet(f"{data}/events.parquet").groupBy("user_id").count()
    assert {(r.user_id, r.n) for r in last.collect()} == {(r.user_id, r["count"]) for r in want.collect()}


def test_sessions(spark, data):
    stream = running.source(spark, f"{data}/events.parquet")
    assert running.sessions(stream, "ts", "30 minutes", ["user_id"]).isStreaming

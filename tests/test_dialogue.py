"""The dialogue stream: steps against a plain loop, state over batches, idle sessions that are forgotten."""

import time

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.operators import chat
from docflow.streaming import jobs


def looped(rows, state):
    pending, intent, name, patient = state
    out = []
    for turn, i, n, yes in rows:
        if not pending:
            pending, intent, name = True, i, n
            out.append((turn, "ask", intent, name, False))
            continue
        pending = False
        switched = bool(yes) and name is not None and intent != chat.UNKNOWN and name != patient
        if switched:
            patient = name
        out.append((turn, "execute" if yes else "reset", intent, name, switched))
    return out, (pending, intent, name, patient)


names = st.sampled_from([None, "A", "B"])
intents = st.sampled_from([chat.UNKNOWN, "plan", "x"])
states = st.tuples(st.booleans(), intents, names, names)


@given(st.lists(st.tuples(intents, names, st.booleans()), min_size=1, max_size=14), states, st.integers(1, 13))
@settings(max_examples=300, deadline=None)
def test_steps_equal_a_loop(rows, state, cut):
    rows = [(t, *r) for t, r in enumerate(rows)]
    want, after = looped(rows, state)
    got, now = [], state
    for part in (rows[:cut], rows[cut:]):  # the state carries over
        if part:
            out, now = jobs._steps(pd.DataFrame(part, columns=["turn", "intent", "name", "is_yes"]), now)
            got += list(out[["turn", "action", "intent", "patient", "switched"]].itertuples(index=False, name=None))
    clean = [tuple(None if x is None or x != x else x for x in r) for r in got]
    assert clean == want and now == after


def test_idle_sessions_leave_the_state(spark, tmp_path):
    schema = "session bigint, turn bigint, text string, intent string, name string"
    path = str(tmp_path / "in")

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def held(query):
        progress = query.lastProgress
        return progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else None

    def until(check):
        end = time.time() + 60
        while not check():
            assert query.exception() is None and time.time() < end
            time.sleep(0.2)

    deliver([(1, 1, "plan", "plan", "A"), (2, 1, "plan", "plan", "B")])
    stream = jobs.dialogue_stream(spark.readStream.schema(schema).parquet(path), idle_seconds=4)
    query = (
        stream.writeStream.format("memory").queryName("dialogue_rows").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(processingTime="500 milliseconds").start()
    )
    try:
        until(lambda: held(query) == 2)
        until(lambda: held(query) == 0)
        deliver([(1, 2, "oui", "plan", "C")])
        until(lambda: spark.table("dialogue_rows").count() == 3)
    finally:
        query.stop()
    rows = {(r.session, r.turn): r.action for r in spark.table("dialogue_rows").collect()}
    assert rows == {(1, 1): "ask", (2, 1): "ask", (1, 2): "ask"}  # the first request was forgotten

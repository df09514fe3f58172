"""Keys that hold most rows: bursts of one busy key, names that all begin alike."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from docflow.operators import changes, records


def plain_bursts(times, gap):
    out = []
    for t in sorted(times):
        if out and (t - out[-1][1]).total_seconds() < gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return {tuple(x) for x in out}


@pytest.mark.parametrize("stretch", [1024, 2, 1])
def test_bursts_of_a_busy_key(spark, monkeypatch, stretch):
    """Most events have one key; short stretches put borders inside bursts and leave stretches empty."""
    monkeypatch.setattr(changes, "STRETCH", stretch)
    rng, base = random.Random(stretch), datetime(2026, 1, 1)
    rows = [("busy", base + timedelta(seconds=rng.choice([rng.randint(0, 900), rng.randint(0, 60_000)]))) for _ in range(900)]
    rows += [("calm", base + timedelta(seconds=60 * k)) for k in range(40)] + [("once", base), ("once", base)]
    got = changes.debounce_events(spark.createDataFrame(rows, "k string, t timestamp"), "k", "t", 60)
    found = got.select("k", F.unix_micros("burst_start"), F.unix_micros("burst_end"), "n_events").collect()
    micros = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() * 1e6)
    local = int(spark.createDataFrame([(base,)], "t timestamp").select(F.unix_micros("t")).first()[0]) - micros(base)
    want = {(k, micros(s) + local, micros(e) + local, n) for k in ("busy", "calm", "once") for s, e, n in plain_bursts([t for x, t in rows if x == k], 60)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert sum(1 for r in found if r.k == "calm") == 40 and max(r.n_events for r in found) > 100


def test_busy_key_is_cut_into_many_groups(spark, monkeypatch):
    monkeypatch.setattr(changes, "STRETCH", 4)
    rows = spark.range(4000).select(F.lit("busy").alias("k"), F.timestamp_seconds(F.col("id") * 61).alias("t"))
    plan = changes.debounce_events(rows, "k", "t", 60)
    assert plan.count() == 4000
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("Window [") >= 4 and "_b" in shown


def test_names_with_one_beginning(spark):
    """All names and all files start alike; each name probes with its rarest substring."""
    rng = random.Random(2)
    stems = [f"dupont_{''.join(rng.choice('abcdefgh') for _ in range(5))}_{k}" for k in range(300)]
    files = [f"/data/{s}.json" for s in stems] + ["/data/.hidden", "x", ""]
    names = [s[:12].upper() for s in rng.sample(stems, 40)] + ["dupont", "du", "d", "zz", "", "ont_a", "p" * 30, "hidden"]
    got = records.find_records(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(f,) for f in files], "file string")
    )
    all_stems = {f: (lambda b: b.rsplit(".", 1)[0] if "." in b[1:] else b)(f.rsplit("/", 1)[-1]).lower() for f in files}
    for r in got.collect():
        hits = sorted(f for f, s in all_stems.items() if r.name and r.name.lower() in s)
        assert (r.file, r.n_matches) == (hits[0] if hits else None, len(hits)), r
    assert got.count() == len(set(names))

"""Repair of event logs against a search that writes every candidate out."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pavelens.llm import logs
from pavelens.llm.logs import LogForm, Prefixes, audit_event_logs, log_digests, repair_event_logs, repaired_events

FORM = LogForm()
SCHEMA = "source string, event_time long, type string, message string, piece2 int, _kind string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
TURNS = ((0, 2, "update"), (1, 2, "update"), (3, 2, "update"), (2, 3, "complete"))


def plainly(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows) of (order, type, message) rows in order."""
    seen, faults = set(), []
    for _, kind, text in rows:
        found = VISIBLE.findall(text)
        faults.append("b" if not found else "d" if (kind, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((kind, text))

    def put(at, state, new):
        if state not in at or new[:2] < at[state][:2]:
            at[state] = new

    def inserted(at):
        at = dict(at)
        for _ in range(3):
            for a, b, role in TURNS:
                if a in at:
                    put(at, b, (at[a][0] + 5, at[a][1] + "I", [*at[a][2], (role, "")]))
        return at

    best = {0: (0, "", [])}
    for (_, kind, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, out) in inserted(best).items():
            put(new, state, (cost + 2, audit + "D", out))
            if fault in ("b", "d"):
                continue
            cost += 5 if fault == "t" else 0
            if state == 0 and kind[0] == "h":
                put(new, 1, (cost, audit + "K", [*out, (kind, text)]))
            for a, b, role in TURNS:
                if a == state:
                    put(new, b, (cost, audit + "K", [*out, (kind, text)]) if kind[0] == role[0] else (cost + 1, audit + "R", [*out, (role, text)]))
        best = new
    best = inserted(best)
    cost, audit, out = min(best[s] for s in (0, 3) if s in best)
    at = [t for t, _, _ in rows if t is not None]
    pairs = [a[0] + b[0] for (_, a, _), (_, b, _) in zip(rows, rows[1:])]
    return (max(at) - min(at) + 1 - len(set(at)) if at else 0, *(faults.count(f) for f in "bdt"), sum(p not in ("hu", "uc", "cu") for p in pairs), cost, audit, out)


def some_logs(n=60, seed=3):
    r, out = random.Random(seed), {}
    for k in range(n):
        size = r.choice([0, 1, 2, 3, 5, 8, 13, 40])
        rows = [(r.choice([None, *range(size + 2)]), r.choice(["health_report", "update", "update", "complete", "complete", "item_error"]), r.choice(["a.", "b!", "c", "", " \t", "d?", f"{r.random()}."])) for _ in range(size)]
        out[None if k == 7 else f"s{k}"] = rows
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_repair_equals_a_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(logs, "BLOCK_ROWS", block)
    given = some_logs()
    given["long"] = [(i % 900, ["update", "complete", "update"][i % 3], f"m{i % 700}.") for i in range(3000)]
    events = spark.createDataFrame([(s, t, k, m, 1, "x") for s, rows in given.items() for t, k, m in rows], SCHEMA)
    sources = spark.createDataFrame([(s,) for s in given], "source string")
    pieces = repair_event_logs(events)
    audits = {r["source"]: r for r in audit_event_logs(pieces, of=sources).collect()}
    digests = {r["source"]: r["digest"] for r in log_digests(pieces).collect()}
    rows: dict = {}
    for r in repaired_events(pieces).orderBy("piece", "place").collect():
        rows.setdefault(r["source"], []).append((r["type"], r["message"]))
    assert audits.keys() == given.keys()
    for s, log in given.items():
        log = sorted(log, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        want = plainly(log)
        r = audits[s]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == want[:-1], s
        assert rows.get(s, []) == want[-1]
        assert digests.get(s, hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(f"{k}:{m}" for k, m in want[-1]).encode()).hexdigest()


def test_null_fields_times_and_empty_tables(spark):
    events = spark.createDataFrame([("a", None, None, None, 1, "x"), ("a", 3, "", "m.", 1, "x"), ("b", None, "update", "m.", 1, "x")], SCHEMA)
    got = {r["source"]: r for r in audit_event_logs(repair_event_logs(events)).collect()}
    assert (got["a"]["gaps"], got["a"]["blank"], got["a"]["illegal"], got["a"]["audit"], got["a"]["cost"]) == (0, 1, 1, "DD", 4)
    assert (got["b"]["gaps"], got["b"]["audit"], got["b"]["cost"]) == (0, "D", 2)
    live = events.withColumn("event_time", F.timestamp_seconds(F.col("event_time")))
    assert audit_event_logs(repair_event_logs(live)).count() == 2
    none = repair_event_logs(events.where("false"))
    assert audit_event_logs(none).count() == 0 and log_digests(none).count() == 0
    assert audit_event_logs(none, of=events).collect()[0]["audit"] == ""
    with pytest.raises(ValueError):
        repair_event_logs(events.withColumnRenamed("source", "audit"), source="audit")
    with pytest.raises(ValueError):
        LogForm(first="x", second="xy")


@pytest.mark.parametrize("mod", [(1 << 61) - 1, 3])
def test_prefixes_compare_as_their_texts_even_when_hashes_collide(mod):
    r, nodes = random.Random(1), Prefixes(mod=mod)
    known = [(0, "")]
    for _ in range(400):
        at, text = r.choice(known[-40:])
        e = r.choice("DIKR")
        known.append((nodes.add(at, e), text + e))
    for _ in range(4000):
        (a, s), (b, t) = r.choice(known), r.choice(known)
        got = nodes.compare(a, b)
        assert ((got > 0) - (got < 0)) == ((s > t) - (s < t))
        assert nodes.text(a) == s

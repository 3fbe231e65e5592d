"""Operators on random sessions against plain sequential models."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import derive
from logweave.operators import entries as ops
from logweave.sources.jsonl import canonical

SESSIONS = 150


@pytest.fixture(scope="module")
def logs():
    """{session: [entry, ...]} of random entries."""
    rng = random.Random(1)
    ids = ["i1", "i2", "i3"]

    def assistant():
        blocks = []
        for _ in range(rng.randint(0, 3)):
            blocks.append(
                rng.choice([
                    {"type": "thinking", "thinking": rng.choice(["", "hm"])},
                    {"type": "text", "text": rng.choice(["", "  \n", "done", " "])},
                    {"type": "tool_use", "id": rng.choice(ids), "name": rng.choice(["Bash", "Agent", "ExitPlanMode"]), "input": {}},
                    {"type": "tool_use", "id": rng.choice(ids), "name": "SendMessage", "input": {"type": "shutdown_response", "approve": rng.choice([True, False, "true"])}},
                ])
            )
        usage = {k: rng.choice([0, 0, 5, 70, 300]) for k in rng.sample(["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"], rng.randint(0, 4))}
        e = {"type": "assistant", "message": {"role": "assistant", "model": rng.choice(["m", "<synthetic>"]) if rng.random() < 0.3 else "m", "content": blocks, "usage": usage}}
        if rng.random() < 0.5:
            e["requestId"] = rng.choice(["", "r1", "r2", "r3", 7, "7"])
        if rng.random() < 0.2:
            e["isSidechain"] = rng.choice([True, False])
        return e

    def user():
        content = rng.choice([
            "hello", "  spaced 　", "", "<system-reminder>x", "<command-name>/model</command-name> rest", "[Request interrupted", "z" * 700,
            [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}],
            [{"type": "tool_result", "tool_use_id": rng.choice(ids), "is_error": rng.choice([True, False])}],
            [{"type": "text", "text": "[Request interrupted by user]"}],
        ])
        e = {"type": "user", "message": {"role": "user", "content": content}}
        if rng.random() < 0.2:
            e["isCompactSummary"] = True
        if rng.random() < 0.1:
            e["toolUseResult"] = rng.choice(["User rejected tool use", {"stdout": ""}])
        return e

    def attachment():
        names = lambda: rng.sample("abcdef", rng.randint(0, 3))
        return {"type": "attachment", "attachment": rng.choice([{"type": "deferred_tools_delta", "addedNames": names(), "removedNames": names()}, {"type": "skill_listing", "content": rng.choice(["- a: b\n- p:q: r\n-x: y\n- none", "", "intro\n-  b : c\n- : d"])}])}

    def other():
        return rng.choice([{"type": "system"}, {"type": "permission-mode", "permissionMode": rng.choice(["", "plan"])}, {"type": "new-kind", "x": 1}])

    out = {}
    for k in range(SESSIONS):
        entries = []
        for n in range(rng.randint(1, 14)):
            e = rng.choice([assistant, assistant, user, user, attachment, other])()
            for key, values in (("sessionId", ["", "s1", "s2", 5]), ("version", ["", "1"]), ("cwd", ["", "/a"]), ("gitBranch", ["main"]), ("timestamp", ["", "2026-01-01T00:00:%02d.000Z" % n, "no"])):
                if rng.random() < 0.5:
                    e[key] = rng.choice(values)
            entries.append(e)
        out[f"s{k:03}"] = entries
    return out


@pytest.fixture(scope="module")
def entries(spark, logs):
    from logweave.sources.jsonl import configure

    configure(spark)
    rows = [(s, 0, n, n + 1, json.dumps(e)) for s, es in logs.items() for n, e in enumerate(es)]
    df = spark.createDataFrame(rows, "session_key string, file_size long, line_no long, nonblank_no long, line string").repartition(5)
    return canonical(df.select("session_key", "file_size", "line_no", "nonblank_no", F.parse_json("line").alias("raw"))).persist()


def keep_last(es):
    last = {}
    for n, e in enumerate(es):
        if e.get("requestId"):
            last[json.dumps(e["requestId"])] = n
    return [(n, e) for n, e in enumerate(es) if not e.get("requestId") or last[json.dumps(e["requestId"])] == n]


def by_session(df):
    return {r["session_key"]: r for r in df.collect()}


def test_deduplicate(entries, logs):
    got = {}
    for r in ops.deduplicate(entries).select("session_key", "line_no").collect():
        got.setdefault(r["session_key"], []).append(r["line_no"])
    assert {s: sorted(v) for s, v in got.items()} == {s: [n for n, _ in keep_last(es)] for s, es in logs.items()}


def test_metrics(entries, logs):
    got = by_session(derive.metrics(entries))
    for s, es in logs.items():
        total = dict.fromkeys(["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"], 0)
        for e in es:
            if e["type"] == "assistant":
                for k in total:
                    total[k] += e["message"]["usage"].get(k, 0)
        times = [int(e["timestamp"][17:19]) * 1000 for e in es if e.get("timestamp", "").startswith("2026")]
        r = got[s]
        assert [r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["cache_creation_tokens"]] == list(total.values())
        assert r["total_tokens"] == sum(total.values()) and r["message_count"] == len(es)
        assert r["duration_ms"] == (max(times) - min(times) if times else 0)


def phases_by_model(es):
    last, phases, waiting = 0, [], False
    for e in es:
        if e["type"] == "assistant" and not e.get("isSidechain") and e["message"]["model"] != "<synthetic>":
            u = e["message"]["usage"]
            n = u.get("input_tokens", 0) + u.get("cache_read_input_tokens", 0) + u.get("cache_creation_input_tokens", 0)
            if n > 0:
                if waiting:
                    phases[-1][1], waiting = n, False
                last = n
        if e["type"] == "user" and e.get("isCompactSummary"):
            phases.append([last, 0])
            waiting = True
    if not last:
        return len(phases), []
    out = [(k + 1, pre - (phases[k - 1][1] if k else 0), pre, post) for k, (pre, post) in enumerate(phases)]
    if not phases:
        out.append((1, last, last, None))
    elif phases[-1][1] > 0:
        out.append((len(phases) + 1, last - phases[-1][1], last, None))
    return len(phases), out


def test_compaction(entries, logs):
    got = {}
    for r in derive.compaction_phases(entries).collect():
        got.setdefault(r["session_key"], []).append((r["phase_number"], r["contribution"], r["peak_tokens"], r["post_compaction"]))
    sums = by_session(derive.compaction(entries))
    for s, es in logs.items():
        count, phases = phases_by_model(es)
        assert sorted(got.get(s, [])) == phases, s
        assert sums[s]["compaction_count"] == count
        assert sums[s]["context_consumption"] == (sum(p[1] for p in phases) if phases else None)


def ongoing_by_model(es):
    events, shut = [], set()
    for e in es:
        content = e.get("message", {}).get("content")
        if not isinstance(content, list):
            continue
        for b in content:
            if e["type"] == "assistant":
                if b["type"] == "thinking" and b["thinking"]:
                    events.append(True)
                elif b["type"] == "tool_use":
                    stops = b["name"] == "SendMessage" and b["input"].get("approve") is True
                    if stops:
                        shut.add(b["id"])
                    events.append(not (stops or b["name"] == "ExitPlanMode"))
                elif b["type"] == "text" and b["text"].strip():
                    events.append(False)
            elif b["type"] == "tool_result":
                events.append(not (b["tool_use_id"] in shut or e.get("toolUseResult") == "User rejected tool use"))
            elif b["type"] == "text" and b["text"].startswith("[Request interrupted"):
                events.append(False)
    return bool(events) and events[-1]


def test_ongoing(entries, logs):
    got = by_session(derive.ongoing(derive.activity_events(entries), entries.select("session_key")))
    assert {s: r["is_ongoing"] for s, r in got.items()} == {s: ongoing_by_model(es) for s, es in logs.items()}


def first_by_model(es, key, where=lambda e: True):
    found = [e[key] for e in es if where(e) and isinstance(e.get(key), str)]
    return next((x for x in found if x), "" if found else None)


def test_first_observed(entries, logs):
    got = by_session(derive.first_observed(entries))
    for s, es in logs.items():
        r = got[s]
        assert [r["session_id"], r["version"], r["git_branch"], r["cwd"]] == [first_by_model(es, k) for k in ("sessionId", "version", "gitBranch", "cwd")]
        assert r["permission_mode"] == first_by_model(es, "permissionMode", lambda e: e["type"] == "permission-mode")


def message_by_model(es):
    fallback = None
    for e in es:
        if e["type"] != "user":
            continue
        c = e["message"]["content"]
        text = (c if isinstance(c, str) else " ".join(b["text"] for b in c if b["type"] == "text")).strip()
        if not text or text.startswith(("<system-reminder>", "[Request interrupted")):
            continue
        if "<command-name>/" in text:
            fallback = fallback or "/model"
            continue
        return text[:500]
    return fallback


def test_first_user_message(entries, logs):
    got = by_session(derive.first_user_message(entries.withColumn("text", derive.user_text(entries))))
    assert {s: r["text"] for s, r in got.items()} == {s: m for s, es in logs.items() if (m := message_by_model(es)) is not None}


def test_skills(entries, logs):
    names = {"- a: b\n- p:q: r\n-x: y\n- none": ["a", "p:q"], "": [], "intro\n-  b : c\n- : d": ["b"]}
    first = {s: next((e["attachment"]["content"] for e in es if e["type"] == "attachment" and e["attachment"]["type"] == "skill_listing"), None) for s, es in logs.items()}
    got = by_session(derive.skills(derive.skill_listings(entries)))
    assert {s: r["names"] for s, r in got.items()} == {s: names[c] for s, c in first.items() if c is not None}


def test_deferred_tools(entries, logs):
    want = {}
    for s, es in logs.items():
        have = {}
        for e in es:
            if e["type"] == "attachment" and e["attachment"]["type"] == "deferred_tools_delta":
                for n in e["attachment"]["addedNames"]:
                    have.setdefault(n)
                for n in e["attachment"]["removedNames"]:
                    have.pop(n, None)
        if have:
            want[s] = list(have)
    got = by_session(derive.deferred_tools(derive.deferred_deltas(entries)))
    assert {s: r["names"] for s, r in got.items()} == want


def test_tool_calls_and_results(entries, logs):
    rows = ops.blocks(entries)
    calls, results = ops.tool_calls(rows), ops.tool_results(rows)
    want_calls = sorted((s, n, k, b["id"], b["name"], b["name"] == "Agent") for s, es in logs.items() for n, e in enumerate(es) if e["type"] == "assistant" for k, b in enumerate(e["message"]["content"]) if b["type"] == "tool_use")
    assert sorted((r["session_key"], r["line_no"], r["block_no"], r["tool_id"], r["name"], r["is_task"]) for r in calls.collect()) == want_calls
    want = sorted((s, n, b["tool_use_id"], bool(b["is_error"])) for s, es in logs.items() for n, e in enumerate(es) if e["type"] == "user" and isinstance(e["message"]["content"], list) for b in e["message"]["content"] if b["type"] == "tool_result")
    assert sorted((r["session_key"], r["line_no"], r["tool_use_id"], r["is_error"]) for r in results.collect()) == want
    have = {(s, i) for s, _, _, i, _, _ in want_calls}
    assert ops.orphan_results(results, calls).count() == sum((s, i) not in have for s, _, i, _ in want)
    first = ops.find_first(calls, "tool_id", "i2").collect()[0]
    assert (first["session_key"], first["line_no"]) == next(c[:2] for c in want_calls if c[3] == "i2")


def test_guards(entries, logs):
    every = [e for es in logs.values() for e in es]
    for name in [*ops.ENTRY_TYPES, "new-kind"]:
        assert ops.of_type(entries, name).count() == sum(e["type"] == name for e in every)
    assert ops.main_chain(entries).count() == sum(e["type"] == "assistant" and not e.get("isSidechain") and e["message"]["model"] == "m" for e in every)

"""Readers on small folders of logs and of the stores beside them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from logweave.functions.scalars import epoch_ms, kind_of, strict_json, trim_all, truthy
from logweave.operators import audit
from logweave.operators import entries as ops
from logweave.plans.session import SessionLogs
from logweave.sources import discovery, file_history, jsonl, persisted, tasks


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, **more}


def assistant(n_in, n_out, content=(), **more):
    return {"type": "assistant", "message": {"role": "assistant", "model": "m", "content": list(content), "usage": {"input_tokens": n_in, "output_tokens": n_out}}, **more}


def test_lines_are_numbered_and_bad_ones_left_out(spark, tmp_path):
    path = write(tmp_path / "s.jsonl", "", "not-json", user("a"), "  ", '{"type":"user"} trailing', [1, 2], {"no": "type"}, {"type": 5}, user("b"))
    lines = jsonl.read_lines(jsonl.configure(spark), path).orderBy("line_no").collect()
    assert [r["line_no"] for r in lines] == list(range(9)) and [r["nonblank_no"] for r in lines] == [0, 1, 2, 2, 3, 4, 5, 6, 7]
    rows = jsonl.read_entries(spark, path)
    assert sorted(r["line_no"] for r in rows.select("line_no").collect()) == [2, 8]
    assert jsonl.head(rows, 2).count() == 1 and jsonl.head(rows, 0).count() == 0 and jsonl.head(rows, 7).count() == 2


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "long.jsonl", *({"type": "user", "n": k, "pad": "x" * 200} for k in range(6000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = jsonl.read_entries(spark, path).select("line_no", F.expr("variant_get(raw, '$.n', 'long')").alias("n"))
        assert rows.where("line_no = n").count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text, good", [('{"a":1}', True), ('{"a":1} x', False), ('{"a":1},{"b":2}', False), ('{"a":1}] {x}', False), ("[1]", True), ("'a'", False), ("01", False), ("", False), ('{"a":1,"a":2}', True), ("null", True), ("NaN", False)])
def test_strict_json(spark, text, good):
    jsonl.configure(spark)
    row = spark.createDataFrame([(text,)], "t string").select(strict_json(F.col("t")).isNotNull()).first()
    assert row[0] is good


def test_scalars(spark):
    df = spark.createDataFrame([("﻿  x y \n",)], "t string")
    assert df.select(trim_all(F.col("t"))).first()[0] == "x y"
    stamps = ["2026-01-01T00:00:01.500Z", "2026-01-01T02:00:01.500+02:00", "t", ""]
    got = spark.createDataFrame([(s,) for s in stamps], "t string").select(epoch_ms(F.col("t"))).collect()
    assert [r[0] for r in got] == [1767225601500, 1767225601500, None, None]
    values = ['"a"', '""', "0", "3.5", "true", "false", "null", "{}", "[]"]
    got = spark.createDataFrame([(v,) for v in values], "t string").select(kind_of(F.parse_json("t")), truthy(F.parse_json("t"))).collect()
    assert [r[0] for r in got] == ["string", "string", "number", "number", "boolean", "boolean", "null", "object", "array"]
    assert [r[1] for r in got] == [True, False, False, True, True, False, False, True, True]


def test_projects_and_sessions(spark, tmp_path):
    write(tmp_path / "-a/s1.jsonl", user("one", timestamp="2026-01-01T00:00:00Z", sessionId="s1", cwd="/w"), user("two", timestamp="2026-01-01T00:01:00Z"))
    write(tmp_path / "-a/s2.jsonl", user("<command-name>/model</command-name>", timestamp="2026-02-01T00:00:00Z", version="1"))
    write(tmp_path / "-c/no-ts.jsonl", user("x"))
    write(tmp_path / "-c/no-ts-2.jsonl", user("y"))
    write(tmp_path / "-c/with-ts.jsonl", user("z", timestamp="2026-01-01T00:00:00Z"))
    (tmp_path / "-c/empty.jsonl").write_text("")
    (tmp_path / "Empty").mkdir()
    (tmp_path / "file.jsonl").write_text("")
    got = discovery.list_projects(spark, str(tmp_path)).collect()
    assert {r["project"]: r["session_count"] for r in got} == {"-a": 2, "-c": 4, "Empty": 0}
    assert discovery.list_projects(spark, str(tmp_path / "missing")).count() == 0
    a = discovery.list_sessions(spark, str(tmp_path / "-a")).collect()
    assert [r["name"] for r in a] == ["s2.jsonl", "s1.jsonl"]
    assert [r["first_message"] for r in a] == ["/model", "one"] and a[1]["last_timestamp"] == "2026-01-01T00:01:00Z" and a[1]["session_id"] == "s1"
    assert discovery.list_sessions(spark, str(tmp_path / "-a"), head_lines=1).collect()[1]["last_timestamp"] == "2026-01-01T00:00:00Z"
    c = [r["name"] for r in discovery.list_sessions(spark, str(tmp_path / "-c")).collect()]
    assert c[0] == "with-ts.jsonl" and sorted(c[1:]) == ["empty.jsonl", "no-ts-2.jsonl", "no-ts.jsonl"]
    every = [r["name"] for r in discovery.find_all_sessions(spark, str(tmp_path)).collect()]
    assert every[:3] == ["s2.jsonl", "s1.jsonl", "with-ts.jsonl"] and len(every) == 6
    assert discovery.list_sessions(spark, str(tmp_path / "Empty")).count() == 0


def test_subagents(spark, tmp_path):
    parent = write(tmp_path / "parent.jsonl", user("p", sessionId="s"))
    write(tmp_path / "parent/subagents/agent-x.jsonl", user("c", sessionId="other"))
    (tmp_path / "parent/subagents/agent-empty.jsonl").write_text("")
    write(tmp_path / "agent-y.jsonl", user("c", sessionId="s"))
    write(tmp_path / "agent-z.jsonl", user("c", sessionId="t"))
    write(tmp_path / "agent-bad.jsonl", "not json")
    names = lambda df: sorted((r["child_key"].rsplit("/", 1)[1], r["layout"]) for r in df.collect())
    assert names(discovery.find_subagent_files(spark, parent)) == [("agent-x.jsonl", "new"), ("agent-y.jsonl", "old")]
    logs = SessionLogs(spark, parent, persist=False)
    assert names(logs.subagents()) == [("agent-x.jsonl", "new"), ("agent-y.jsonl", "old")]
    # a log of the old layout lists itself
    assert names(discovery.find_subagent_files(spark, str(tmp_path / "agent-z.jsonl"))) == [("agent-z.jsonl", "old")]


def test_tree_totals_end_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("a", "d"), ("a", "b")], "parent_key string, child_key string")
    totals = spark.createDataFrame([("a", 1), ("b", 10), ("c", 100), ("d", 1000)], "session_key string, tokens long")
    got = {r["root_key"]: (r["n_sessions"], r["tokens"]) for r in discovery.tree_totals(edges, totals).collect()}
    assert got == {"a": (4, 1111), "b": (4, 1111), "c": (4, 1111), "d": (1, 1000)}


def test_trees_of_any_depth(spark):
    n = 200
    edges = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(n - 1)], "parent_key string, child_key string")
    totals = spark.createDataFrame([(f"s{k}", 1) for k in range(n)], "session_key string, tokens long")
    got = {r["root_key"]: (r["n_sessions"], r["tokens"]) for r in discovery.tree_totals(edges, totals).collect()}
    assert got == {f"s{k}": (n - k, n - k) for k in range(n)}


def test_inventory_of_any_depth(spark):
    jsonl.configure(spark)
    deep: object = {"end": 1}
    for _ in range(60):
        deep = {"d": deep}
    df = spark.createDataFrame([(json.dumps({"type": "a", "x": deep}),), (json.dumps({"type": "a", "x": [[[[[[[[[[5]]]]]]]]]]}),)], "t string").select(F.parse_json("t").alias("raw"))
    seeds = audit.entry_seeds(df)
    got = {r["path"]: r["kinds"] for r in audit.inventory(seeds).collect()}
    assert got["entry[a].x" + ".d" * 60 + ".end"] == ["number"] and got["entry[a].x"] == ["array", "object"]
    assert got["entry[a].x" + "[]" * 10] == ["number"] and len(got) == 3 + 60 + 1 + 10
    rows = [(r["path"], r["kind"]) for r in audit.walk(seeds).collect()]
    assert len(rows) == (3 + 60 + 1) + (3 + 10) and {p for p, _ in rows} == set(got)


def test_head_scans_exchange_a_few_lines(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / f"{name}.jsonl", "", user("first", sessionId=name), "not json", *({"type": "user", "n": k, "pad": "x" * 300} for k in range(4000)))
    (tmp_path / "c.jsonl").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        paths = str(tmp_path / "*.jsonl")
        head = jsonl.read_head(spark, paths, 5).orderBy("session_key", "line_no")
        whole = jsonl.head(jsonl.read_entries(spark, paths), 5).orderBy("session_key", "line_no")
        assert [(r["session_key"], r["nonblank_no"]) for r in head.collect()] == [(r["session_key"], r["nonblank_no"]) for r in whole.collect()]
        plan = head._jdf.queryExecution().executedPlan().toString()
        assert plan.index("WindowGroupLimit") < plan.index("hashpartitioning(session_key") < plan.rindex("WindowGroupLimit")
        # a blank first line has no session id
        assert jsonl.first_lines(spark, paths).count() == 0
        write(tmp_path / "d.jsonl", user("x", sessionId="d"), *({"pad": "x" * 300} for _ in range(1000)))
        assert [r["first_session_id"] for r in jsonl.first_lines(spark, paths).collect()] == ["string:d"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def task(i, **more):
    return json.dumps({"id": i, "subject": "s", "description": "d", "status": "pending", "blocks": [], "blockedBy": ["1"], **more})


def test_tasks(spark, tmp_path):
    folder = tmp_path / "sess"
    folder.mkdir()
    (tmp_path / "none").mkdir()
    (tmp_path / ".hidden").mkdir()
    good = {"10": task("10"), "2": task("2", owner=5, metadata=[1]), "1": task("1", owner="me", metadata={"k": 1}), "x": task("abc")}
    bad = {"b1": "{", "b2": task(5), "b3": task("3", status="archived"), "b4": task("4", blocks=["a", 1]), "b5": "[]", "b6": task("6", blocks=None)}
    for name, text in {**good, **bad}.items():
        (folder / f"{name}.json").write_text(text)
    (folder / ".lock").write_text("")
    got = tasks.list_tasks(spark, "sess", str(tmp_path)).collect()
    assert [r["id"] for r in got] == ["1", "2", "10", "abc"]
    assert [(r["owner"], r["metadata"] is not None) for r in got] == [("me", True), (None, False), (None, False), (None, False)]
    assert tasks.read_task(spark, "sess", "x", str(tmp_path)).first()["id"] == "abc"
    assert tasks.read_task(spark, "sess", "b2", str(tmp_path)).count() == 0 and tasks.read_task(spark, "sess", "no", str(tmp_path)).count() == 0
    assert len(tasks.read_task(spark, "sess", "x", str(tmp_path)).inputFiles()) == 1
    assert [r[0] for r in tasks.list_task_sessions(spark, str(tmp_path)).collect()] == ["none", "sess"]
    assert tasks.find_tasks_dir(spark, "gone", str(tmp_path)) is None
    assert tasks.list_tasks(spark, "gone", str(tmp_path)).count() == 0 and tasks.list_tasks(spark, "none", str(tmp_path)).count() == 0


def test_file_history(spark, tmp_path):
    def snap(files):
        return {"type": "file-history-snapshot", "snapshot": {"messageId": "m", "trackedFileBackups": files, "timestamp": "t"}}

    def backup(v, name, time):
        return {"backupFileName": name, "version": v, "backupTime": time}

    log = write(
        tmp_path / "p/s.jsonl", user("x", sessionId="sid"), snap({"notes.md": backup(1, None, "t1"), "README.md": backup(1, "gone@v1", "t1")}),
        snap({"notes.md": backup(2, "abc@v2", "t2")}), snap({"notes.md": backup(2, "abc@v2", "t3")}), snap([]), {"type": "file-history-snapshot", "snapshot": {}},
    )
    store = tmp_path / "store/sid"
    store.mkdir(parents=True)
    (store / "abc@v2").write_text("blob")
    (store / "zzz@v9").write_text("orphan")
    (store / "other").write_text("")
    logs = SessionLogs(spark, log, persist=False)
    got = logs.file_history(str(tmp_path / "store")).collect()
    assert [(r["file_path"], r["version"], r["backup_time"], r["size"]) for r in got] == [("notes.md", 1, "t1", None), ("notes.md", 2, "t3", 4), ("README.md", 1, "t1", None)]
    assert [r["blob_path"] is not None for r in got] == [False, True, False]
    read = {(r["file_path"], r["version"]): r["content"] for r in logs.read_file_history(str(tmp_path / "store")).collect()}
    assert read[("notes.md", 2)] == "blob" and read[("README.md", 1)] is None
    assert {r["content"] for r in file_history.read_blobs(spark, logs.file_history(str(tmp_path / "store")), str(tmp_path / "gone")).collect()} == {None}
    (store / "abc@v2").write_bytes(b"b\xff")
    assert {r["content"] for r in logs.read_file_history(str(tmp_path / "store")).where("version = 2").collect()} == {"b�"}
    blobs = file_history.list_blobs(spark, str(tmp_path / "store"))
    assert [r["backup_file_name"] for r in file_history.orphan_blobs(blobs, logs.file_history(str(tmp_path / "store")).select("session_id", "backup_file_name")).collect()] == ["zzz@v9"]
    assert file_history.find_history_dir(spark, "sid", str(tmp_path / "store")) and file_history.find_history_dir(spark, "no", str(tmp_path / "store")) is None


def test_persisted_outputs(spark, tmp_path):
    text_file, json_file = tmp_path / "a.txt", tmp_path / "b.json"
    text_file.write_text("whole\ntext")
    json_file.write_text('[{"type":"text","text":"t"}]')
    wrap = lambda p, tail="": f"<persisted-output>\nOutput too large (3KB). Full output saved to: {p}\n\nPreview (first 2KB):\nsome\n preview{tail}"
    contents = [wrap(text_file), wrap(json_file, "\n</persisted-output>\n "), wrap(tmp_path / "no.txt"), "plain", " " + wrap(text_file)]
    df = spark.createDataFrame(list(enumerate(contents)), "k int, content string")
    refs = persisted.parse_persisted(df)
    assert [(r["k"], r["size_label"], r["preview"]) for r in refs.orderBy("k").collect()] == [(k, "3KB", "some\n preview") for k in range(3)]
    loaded = {r["k"]: r for r in persisted.load_persisted(refs, persisted.read_spilled(spark, [str(text_file), str(json_file)])).collect()}
    assert loaded[0]["text"] == "whole\ntext" and loaded[0]["blocks"] is None and loaded[1]["blocks"] is not None and not loaded[2]["found"]
    with pytest.raises(Exception, match="cannot load"):
        persisted.load_persisted(refs, persisted.read_spilled(spark, [str(text_file)]), strict=True).collect()


def test_inventory_and_drift(spark):
    jsonl.configure(spark)

    def inventory(*values):
        df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string").select(F.parse_json("t").alias("raw"))
        return audit.inventory(audit.entry_seeds(df))

    def as_dict(df):
        return {r["path"]: r["kinds"] for r in df.collect()}

    message = {"type": "user", "message": {"content": [{"type": "tool_use", "input": {"deep": 1}}, {"type": "tool_result", "content": [{"type": "text", "text": "x"}]}, {"type": 5}, "s"]}}
    snapshot = {"type": "file-history-snapshot", "snapshot": {"trackedFileBackups": {"a": {"v": 1}, "b": {"v": None}}}}
    got = as_dict(inventory(message, snapshot, {"x": True}, 5, [1]))
    p = "entry[user].message.content"
    assert got[p] == ["array"] and got[f"{p}[tool_use].input"] == ["object"] and f"{p}[tool_use].input.deep" not in got
    assert got[f"{p}[tool_result].content[text].text"] == ["string"] and got[f"{p}[]"] == ["object", "string"] and got[f"{p}[].type"] == ["number"]
    assert got["entry[file-history-snapshot].snapshot.trackedFileBackups{*}.v"] == ["null", "number"]
    assert got["entry[<no-type>].x"] == ["boolean"] and len([k for k in got if k.startswith("entry[<no-type>]")]) == 2
    before, after = inventory({"type": "a", "x": 1, "gone": 1}), inventory({"type": "a", "x": "s", "new": {}})
    diff = audit.compare(before, after)
    assert {(r["path"], r["status"], ",".join(r["kinds"])) for r in diff.collect()} == {("entry[a].x", "new_types", "string"), ("entry[a].gone", "removed", "number"), ("entry[a].new", "new", "object")}
    assert audit.drift_count(diff).first()[0] == 2 and audit.drift_count(audit.compare(before, before)).first()[0] == 0


def test_facade(spark, tmp_path):
    big = [{"type": "tool_use", "id": "t1", "name": "Agent", "input": {}}]
    one = write(tmp_path / "p/one.jsonl", user("hello", sessionId="s1", timestamp="2026-01-01T00:00:00.000Z"), assistant(5, 1, requestId="r"), assistant(7, 2, big, requestId="r", timestamp="2026-01-01T00:00:01.000Z"), user([{"type": "tool_result", "tool_use_id": "t1"}]))
    (tmp_path / "p/two.jsonl").write_text("")
    logs = SessionLogs(spark, str(tmp_path / "p/*.jsonl"))
    key = "file:" + one
    m = {r["session_key"]: r for r in logs.metrics().collect()}
    assert (m[key]["input_tokens"], m[key]["total_tokens"], m[key]["duration_ms"], m[key]["message_count"]) == (7, 9, 1000, 3)
    assert len(m) == 2 and m["file:" + str(tmp_path / "p/two.jsonl")]["message_count"] == 0
    assert {r["session_key"]: r["is_ongoing"] for r in logs.is_ongoing().collect()}[key] is True
    assert logs.first_user_message().first()["text"] == "hello"
    assert logs.find_tool_call("t1").first()["is_task"] and logs.find_tool_result("nope").count() == 0
    assert {r["session_id"] for r in logs.metadata().collect()} == {"s1", ""}
    assert ops.calls_with_results(logs.tool_calls(), logs.tool_results(), "inner").count() == 1
    assert logs.malformed().count() == 0
    names = logs.views("t_")
    assert spark.sql("select sum(total_tokens) from t_metrics").first()[0] == 9 and "t_ongoing" in names
    logs.close()

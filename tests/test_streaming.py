import json

from logweave.streaming.logs import latest_usage, recent_usage, stream_entries, throughput


def line(n, request, minute):
    return json.dumps({"type": "assistant", "requestId": request, "timestamp": f"2026-01-01T00:{minute:02}:00Z", "message": {"content": [], "usage": {"input_tokens": n}}})


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([line(1, "r", 0), line(5, "r", 1), "bad", line(7, "s", 20)]))
    entries = stream_entries(spark, str(folder))
    runs = [
        latest_usage(entries).writeStream.format("memory").queryName("usage").outputMode("complete").start(),
        recent_usage(entries, "10 minutes").writeStream.format("memory").queryName("recent").outputMode("append").start(),
        throughput(entries).writeStream.format("memory").queryName("rate").outputMode("append").start(),
    ]
    for q in runs:
        q.processAllAvailable()
    assert sorted((r["request_id"], r["input_tokens"]) for r in spark.table("usage").collect()) == [("r", 5), ("s", 7)]
    (folder / "b.jsonl").write_text(line(9, "t", 59))
    for q in runs:
        q.processAllAvailable()
    got = sorted((r["start"].minute, r["entries"], r["tokens"]) for r in spark.table("rate").collect())
    assert got == [(0, 2, 6), (20, 1, 7)]
    assert sorted((r["start"].minute, r["request_id"], r["input_tokens"]) for r in spark.table("recent").collect()) == [(0, "r", 5), (20, "s", 7)]
    for q in runs:
        q.stop()

"""Transcript formats, folders, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from skein.sources import folders, transcripts, writers
from skein.streaming import folds


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_compact_and_results(spark, tmp_path):
    put(
        tmp_path / "s1.jsonl",
        {"isCompactSummary": True, "message": {"content": "1. First\n" + "a" * 120 + "\n2. Second\n" + "b" * 120 + "\n3. No"}},
        {"message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": False, "content": "r" * 600}, {"type": "tool_result", "is_error": True, "content": "e" * 600}]}},
        "{broken",
    )
    lines = transcripts.read_lines(spark, str(tmp_path))
    assert [r["subject"] for r in transcripts.compact_summaries(lines).orderBy("seq").collect()] == ["1. First", "2. Second"]
    assert [len(r["body"]) for r in transcripts.tool_results(lines).collect()] == [600]


def test_thoughts(spark):
    doc = {"sessionId": "s", "messages": [{"thoughts": [{"subject": "Plan", "description": "d"}, {"subject": "Prioritizing file exploration", "description": "x"}], "toolCalls": [{"name": "ls", "args": {"b": "1", "a": "2"}, "result": [{"functionResponse": {"response": {"output": "out"}}}]}, {"name": "env", "args": {}, "result": [{"functionResponse": {"response": {"output": "MY_TOKEN=1"}}}]}]}]}
    files = spark.createDataFrame([("f", json.dumps(doc))], "file string, value string")
    assert [(r["type"], r["subject"]) for r in transcripts.thought_documents(files).orderBy("seq").collect()] == [("decision", "Plan"), ("discovery", "ls")]


def test_flow_logs(spark, tmp_path):
    put(tmp_path / "f.jsonl", {"_meta": {"id": "7"}}, {"_log_type": "terminalLogs", "type": "stdout", "text": "x" * 60}, {"_log_type": "terminalLogs", "type": "stdin", "text": "y" * 60}, {"_log_type": "messageLogs", "type": "report", "message": "m"})
    got = transcripts.flow_logs(transcripts.read_lines(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r["session"], r["type"]) for r in got] == [("7", "discovery"), ("7", "decision")]


def test_answers_carry_the_question(spark, tmp_path):
    put(tmp_path / "c.jsonl", {"type": "user", "content": "<user_query>why?</user_query>"}, {"type": "assistant", "content": "thinking", "tool_calls": [1]}, {"type": "assistant", "content": "because"}, {"type": "user", "content": "<system-reminder>x</system-reminder>"}, {"type": "assistant", "content": "still"})
    got = transcripts.answered_turns(transcripts.read_lines(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r["subject"], r["body"]) for r in got] == [("why?", "because"), ("why?", "still")]


def test_dated_rollouts(spark, tmp_path):
    put(tmp_path / "2024" / "r.jsonl", {"payload": {"role": "user", "content": [{"type": "text", "text": "ask"}]}}, {"payload": {"role": "assistant", "content": [{"type": "text", "text": "tell"}]}})
    got = transcripts.answered_turns(transcripts.read_lines(spark, str(tmp_path)), "$.payload.role", "$.payload.content", tools=None).collect()
    assert [(r["subject"], r["body"]) for r in got] == [("ask", "tell")]


def test_simple_turns_and_pairs(spark, tmp_path):
    put(tmp_path / "t.jsonl", {"query": "q", "response": "long enough an answer"}, {"query": "q", "response": "short"})
    put(tmp_path / "p.txt", "USER: a", "ASSISTANT: b", "ASSISTANT: c", "USER: d")
    assert transcripts.simple_turns(transcripts.read_lines(spark, str(tmp_path))).count() == 1
    assert [(r["query"], r["response"]) for r in transcripts.paired_lines(transcripts.read_lines(spark, str(tmp_path), "*.txt")).collect()] == [("a", "b")]


def test_markdown_and_yaml(spark, tmp_path):
    put(tmp_path / "storage.md", "---\nname: 'x'\n---\n- fact one\ntext\n- fact two")
    docs = folders.front_matter(folders.read_markdown(spark, str(tmp_path)), "name")
    assert docs.first()["name"] == "x"
    assert [r["fact_text"] for r in folders.bullets(docs).orderBy("line_no").collect()] == ["fact one", "fact two"]
    files = spark.createDataFrame([("f", "a:\n  b: 1\n  token: z\nl: [x, '{{t}}']"), ("g", "a: [")], "file string, value string")
    assert [(r["path"], r["leaf"]) for r in folders.yaml_leaves(files).orderBy("place").collect()] == [("a.b", "1"), ("l[0]", "x")]


def test_registries_and_commits(spark):
    a, b = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "a")], [(1, "b"), (2, "b")]))
    assert {r["id"]: r["v"] for r in folders.merge_registries(a, b, key="id").collect()} == {1: "a", 2: "b"}
    commits = spark.createDataFrame([("r", "1", "2024-01-01", "feat: x"), ("r", "2", "2024-01-02", "fix: x"), ("r", "3", "2024-01-09", "fix: y"), ("r", "4", "2024-01-10", 'Revert "feat: x"')], "repo string, sha string, at string, subject string")
    assert sorted((r["kind"], r["by"], r["sha"]) for r in folders.revert_pairs(commits).collect()) == [("fix_after_feat", "2", "1"), ("revert", "4", "1")]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    first = writers.publish(spark.range(2).toDF("id"), root)
    second = writers.publish(spark.range(3).toDF("id"), root, keep=first)
    assert writers.read_current(spark, root).count() == 3
    with pytest.raises(RuntimeError):
        writers.publish(spark.range(1).toDF("id"), root, keep=first)
    assert second > first
    with pytest.raises(ValueError):
        writers.guard_path("/a/../b", "/a")


def test_streaming_folds(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", True, "x"), (1, 2, "2024-01-01 00:01:00", True, "x"), (2, 3, "2024-01-01 00:02:00", False, "x"), (1, 4, "2024-01-01 00:03:00", False, "x"), (1, 5, "2024-01-01 00:04:00", True, "x")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, is_error boolean, target string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {r["event_id"]: r["run"] for r in run(folds.error_runs(stream()), "runs")} == {1: 1, 2: 2, 5: 1}
    assert sorted((r["user_id"], r["event_id"]) for r in run(folds.cursors(stream(), most=2), "shown")) == [(1, 1), (1, 2), (2, 3)]
    assert {r["user_id"]: r["n"] for r in run(folds.tumbling(stream(), "ts", "user_id"), "days", "complete")} == {1: 4, 2: 1}
    assert len(run(folds.once(stream(), "ts", ["user_id"]), "once")) == 2

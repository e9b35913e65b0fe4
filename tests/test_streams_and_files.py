import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import encode, retrieval
from corpusmill.sources import generators, readers, sinks
from corpusmill.streaming import logs


def lines(path, rows, torn=None):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + (torn or ""))


def test_torn_lines_are_dropped(spark, tmp_path):
    lines(tmp_path / "a.json", [{"run": "r", "step": 1}, {"run": "r", "step": 2}], '{"run": "r", "st')
    assert sorted(r.step for r in readers.metrics(spark, str(tmp_path)).collect()) == [1, 2]


def test_oversize_lines_are_counted(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"x": "ok"}\n{"x": "' + "y" * 500 + '"}\nnot json\n')
    rows, audit = readers.bounded_lines(spark, str(tmp_path), "x string", 100)
    assert [r.x for r in rows.collect()] == ["ok"] and tuple(audit.first()) == (3, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    lines(src / "a.json", [{"run": "r", "event": "train", "step": i, "logged_at": f"2024-01-01T00:{i:02}:00"} for i in range(30)])
    stream = logs.with_event_time(logs.tail_metrics(spark, str(src)), "logged_at", "5 minutes")
    stream = logs.windowed(logs.unique(stream, ["run", "step"]), "logged_at", "10 minutes", ["run"], F.count("*").alias("n"))
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ck)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    lines(src / "b.json", [{"run": "r", "event": "train", "step": 99, "logged_at": "2024-01-02T00:00:00"}])
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ck)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(out)).collect()) == [10, 10, 10]


def test_hooks_run_once_over_restarts(spark, tmp_path):
    src, calls = tmp_path / "in", []
    src.mkdir()
    for k in range(2):
        lines(src / f"{k}.json", [{"run": r, "event": "complete"} for r in ("a", "b")[: k + 1]])
        logs.exactly_once(logs.tail_metrics(spark, str(src)), str(tmp_path / "ck"), str(tmp_path / "done"), ["run"], lambda df, n: calls.extend(r.run for r in df.collect())).awaitTermination()
    assert sorted(calls) == ["a", "b"]


def test_state_changes_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines(src / "a.json", [{"run": "r", "event": e, "step": i} for i, e in enumerate(["train", "train", "paused", "train"])])
    out = logs.state_change_events(logs.tail_metrics(spark, str(src)), "run", "event", "step")
    q = out.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.state for r in spark.table("changes").orderBy("at").collect()] == ["train", "paused", "train"]


def test_archives(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w") as t:
            for n, data in members:
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    archive("ok.tar", [("a.json", b"{}"), ("a.mp4", b"xx"), ("b.json", b"{}")])
    assert [(r.key, bytes(r.content)) for r in readers.tar_pairs(spark, str(tmp_path / "ok.tar")).collect()] == [("a", b"xx")]
    archive("bad.tar", [("../a.json", b"{}")])
    with pytest.raises(Exception, match="unsafe member"):
        readers.tar_pairs(spark, str(tmp_path / "bad.tar")).collect()


def test_scan_order_resumes(spark):
    whole = readers.shuffled_parquet(spark, "/root/testdata/sf0.001/part.parquet", 3, 0, ["p_partkey"]).orderBy("place").collect()
    rest = readers.shuffled_parquet(spark, "/root/testdata/sf0.001/part.parquet", 3, 50, ["p_partkey"]).orderBy("place").collect()
    assert [r.p_partkey for r in whole[50:]] == [r.p_partkey for r in rest] and [r.place for r in whole] == list(range(len(whole)))


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1, 2], None), ("b", [3], "bad")], "id string, tokens array<int>, reason string")
    sinks.with_quarantine(rows, "reason", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.with_quarantine(rows, "reason", str(tmp_path / "good"), str(tmp_path / "bad"))
    sinks.csv_export(rows, str(tmp_path / "csv"), ["id", "tokens"])
    assert {r.tokens for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"[1,2]", "[3]"}
    sinks.compact_shards(rows.select("id", "tokens"), str(tmp_path / "shards"), "tokens", ["id"], 2)
    assert {(r.id, r.shard) for r in spark.read.parquet(str(tmp_path / "shards")).collect()} == {("a", 0), ("b", 1)}
    sinks.write_json(str(tmp_path / "m.json"), {"b": 1})
    assert sinks.digest({"b": 1, "a": 2}) == sinks.digest({"a": 2, "b": 1}) and "| x |" in sinks.markdown([{"c": "x"}], ["c"])


def test_generators(spark):
    rows = generators.fraction_documents(spark, 40, 1).collect()
    from fractions import Fraction

    for r in rows:
        left, right = r.text.split(" = ")
        assert sum(Fraction(x) for x in left.split(" + ")) == Fraction(right) == Fraction(r.num, r.den) and Fraction(r.num, r.den).denominator == r.den
    for r in generators.arithmetic(spark, 30, 1).collect():
        assert eval(r.question[8:-1]) == int(r.answer)  # noqa: S307
    assert generators.diagnostics(spark, 5, 6, 1).count() == 11


def test_nearest_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(50, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "iid long, v array<double>")
    got = {r.qid: r.iid for r in retrieval.nearest(df.select(F.col("iid").alias("qid"), F.col("v").alias("q")), df, block=7).collect()}
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    assert got == {i: int(s[i].argmax()) for i in range(50)}


def test_encoding_round_trip(spark):
    from corpusmill.plans.relational import PATTERN

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    texts = ["hello world 汉字", "", "é" * 300]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    enc = encode.encoding_of(spark, path, PATTERN)()
    rows = {r.id: r for r in encode.encoded_documents(df, path, PATTERN).collect()}
    for i, t in enumerate(texts):
        assert enc.decode([x - encode.OFFSET for x in rows[str(i)].tokens[1:-1]]) == t and rows[str(i)].labels[0] == -100
    pieces = encode.chunks(df, path, PATTERN, 3).collect()
    for i, t in enumerate(texts):
        own = sorted((r.chunk, r.begin, r.end, r.text) for r in pieces if r.id == str(i))
        assert "".join(x[3] for x in own) == t and all(t[a:b] == x for _, a, b, x in own)
    tokens, labels = encode.chat_tokens([{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], enc.encode_ordinary)
    assert labels[:3] == [-100] * 3 and labels[-1] == 2 and len(tokens) == len(labels)
    assert encode.wrapped("aa bbb cccccc d", 4) == ["aa", "bbb", "cccc", "cc d"]


def test_controlled_turns_are_encoded_and_parsed_again(spark):
    from pyspark.sql import Row
    from pyspark.sql import functions as F

    from corpusmill.plans.relational import PATTERN, RANKS

    turn = lambda role, content, reasoning=None, calls=None, tools=None: Row(role=role, content=content, reasoning=reasoning, tool_calls=calls, tools=tools)
    rows = [
        ("a", [turn("user", "hi"), turn("assistant", "hello", "a greeting")], "thinking", "high"),
        ("b", [turn("user", "hi", None, None, '[{"n": 1}]'), turn("assistant", 'say "x"', None, '[{"f": 2}]'), turn("tool", "2"), turn("assistant", "two")], "direct", "low"),
    ]
    df = spark.createDataFrame(rows, "id string, turns array<struct<role:string,content:string,reasoning:string,tool_calls:string,tools:string>>, mode string, effort string")
    t, m = F.col("turns"), F.col("mode")
    assert [r.f for r in df.select(encode.control_fault(t, F.lit("direct")).alias("f")).collect()] == ["reasoning_in_direct_mode", None]
    assert [r.f for r in df.select(encode.control_fault(t, F.lit("thinking")).alias("f")).collect()] == [None, "no_reasoning_in_thinking_mode"]
    enc = encode.encoded_segments(df.select("id", encode.control_segments(t, m, F.col("effort")).alias("segments")), RANKS, PATTERN)
    got = {r.id: r for r in enc.collect()}
    assert all(r.tokens[:2] == [1, 3] and len(r.tokens) == len(r.labels) and r.tokens[-1] == 2 for r in got.values())
    assert got["a"].tokens.count(15) == 1 and 13 in got["a"].tokens and got["b"].tokens.count(18) == 1 and got["b"].tokens.count(19) == 1 and 12 in got["b"].tokens
    own = spark.createDataFrame([("a", [x for x in got["a"].labels if x != -100]), ("c", [17, 30, 4, 2]), ("d", [15, 30]), ("e", [17, 30]), ("f", []), ("g", [18, 30, 2])], "id string, ids array<int>")
    acts = {r.id: r.a for r in own.select("id", encode.parsed_action(F.col("ids"), True).alias("a")).collect()}
    assert {k: v.kind for k, v in acts.items()} == {"a": "final", "c": "invalid", "d": "truncated", "e": "truncated", "f": "truncated", "g": "tool"}
    said = encode.decoded(own.select("id", encode.parsed_action(F.col("ids")).alias("a")).select(F.concat("id", F.lit("")).alias("id"), F.concat("a.thoughts", "a.body").alias("tokens")), RANKS, PATTERN, encode.CONTROL_OFFSET)
    assert {r.id: r.text for r in said.collect()}["a"] == "a greetinghello"
    calls = encode.decoded(enc.filter("id = 'b'"), RANKS, PATTERN, encode.CONTROL_OFFSET).first().text
    assert '{"calls": [{"f": 2}], "content": "say \\"x\\""}' in calls and 'hi\n[{"n": 1}]' in calls


def test_pictures_take_places_before_the_question(spark):
    from pyspark.sql import functions as F

    rows = [("a", [(4, None, False), (None, "what is it", False)], [(56, 29), (2800, 2800), (None, 5)]), ("b", [(5, None, True)], [(56, 56)])]
    df = spark.createDataFrame(rows, f"id string, s {encode.SEGMENTS}, media array<struct<width:int,height:int>>")
    got = {r.id: [x.marker for x in r.x] for r in df.select("id", encode.multimodal_segments(F.col("s"), F.col("media")).alias("x")).collect()}
    assert got["a"] == [4, 20, *[9] * 4, 10, 20, *[9] * 256, 10, 20, 9, 10, None] and got["b"] == [5]


def test_documents_and_logs_are_put_in_place_once(spark, tmp_path):
    import json

    from corpusmill.sources import sinks

    target = tmp_path / "sub" / "m.json"
    for v in ({"b": 1}, {"b": [2, "ß"]}):
        sinks.write_json(str(target), v)
        assert json.loads(target.read_text(encoding="utf-8")) == v
    assert [f.name for f in target.parent.iterdir() if not f.name.endswith(".crc")] == ["m.json"]
    df = spark.createDataFrame([("a", "train", 1), ("b", "val", 2)], "id string, split string, n int")
    name = sinks.rollout_log(df, str(tmp_path / "log"), {"policy": "p", "step": 3})
    assert spark.read.parquet(str(tmp_path / "log" / name)).count() == 2 and json.loads((tmp_path / "log" / f"{name}.json").read_text())["step"] == 3
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.rollout_log(df, str(tmp_path / "log"), {"step": 3, "policy": "p"})
    sinks.jsonl_by_split(df, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits" / "split=val")).first().n == 2
    sinks.require_space(str(tmp_path), 1, 1)
    with pytest.raises(OSError, match="bytes free"):
        sinks.require_space(str(tmp_path), 1 << 60)

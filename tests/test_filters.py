from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusmill.functions import chat, expr
from corpusmill.functions.text import canonical_question, fingerprint, match_text, normalized, squeezed
from corpusmill.operators import decontam, filters, verify, views


def test_normal_forms(spark):
    rows = [("  Ｓtraße \x00 x\x1cy ", ), ("", ), (None, )]
    got = spark.createDataFrame(rows, "t string").select(normalized(F.col("t")).alias("n"), squeezed(F.col("t")).alias("s"), canonical_question(F.lit("Ｗhy？ no, yes!")).alias("q"), match_text(F.lit("Çeau-ß 12")).alias("m"), fingerprint(F.col("t")).alias("f")).collect()
    assert got[0].n == "Straße  x\x1cy" and got[0].s == "strasse\x00xy" and got[0].q == "whynoyes" and got[0].m == "çeau ss 12"
    assert got[1].s == "" and got[2].s is None and got[2].f is None


def test_first_failing_rule_wins(spark):
    text = [("short", "en"), ("ok " * 60, "en"), ("汉字" * 60, "en"), (None, "en"), ("a" * 99 + "\x01", "en"), ("<div> <span> <body> <nav> " + "word " * 40, "en"), ("1" * 120, "zh")]
    got = [r.r for r in spark.createDataFrame(text, "t string, l string").select(filters.quality(F.col("t"), F.col("l")).alias("r")).collect()]
    assert got == ["length_outside_100_100000_characters", None, "language_script_mismatch", "missing_payload", "invalid_encoding_or_controls", "unremoved_html", "insufficient_language_content"]


def test_boilerplate_border(spark):
    line = "a line of more than twenty characters"
    same = "\n".join([line] * 2 + [f"{line} {i}" for i in range(3)])
    got = spark.createDataFrame([(same,), ("\n".join([line] * 3),), ("",)], "t string").select(expr.repeated_share(F.col("t")).alias("s")).collect()
    assert [round(r.s, 3) for r in got] == [0.2, 0.667, 0.0]


def test_python_and_licences(spark):
    code = '"""Copyright 2020. Permission"""\ndef f():\n    return 1\n'
    got = spark.createDataFrame([(code,), ("x = 1",), ("def (",), (None,)], "t string").select(filters.python_shape(F.col("t")).alias("s")).select("s.*").collect()
    assert [r.reason for r in got] == [None, "no_function_or_class", "not_parseable_python3", "not_parseable_python3"]
    assert got[0].header.startswith('"""Copyright')


def test_chat_rules(spark):
    t = lambda *pairs: [Row(role=r, content=c, reasoning=None, tool_calls=None, tools=None) for r, c in pairs]
    rows = [(1, t(("user", "a"), ("assistant", "b"))), (2, t(("user", "a"))), (3, t(("robot", "a"), ("assistant", "b"))), (4, []), (5, None)]
    c = F.col("turns")
    got = {r.id: r for r in spark.createDataFrame(rows, f"id long, turns {chat.TURNS}").select("id", chat.incomplete(c).alias("i"), F.coalesce(chat.invalid(c), F.lit(False)).alias("v"), chat.direct(c).alias("d"), chat.flattened(c, "titled").alias("f")).collect()}
    assert not got[1].i and got[1].d and got[1].f == "User: a\n\nAssistant: b"
    assert got[2].i and got[3].v and got[4].i and got[5].i and not got[5].d


def test_native_record_faults(spark):
    schema = "sample_id string, split_group string, language string, domain string, supervision struct<type:string>, messages array<struct<role:string,content:array<struct<type:string,text:string,media_id:string>>>>, media array<struct<media_id:string,frames:array<string>,timestamps:array<double>>>"
    ok = ("s", "g", "en", "d", ("answer_ce",), [("user", [("text", "x", None)])], [("m", ["a", "b"], [0.0, 1.0])])
    rows = [ok, (*ok[:6], [("m", ["a", "b"], [1.0, 1.0])]), (*ok[:5], [], ok[6]), (None, *ok[1:])]
    df = spark.createDataFrame(rows, schema)
    assert [r.r for r in df.select(filters.native_reason(df).alias("r")).collect()] == [None, "timestamps_not_rising", "no_messages", "missing_sample_id"]


def test_short_prompts_and_answers_match(spark):
    prompt = "write a function that adds two numbers"  # 7 words, 38 characters
    answer = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([("p", prompt, None), ("q", "too short", answer)], "item string, prompt string, answer string")
    found = decontam.phrases(items)
    rows = [(1, f"please {prompt} now"), (2, "too short"), (3, "x " + " ".join(f"word{i}" for i in range(4, 17))), (4, "rewrite a function that adds two numbers"), (5, "")]
    got = {r.id: r.item for r in decontam.matches(spark.createDataFrame(rows, "id long, text string"), found).collect()}
    assert got == {1: "p", 3: "q"}


def test_short_grams_and_upstream_repositories(spark):
    short, long = " ".join(["ab"] * 13), " ".join(["abcde"] * 13)
    items = spark.createDataFrame([("p", None, short + " x " + long)], "item string, prompt string, answer string")
    found = decontam.phrases(items)
    assert all(len(r.phrase) >= 64 for r in found.collect())
    rows = spark.createDataFrame([(1, short, None), (2, long, None), (3, "", "OpenAI/human-eval.git"), (4, long, "openai/human-eval"), (5, "x", "a/b")], "id long, text string, repo_id string")
    assert {r.id: r.item for r in decontam.all_matches(rows, found).collect()} == {2: "p", 3: "upstream_repository", 4: "upstream_repository"}


def test_phrases_of_many_lengths_equal_a_search(spark):
    import random

    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    prompts = [some(n) for n in (6, 7, 8, 13, 14, 15, 20, 40, 41)] + [""]
    items = spark.createDataFrame([(f"i{k}", p, None) for k, p in enumerate(prompts)], "item string, prompt string, answer string")
    found = decontam.phrases(items)
    texts = [some(3) + " " + p[: rng.randrange(20, len(p) + 1) if p else 0] + " " + some(2) if k % 2 else some(4) + " " + p + " " + some(30) for k, p in enumerate(prompts * 6)]
    got = {r.id: (r.item, r.phrase) for r in decontam.matches(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), found).collect()}
    rows = [(r.phrase, r["words"], r.item) for r in found.collect()]
    for k, t in enumerate(texts):
        w = t.split()
        hits = [(i + n, item, p) for p, n, item in rows for i in range(1, len(w) - n + 2) if " ".join(w[i - 1 : i - 1 + n]) == p]
        assert got.get(k) == (min(hits)[1:] if hits else None)


def test_overlay_and_delta(spark):
    base = spark.createDataFrame([("a", "g1", "train"), ("b", "g2", "val"), ("c", "g3", "train"), ("d", None, "test")], "id string, group_root string, split string")
    g = lambda *x: spark.createDataFrame([(v,) for v in x], "group_root string")
    view = views.effective(base, g("g1", "g1"), g("g3"), g("g2"))
    assert {r.id: r.split for r in view.collect()} == {"a": "val", "b": "test", "d": "test"}
    assert {r.id: r.change for r in views.delta(base, view).collect()} == {"a": "moved", "b": "moved", "c": "remove_train", "d": "unchanged"}
    assert {r.fault for r in views.reservation_faults(base, g("g2"), g("nope"), g("g1")).collect()} == {"val_from_held_out", "unknown_group", "test_not_from_val"}
    only = lambda a, b: {r.side: r.rows for r in views.equal_rows(a, b).collect()}
    assert only(base, base.unionByName(base.limit(1))) == {"left": 0, "right": 1}


def test_verifiers(spark):
    q = '{"kind": "quantity", "value": 1.5, "unit": "km", "unit_factors": {"m": 1, "km": 1000}}'
    near = '{"kind": "quantity", "value": 2, "unit": "m", "unit_factors": {"m": 1}, "relative_tolerance": 0.1}'
    b = '{"kind": "box", "expected": [0, 0, 1, 1], "max_coordinate_error": 0.1}'
    j = '{"kind": "json", "expected": {"a": [1, 2.5], "b": null}}'
    cases = [
        ('{"value": 1500, "unit": "m"}', q, 1), ('{"unit": "m", "value": 1500.0}', q, 1), ('{"value": true, "unit": "m"}', q, 0), ('{"value": "1500", "unit": "m"}', q, 0), ("1.5 km", q, 0), ('{"value": 1.5, "unit": "mile"}', q, 0), ('{"value": 1500, "unit": "m", "x": 1}', q, 0), (None, q, 0),
        ('{"value": 2.1, "unit": "m"}', near, 1), ('{"value": 2.3, "unit": "m"}', near, 0),
        ("[0, 0, 1, 0.95]", b, 1), ("[1, 0, 0, 1]", b, 0), ("[0, 0, 1]", b, 0), ("[0, 0, 1, 1.01]", b, 0), ('[0, 0, 1, "1"]', b, 0), (None, b, 0), ("[]", b, 0),
        ('{"b": null, "a": [1.0, 2.5]}', j, 1), ('{"a": [1, 2.5]}', j, 0), ("{", j, 0),
    ]
    got = [r.s for r in spark.createDataFrame(cases, "t string, spec string, want int").select(verify.structured(F.col("t"), F.col("spec")).alias("s")).collect()]
    assert got == [w for _, _, w in cases]


def test_headers_and_grants(spark):
    mit = "Copyright 2020 A\nPermission is hereby granted, free of charge, to deal in the Software without restriction\nthe above copyright notice and this permission notice shall be included. The software is provided as is"
    bsd = "Copyright\n* Redistribution and use in source and binary forms\n Redistributions of source code\nRedistributions in binary form\nThis software is provided as is"
    note = lambda t: "".join(f"# {x}\n" for x in t.split("\n"))
    rows = [(note(mit) + "import os\nclass A: pass", "mit", None), (f'"""{mit}"""\ndef f(): pass', "mit", None), ("x = 1\n" + note(mit) + "def f(): pass", "mit", "missing_or_conflicting_file_grant"), (note(mit) + "# SPDX-License-Identifier: GPL-3.0\ndef f(): pass", "mit", "conflicting_spdx_header"), (note(mit) + "# SPDX-License-Identifier: MIT\ndef f(): pass", "mit", None), (note(mit + " non-commercial") + "def f(): pass", "mit", "missing_or_conflicting_file_grant"), (note(bsd) + "def f(): pass", "bsd-2-clause", None), (note(bsd) + "def f(): pass", "bsd-3-clause", "no_matching_in_file_license"), (note(bsd + " neither the name") + "def f(): pass", "bsd-3-clause", None)]
    df = spark.createDataFrame(rows, "t string, l string, want string").withColumn("s", filters.python_shape(F.col("t")))
    assert all(r.s.reason is None and r.s.ast_sha256 for r in df.collect())
    assert [r.r for r in df.select(filters.license_grant(F.col("s.header"), F.col("l")).alias("r")).collect()] == [w for _, _, w in rows]


def test_schedules():
    assert expr.parsed_schedule("0:8,10:16") == [(0, 8), (10, 16)]
    for bad in ("1:8", "0:8,0:9", "0:8,5:4", "x"):
        try:
            expr.parsed_schedule(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert expr.frame_indices(10, 4) == [0, 3, 6, 9]


def test_modes(spark):
    rows = [(None, None), ("thinking", None), (None, "max"), ("thinking-high", "max"), ("direct", "thinking-max"), ("odd", None), ("tool", "")]
    got = [r.x for r in spark.createDataFrame(rows, "m string, e string").select(expr.mode_and_effort(F.col("m"), F.col("e")).alias("x")).collect()]
    assert [tuple(x) if x else None for x in got] == [("direct", "low"), ("thinking", "low"), ("thinking", "max"), None, None, None, None]

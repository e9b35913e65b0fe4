"""Every query on empty tables, and on odd rows with and without further columns of clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.queries import QUERIES

from .conftest import SCHEMAS, document, sample

LONG = "The mill stands near the river, and the wheel turns with the water of the valley. " * 4_000
TALK = [{"role": "user", "content": "What is a mill?"}, {"role": "assistant", "content": "I'm sorry, but I can't help with the mill."}, {"role": "user", "content": None}, {"role": "assistant", "content": ""}]
ODD = {
    "samples": [
        sample("a", LONG, root="R"), sample("b", LONG.replace("wheel", "wheels", 3), "val", root=" r"), sample("c", None, None), sample("d", "", "test"), sample("e", " \n ", "val", turns=TALK), sample("f", "abcd", "test"), sample("g", "ABCD", "train"),
        sample("h", "x", None, payload="{torn"), sample("i", "�\x00 ​", "val", payload="null"), sample("j", "same text here", "train", turns=TALK), sample("k", "same text here", "test", turns=TALK[:1]), (None, *sample("l", "same text here", "val")[1:]), sample("m", "same text here", "other", source=None),
        (*sample("n", "one two three")[:2], None, *sample("n", "one two three")[3:]),
    ],
    "links": [("a", "k:1"), ("b", "K: 1"), ("c", None), (None, "k:1"), ("zz", "k:1"), ("d", " "), ("d", "k:2"), ("e", "k:2")],
    "image_bands": [(0, 1, "00ff", "a"), (0, 1, "0x00fe", "b"), (None, None, None, "c"), (1, 1, "zz", "d"), (0, 1, "00ff", None), (0, 1, "00ff", "a")],
    "documents": [document(1, LONG, " S_one", "en-US"), document(2, None, "s-one"), document(3, "", None), document(4, " \t", "s-one", "xx"), document(5, "- a b\n- c d\n- e f", "two", None), document(6, "- a b\n- c d\n- e f", "two", "qq"), document(7, "It is the word of the mill.", "two"), document(8, "�" * 300, "none")],
    "source_specs": [("s-one", "r", "l", "pretrain", "t", ["en"]), ("two", "r", "l", "sft", None, None), (None, None, None, None, None, None)],
    "mix_targets": [("S-One", 0.5, 2), ("two", 0.3, None), ("gone", 0.2, 1), (None, 0.1, 1), ("none", None, 3), ("none", -1.0, 3)],
    "pack_windows": [("p", 50), ("q", None), (None, 20), ("r", 0)],
    "split_plan": [("train", 0.8), ("val", 0.2), (None, 0.1), ("test", None)],
}
#: Names that operators use inside.
CLASH = ("th", "rk", "sk", "w", "key", "v", "u", "k", "n", "part", "pool", "block", "label", "tokens", "group_id", "links", "a", "b", "x", "chain", "at", "qk", "kind", "repeats", "capacity", "shard")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    plain, more, empty = (tmp_path_factory.mktemp(n) for n in ("plain", "more", "empty"))
    for name, schema in SCHEMAS.items():
        rows = spark.createDataFrame(ODD[name] * 2 if name in ("samples", "links", "image_bands") else ODD[name], schema)
        rows.write.parquet(str(plain / f"{name}.parquet"))
        rows.withColumns({c: F.lit(f"{c}!") for c in CLASH if c not in rows.columns}).write.parquet(str(more / f"{name}.parquet"))
        rows.limit(0).write.parquet(str(empty / f"{name}.parquet"))
    return str(plain), str(more), str(empty)


def rows(df):
    return sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"p3_assignment", "p3_report"}))
def test_odd_rows_and_further_columns(spark, odd, name):
    plain, more, empty = odd
    got = rows(QUERIES[name](spark, plain))
    assert got == rows(QUERIES[name](spark, more))
    left = QUERIES[name](spark, empty).collect()
    assert not left or name in ("p2_token_budget",)


@pytest.mark.parametrize("name", ["p3_assignment", "p3_report"])
def test_assignment_of_odd_rows(spark, odd, name):
    plain, more, empty = odd
    assert rows(QUERIES[name](spark, plain)) == rows(QUERIES[name](spark, more))
    with pytest.raises(ValueError, match="no positive share"):
        QUERIES[name](spark, empty)


def test_what_odd_rows_give(spark, odd):
    d = odd[0]
    got = {tuple(r) for r in QUERIES["p1_found"](spark, d).collect()}
    assert got == {("a", "b"), ("f", "g"), ("e", "j"), ("j", "k")}
    got = {tuple(r) for r in QUERIES["p4_found"](spark, d).collect()}
    assert got == {("image", "a", "b"), ("text", "a", "b"), ("text", "f", "g"), *[("text", *p) for p in (("j", "k"), ("j", "m"), ("k", "m"))]}
    assert {r.id for r in QUERIES["p3_found"](spark, d).collect()} == {"a", "b", "d", "e"}
    assert {(r.id, r.turn, r.defect) for r in QUERIES["p5_found"](spark, d).collect()} == {(i, *x) for i in "ej" for x in ((0, "refusal"), (2, "empty_answer"))} | {("k", 0, "empty_answer")}
    assert {(r.doc_id, r.kind) for r in QUERIES["p8_found"](spark, d).collect()} == {(1, "junk"), (5, "list"), (6, "list"), (8, "junk")}

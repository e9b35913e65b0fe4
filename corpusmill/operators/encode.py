"""Tokens and labels of documents and chats, as arrays.

Tokenizers are read from a file that the caller names; they are never trained here. Ids of the
vocabulary are shifted by OFFSET to leave room for the markers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Begin, end, and the role markers.
BEGIN, END, IGNORED = 1, 2, -100
ROLE_IDS = {"system": 3, "user": 4, "assistant": 5, "tool": 6}
OFFSET = 8
#: Markers of the controlled template, and the first id of the vocabulary in it.
EFFORT_IDS = {"low": 12, "high": 13, "max": 14}
THINK, THOUGHT, FINAL, CALL, RESULT, CONTROL_OFFSET = 15, 16, 17, 18, 19, 21
_loaded: dict[bytes, object] = {}

ENCODED = "id string, tokens array<int>, labels array<int>"
SEGMENTS = "array<struct<marker:int,text:string,learned:boolean>>"


def encoding_of(spark: SparkSession, path: str, pattern: str):
    """A function that gives the tiktoken encoding of a rank file on a worker.

    The file is read on the driver and broadcast (about 1 MB), so executors need no copy of it; a
    worker keeps encodings by the file's bytes.
    """
    data = Path(path).read_bytes()
    shared, digest = spark.sparkContext.broadcast(data), sha256(data).digest()

    def get():
        import tiktoken

        if digest not in _loaded:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line.strip())}
            _loaded[digest] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _loaded[digest]

    return get


def document_tokens(ids: list[int]) -> tuple[list[int], list[int]]:
    """[begin, ids, end] and the same as labels, the first ignored."""
    out = [BEGIN, *(i + OFFSET for i in ids), END]
    return out, [IGNORED, *out[1:]]


def chat_tokens(turns: list[dict], encode) -> tuple[list[int], list[int]]:
    """Begin, then role marker, content, end for each turn; only assistants' content and end are labels."""
    tokens, labels = [BEGIN], [IGNORED]
    for t in turns:
        if t["role"] not in ROLE_IDS:
            raise ValueError(f"unknown role {t['role']}")
        body = "\n".join([t.get("content") or "", *[t[k] for k in ("tool_calls", "tools") if t.get(k)]])
        value = [*(i + OFFSET for i in encode(body)), END]
        tokens += [ROLE_IDS[t["role"]], *value]
        labels += [IGNORED, *(value if t["role"] == "assistant" else [IGNORED] * len(value))]
    return tokens, labels


def encoded_documents(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, tokens, labels) of id and text. A null text is [begin, end]."""

    get = encoding_of(rows.sparkSession, path, pattern)

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = get()
        for pdf in frames:
            both = [document_tokens(enc.encode_ordinary(t or "")) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"].astype(str), "tokens": [a for a, _ in both], "labels": [b for _, b in both]})

    return rows.select("id", "text").mapInPandas(on, ENCODED)


def encoded_chats(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, tokens, labels) of id and turns (array of structs). Rows without turns are left out."""

    get = encoding_of(rows.sparkSession, path, pattern)

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = get()
        for pdf in frames:
            both = [chat_tokens([t if isinstance(t, dict) else t.asDict() for t in ts], enc.encode_ordinary) for ts in pdf["turns"]]
            yield pd.DataFrame({"id": pdf["id"].astype(str), "tokens": [a for a, _ in both], "labels": [b for _, b in both]})

    return rows.filter(F.size("turns") > 0).select("id", "turns").mapInPandas(on, ENCODED)


# ---------------------------------------------------------------- controlled template


def control_fault(turns: Column, mode: Column) -> Column:
    """Why turns don't fit a mode: reasoning in direct answers, none in thinking ones, unknown roles; null if they do."""
    said = F.filter(turns, lambda t: t["role"] == "assistant")
    thinks = lambda t: F.coalesce(t["reasoning"], F.lit("")) != ""
    calls = lambda t: F.coalesce(t["tool_calls"], F.lit("")) != ""
    return (
        F.when(F.exists(turns, lambda t: F.coalesce(~t["role"].isin(*ROLE_IDS), F.lit(True))), "unknown_role")
        .when((mode == "direct") & F.exists(said, thinks), "reasoning_in_direct_mode")
        .when((mode == "thinking") & F.exists(said, lambda t: ~thinks(t) & ~calls(t)), "no_reasoning_in_thinking_mode")
    )


def control_segments(turns: Column, mode: Column, effort: Column, title: str = "control-v1") -> Column:
    """The controlled template as an array of segments: a marker or a text each, learned or not.

    A system line names mode and effort. An assistant's turn is its role, its effort, its thoughts
    between two markers, and its final text, or its calls with the text beside them; only what
    follows the effort is learned. Other turns are their role, for tools a result marker, and text.
    """
    segment = lambda marker, text, learned: F.struct((F.lit(None) if marker is None else marker).cast("int").alias("marker"), (F.lit(None) if text is None else text).cast("string").alias("text"), F.lit(learned).alias("learned"))
    mark = lambda m, learned: segment(F.lit(m) if isinstance(m, int) else m, None, learned)
    word = lambda t, learned: segment(None, t, learned)
    role, level = (F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))]) for d in (ROLE_IDS, EFFORT_IDS))
    none = F.array().cast(SEGMENTS)
    body = lambda t: F.coalesce(t["content"], F.lit(""))
    has = lambda c: F.coalesce(c, F.lit("")) != ""

    def turn(t: Column) -> Column:
        thoughts = F.when(has(t["reasoning"]), F.array(mark(THINK, True), word(t["reasoning"], True), mark(THOUGHT, True))).otherwise(none)
        beside = F.concat(F.lit('{"calls": '), t["tool_calls"], F.lit(', "content": '), F.to_json(F.struct(body(t).alias("c"))).substr(F.lit(6), F.length(F.to_json(F.struct(body(t).alias("c")))) - 6), F.lit("}"))
        answer = F.when(has(t["tool_calls"]), F.array(mark(CALL, True), word(beside, True))).otherwise(F.array(mark(FINAL, True), word(body(t), True)))
        learned = F.concat(F.array(mark(F.try_element_at(role, t["role"]), False), mark(F.try_element_at(level, effort), False)), thoughts, answer, F.array(mark(END, True)))
        given = word(F.concat(body(t), F.when(has(t["tools"]), F.concat(F.lit("\n"), t["tools"])).otherwise("")), False)
        result = F.when(t["role"] == "tool", F.array(mark(RESULT, False))).otherwise(none)
        return F.when(t["role"] == "assistant", learned).otherwise(F.concat(F.array(mark(F.try_element_at(role, t["role"]), False)), result, F.array(given, mark(END, False))))

    head = F.array(mark(BEGIN, False), mark(ROLE_IDS["system"], False), word(F.concat(F.lit(f"{title}: mode="), mode, F.lit("; effort="), effort, F.lit(".")), False), mark(END, False))
    return F.concat(head, F.flatten(F.transform(turns, turn)))


#: Markers around the places of a picture, and of one place.
PICTURE, PATCH, PICTURE_END = 20, 9, 10


def picture_places(width: Column, height: Column, patch: int = 28, most: int = 256) -> Column:
    """Places that a picture takes: patches of its sides; a larger one is scaled down evenly until it fits."""
    side = lambda c, f: F.greatest(F.lit(1), F.ceil(c * f / patch))
    whole = side(width, F.lit(1.0)) * side(height, F.lit(1.0))
    shrink = F.sqrt(F.lit(float(most)) * patch * patch / (width.cast("double") * height))
    fit = lambda c: F.greatest(F.lit(1), F.floor(c * shrink / patch))
    return F.when((width > 0) & (height > 0), F.when(whole <= most, whole).otherwise(fit(width) * fit(height))).cast("int")


def multimodal_segments(segments: Column, media: Column) -> Column:
    """segments with the places of all pictures put before the first text of a user; unlearned.

    media: array of structs with width and height; pictures without a size take one place.
    """
    mark = lambda m: F.struct(F.lit(m).cast("int").alias("marker"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("learned"))
    places = lambda m: F.concat(F.array(mark(PICTURE)), F.array_repeat(mark(PATCH), F.coalesce(picture_places(m["width"], m["height"]), F.lit(1))), F.array(mark(PICTURE_END)))
    pictures = F.flatten(F.transform(media, places))
    at = F.array_position(F.transform(segments, lambda x: F.coalesce(x["marker"] == ROLE_IDS["user"], F.lit(False))), F.lit(True)).cast("int")
    return F.when((F.size(media) > 0) & (at > 0), F.concat(F.slice(segments, F.lit(1), at), pictures, F.slice(segments, at + 1, F.size(segments)))).otherwise(segments)


def encoded_segments(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, tokens, labels) of id and segments; texts are encoded, markers taken as they are."""
    get = encoding_of(rows.sparkSession, path, pattern)

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = get().encode_ordinary
        for pdf in frames:
            tokens, labels = [], []
            for own in pdf["segments"]:
                ids = [([int(x["marker"])] if x["text"] is None else [i + CONTROL_OFFSET for i in encode(x["text"])], x["learned"]) for x in own]
                tokens.append([i for part, _ in ids for i in part])
                labels.append([i if learned else IGNORED for part, learned in ids for i in part])
            yield pd.DataFrame({"id": pdf["id"].astype(str), "tokens": tokens, "labels": labels})

    return rows.select("id", "segments").mapInPandas(on, ENCODED)


def parsed_action(ids: Column, require_end: bool = False) -> Column:
    """struct(kind, thoughts, body, ended) of sampled ids: final, tool, truncated or invalid.

    Markers inside thoughts or body make an action invalid, so a sampled role or result marker is
    never a command.
    """
    none = F.array().cast("array<int>")
    ended = F.coalesce(F.try_element_at(ids, F.lit(-1)) == END, F.lit(False))
    rest = F.when(ended, F.slice(ids, 1, F.size(ids) - 1)).otherwise(ids)
    close = F.array_position(rest, THOUGHT).cast("int")
    opens = F.coalesce(F.try_element_at(rest, F.lit(1)) == THINK, F.lit(False))
    thoughts = F.when(opens & (close > 0), F.slice(rest, F.lit(2), close - 2)).otherwise(none)
    after = F.when(opens, F.when(close > 0, F.slice(rest, close + 1, F.size(rest))).otherwise(none)).otherwise(rest)
    first, body = F.try_element_at(after, F.lit(1)), F.slice(after, F.lit(2), F.size(after))
    clean = ~F.exists(F.concat(thoughts, body), lambda i: i < CONTROL_OFFSET)
    kind = F.when(F.lit(require_end) & ~ended, "truncated").when(clean & (first == FINAL), "final").when(clean & (first == CALL), "tool").otherwise("invalid")
    ok = kind.isin("final", "tool")
    return F.struct(kind.alias("kind"), F.when(ok, thoughts).otherwise(none).alias("thoughts"), F.when(ok, body).otherwise(none).alias("body"), ended.alias("ended"))


def decoded(rows: DataFrame, path: str, pattern: str, offset: int = OFFSET) -> DataFrame:
    """(id, text) of id and tokens: the bytes of all ids from `offset` on; markers are left out."""
    get = encoding_of(rows.sparkSession, path, pattern)

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = get()
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "text": [enc.decode_bytes([i - offset for i in own if i >= offset]).decode("utf-8", "replace") for own in pdf["tokens"]]})

    return rows.select("id", "tokens").mapInPandas(on, "id string, text string")


def round_trip_faults(encoded: DataFrame, texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, fault): encoded documents that don't decode to their text. texts: id, text."""
    own = decoded(encoded, path, pattern).withColumnRenamed("text", "_t")
    return own.join(texts.select(F.col("id").cast("string").alias("id"), "text"), "id").filter(~F.coalesce(F.col("_t") == F.col("text"), F.lit(False))).select("id", F.lit("decodes_differently").alias("fault"))


# ---------------------------------------------------------------- audits and reuse


def supervised(labels: Column) -> Column:
    """Number of labels that count, the first left out as nothing predicts it."""
    return F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != IGNORED))


def audit(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(id, fault) of encoded rows: not a member, missing, bad boundaries, labels that differ, no label."""
    j = rows.join(members.select(F.col("id").cast("string").alias("id"), F.lit(True).alias("_m")), "id", "full")
    off = F.exists(F.arrays_zip("tokens", "labels"), lambda x: (x["labels"] != IGNORED) & (x["labels"] != x["tokens"]))
    fault = (
        F.when(F.col("_m").isNull(), "not_a_member").when(F.col("tokens").isNull(), "missing").when(F.size("tokens") != F.size("labels"), "lengths_differ")
        .when((F.try_element_at("tokens", F.lit(1)) != BEGIN) | (F.try_element_at("tokens", F.lit(-1)) != END), "bad_boundary").when(off, "label_differs").when(supervised(F.col("labels")) == 0, "no_label")
    )
    return j.select("id", fault.alias("fault")).filter("fault is not null")


def reused(rows: DataFrame, parent: DataFrame) -> DataFrame:
    """rows with `reuse`: whether the parent encoding holds the id under the same identity hash.

    Both: id, identity. Rows that can't be reused are to be encoded again.
    """
    p = parent.select("id", F.col("identity").alias("_i"))
    return rows.join(p, "id", "left").withColumn("reuse", F.coalesce(F.col("_i") == F.col("identity"), F.lit(False))).drop("_i")


def chunks(rows: DataFrame, path: str, pattern: str, most: int) -> DataFrame:
    """(id, chunk, begin, end, text): texts cut at token borders, every character kept once.

    A border inside a character moves back to its start.
    """

    get = encoding_of(rows.sparkSession, path, pattern)

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = get()
        for pdf in frames:
            out = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                ids, at, k = enc.encode_ordinary(t or ""), 0, 0
                data = (t or "").encode("utf-8")
                borders, n = [0], 0
                for x, token in enumerate(ids, 1):
                    n += len(enc.decode_single_token_bytes(token))
                    if x % most == 0 or x == len(ids):
                        b = n
                        while b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        if b > borders[-1]:
                            borders.append(b)
                for a, b in zip(borders, borders[1:], strict=False):
                    piece = data[a:b].decode("utf-8")
                    out.append((str(i), k, at, at + len(piece), piece))
                    at, k = at + len(piece), k + 1
            yield pd.DataFrame(out, columns=["id", "chunk", "begin", "end", "text"])

    return rows.select("id", "text").mapInPandas(on, "id string, chunk int, begin long, end long, text string")


def wrapped(text: str, width: int) -> list[str]:
    """Greedy lines of at most `width` characters: by words where there are blanks, by characters in longer words."""
    lines, line = [], ""
    for word in text.split():
        while len(word) > width:
            if line:
                lines.append(line)
                line = ""
            lines.append(word[:width])
            word = word[width:]
        if not line:
            line = word
        elif len(line) + 1 + len(word) <= width:
            line += " " + word
        else:
            lines.append(line)
            line = word
    return [*lines, line] if line else lines

"""Problem 6: texts packed whole into windows of fixed capacity.

Bounded-space online packing: every part keeps a fixed number of open windows, places each
text where it fits best, and emits the fullest window when none fits. What stays open is
merged in rounds, a fixed number of parts at a time, largest texts first, until one part is
left; each merge passes on its emptiest windows only. So no task ever holds more than a bounded
number of texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.sizes import token_sizes
from corpusmill.session import table, written

#: Open windows of a part; texts a part; parts merged at once.
OPEN, PART, FAN = 64, 40_000, 16

_ITEMS = "profile string, capacity long, part long, doc_id long, piece int, tokens long"
_PLACED = _ITEMS + ", window_id string, start long, closed boolean"


def pack(items: list[tuple[int, int]], capacity: int, space: int = OPEN) -> tuple[list[list[int]], list[list[int]]]:
    """(closed, open) windows, each a list of item numbers, of items (number, size) in their order.

    No size may exceed the capacity. A full window is closed at once.
    """
    closed: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, window), sorted
    windows: dict[int, list[int]] = {}
    for k, (number, size) in enumerate(items):
        i = bisect_left(room, (size, -1))
        if i < len(room):
            free, w = room.pop(i)
        else:
            if len(room) == space:
                closed.append(windows.pop(room.pop(0)[1]))
            free, w = capacity, k
            windows[w] = []
        windows[w].append(number)
        if free == size:
            closed.append(windows.pop(w))
        else:
            insort(room, (free - size, w))
    return closed, [windows[w] for _, w in room]


def _packing(turn: int, last: bool, seed: int):
    def on(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, profile, part = int(pdf["capacity"].iloc[0]), pdf["profile"].iloc[0], int(pdf["part"].iloc[0])
        # first pass: in a mixed order, as a stream would come; merges: large ones first
        pdf["h"] = (pdf["doc_id"] * 2654435761 + pdf["piece"] + seed) % 4294967291
        pdf = pdf.sort_values(["h", "doc_id", "piece"] if turn == 0 else ["tokens", "doc_id", "piece"], ascending=turn == 0 or [False, True, True], ignore_index=True)
        sizes = pdf["tokens"].tolist()
        # a merge holds FAN * OPEN windows at most, so there all of them may stay open
        closed, left = pack(list(enumerate(sizes)), capacity, OPEN if turn == 0 else len(sizes))
        if last:
            closed, left = closed + left, []
        elif turn:
            left.sort(key=lambda w: sum(sizes[i] for i in w))
            closed, left = closed + left[OPEN:], left[:OPEN]
        window, start, done = [""] * len(sizes), [0] * len(sizes), [False] * len(sizes)
        for shut, group in ((True, closed), (False, left)):
            for w, members in enumerate(group):
                at = 0
                for i in members:
                    window[i], start[i], done[i] = f"{profile}-{turn}-{part}-{'c' if shut else 'o'}{w}", at, shut
                    at += sizes[i]
        pdf["window_id"], pdf["start"], pdf["closed"] = window, start, done
        return pdf.drop(columns="h")

    return on


def packed(sizes: DataFrame, windows: list[tuple[str, int]], seed: int = 17) -> DataFrame:
    """profile, capacity, window_id, doc_id, piece, start, tokens: where every text lies.

    sizes: doc_id, tokens. A text longer than the capacity is cut into full windows and one
    rest; all others stay whole. Texts without tokens are not placed; a profile whose capacity
    is null or not positive holds nothing.
    """
    spark = sizes.sparkSession
    kinds = [(p, int(c)) for p, c in windows if p is not None and c is not None and c > 0]
    if not kinds:
        return spark.createDataFrame([], "profile string, capacity long, window_id string, doc_id long, piece int, start long, tokens long")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("long").alias("capacity")) for p, c in kinds]))
    long = sizes.filter("tokens > 0").select("doc_id", "tokens", each.alias("w")).select("w.profile", "w.capacity", "doc_id", "tokens")
    number = (F.col("tokens") / F.col("capacity")).cast("long")
    whole = long.filter("tokens >= capacity").select("profile", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), (number - 1).cast("int"))).alias("piece"))
    full = whole.select("profile", "capacity", F.concat_ws("-", "profile", F.lit("f"), "doc_id", "piece").alias("window_id"), "doc_id", "piece", F.lit(0).cast("long").alias("start"), F.col("capacity").alias("tokens"))
    parts = max(1, -(-sizes.count() // PART))
    rest = long.withColumn("piece", number.cast("int")).withColumn("tokens", F.col("tokens") % F.col("capacity")).filter("tokens > 0")
    now = rest.select("profile", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long").alias("part"), "doc_id", "piece", "tokens")
    done, turn = [], 0
    while True:
        last = parts == 1 and turn > 0
        placed = written(now.groupBy("profile", "part").applyInPandas(_packing(turn, last, seed), _PLACED))
        done.append(placed.filter("closed"))
        if last:
            break
        parts = -(-parts // FAN)
        now = placed.filter("not closed").select("profile", "capacity", F.floor(F.col("part") / F.lit(FAN)).cast("long").alias("part"), "doc_id", "piece", "tokens")
        turn += 1
    out = full
    for d in done:
        out = out.unionByName(d.select("profile", "capacity", "window_id", "doc_id", "piece", "start", "tokens"))
    return out


def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, capacity, window_id, doc_id, piece, start, tokens: a row a text or piece of one."""
    sizes = written(token_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"), ""))
    return packed(sizes, [(r.profile, r.capacity) for r in table(spark, sf_dir, "pack_windows").select("profile", "capacity").collect()])


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, capacity, windows, texts, tokens, fill: how full the windows are, by profile."""
    each = placement(spark, sf_dir).groupBy("profile", "capacity", "window_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return each.groupBy("profile", "capacity").agg(F.count("*").alias("windows"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * F.first("capacity")), 6).alias("fill"))

"""Native column expressions: everything here stays in generated code.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markup that a cleaned text should not hold, and control characters.
HTML_TAG = r"(?i)<\s*(?:script|style|div|span|html|body|nav)\b"
#: Ends of lines as Python sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does. An unknown condition doesn't hold."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules], F.lit(None).cast("string"))


def count_of(c: Column, pattern: str) -> Column:
    """Number of matches of a pattern."""
    return F.regexp_count(c, F.lit(pattern))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def han(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^㐀-鿿]", ""))


def latin(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]", ""))


def script_language(c: Column) -> Column:
    """zh if two Han letters or more and a quarter of the Latin ones; en if three Latin letters or
    more and 75 % of all letters; else null."""
    h, a, n = han(c), latin(c), letters(c)
    return F.when((h >= 2) & (4 * h >= a), "zh").when((a >= 3) & (a * 4 >= n * 3), "en")


def repeated_share(c: Column) -> Column:
    """1 - distinct / all of the trimmed lines of more than 20 characters; 0 without such lines.

    The lines are split once: a one-element array hands them on by name.
    """
    lines = F.filter(F.transform(F.split(c, LINE_END), lambda x: F.trim(x)), lambda x: F.length(x) > 20)
    share = lambda x: F.when(F.size(x) > 0, 1 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(F.lit(0.0))
    return F.when(c.isNull(), F.lit(0.0)).otherwise(F.element_at(F.transform(F.array(lines), share), 1))


def plain_fingerprint(c: Column) -> Column:
    """SHA-256 of the text with runs of white space made one space; no other normal form."""
    return F.sha2(F.regexp_replace(c, r"\s+", " "), 256)


def bucket(seed: int | str, key: Column, digits: int = 16, buckets: int = 10_000) -> Column:
    """Hash bucket: the first hexadecimal digits of sha256('seed:key') modulo buckets."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, digits)
    return (F.conv(digest, 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def three_way(b: Column, val: int = 50, test: int = 50) -> Column:
    """val below the first border, test below the second, else train."""
    return F.when(b < val, "val").when(b < val + test, "test").otherwise("train")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def git_blob_sha1(data: Column) -> Column:
    """Name of a blob in git: SHA-1 of 'blob ', its length, NUL and its bytes."""
    raw = data.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string"), F.lit("\x00")).cast("binary"), raw))


def short_id(*parts: Column, prefix: str = "exp-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12))


def escaped_controls(c: Column, tokens: list[str]) -> Column:
    """Each control token with U+2060 behind its first character, so that no encoder takes it as one."""
    for t in tokens:
        c = F.replace(c, F.lit(t), F.lit(t[0] + "⁠" + t[1:]))
    return c


def moved_prefix(c: Column, old: str, new: str) -> Column:
    """Paths under one folder put under another."""
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(c)


def ngrams(words: Column, n: int) -> Column:
    """Array of the n-grams of an array of words, joined by one space; empty if there are fewer."""
    return F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def simple_words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0)


def length_class(c: Column) -> Column:
    """Class of a length: 512, 1024, 2048, 4096, 8192 or over."""
    out = F.lit("over")
    for b in (8192, 4096, 2048, 1024, 512):
        out = F.when(c <= b, str(b)).otherwise(out)
    return F.when(c.isNotNull(), out)


def is_real(c: Column) -> Column:
    """Whether a number is finite; false for null and NaN."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def mode_and_effort(mode: Column, effort: Column) -> Column:
    """struct(mode, effort) with aliases resolved; null where they disagree or are unknown."""
    alias = lambda c: F.when(c == "non-thinking", F.struct(F.lit("direct").alias("m"), F.lit("low").alias("e"))).when(c == "thinking-high", F.struct(F.lit("thinking").alias("m"), F.lit("high").alias("e"))).when(c == "thinking-max", F.struct(F.lit("thinking").alias("m"), F.lit("max").alias("e")))
    by_effort, by_mode = alias(effort), alias(mode)
    m = F.coalesce(by_mode["m"], by_effort["m"], mode)
    e = F.coalesce(by_mode["e"], by_effort["e"], effort)
    e2 = F.coalesce(e, F.lit("low"))
    m2 = F.coalesce(m, F.when(e2.isin("high", "max"), "thinking").otherwise("direct"))
    clash = (by_effort.isNotNull() & mode.isNotNull() & by_mode.isNull() & (mode != by_effort["m"])) | (by_mode.isNotNull() & effort.isNotNull() & by_effort.isNull() & (effort != by_mode["e"]))
    ok = m2.isin("direct", "thinking", "tool") & e2.isin("low", "high", "max") & ~F.coalesce(clash, F.lit(False)) & F.coalesce(mode != "", F.lit(True)) & F.coalesce(effort != "", F.lit(True))
    return F.when(ok, F.struct(m2.alias("mode"), e2.alias("effort")))


# ---------------------------------------------------------------- schedules


def warm_flat_cosine(position: Column, start: int, warmup: int, decay: int, end: int, floor: float = 0.1) -> Column:
    """Factor that rises over warmup, stays 1 until decay and falls by a cosine to floor at end."""
    if not (0 <= start < end and 0 < warmup <= decay - start and decay <= end and 0 <= floor <= 1):
        raise ValueError("schedule borders are out of order")
    rise = F.least(F.lit(1.0), F.greatest(F.lit(1), position - start) / warmup)
    if decay == end:
        return F.when(position < start + warmup, rise).otherwise(F.lit(1.0))
    fall = floor + (1 - floor) * 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), (position - decay) / (end - decay))))
    return F.when(position < start + warmup, rise).when(position <= decay, F.lit(1.0)).otherwise(fall)


_PAIR = re.compile(r"(\d+)\s*:\s*(\d+)")


def parsed_schedule(text: str) -> list[tuple[int, int]]:
    """Milestones of 'seen:target,...'; they must start at 0, increase, and never lower the target."""
    if not text:
        return []
    if not re.fullmatch(rf"\s*{_PAIR.pattern}(?:\s*,\s*{_PAIR.pattern})*\s*", text):
        raise ValueError("a schedule is a list of seen:target pairs")
    seen, target = np.array(_PAIR.findall(text), dtype=np.int64).T
    if seen[0] or np.diff(seen, prepend=-1).min() < 1 or np.diff(target, prepend=0).min() < 0:
        raise ValueError("milestones start at 0 and increase, targets never fall")
    return list(zip(seen.tolist(), target.tolist(), strict=True))


def schedule_target(seen: Column, text: str) -> Column:
    """The target of the last milestone not after `seen` (an as-of lookup in a constant table)."""
    out = F.lit(None).cast("long")
    for milestone, target in parsed_schedule(text):
        out = F.when(seen >= milestone, F.lit(target).cast("long")).otherwise(out)
    return out


def microbatch(capacity: Column, remaining: Column, length: Column, world: int = 1) -> Column:
    """Whole examples of a step: at least one, at most the capacity; null where an input is below 1."""
    ok = (capacity >= 1) & (remaining >= 1) & (length >= 1)
    return F.when(ok, F.least(capacity, F.greatest(F.lit(1), F.floor(remaining / (length * world))))).cast("long")


def crossed(before: Column, after: Column, early_until: int, early: int, later: int) -> Column:
    """Whether a running count crosses a milestone: every `early` until a border, every `later` beyond."""
    div = lambda a, b: F.floor(a / b)
    end = F.lit(early_until)
    first = div(F.least(before, end), F.lit(early)) < div(F.least(after, end), F.lit(early))
    rest = (after > end) & (div(F.greatest(before, end) - end, F.lit(later)) < div(after - end, F.lit(later)))
    return (after > before) & (first | rest)


def frame_indices(count: int, frames: int) -> list[int]:
    """Evenly spread indices of a clip, first and last included; halves round to even."""
    if count < 1 or frames < 1:
        raise ValueError("counts must be positive")
    return [0] * frames if frames == 1 else [round(i * (count - 1) / (frames - 1)) for i in range(frames)]

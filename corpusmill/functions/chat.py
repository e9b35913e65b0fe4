"""Expressions on arrays of turns: struct(role, content, reasoning, tool_calls, tools)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,content:string,reasoning:string,tool_calls:string,tools:string>>"
ROLES = ("system", "user", "assistant", "tool")


def parsed_turns(payload: Column) -> Column:
    """The turns of a JSON record; null if there are none or the JSON is torn.

    Nested values (tool calls) come as their JSON text.
    """
    return F.from_json(F.get_json_object(payload, "$.turns"), TURNS)


def semantic_content(t: Column) -> Column:
    """Reasoning, content, tool calls and tools of a turn, each on its own line."""
    body = F.concat(F.when(F.coalesce(t["reasoning"], F.lit("")) != "", F.concat(t["reasoning"], F.lit("\n"))).otherwise(""), F.coalesce(t["content"], F.lit("")))
    for k in ("tool_calls", "tools"):
        body = F.concat(body, F.when(F.coalesce(t[k], F.lit("")) != "", F.concat(F.lit("\n"), t[k])).otherwise(""))
    return body


def flattened(turns: Column, style: str = "plain") -> Column:
    """Turns as text: plain role:content lines; titled Role: content, blank lines between; lines without them."""
    if style == "plain":
        return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), semantic_content(t))), "\n")
    gap = {"titled": "\n\n", "lines": "\n"}[style]
    return F.array_join(F.transform(turns, lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), F.coalesce(t["content"], F.lit("")))), gap)


def first_user(turns: Column) -> Column:
    """Content of the first user turn; null if there is none."""
    return F.try_element_at(F.filter(turns, lambda t: t["role"] == "user"), F.lit(1))["content"]


def incomplete(turns: Column) -> Column:
    """No turns, or the last is not an assistant's with content."""
    last = F.try_element_at(turns, F.lit(-1))
    return F.coalesce(F.size(turns) <= 0, F.lit(True)) | F.coalesce((last["role"] != "assistant") | (F.trim(F.coalesce(last["content"], F.lit(""))) == ""), F.lit(True))


def invalid(turns: Column) -> Column:
    """Some turn has an unknown role, or neither content nor tool calls."""
    return F.exists(turns, lambda t: F.coalesce(~t["role"].isin(*ROLES), F.lit(True)) | (t["content"].isNull() & t["tool_calls"].isNull()))


def dialogue(turns: Column) -> Column:
    """Only system, user and assistant turns with content, and the last is an assistant's."""
    ok = F.forall(turns, lambda t: F.coalesce(t["role"].isin("system", "user", "assistant") & t["content"].isNotNull(), F.lit(False)))
    return F.coalesce((F.size(turns) > 0) & ok & (F.try_element_at(turns, F.lit(-1))["role"] == "assistant"), F.lit(False))


def direct(turns: Column) -> Column:
    """User and assistant in turn, an even number, no tools, no reasoning."""
    alternate = F.forall(F.transform(turns, lambda t, i: F.coalesce(t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False)) & t["tool_calls"].isNull() & t["tools"].isNull() & (F.coalesce(t["reasoning"], F.lit("")) == "")), lambda x: x)
    return F.coalesce((F.size(turns) > 0) & (F.size(turns) % 2 == 0) & alternate, F.lit(False))


def without_empty_thought(content: Column) -> Column:
    return F.regexp_replace(content, r"^\s*<think>\s*</think>\s*", "")


def valid_preference(chosen: Column, rejected: Column) -> Column:
    """Two answers to one prompt: equal up to the last turn, both ending with an assistant's, and different."""
    head = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    last = lambda c: F.try_element_at(c, F.lit(-1))
    return F.coalesce((F.size(chosen) > 1) & (F.size(rejected) > 1) & (head(chosen) == head(rejected)) & (last(chosen)["role"] == "assistant") & (last(rejected)["role"] == "assistant") & (last(chosen)["content"] != last(rejected)["content"]), F.lit(False))

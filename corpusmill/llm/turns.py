"""Problem 5: user turns without a proper answer, each with its type of defect.

Copies are found by aligning prompt and answer: containment of character shingles first, then
longest common subsequences of tokens. Refusals are found by aligning the sentences of the
answer with refusal templates of five languages (align.py). What is left is looked at for its language
and its ending.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.align import ALIKE, COMPANIONS, REFUSALS, common_length
from corpusmill.llm.base import samples
from corpusmill.llm.language import detect

#: Least share of the answer's shingles that stand in the prompt, and of its tokens in the
#: common subsequence; least length of a copy against the prompt. A copy may be longer than the
#: prompt by any factor: it then gives the prompt back several times.
CONTAINED, ALIGNED, LENGTH = 0.8, 0.8, 0.4
#: Least share of an answer that its refusing sentences make up.
REFUSING = 0.5

_ASKED = {
    "zh": r"chinese|chinesisch|chinois|\bchino\b|中文|汉语|普通话",
    "en": r"english|englisch|anglais|ingl[eé]s|英文|英语",
    "de": r"german\b|deutsch|allemand|alem[aá]n|德文|德语",
    "fr": r"french|französisch|français|franc[eé]s|法文|法语",
    "es": r"spanish|spanisch|espagnol|español|西班牙",
}
_ASKED = {k: re.compile(v, re.I) for k, v in _ASKED.items()}
_THINK = re.compile(r"<(think|thinking|reasoning)>.*?(?:</\1>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^<>\n]{1,200}>|&[a-z]{2,8};|&#\d+;", re.I)
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_ITEM = re.compile(r"^\s*(?:[-*•‣]|\(?\d{1,3}[.)、]|\[[ xX]?\])(?:\s+|$)")
_TOKEN = re.compile(r"[㐀-鿿]|\w+")
_CLOSERS = "\"'”’»)）」』]】*_`~"
_STOPS = ".!?。！？…｡؟$"
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "』": "『", "”": "“"}


def readable(answer: str) -> str:
    """The answer without thinking and markup."""
    return _TAG.sub(" ", _THINK.sub(" ", answer))


def is_empty(answer: str | None) -> bool:
    return answer is None or not any(c.isalnum() for c in readable(answer))


def is_refusal(answer: str) -> bool:
    """Whether sentences that align with refusal templates make up most of the answer."""
    whole = refusing = 0
    before = False
    for s in sentences(readable(answer)):
        whole += len(s)
        before = REFUSALS.score(s) >= ALIKE or (before and COMPANIONS.score(s) >= ALIKE)
        refusing += len(s) * before
    return whole > 0 and refusing >= REFUSING * whole


def sentences(text: str) -> list[str]:
    parts = re.split(r"(?<=[.!?。！？])\s*|\n+", unicodedata.normalize("NFKC", text).strip())
    return [s for p in parts if (s := p.strip())]


def _squeeze(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).casefold())


def is_copy(prompt: str, answer: str) -> bool:
    """Whether the answer is made of the prompt: shingle containment, then common subsequences.

    Each sentence of the answer is aligned with the whole prompt, so sentences that changed
    places, or come several times, still are the prompt's.
    """
    q, a = _squeeze(prompt), _squeeze(readable(answer))
    if not q or not a or len(a) < LENGTH * len(q):
        return False
    if q == a:
        return True
    width = 4 if len(a) >= 8 else 2
    of = lambda s: [s[i : i + width] for i in range(len(s) - width + 1)]
    theirs, each = set(of(q)), of(a)
    inside = lambda c: sum(g in theirs for g in c) / max(1, len(c))
    # in an answer longer than the prompt every place counts: repeats that each have another edit
    if not each or max(inside(set(each)), inside(each) if len(a) > len(q) else 0.0) < CONTAINED:
        return False
    y = _tokens(prompt)
    own = [_tokens(s) for s in sentences(readable(answer))]
    # an edit may have moved the ends of sentences: then a piece is aligned with the prompt twice on end
    return sum(common_length(x, y if len(x) <= len(y) else y * (1 + len(x) // max(1, len(y)))) for x in own) >= ALIGNED * sum(map(len, own))


def other_language(prompt: str, answer: str) -> bool:
    text = unicodedata.normalize("NFKC", _FENCED.sub(" ", readable(answer)))
    has = detect(text)
    if has is None:
        return False
    ask = unicodedata.normalize("NFKC", _FENCED.sub(" ", prompt))
    wants = detect(ask) or detect(ask, 0.5, 1.01)
    if wants is None and re.search("[A-Za-z]", ask):
        wants = "en" if has == "zh" else None
    if wants is None and not re.search("[A-Za-z]", ask):
        return False
    if wants is None:  # a few Latin words without function words: only a clear English prompt
        wants = "en" if re.match(r"(?:describe|read|show|name|list|explain|write|translate|summari[sz]e|compare)\b", ask.strip(), re.I) else has
    return has != wants and not _ASKED[has].search(ask)


def _open(text: str) -> bool:
    """Whether a bracket or a double quote is left open at the end."""
    stack = []
    for c in text:
        if c in "([{（【「『“":
            stack.append(c)
        elif c in _PAIRS:
            if stack and stack[-1] == _PAIRS[c]:
                stack.pop()
    return bool(stack)


def _code_breaks_off(code: str) -> bool:
    """Whether brackets, strings or a statement stay open at the end of the code."""
    if code.count('"""') % 2 or code.count("'''") % 2:
        return True
    bare = re.sub(r'""".*?"""|\'\'\'.*?\'\'\'', "''", code, flags=re.S)
    bare = re.sub(r"(?m)#.*$", "", bare)
    bare = re.sub(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', "''", bare)
    last = bare.rstrip().rsplit("\n", 1)[-1].rstrip()
    return _open(bare) or '"' in last or bool(re.search(r"(?:[=+\-*/%,(\[{\\.]|\b(?:def|return|in|and|or|not|if|for|import|from|while|class|lambda|is|with|as))$", last)) or bool(re.match(r"\s*(?:def|class|if|for|while|with|else|try)\b.*:$", last)) or bool(re.match(r"\s*(?:def|class)\b(?!.*:)", last))


def is_truncated(answer: str) -> bool:
    """Whether the answer stops before its last sentence, entry, bracket, block or value ends."""
    text = _THINK.sub(" ", unicodedata.normalize("NFKC", answer)).rstrip()
    while text and (text[-1].isspace() or (text[-1] not in "`^" and unicodedata.category(text[-1]) in ("So", "Sk", "Cf", "Mn", "Co", "Cn"))):
        text = text[:-1]
    if not text:
        return False
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        body = text[: -3].rsplit("```", 1)[-1]
        return _code_breaks_off(body.partition("\n")[2])
    if text.lstrip()[0] in "{[" and re.match(r"\s*(?:\{\s*(?:\"|$)|\[\s*[\[{\"\d])", text):
        try:
            json.loads(text)
            return False
        except ValueError:
            return _open(text) or text.count('"') % 2 == 1
    last = text.rsplit("\n", 1)[-1]
    if last.lstrip().startswith("|"):
        return not last.endswith("|")
    if _ITEM.match(last + " "):
        rest = _ITEM.sub("", last + " ").strip()
        if not any(c.isalnum() for c in rest) or _open(last) or rest[-1] in ",:;-–(":
            return True
        others = [x.rstrip() for x in text.split("\n")[:-1] if _ITEM.match(x + " ")]
        return bool(others) and all(x[-1] in _STOPS for x in others) and rest.rstrip(_CLOSERS)[-1:] not in _STOPS
    if re.match(r"\s*(?:def |class |import |from \w+ import|return |for .* in |while |if .*:)", last) or re.search(r"(?m)^(?:def |class |import )", text):
        return _code_breaks_off(text)
    bare = text.rstrip("".join(c for c in _CLOSERS if c not in ")]）】")) if not text.endswith(tuple("\"”»")) else text
    core = text.rstrip(_CLOSERS)
    if core and core[-1] in _STOPS:
        tail = re.split(r"(?<=[.!?。！？])\s", text)[-1]
        return _open(tail) and tail.count("(") != tail.count(")") and not re.search(r"[.!?。！？][\"'”’»)）]*$", tail)
    if text[-1] in ")）]】" and not _open(last):
        return False  # a name or a reference in brackets ends it
    end = bare[-1] if bare else text[-1]
    if end in ",;:、，；：-–—(（[【{“\"«=+":
        return True
    if _open(last):
        return True
    # no full stop: a word, a name or a value is an answer; a sentence is not at its end
    if re.search(r"[.!?。！？](?:[\"'”’»)）]*)(?:\s|$)", text[:-1]) or re.search(r"[。！？]", text):
        return True
    han = len(re.findall("[㐀-鿿]", text))
    words = len(text.split())
    if han:
        return han > 12 or "，" in text
    return words > 5 or bool(re.search(r"\b(?:because|weil|denn|parce que|car|porque|that|the|and|of|der|die|das|und|que|de|la|le|el|y|et)$", text, re.I))


def defect(prompt: str | None, answer: str | None) -> str | None:
    """The defect of an answer; the first that fits of empty, refusal, copy, language, truncation."""
    if is_empty(answer):
        return "empty_answer"
    prompt = prompt or ""
    if is_refusal(answer):
        return "refusal"
    if is_copy(prompt, answer):
        return "question_copy"
    if other_language(prompt, answer):
        return "other_language"
    return "truncated_answer" if is_truncated(answer) else None


def exchanges(payload: str | None) -> list[tuple[int, str | None, str | None]]:
    """(turn, prompt, answer) of every user turn; [] if the payload holds no readable turns."""
    if payload is None or '"turns"' not in payload:
        return []
    try:
        turns = json.loads(payload).get("turns")
    except (ValueError, AttributeError):
        return []
    out: list[tuple[int, str | None, str | None]] = []
    for i, t in enumerate(turns if isinstance(turns, list) else []):
        if not isinstance(t, dict):
            continue
        content = t.get("content")
        content = content if isinstance(content, str) else None
        if t.get("role") == "user":
            out.append((i, content, None))
        elif t.get("role") == "assistant" and out and not (t.get("tool_calls") and not (content or "").strip()):
            out[-1] = (*out[-1][:2], content)
    return out


def defects(records: DataFrame) -> DataFrame:
    """(id, turn, defect) of id and payload. Repeated rows count once; bad payloads have none."""

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, turn, d) for i, p in zip(pdf["id"], pdf["payload"], strict=True) if i is not None for turn, q, a in exchanges(p) if (d := defect(q, a))]
            yield pd.DataFrame(rows, columns=["id", "turn", "defect"])

    return records.select("id", "payload").filter(F.col("payload").contains('"turns"')).mapInPandas(on, "id string, turn int, defect string").distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, turn, defect: one row a user turn with a defective answer.

    Null, torn or turnless payloads give no row; a user turn that nothing follows is
    empty_answer; a user turn without content can be answered, but not copied.
    """
    return defects(samples(spark, sf_dir, "id", "payload"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, defect, turns, records: defects by source."""
    from corpusmill.functions.labels import source_key

    own = samples(spark, sf_dir, "id", "source").dropDuplicates(["id"]).select("id", source_key(F.col("source")).alias("source"))
    return found(spark, sf_dir).join(own, "id").groupBy("source", "defect").agg(F.count("*").alias("turns"), F.countDistinct("id").alias("records"))

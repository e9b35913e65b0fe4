"""Queries without SQL against plain Python over the same tables."""

import ast
import hashlib
import itertools
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
import tiktoken

from corpusmill.operators import encode
from corpusmill.plans.catalog import QUERIES
from corpusmill.plans.relational import PATTERN, RANKS

DATA = "/root/testdata/sf0.001"
BY_HAND = {}


def by_hand(f):
    BY_HAND[f.__name__] = f
    return f


def frame(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def records():
    return frame("samples").drop_duplicates("id")


def sha(t):
    return hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()


def squeezed(t):
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", t).strip().casefold())


def grams(t):
    s = squeezed(t)
    return {s[i : i + 5] for i in range(max(1, len(s) - 4))}


def encoding(name="byte_bpe_50k"):
    import base64

    with open(RANKS.replace("byte_bpe_50k", name), "rb") as f:
        return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}, special_tokens={})


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


@by_hand
def normal_forms(got):
    d = frame("documents").dropna(subset=["text"])
    question = lambda t: re.sub(r"[\s，。！？,.!?]", "", unicodedata.normalize("NFKC", t).strip().casefold())
    want = {(i, sha(unicodedata.normalize("NFKC", t).replace("\0", "").strip()), sha(squeezed(t)), sha(question(t)), sha(" ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())))) for i, t in zip(d.doc_id, d.text, strict=True)}
    assert rows(got, "doc_id", "normalized", "squeezed", "question", "words") == want


def _stored(x):
    x = None if x is None else re.sub("^0x", "", x.strip(" ").lower())
    return int(x, 16) if x and re.fullmatch("[0-9a-f]{1,16}", x) else None


@by_hand
def admission_order(got):
    r = records()
    value = {i: _stored(s) for i, s in zip(r.id, r.simhash, strict=True)}
    question = dict(zip(r.id, r.first_question, strict=True))
    kept, asked = [], {}
    for i in sorted(value):
        near = value[i] and any(value[j] and (value[i] ^ value[j]).bit_count() <= 3 for j in kept)
        if not near and (not question[i] or asked.get(question[i], 0) < 3):
            kept.append(i)
            asked[question[i]] = asked.get(question[i], 0) + 1
    assert rows(got, "node", "kept") == {(i, i in set(kept)) for i in value}


@by_hand
def stored_simhash_check(got):
    r, want = records(), set()
    for i, t, s in zip(r.id, r.text, r.simhash, strict=True):
        own, bits = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams(t)], 0
        for b in range(64):
            bits |= (2 * sum(h >> b & 1 for h in own) >= len(own)) << b
        want.add((i, "missing" if _stored(s) is None else "equal" if _stored(s) == bits else "differs"))
    assert rows(got, "id", "state") == want


@pytest.mark.parametrize("name", ["shingle_pairs", "shingle_holdout_audit"])
def test_pairs_of_shingle_sets_by_hand(spark, name):
    r = records()
    sets = {i: grams(t) for i, t in zip(r.id, r.text, strict=True)}
    split = dict(zip(r.id, r.split, strict=True))
    want = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and (name == "shingle_pairs" or {split[a], split[b]} & {"val", "test"}):
            want.add((a, b, both, len(sets[a]) + len(sets[b]) - both))
    assert rows(QUERIES[name](spark, DATA), "a", "b", "overlap", "united") == want


@by_hand
def tokenizer_comparison(got):
    d = frame("documents").dropna(subset=["text"])
    size = sum(len(t.encode()) for t in d.text)
    want = {(n, sum(len(encoding(n).encode_ordinary(t)) for t in d.text), size) for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    assert rows(got, "tokenizer", "tokens", "bytes") == want


@by_hand
def encoded_windows(got):
    d, e = frame("documents").dropna(subset=["text"]), encoding()
    assert rows(got, "id", "tokens", "supervised") == {(str(i), n + 2, n + 1) for i, t in zip(d.doc_id, d.text, strict=True) for n in [len(e.encode_ordinary(t))]}


@by_hand
def token_chunks(got):
    d = frame("documents").dropna(subset=["text"])
    text, e, at = dict(zip(d.doc_id.astype(str), d.text, strict=True)), encoding(), {}
    for r in sorted(got.collect(), key=lambda r: (r.id, r.chunk)):
        assert r.begin == at.get(r.id, 0) and len(e.encode_ordinary(text[r.id][r.begin : r.end])) <= 256 + 8
        at[r.id] = r.end
    assert at == {i: len(t) for i, t in text.items() if t}


@by_hand
def encoded_chats(got):
    r, e, want = records(), encoding(), set()
    for i, p in zip(r.id, r.payload, strict=True):
        try:
            turns = json.loads(p)["turns"]
        except (ValueError, KeyError, TypeError):
            continue
        if not turns or any(t["role"] not in encode.ROLE_IDS for t in turns) or any(t.get("content") is None and t.get("tool_calls") is None for t in turns):
            continue
        size = [1 + len(e.encode_ordinary("\n".join([t.get("content") or "", *[json.dumps(t[k], ensure_ascii=False, separators=(",", ":")) for k in ("tool_calls", "tools") if t.get(k)]]))) for t in turns]
        plain = not any(t.get("tool_calls") for t in turns)
        want.add((i, 1 + sum(size) + len(size) if plain else None, sum(n for n, t in zip(size, turns, strict=True) if t["role"] == "assistant") if plain else None))
    plain = {i for i, n, _ in want if n is not None}
    assert {(i, n if i in plain else None, s if i in plain else None) for i, n, s in rows(got, "id", "tokens", "supervised")} == want


@by_hand
def python_syntax(got):
    r, want = records(), set()
    for i, t in zip(r.id[r.task == "code"], r.text[r.task == "code"], strict=True):
        try:
            tree = ast.parse(t)
        except (SyntaxError, ValueError):
            want.add((i, "not_parseable_python3", None))
            continue
        some = any(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) for n in ast.walk(tree))
        want.add((i, None, sha(ast.dump(tree))) if some else (i, "no_function_or_class", None))
    assert rows(got, "id", "reason", "ast_sha256") == want


@by_hand
def wrapped_lines(got):
    d, want = frame("documents").dropna(subset=["text"]), set()
    for i, t in zip(d.doc_id, d.text, strict=True):
        n, used = 0, 61
        for w in t.split():
            if len(w) > 60:
                full, rest = divmod(len(w), 60)
                full, rest = (full, rest) if rest else (full - 1, 60)
                n, used = n + full + 1, rest
            elif used + 1 + len(w) <= 60:
                used += 1 + len(w)
            else:
                n, used = n + 1, len(w)
        want.add((i, n))
    assert rows(got, "doc_id", "lines") == want


@by_hand
def embedding_pictures(got):
    k = np.arange(32)
    wave = np.cos(np.pi * np.outer(np.arange(8), 2 * k + 1) / 64)
    want = set()
    for i, v in zip(*(frame("embeddings")[c] for c in ("vec_id", "embedding")), strict=True):
        v = np.asarray(v, dtype=np.float64)
        terms = (wave @ np.outer(v[k % len(v)], v[(k + 7) % len(v)]) @ wave.T).ravel()
        want.add((i, f"{int(''.join('1' if t > np.median(terms[1:]) else '0' for t in terms), 2):016x}"))
    assert rows(got, "vec_id", "phash") == want


def _sized():
    d = frame("documents")
    return {i: len(t) if t is not None else 0 for i, t in zip(d.doc_id, d.text, strict=True)}


@by_hand
def pack_records(got):
    n, most, packs, seen = _sized(), max(8192, *_sized().values()), {}, []
    for r in sorted(got.collect(), key=lambda r: (r.shard, r["pack"], r.segment)):
        own = packs.setdefault((r.shard, r["pack"]), [])
        assert r.segment == len(own) and r.start == sum(own) and r.n == n[r.doc_id]
        own.append(r.n)
        seen.append(r.doc_id)
    assert sorted(seen) == sorted(n) and all(sum(p) <= most for p in packs.values())
    assert all(sum(packs[s, k]) + packs[s, k + 1][0] > most for s, k in packs if (s, k + 1) in packs)


@by_hand
def microbatches(got):
    n, batches, seen = _sized(), {}, []
    for r in sorted(got.collect(), key=lambda r: (r.shard, r.doc_id)):
        batches.setdefault((r.shard, r.batch), []).append((r.n, r.source))
        seen.append(r.doc_id)
    assert sorted(seen) == sorted(n)
    for (s, k), own in batches.items():
        assert len(own) <= 8 and len({x for _, x in own}) == 1 and (len(own) == 1 or max(a for a, _ in own) * len(own) <= 16_384)
        if nxt := batches.get((s, k + 1)):
            more = [*own, nxt[0]]
            assert len(more) > 8 or len({x for _, x in more}) > 1 or max(a for a, _ in more) * len(more) > 16_384


@by_hand
def identity_quota(got):
    n, shards = _sized(), {}
    for r in got.collect():
        shards.setdefault(r.shard, []).append((r.doc_id, r.n, r.flag, r.kept))
    assert sum(map(len, shards.values())) == len(n)
    for own in shards.values():
        all_ = flagged = 0
        for i, x, flag, kept in sorted(own):
            assert x == n[i] and flag == (i % 7 == 0) and kept == (not flag or flagged + x <= 0.005 * (all_ + x))
            all_, flagged = all_ + x * kept, flagged + x * (kept and flag)


@by_hand
def media_mixture(got):
    r, kinds = records(), {}
    for i, p in zip(r.id, r.payload, strict=True):
        try:
            m = json.loads(p or "{}").get("media") or []
        except (ValueError, AttributeError):
            m = []
        kinds[i] = m[0].get("kind", "image") if m else "text"
    out = sorted(got.collect(), key=lambda x: x.position)
    assert [x.position for x in out] == list(range(len(out))) and all(kinds[x.id] == x.kind for x in out)
    pictures = [(x.id, x.epoch) for x in out if x.kind != "text"]
    assert sorted(pictures) == sorted((i, e) for i, k in kinds.items() if k != "text" for e in (0, 1))
    assert all(x.epoch == 0 for x in out if x.kind == "text")


@by_hand
def fraction_documents(got):
    out = got.collect()
    assert len(out) == len(frame("supplier")) and len({tuple(r) for r in out}) > 1


@by_hand
def math_documents(got):
    out = got.collect()
    assert len(out) == len(frame("supplier")) and all(r.check for r in out) and len({r.kind for r in out}) == 6
    for r in out:
        n = [int(x) for x in re.findall(r"-?\d+", r.text)]
        assert n[-1] == r.value
        want = {"divisor": lambda: np.gcd(n[0], n[1]), "mean": lambda: sum(n[:4]) / 4, "polynomial": lambda: n[0] * n[4] ** 2 + n[2] * n[4] + n[3], "equation": lambda: (n[2] - n[1]) / n[0], "remainder": lambda: n[0] % n[1], "percent": lambda: n[0] * n[1] / 100}
        assert want[r.kind]() == r.value, r


@by_hand
def arithmetic_tasks(got):
    out = got.collect()
    assert len(out) == len(frame("supplier")) and all(eval(r.question[8:-1]) == int(r.answer) for r in out)  # noqa: S307


@by_hand
def shuffled_scan(got):
    n = len(frame("part"))
    out = got.collect()
    assert sorted(r.place for r in out) == list(range(100, n)) and len({r.p_partkey for r in out}) == n - 100
    assert [r.p_partkey for r in sorted(out, key=lambda r: r.place)] != sorted(r.p_partkey for r in out)


@pytest.mark.parametrize("name", sorted(BY_HAND))
def test_same_as_by_hand(spark, name):
    BY_HAND[name](QUERIES[name](spark, DATA))

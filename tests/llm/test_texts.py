"""Problems 2, 5, 6, 7 and 8."""

import base64
import json
import random

import pytest
import tiktoken

from corpusmill.llm import align, mixing, packing, quality, sizes, tokens, turns
from corpusmill.llm.bpe import PATTERN, TOKENIZERS, Counter, read_ranks
from corpusmill.llm.shape import Shape

from .conftest import document, sample


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_counts_equal_a_real_encoder(name):
    data = read_ranks(TOKENIZERS, name)
    own = Counter(data)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    real = tiktoken.Encoding("real", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for alphabet in ("ab ", "aé漢字 \n", "thequickbrown fox.,'", "0123 =+-\t", "😀a​ "):
        for _ in range(150):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))
            assert own(t) == len(real.encode_ordinary(t)), t
    for t in ("", "a" * 5000, "漢" * 3000, "ab" * 4000, " " * 3000):
        assert own(t) == len(real.encode_ordinary(t))


def test_budget_totals(spark, folder):
    rows = [sample("a", "the cat and the dog are in the house", source=" S_one", task="t", payload='{"lang": "zh"}'), sample("b", None, source="s-ONE"), sample("c", "la casa de los perros y el gato en la calle", source="two", task=" ")]
    d = folder(samples=rows + rows[:1], source_specs=[("s-one", "r", "l", "pretrain", "own", ["en"])])
    got = {(r.source, r.lang, r.task): (r.records, r.chars) for r in tokens.budget(spark, d).collect()}
    assert got["(all)", "(all)", "(all)"] == (3, 36 + 43) and got["s-one", "en", "t"] == (1, 36) and got["s-one", "en", "own"] == (1, 0) and got["two", "es", "unknown"] == (1, 43)
    assert tokens.budget(spark, folder()).filter("records > 0").count() == 0


def test_files_of_one_name_are_told_apart(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the mill", "the mill")], "doc_id long, text string, t string").select("doc_id", "text")
    data = read_ranks(TOKENIZERS, "byte_bpe_50k.tiktoken")
    few = b"\n".join(line for line in data.splitlines() if len(base64.b64decode(line.split()[0])) == 1)
    (tmp_path / "byte_bpe_50k.tiktoken").write_bytes(few)
    own = rows.select("doc_id", "text")
    assert [sizes.token_sizes(own, "", f, "byte_bpe_50k.tiktoken").first().tokens for f in (TOKENIZERS, str(tmp_path))] == [2, 8]


ASK = "The old mill stands near the river. What is the role of the wheel in it?"
CASES = [
    ("", "empty_answer"), (None, "empty_answer"), ("<think>The wheel is old and it turns.</think>\n", "empty_answer"), ("**\n**", "empty_answer"), ("…", "empty_answer"),
    ("I'm sorry, but I can't help with the wheel.", "refusal"), ("Leider kann ich dazu nichts sagen.", "refusal"), ("Je préfère ne pas en parler, il m'est impossible de répondre.", "refusal"), ("对不起，这个请求我不能处理。", "refusal"), ("No puedo responder a eso.", "refusal"),
    ("The old mill stands near the river.\n\nWhat is the role of the wheel in it?", "question_copy"), ("> what is the role of the wheel in it? THE OLD MILL STANDS NEAR THE RIVER.", "question_copy"),
    ("Das Rad ist nicht alt, und es dreht sich mit dem Wasser von dem Fluss.", "other_language"), ("这说明轮子和水流之间存在安静的联系。", "other_language"),
    ("The wheel turns with the water. It then drives the mill st", "truncated_answer"), ('{"name": "wheel", "values": [1, 2', "truncated_answer"), ("It is like this.\n\n```python\ndef f(x):\n    return x", "truncated_answer"), ("The steps are:", "truncated_answer"), ("1. The wheel turns.\n2. The mill runs.\n3.", "truncated_answer"),
    ("The wheel turns with the water and drives the mill.", None), ("Wheel", None), ("313 hours", None), ("x = 606", None), ("1. wheel\n2. stone (old)\n3. river", None), ('{"name": "wheel", "values": [1, 2]}', None), ("It does.\n\n```python\ndef f(x):\n    return x\n```", None), ("It drives the mill. 🙂", None), ("It turns. — “It drives the mill.”", None),
    ("Unfortunately the wheel broke last year, but a pump can take its place. It is in the barn.", None), (ASK + " It drives the stones, and the stones grind the grain of the whole valley. The grain is then kept in the barn until the first winter.", None),
]


@pytest.mark.parametrize(("answer", "want"), CASES)
def test_defects(answer, want):
    assert turns.defect(ASK, answer) == want


def test_common_subsequences_equal_the_table():
    rng = random.Random(5)
    for _ in range(200):
        x, y = ([rng.choice("abcdef") for _ in range(rng.randrange(90))] for _ in "xy")
        row = [0] * (len(y) + 1)
        for t in x:
            last = row[:]
            for j, u in enumerate(y):
                row[j + 1] = last[j] + 1 if t == u else max(last[j + 1], row[j])
        assert align.common_length(x, y) == row[-1]
    assert align.common_length(["a"] * 5_000, ["a", "b"] * 3_000) == 3_000


def test_templates_take_gaps_but_not_other_orders():
    t = align.Templates(["i|we cannot help|answer", "无法 回答"])
    assert t.score("We really cannot, sadly, answer that") > 0.9 and t.score("I cannot for any reason of this wide and old world help") < align.ALIKE
    assert t.score("help cannot i") < align.ALIKE and t.score("我无法为您回答") > 0.9 and t.score("") == 0


@pytest.mark.parametrize("text", ["We cannot breathe under water because lungs need air.", "No, I will not be closed on Monday.", "The wheel cannot turn without water. I have seen it.", "Je ne suis pas grand.", "Ich kann das Rad nicht sehen.", "No puedo ver la rueda desde aquí.", "水太冷，鱼不能游泳。", "You must not touch the wheel while it turns."])
def test_sentences_that_do_not_refuse(text):
    assert turns.defect(ASK, text) != "refusal"


@pytest.mark.parametrize("text", ["Sorry, but we can't really provide that.", "I would prefer not to discuss it.", "I must respectfully decline.", "Dazu kann ich Ihnen leider keine Auskunft geben.", "Ich möchte darüber lieber nicht sprechen.", "Je ne peux malheureusement pas vous aider.", "Lamento decirte que no podemos responder.", "抱歉，我暂时无法为您提供这方面的信息。"])
def test_refusals_of_other_wordings(text):
    assert turns.defect(ASK, text) == "refusal" and turns.defect(ASK, text * 40) == "refusal"


@pytest.mark.parametrize("times", [2, 3, 7])
def test_prompts_given_back_several_times(times):
    ask = "Which of the old wheels in the valley still turns with the water of the river?"
    assert turns.defect(ask, " ".join([ask] * times)) == "question_copy"
    edited = " ".join(ask.replace(w, "engine") for w in ("valley", "river", "wheels", "water", "Which", "still", "turns")[:times])
    assert turns.defect(ask, edited) == "question_copy"
    assert turns.defect(ask, ask + " Only the third one, behind the mill, has been repaired since the flood; all others are kept for show." * times) != "question_copy"


def test_long_refusals():
    declines = "I'm sorry, but I can't help with the wheel. I cannot discuss the mill, and I won't talk about the river either. "
    assert turns.defect(ASK, declines * 20) == "refusal"
    assert turns.defect(ASK, declines + "The wheel turns with the water and drives the mill. " * 40) != "refusal"


def test_language_that_was_asked_for():
    answer = "Das Rad ist nicht alt, und es dreht sich mit dem Wasser von dem Fluss."
    assert turns.defect("Translate into German: the wheel is not old and it turns.", answer) is None
    assert turns.defect("Translate into French: the wheel is not old and it turns.", answer) == "other_language"


def test_turn_numbers(spark, folder):
    u, a = lambda c: {"role": "user", "content": c}, lambda c, **k: {"role": "assistant", "content": c, **k}
    talk = [{"role": "system", "content": ""}, u("What is a mill?"), a(None, tool_calls=[{"name": "f"}]), {"role": "tool", "content": "x"}, a("It grinds the grain of the valley."), u("And the wheel?"), a("It turns."), a(""), u("Why?")]
    rows = [sample("a", turns=talk), sample("b", turns=[]), sample("c", payload="null"), sample("d", payload='{"turns": 5}'), sample("e", payload='{"turns": [3, {"role": "user"}]}'), sample("f", turns=[u("x"), a(None, tool_calls=[{"n": 1}])]), (None, *sample("g", turns=talk)[1:])]
    got = {(r.id, r.turn): r.defect for r in turns.found(spark, folder(samples=rows + rows[:1])).collect()}
    assert got == {("a", 5): "empty_answer", ("a", 8): "empty_answer", ("e", 1): "empty_answer", ("f", 0): "empty_answer"}
    assert turns.found(spark, folder()).count() == 0


def test_packing_places_every_token_once(spark, folder):
    rng = random.Random(2)
    docs = [document(k, " ".join(["word"] * rng.choice([1, 5, 40, 400, 3000]))) for k in range(120)] + [document(900, None), document(901, "")]
    d = folder(documents=docs, pack_windows=[("s", 64), ("l", 1000), ("none", None), ("zero", 0)])
    rows = packing.placement(spark, d).collect()
    for profile, capacity in (("s", 64), ("l", 1000)):
        own = [r for r in rows if r.profile == profile]
        by_doc, by_window = {}, {}
        for r in own:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_window.setdefault(r.window_id, []).append(r)
        sizes = {r.doc_id: sum(x.tokens for x in by_doc[r.doc_id]) for r in own}
        assert sizes == {r[0]: len(r[1].split()) for r in docs if r[1]}  # one token a word
        assert all(len(p) == 1 for i, p in by_doc.items() if sizes[i] <= capacity)
        for w in by_window.values():
            w.sort(key=lambda r: r.start)
            assert [r.start for r in w] == [sum(x.tokens for x in w[:k]) for k in range(len(w))] and sum(r.tokens for r in w) <= capacity
        fill = sum(sizes.values()) / (capacity * len(by_window))
        assert fill > 0.9
    assert {r.profile for r in rows} == {"s", "l"} and packing.placement(spark, folder()).count() == 0


def test_packing_in_many_parts(spark):
    rng = random.Random(5)
    sizes = spark.createDataFrame([(k, rng.randrange(1, 90)) for k in range(3000)], "doc_id long, tokens long")
    before, packing.PART = packing.PART, 100
    try:
        rows = packing.packed(sizes, [("p", 100)]).collect()
    finally:
        packing.PART = before
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert sum(r.tokens for r in rows) / (100 * len({r.window_id for r in rows})) > 0.93


def test_best_fit():
    closed, left = packing.pack([(0, 6), (1, 5), (2, 4), (3, 5), (4, 9)], 10, 2)
    assert sorted(closed) == [[0, 2], [1, 3]] and left == [[4]]


def test_sainte_lague():
    assert mixing.sainte_lague({"a": 53.0, "b": 24.0, "c": 23.0}, 7) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 9.0, "b": 1.0}, 10, {"a": 4}) == {"a": 4, "b": 6}
    assert mixing.sainte_lague({}, 5) == {} and mixing.sainte_lague({"a": 0.0}, 5) == {"a": 0}


def test_sainte_lague_of_many_seats_equals_the_loop():
    rng = random.Random(4)
    for _ in range(60):
        weights = {k: rng.choice([1.0, 2.0, rng.random() * 50]) for k in range(rng.randrange(1, 9))}
        caps = {k: rng.choice([0, 3, 400, 10**6]) for k in weights if rng.random() < 0.5}
        seats = rng.choice([0, 1, 7, 500])
        held = dict.fromkeys(weights, 0)
        for _ in range(seats):
            free = [k for k in weights if held[k] < caps.get(k, 10**9)]
            if free:
                held[min(free, key=lambda k: (-weights[k] / (2 * held[k] + 1), k))] += 1
        assert mixing.sainte_lague(weights, seats, caps) == held
    assert sum(mixing.sainte_lague({"a": 2.0, "b": 1.0}, 10**12).values()) == 10**12


def test_mixture_meets_shares(spark):
    rows = [(k, "abc"[k % 3], 10 + k % 7) for k in range(6000)] + [(9000 + k, "d", 10) for k in range(100)] + [(9999, "e", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = [("a", 0.5, 1), ("b", 0.2, 2), ("d", 0.1, 3), ("gone", 0.2, 4), ("e", 0.1, 1), (None, 1.0, 1)]
    done = mixing.mixed(df, targets, 30_000).collect()
    total = sum(r.tokens * r.repeats for r in done)
    share = {s: sum(r.tokens * r.repeats for r in done if r.source == s) / total for s in "abd"}
    assert abs(total - 30_000) < 1_000 and abs(share["a"] - 0.625) < 0.03 and abs(share["b"] - 0.25) < 0.03 and abs(share["d"] - 0.1) < 0.02
    assert len({r.doc_id for r in done}) == len(done) and max(r.repeats for r in done if r.source == "d") == 3 and max(r.repeats for r in done if r.source == "a") == 1
    assert mixing.mixed(df.limit(0), [("a", 1.0, 1)]).count() == 0


def test_what_a_capped_source_leaves_goes_to_the_others(spark):
    rows = [(k, "abc"[k % 3], 300) for k in range(900)] + [(9000 + k, "d", 300) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    done = mixing.mixed(df, [("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("d", 0.2, 4)]).collect()
    of = lambda s: sum(r.tokens * r.repeats for r in done if r.source == s)
    total = sum(map(of, "abcd"))
    assert abs(total - 910 * 300) < 2_000 and of("d") == 4 * 3_000 and all(r.repeats == 4 for r in done if r.source == "d")
    assert of("a") <= 90_000 and abs(of("a") - 90_000) < 1_500  # its epochs stop it as well
    assert abs(of("b") / of("c") - 1.5) < 0.05
    again = {(r.doc_id, r.repeats) for r in mixing.mixed(df, [("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("d", 0.2, 4)]).collect()}
    assert again == {(r.doc_id, r.repeats) for r in done}


def test_shards_share_a_quota(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 50)
    df = spark.createDataFrame([(k, "a", 100 + k % 50) for k in range(1_000)], "doc_id long, source string, tokens long")
    whole = sum(100 + k % 50 for k in range(1_000))
    done = mixing.mixed(df, [("a", 1.0, 3)], 2 * whole + whole // 2).collect()
    assert abs(sum(r.tokens * r.repeats for r in done) - 2.5 * whole) < 0.03 * 2.5 * whole and {r.repeats for r in done} <= {2, 3} and len(done) == 1_000


def test_mixture_report(spark, folder):
    d = folder(documents=[document(k, "some words of a text " * 30, " A_x") for k in range(50)], mix_targets=[("a-x", 0.5, 1), ("none", 0.5, 2)])
    got = {r.source: r for r in mixing.report(spark, d).collect()}
    assert got["a-x"].reached == 1 and got["none"].reached == 0 and got["a-x"].target == 0.5


def test_report_shows_capped_sources(spark, folder):
    text = "The mill stands near the river and grinds the grain of the valley. " * 40
    docs = [document(k, text, source="big") for k in range(60)] + [document(100 + k, text, source="small") for k in range(2)] + [document(200, None, source="big")]
    d = folder(documents=docs, mix_targets=[("big", 0.5, 2), ("small", 0.5, 3)])
    got = {r.source: r for r in mixing.report(spark, d).collect()}
    assert got["small"].capped and not got["big"].capped and 2.5 < got["small"].epochs <= 3 and got["small"].reached < 0.15
    assert abs(got["big"].tokens + got["small"].tokens - got["big"].available - got["small"].available) < 0.05 * got["big"].available
    assert max(r.repeats for r in mixing.mixture(spark, d).filter("source = 'small'").collect()) <= 3


PROSE = "The mill stands near the river, and the wheel turns with the water. It was the old stone, not the wheel, that made it slow."
SHAPES = [
    (PROSE, None), ("def f(x):\n    return x + 1\n\nclass A:\n    def g(self):\n        return 2", None), ("user:What is it?\nassistant:It is the wheel of the mill near the river.", None), ("因为土壤的变化，花粉很少延缓了细密的花粉。没有田埂，可靠的种子就无法在清晨保持原样。", None),
    ("Since 12 * 4 = 48, the remainder after division by 5 is 3. Let a = 7 and b = 9; then 3a + b = 30.", None), (PROSE.replace(" ", "\n"), None),
    ("- wheel\n- old stone\n- river", "list"), ("1. wheel\n2. old stone\n3. river", "list"), ("red wheel; old stone; river; copper lantern; willow", "list"), ("Wheel\nOld stone\nRiver bank\nCopper lantern", "list"), ("· 潮湿的订单\n· 预算\n· 结果", "list"), ("1.1 wheel ........ 4\n1.2 stone ........ 9", "list"),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "table"), ("a,b,c\n1,2,3\n4,5,6", "table"), ("a\tb\tc\n1\t2\t3\n4\t5\t6", "table"), ("<tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr>", "table"), ('"der Hebel";"7"\n"der Stein";"8"', "table"), ("wheel     stone     river\n12        13        14\n15        16        17", "table"),
    ("åœ¨äºšæ©å¾·æ ¼æ¢…ï¼Œç»“æžœä¸€èˆ¬ç”±å¸¸è§çš„ä½™é¢æ¥è§£é‡Š", "junk"), ("T�e r�po�� �n t�e m�ll �i�ts s�v�n", "junk"), ("page 7 of 17 " * 60, "junk"), ("fodx tjwufrxb bxfkonm rnkolxm mtakzmnt jnbbabrbv vrfddr bjzo pzivq bdfzpdz", "junk"), ("00000000  89 64 2e b0 2f db 71 f0\n00000010  0d 00 9f 1f 03 3d 27 37", "junk"), ("kernel cadre buffer queue Sensor membrane lagoon decree machine arch auditor ledger Wall angle deposit feuille", "junk"), ("]×/+:]^/&^$\\×[¶=%<±?]×§;^×*=++_?#*%\\ \\+}_!", "junk"),
]


@pytest.mark.parametrize(("text", "want"), SHAPES)
def test_shapes(text, want):
    assert Shape(text).kind(text) == want


def test_exact_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["en", "zh"]), rng.randrange(2), float(rng.choice([0, 0, 0, 1, 2, rng.random()]))) for _ in range(600)]
    got = {(r.lang, r.k, r.v): (r.below, r.upto, r.total) for r in quality.ranks(spark.createDataFrame(rows, "lang string, k int, v double")).collect()}
    for lang, k, v in set(rows):
        own = [x for a, b, x in rows if (a, b) == (lang, k)]
        assert got[lang, k, v] == (sum(x < v for x in own), sum(x <= v for x in own), len(own))


def test_quality_of_a_collection(spark, folder):
    from corpusmill.llm.quality import FIGURES

    rng, words = random.Random(7), [w for t, _ in SHAPES[:1] for w in t.replace(",", "").replace(".", "").split()] + "copper lantern willow orchard because under which between after many".split()
    long = " ".join("The " + " ".join(rng.choices(words, k=rng.randrange(5, 20))) + "." for _ in range(8_000))
    docs = [document(k, PROSE * (1 + k % 3), lang="en-US") for k in range(60)] + [document(100 + k, t) for k, (t, _) in enumerate(SHAPES)] + [document(900, None), document(901, " \n"), document(902, long)]
    d = folder(documents=docs)
    got = {r.doc_id: r.kind for r in quality.found(spark, d).collect()}
    assert got == {100 + k: w for k, (_, w) in enumerate(SHAPES) if w}
    stats = {r.doc_id: r for r in quality.statistics(spark, d).collect()}
    assert len(stats) == len(docs) and stats[900].words == 0 and stats[900].score is None and set(FIGURES) < set(stats[0].asDict())
    assert quality.found(spark, folder()).count() == 0


def test_the_score_decides_and_the_border_moves_with_the_collection(spark):
    rows = [(k, "en", "list", [0.0] * 8, [u, 0.0, 0.2]) for k, u in enumerate([0.0] * 300 + [0.4, 0.9, 0.999999, 1.0, 1.5] + [2.0] * 250)]
    rows += [(2_000, "zh", "junk", [0.0] * 8, [0.0, 0.99, 0.0]), (2_001, "de", "junk", [0.0] * 8, [0.3, 3.0, 0.0]), (2_002, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, pool string, kind string, v array<double>, u array<double>")
    got = {r.doc_id: r.margin for r in quality.outliers(df).collect()}
    assert set(got) == {*range(303, 555), 2_001} and got[303] == 0 and 0 < got[304] < got[305] == got[554]


def test_hot_values_are_looked_up_as_others(spark, monkeypatch):
    rows = [(k, "en", k % 3, float(k % 7 if k % 2 else 1)) for k in range(500)]
    values = spark.createDataFrame(rows, "doc_id long, lang string, k int, v double")
    own = quality.ranks(values.select("lang", "k", "v"))
    want = sorted(tuple(r) for r in values.join(own, ["lang", "k", "v"]).select("doc_id", "k", "v", "upto").collect())
    for hot in (1, 5, 4_000):
        monkeypatch.setattr(quality, "HOT", hot)
        assert sorted(tuple(r) for r in quality.looked_up(values, own).select("doc_id", "k", "v", "upto").collect()) == want


@pytest.mark.parametrize("few", [30, 120])
def test_frequent_lists_and_tables_are_found(spark, folder, few):
    cases = [(SHAPES[6][0], "list"), (SHAPES[12][0], "table")]
    for text, kind in cases:
        # copies are well over half of the texts of their language
        rows = [document(k, text, lang="en") for k in range(2 * few)] + [document(1000 + k, f"{PROSE} It was {k} years old.", lang="en") for k in range(few)]
        got = {r.doc_id: r.kind for r in quality.found(spark, folder(documents=rows)).collect()}
        assert got == {k: kind for k in range(2 * few)}


def test_queries_ignore_more_columns(spark, tmp_path):
    spark.createDataFrame([(1, "- a b\n- c d\n- e f", "x", "en", "k")], "doc_id long, text string, kind string, lang string, v string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in quality.found(spark, str(tmp_path)).collect()] == [(1, "list")]
    assert json.dumps([r.words for r in quality.statistics(spark, str(tmp_path)).collect()])

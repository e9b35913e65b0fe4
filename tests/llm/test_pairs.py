"""Problems 1, 3 and 4 against brute force."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest

from corpusmill.llm import base, neardup, overlap, splits

from .conftest import sample

WORDS = "stone river lantern orchard copper window valley thunder marble harbour pepper saddle willow engine garden market violin ribbon candle meadow".split()


def squeezed(t):
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", t).strip().casefold())


def grams(t):
    s = squeezed(t)
    return {s[i : i + 5] for i in range(max(1, len(s) - 4))}


def near(a, b):
    x, y = grams(a), grams(b)
    return 100 * len(x & y) >= 85 * len(x | y)


def texts(count, seed):
    """Texts of all lengths with edited copies around the border of 85 %."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        base = " ".join(rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(rng.choice([3, 8, 25, 60, 200])))
        out.append(base)
        for _ in range(rng.randrange(4)):
            words = base.split()
            for _ in range(rng.randrange(1 + len(words) // 12) + rng.randrange(2)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(rng.choice([str.upper, str, lambda t: t.replace(" ", "\n ")])(" ".join(words)))
    return out[:count]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_texts_equal_brute_force(spark, folder, seed):
    rng = random.Random(seed)
    body = texts(220, seed)
    rows = [sample(f"i{k:03}", t, rng.choice(["train", "train", "val", "test", None])) for k, t in enumerate(body)]
    d = folder(samples=rows + rows[:9])  # repeated rows are one record
    pairs = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if near(a[5], b[5])}
    got = [tuple(r) for r in neardup.found(spark, d).collect()]
    assert len(got) == len(set(got)) and {(a, b) for k, a, b in got if k == "text"} == pairs and len(pairs) > 40
    side = {r[0]: r[9] for r in rows}
    across = {(a, b) for a, b in pairs if side[a] and side[b] and (side[a] == "train") != (side[b] == "train")}
    got = [tuple(r) for r in overlap.found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == across


def test_edits_at_the_ends_and_inside_short_texts(spark, folder):
    rng, rows, want = random.Random(8), [], set()
    for k, n in enumerate([*range(12, 90, 3), 140, 200, 400]):
        t = "".join(rng.sample([chr(c) for c in range(0x4E00, 0x4E00 + 900)], n))
        edits = ["x" + t[1:], t[1:], t[2:], t[3:], t[:-1], t[1:-1], "yz" + t[2:], t[:-2] + "q"]
        edits += [t[1 : m - 1] + t[m + 1 : -1] for m in range(3, n - 2, 5)]
        rows.append(sample(f"e{k}", t, "val"))
        for j, e in enumerate(edits):
            rows.append(sample(f"t{k}-{j}", e, "train"))
            if near(t, e):
                want.add((f"e{k}", f"t{k}-{j}"))
    assert {tuple(r) for r in overlap.found(spark, folder(samples=rows)).collect()} == want and len(want) > 200


@pytest.mark.parametrize("seed", [1, 2])
def test_short_and_repeating_texts_equal_brute_force(spark, folder, seed):
    rng, rows, letters = random.Random(seed), [], "etaoinshrdlucm"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for k in range(160):
        if k % 2:
            t = word(rng.randrange(20, 91))
        else:  # units that the evaluation text repeats more often, each time edited
            unit = word(rng.randrange(6, 40))
            t = "".join(unit if rng.random() < 0.7 else unit[:3] + rng.choice(letters) + unit[4:] for _ in range(rng.randrange(2, 9)))
        rows.append(sample(f"e{k}", t, rng.choice(["val", "test"])))
        for j in range(6):
            e = list(t)
            e[rng.randrange(2)] = rng.choice(letters)
            if j % 2:
                e[-1 - rng.randrange(2)] = rng.choice(letters)
            for _ in range(rng.randrange(1 + len(e) // 40)):
                e[rng.randrange(len(e))] = rng.choice(letters)
            e = "".join(e)
            rows.append(sample(f"t{k}-{j}", e[: rng.randrange(len(e) // 2, len(e))] + e if j == 5 else e, "train"))
    held, train = [r for r in rows if r[0][0] == "e"], [r for r in rows if r[0][0] == "t"]
    want = {(a[0], b[0]) for a in held for b in train if near(a[5], b[5])}
    assert {tuple(r) for r in overlap.found(spark, folder(samples=rows)).collect()} == want and len(want) > 150


def test_several_blocks_and_small_arrays(spark, folder, monkeypatch):
    rng = random.Random(3)
    rows = [sample(f"i{k:03}", t, rng.choice(["train", "val"])) for k, t in enumerate(texts(150, 12))]
    d = folder(samples=rows)
    whole = {tuple(r) for r in overlap.found(spark, d).collect()}
    monkeypatch.setattr(overlap, "BLOCK_PROBES", 300)
    monkeypatch.setattr(overlap, "EXPANDED", 50)
    assert {tuple(r) for r in overlap.found(spark, d).collect()} == whole and len(whole) > 10


def test_probed_shingles_are_more_than_a_near_text_lacks():
    for a in range(1, 5_000):
        assert base.probed(a) - 1 == max(m for m in range(a) if 100 * (a - m) >= 85 * a)


def test_coverage_is_the_union_of_all_training_texts(spark, folder):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 420)]  # no shingle stands twice
    words = ["".join(letters[7 * k : 7 * k + 7]) for k in range(60)]
    t = " ".join(words)
    edit = lambda *at: " ".join("#####" if k in at else w for k, w in enumerate(words))
    rows = [sample("e", t, "test"), sample("a", edit(5), "train"), sample("b", edit(40), "train"), sample("f", t + " more", "val")]
    got = {r.split: r for r in overlap.report(spark, folder(samples=rows)).collect()}
    assert got["test"].mean_coverage == 1 and got["test"].near_pairs == 2 and 0.98 < got["val"].mean_coverage < 1
    got = {r.split: r for r in overlap.report(spark, folder(samples=rows[:2])).collect()}
    lost = len(words[5])
    assert lost == 7 and got["test"].mean_coverage == round(1 - 7 / len(squeezed(t)), 4)


def test_edges_of_texts(spark, folder):
    long = " ".join(WORDS[k * 7 % 20] + str(k) for k in range(60_000))
    rows = [sample("a", None), sample("b", ""), sample("c", " \n"), sample("d", "abcd"), sample("e", "ABCD"), sample("f", long, "val"), sample("g", long + " end"), sample("h", "abcdefgh", "test"), sample("i", "ab\ncdefgh")]
    d = folder(samples=rows)
    assert {tuple(r)[1:] for r in neardup.found(spark, d).collect()} == {("d", "e"), ("f", "g"), ("h", "i")}
    assert {tuple(r) for r in overlap.found(spark, d).collect()} == {("f", "g"), ("h", "i")}
    groups = {r.id: (r.group_id, r.links) for r in neardup.groups(spark, d).collect()}
    assert groups["e"] == ("d", 1) and set(groups) == {"d", "e", "f", "g", "h", "i"}


def test_a_third_are_copies(spark, folder):
    rows = [sample(f"c{k:03}", "the same words in every copy of it", "train" if k % 40 else "val") for k in range(80)] + [sample(f"x{k}", f"own text number {k} {WORDS[k % 20] * 3}") for k in range(60)]
    d = folder(samples=rows)
    assert sum(r.kind == "text" and r.id_a[0] == "c" for r in neardup.found(spark, d).collect()) == 80 * 79 // 2
    assert overlap.found(spark, d).count() == 2 * 78


def test_opening_questions(spark, folder):
    turn = lambda q: [{"role": "system", "content": "s"}, {"role": "user", "content": q}, {"role": "assistant", "content": "a"}]
    pic = lambda *h: [{"rgb_sha256": x} for x in h]
    rows = [
        sample("a", "t1 alpha beta", "train", turn("What is it?")), sample("b", "t2 gamma delta", "val", turn(" what IS\nit ！")), sample("c", "t3 epsilon", "test", turn("What is it?"), pic("x")), sample("d", "t4 zeta eta", "train", turn("what is it"), pic("x")),
        sample("e", "t5 theta", "train", turn("")), sample("f", "t6 iota", "test", turn("")), sample("g", "t7 kappa", "test", payload='{"turns": [{"role": "user", "content": "What is it?"'), sample("h", "t8", "test", turn("What is it"), pic("x", "y")), sample("i", "t9", None, turn("What is it?")),
    ]
    d = folder(samples=rows)
    assert {tuple(r) for r in overlap.found(spark, d).collect()} == {("a", "b"), ("c", "d")}
    rep = {(r.split, r.source): r for r in overlap.report(spark, d).collect()}
    assert rep["val", "s"].question_pairs == 1 and rep["test", "s"].records == 4 and rep["test", "s"].overlapping == 1 and rep["test", "s"].near_pairs == 0


def test_groups_count_the_links_of_pairs(spark, folder):
    rows = [sample(f"i{k:03}", t) for k, t in enumerate(texts(150, 6))]
    d = folder(samples=rows + rows[:5], image_bands=[(0, 0, f"{v:x}", f"p{k}") for k, v in enumerate([7, 7, 6, 1 << 40, 255 << 50, (255 << 50) + 1])])
    pairs = [tuple(r) for r in neardup.found(spark, d).collect()]
    links = {}
    for kind, a, b in pairs:
        links[kind, a] = links.get((kind, a), 0) + 1
        links[kind, b] = links.get((kind, b), 0) + 1
    got = {(r.kind, r.id): r for r in neardup.groups(spark, d).collect()}
    assert {k: r.links for k, r in got.items()} == links
    assert all(got[k, a].group_id == got[k, b].group_id <= a for k, a, b in pairs)


def test_empty_tables(spark, folder):
    d = folder()
    for q in (neardup.found, neardup.groups, overlap.found, overlap.report, splits.found):
        assert q(spark, d).count() == 0


def test_pictures_equal_brute_force(spark, folder):
    rng, rows = random.Random(4), []
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        w = v
        for b in rng.sample(range(64), rng.choice([0, 3, 6, 7])):
            w ^= 1 << b
        values.append(w)
    pics = [(f"p{k % 70:02}", v) for k, v in enumerate(values)]  # some records own two pictures
    for k, (i, v) in enumerate(pics):
        rows += [(0, 1, [f"{v:016x}", f"0x{v:X}", f"{v:x}", None][k % 4] if k % 4 != 3 else None, i), (1, 2, f"{v:016x}", i)]
    rows += [(0, 0, "not a hash", "q"), (0, 0, None, "r")]
    want = {(min(a, b), max(a, b)) for (a, v), (b, w) in itertools.combinations(pics, 2) if a != b and (v ^ w).bit_count() <= 6}
    got = {(r.id_a, r.id_b) for r in neardup.found(spark, folder(image_bands=rows)).collect()}
    assert got == want and len(want) > 15


def test_thresholds_keep_the_pigeonhole_bound():
    v = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    for total in (100, 10**6, 10**9):
        parts = neardup.bit_partitions(v, total)
        assert sum(t + 1 for _, t in parts) == 7 and all(not (a & b) for (a, _), (b, _) in itertools.combinations(parts, 2))


@pytest.mark.parametrize("keys_of", [base.single_keys, base.coarse_keys])
def test_near_sets_share_a_key(keys_of):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 6, base.BUCKETS)  # many ties
    small, large = [], []
    for _ in range(4_000):
        a = int(rng.integers(1, 300))
        own = rng.choice(1 << 47, a, replace=False).astype(np.uint64)
        lost = int(rng.integers(0, a - -(-85 * a // 100) + 1))
        gain = max(int((a - lost) / 0.85 - a), 0)
        other = np.concatenate((rng.permutation(own)[lost:], rng.choice(1 << 47, gain, replace=False).astype(np.uint64) + np.uint64(1 << 47)))
        if 100 * (a - lost) >= 85 * (a + gain):
            small.append(np.sort(own))
            large.append(np.sort(other))
    assert len(small) > 1_500
    x, y = (keys_of(np.concatenate(s), np.concatenate(([0], np.cumsum([len(v) for v in s]))), counts) for s in (small, large))
    assert all(set(a.tolist()) & set(b.tolist()) for a, b in zip(x, y, strict=True))


def prose(count):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(2_000)]
    return [squeezed(" ".join(rng.choices(words, k=rng.randrange(30, 120)))) for _ in range(count)]


def test_coarse_keys_set_unlike_texts_apart():
    body = prose(1_500)
    sets, starts = base.shingle_sets(body)
    counts = np.bincount(base.buckets(sets), minlength=base.BUCKETS)
    single, coarse = (base.chance_pairs(f(sets, starts, counts)) for f in (base.single_keys, base.coarse_keys))
    assert coarse < 0.1 * single


@pytest.mark.parametrize("keys_of", [base.single_keys, base.coarse_keys])
def test_either_kind_of_keys_finds_the_same(spark, folder, monkeypatch, keys_of):
    rows = [sample(f"i{k:03}", t) for k, t in enumerate(texts(150, 31))]
    monkeypatch.setattr(neardup, "cheaper_keys", lambda *a: keys_of)
    pairs = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if near(a[5], b[5])}
    assert {tuple(r)[1:] for r in neardup.found(spark, folder(samples=rows)).collect()} == pairs and len(pairs) > 20


def test_large_collections_get_coarse_keys(spark):
    df = spark.createDataFrame([(t,) for t in prose(1_500)], "text string")
    counts = base.shingle_counts(df)
    assert base.cheaper_keys(df, 1_500, counts) is base.single_keys and base.cheaper_keys(df, 10**9, counts) is base.coarse_keys


def test_sketch_bounds():
    from math import comb

    for bits, radius in ((neardup.KEY_BITS, neardup.KEY_RADIUS), (neardup.CLASS_BITS, neardup.CLASS_RADIUS)):
        assert sum(comb(bits, k) * 0.075**k * 0.925 ** (bits - k) for k in range(radius + 1, bits + 1)) < 1e-8


def test_many_classes_are_joined_as_few_are(spark, folder, monkeypatch):
    d = folder(samples=[sample(f"i{k:03}", t) for k, t in enumerate(texts(80, 4))])
    few = {tuple(r) for r in neardup.found(spark, d).collect()}
    monkeypatch.setattr(neardup, "PICKED", 0)
    assert {tuple(r) for r in neardup.found(spark, d).collect()} == few and len(few) > 5


def test_groups_with_two_splits(spark, folder):
    rows = [sample("a", split="train", root="R1"), sample("b", split="val"), sample("c", split=None, root=" r1"), sample("d", split="train"), sample("e", split="test", root="r2"), sample("f", split="test", root="r2"), sample("g")]
    links = [("a", "repo:X"), ("b", "Repo: ｘ"), ("b", "repo:X"), ("d", None), ("zz", "repo:q"), ("d", "repo:q"), ("g", "repo:q"), ("f", "  ")]
    d = folder(samples=rows + rows[:2], links=links)
    assert sorted(r.id for r in splits.found(spark, d).collect()) == ["a", "b", "c"]


def test_assignment_keeps_groups_and_meets_shares(spark, folder):
    rng = random.Random(1)
    rows = [sample(f"i{k:04}", split=rng.choice(["train", "val", None]), root="big" if k % 5 == 0 else f"g{k // 4}" if k % 3 else None, task=rng.choice(["x", "y", None])) for k in range(1500)]
    d = folder(samples=rows, links=[("i0001", "k:1"), ("i0002", "k:1")], split_plan=[("train", 0.8), ("val", 0.1), ("test", 0.1), (None, 0.5), ("none", 0.0)])
    done = splits.assignment(spark, d).collect()
    assert len(done) == 1500 and len({(r.group_id, r.split) for r in done}) == len({r.group_id for r in done})
    share = {s: sum(r.split == s for r in done) / 1500 for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.8) < 0.005 and abs(share["val"] - 0.1) < 0.005
    by_task = {r[0]: r[3] for r in rows}
    x = {s: sum(r.split == s and by_task[r.id] == "x" for r in done) for s in share}
    assert abs(x["val"] / sum(x.values()) - 0.1) < 0.03
    assert {r.id: r.split for r in splits.assignment(spark, d).collect()} == {r.id: r.split for r in done}


def test_rare_labels_are_balanced_too(spark):
    rng = random.Random(4)
    rows = [(f"i{k:05}", f"g{k // 3}", f"label-{rng.randrange(60)}") for k in range(9_000)]
    done = splits.assign(spark.createDataFrame(rows, "id string, group_id string, label string"), [("train", 0.8), ("val", 0.2)])
    split = {r.group_id: r.split for r in done.collect()}
    assert len(split) == 3_000
    share = sum(split[g] == "val" for _, g, _ in rows) / len(rows)
    assert abs(share - 0.2) < 0.002
    count = {}
    for _, g, label in rows:
        count.setdefault(label, []).append(split[g] == "val")
    frequent = sorted(count, key=lambda x: -len(count[x]))[: splits.LABELS - 4]
    assert max(abs(sum(count[x]) / len(count[x]) - 0.2) for x in frequent) < 0.05

import random

import pytest

from corpusmill.operators.graph import components, star_edges
from corpusmill.operators.splits import grouped, incremental_groups, merged_audits
from corpusmill.plans.catalog import QUERIES


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    for seed in range(2):
        random.seed(seed)
        edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 540)] + [(900, x) for x in range(700, 780)] + [(None, 3), (5, 5)]
        rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.root for r in rows} == roots(edges) and len(rows) == len(roots(edges))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_hot_key_is_one_group(spark):
    rows = [(f"n{i:03}", "hot") for i in range(300)] + [("x", "own"), (None, "hot"), ("y", None)]
    links = spark.createDataFrame(rows, "id string, key string")
    got = {r.id: r.group_root for r in grouped(links, links.select("id").dropna().distinct()).collect()}
    assert {got[f"n{i:03}"] for i in range(300)} == {"n000"} and got["x"] == "x" and got["y"] == "y"
    assert star_edges(links, "id", "key").count() == 299


def test_incremental_equals_full(spark):
    old, new = [(1, 2), (3, 4), (5, 6)], [(2, 3), (7, 8), (9, 1)]
    closed = components(spark.createDataFrame(old, "a long, b long"))
    got = {r.node: r.root for r in incremental_groups(closed, spark.createDataFrame(new, "a long, b long")).collect()}
    assert got == roots(old + new)


def test_required_split_is_the_highest(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    r = spark.createDataFrame([("a", "train"), ("c", "test")], "node string, split string")
    assert {x.split for x in merged_audits([e, e], r).collect()} == {"test"}


KINDS = ("source-group", "question", "rgb", "document", "repo", "document_id", "origin_id", "phash-neighbor", "Document")


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    """A folder with links of every kind, and its rows; a component needs keys of several kinds."""
    rng, at = random.Random(3), tmp_path_factory.mktemp("links")
    links = [(f"n{rng.randrange(400):03}", f"{kind}:{rng.randrange(150)}") for kind in KINDS for _ in range(30)]
    links += [("c1", "repo:x"), ("c2", "repo:x"), ("c2", "rgb:y"), ("c3", "rgb:y"), ("alone", "question:z"), ("nokey", None), (None, "repo:x")] + [(f"h{k}", "source-group:hot") for k in range(40)]
    records = [(i, rng.choice(["train", "val", "test", None])) for i in sorted({i for i, _ in links if i}) if i[0] != "c"] + [("c1", "train"), ("c3", "test")]
    spark.createDataFrame(links + links[:50], "id string, key string").write.parquet(f"{at}/links.parquet")
    spark.createDataFrame(records + records[:20], "id string, split string").write.parquet(f"{at}/samples.parquet")
    return str(at), links, records


def group_roots(links):
    by_key = {}
    for i, k in links:
        if i is not None and k is not None:
            by_key.setdefault(k, []).append(i)
    own = roots([(v[0], x) for v in by_key.values() for x in v])
    return {i: own.get(i, i) for v in by_key.values() for i in v}


def test_groups_of_equal_union_find(spark, linked):
    d, links, _ = linked
    rows = QUERIES["groups_cc"](spark, d).collect()
    assert {r.id: r.group_root for r in rows} == group_roots(links) and len(rows) == len(group_roots(links))


def test_conflicts_of_equal_union_find(spark, linked):
    d, links, records = linked
    of = {}
    for i, split in records:
        if root := group_roots(links).get(i):
            of.setdefault(root, []).append(split)
    want = {(root, len(set(s) - {None}), len(s)) for root, s in of.items() if len(set(s) - {None}) > 1}
    assert {tuple(r) for r in QUERIES["group_conflicts"](spark, d).collect()} == want and ("c1", 2, 2) in want


def test_incremental_groups_of_equal_full_components(spark, linked):
    d, links, _ = linked
    by_key = {}
    for i, k in links:
        if i and k:
            by_key.setdefault(k, []).append(i)
    rows = QUERIES["incremental_groups"](spark, d).collect()
    want = roots([(v[0], x) for v in by_key.values() for x in v])
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
    whole = components(star_edges(spark.read.parquet(f"{d}/links.parquet"), "id", "key"))
    assert {(r.node, r.root) for r in whole.collect()} == {(r.node, r.root) for r in rows}


def test_aliases_of_all_documents(spark, tmp_path):
    texts = [(1, "a"), (7, "a"), (5, "b"), (11, "b"), (2, "c"), (1, "a"), (4, "b"), (6, "d"), (13, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.retained, r.members) for r in QUERIES["union_aliases"](spark, str(tmp_path)).collect()} == {(1, 2), (4, 3)}

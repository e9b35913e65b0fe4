"""Further queries: normal forms, record projection, audits, figures of pictures and clips."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions import chat, media
from corpusmill.functions.labels import source_key
from corpusmill.functions.text import canonical_question, match_text, normalized, squeezed
from corpusmill.operators import dedup, encode, filters, splits, views, windows
from corpusmill.operators.graph import components, star_edges
from corpusmill.plans.corpus import CC, PHASH, RECORDS, SOURCE
from corpusmill.plans.registry import query
from corpusmill.plans.relational import PATTERN
from corpusmill.session import TOKENIZERS, table
from corpusmill.sources import generators, remote


@query("normal_forms", "P1 P3 P4 C1")
def _(spark, d):
    t = F.col("text")
    rows = table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", F.sha2(normalized(t), 256).alias("normalized"), F.sha2(squeezed(t), 256).alias("squeezed"), F.sha2(canonical_question(t), 256).alias("question"), F.sha2(match_text(t), 256).alias("words"))


@query(
    "source_projection", "P8",
    f"WITH d AS (SELECT *, {SOURCE} AS s FROM documents) SELECT s || ':' || doc_id AS item_id, coalesce(group_id, s) AS group_id, CASE WHEN len(langs) = 1 THEN langs[1] END AS lang, p.task AS task, p.revision AS revision, p.license AS license FROM d JOIN source_specs p ON d.s = p.source",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "group_id", source_key(F.col("source")).alias("source"))
    specs = table(spark, d, "source_specs").select("source", "task", "revision", "license", F.when(F.size("langs") == 1, F.col("langs")[0]).alias("lang"))  # a row a source
    return rows.join(F.broadcast(specs), "source").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("item_id"), F.coalesce("group_id", "source").alias("group_id"), "lang", "task", "revision", "license")


@query("reserved_official_splits", "F2", f"WITH r AS ({RECORDS}) SELECT id, CASE WHEN starts_with(s, 'test') OR starts_with(s, 'validation') THEN 'reserved_official_split' WHEN length(text) < 20 OR contains(text, chr(65533)) THEN 'invalid_text' END AS reason FROM (SELECT id, text, CASE WHEN id < '10' THEN 'test_sft' WHEN id < '18' THEN 'validation' WHEN id < '80' THEN 'train' END AS s FROM r)")
def _(spark, d):
    rows = table(spark, d, "samples").select("id", "text").dropDuplicates(["id"])
    official = F.when(F.col("id") < "10", "test_sft").when(F.col("id") < "18", "validation").when(F.col("id") < "80", "train")
    rows = rows.withColumn("s", official)
    # boilerplate has its own query; here one line a text leaves the other rules
    return rows.select("id", filters.admission(F.regexp_replace("text", r"[\r\n\x0b\x0c\x1c-\x1e\x85  ]", " "), None, F.col("s")).alias("reason"))


@query("row_origins", "J12", rf"WITH r AS ({RECORDS}), j AS (SELECT id, CASE WHEN json_valid(payload) THEN payload::JSON->>'item_id' END AS item FROM r) SELECT id, regexp_extract(item, '^data/(.*):rg(\d+):row(\d+)$', 1) AS file, regexp_extract(item, '^data/(.*):rg(\d+):row(\d+)$', 2)::INT AS row_group, regexp_extract(item, '^data/(.*):rg(\d+):row(\d+)$', 3)::BIGINT AS row FROM j WHERE regexp_matches(item, '^data/(.*):rg(\d+):row(\d+)$')")
def _(spark, d):
    rows = table(spark, d, "samples").select("id", "payload").dropDuplicates(["id"]).filter(F.try_parse_json("payload").isNotNull())
    item, p = F.get_json_object("payload", "$.item_id"), r"^data/(.*):rg(\d+):row(\d+)$"
    part = lambda i: F.regexp_extract(item, p, i)
    return rows.filter(item.rlike(p)).select("id", part(1).alias("file"), part(2).cast("int").alias("row_group"), part(3).cast("long").alias("row"))


@query("newest_first", "S14", "SELECT run, received_at, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY received_at DESC, step DESC) AS k FROM (SELECT DISTINCT run, received_at, step FROM run_metrics WHERE step IS NOT NULL AND received_at IS NOT NULL)) WHERE k <= 5")
def _(spark, d):
    rows = table(spark, d, "run_metrics").select("run", "received_at", "step").dropna().distinct()
    return windows.first_n(rows, ["run"], [F.desc("received_at"), F.desc("step")], 5).select("run", "received_at", "step")


@query(
    "review_closure", "G12",
    f"""WITH s AS (SELECT DISTINCT id, {PHASH} AS v FROM image_bands WHERE phash IS NOT NULL), n AS (SELECT a.id || '|' || b.id AS candidate, min(bit_count(xor(a.v, b.v))) AS bits FROM s a JOIN s b ON a.id < b.id AND bit_count(xor(a.v, b.v)) <= 6 GROUP BY 1),
k AS (SELECT DISTINCT id, key FROM links WHERE key LIKE 'origin_id:%'), o AS (SELECT DISTINCT a.id || '|' || b.id AS candidate FROM k a JOIN k b ON a.key = b.key AND a.id < b.id), d AS (SELECT candidate FROM n WHERE bits = 0 UNION ALL SELECT candidate FROM o), c AS (SELECT candidate, count(*) AS k FROM d GROUP BY 1)
SELECT coalesce(n.candidate, c.candidate) AS candidate, CASE WHEN n.candidate IS NULL THEN 'unknown' WHEN c.candidate IS NULL THEN 'undecided' WHEN k > 1 THEN 'decided_twice' END AS problem FROM n FULL JOIN c ON n.candidate = c.candidate WHERE n.candidate IS NULL OR c.candidate IS NULL OR k > 1""",
)
def _(spark, d):
    # candidates: near pictures; decided by equal hashes and, again, by one origin
    bands = table(spark, d, "image_bands").select("id", dedup.parsed_sim_hash(F.col("phash")).alias("v"))
    pair = F.concat_ws("|", "a", "b").alias("candidate")
    near = dedup.band_pairs(bands, "id", "v", dedup.PICTURE_BANDS, 6).select(pair)
    same = dedup.band_pairs(bands, "id", "v", [(0, 64)], 0).select(pair)
    links = table(spark, d, "links").filter("key like 'origin_id:%'").distinct()
    origin = links.join(links.withColumnRenamed("id", "b"), "key").filter("id < b").select(F.col("id").alias("a"), "b").distinct().select(pair)
    return splits.review_closure(near, same.unionByName(origin))


@query(
    "conflict_overlay", "V4",
    CC + f", r AS ({RECORDS}), g AS (SELECT root AS c, group_root, split FROM m JOIN r USING (id) WHERE group_root IS NOT NULL AND split IS NOT NULL), t AS (SELECT c, bool_or(split = 'test') AS has_test FROM g GROUP BY c HAVING count(DISTINCT split) > 1) SELECT DISTINCT group_root, 'excluded' AS change FROM g JOIN t USING (c) WHERE split = 'train' UNION ALL SELECT DISTINCT group_root, 'promoted' FROM g JOIN t USING (c) WHERE split = 'val' AND has_test",
)
def _(spark, d):
    links = table(spark, d, "links").select("id", "key").dropna().distinct()
    own = components(star_edges(links, "id", "key")).select(F.col("node").alias("id"), F.col("root").alias("component"))
    rows = table(spark, d, "samples").select("id", "group_root", "split").dropDuplicates(["id"]).dropna().join(own, "id")
    out, up = views.conflict_overlay(rows)
    return out.withColumn("change", F.lit("excluded")).unionByName(up.withColumn("change", F.lit("promoted")))


@query(
    "origin_faults", "J11 J12",
    f"WITH r AS ({RECORDS}), k AS (SELECT DISTINCT id, key FROM links WHERE key LIKE 'document%'), h AS (SELECT id, min(id) OVER (PARTITION BY key) AS hub FROM k), l AS (SELECT DISTINCT h.id, hub, split FROM h JOIN r USING (id) WHERE h.id <> hub AND stage = 'sft') SELECT l.id, CASE WHEN o.split IS NULL THEN 'missing_origin' WHEN o.stage <> 'pretrain' THEN 'origin_not_pretraining' ELSE 'split_mismatch' END AS fault FROM l LEFT JOIN r o ON o.id = hub WHERE o.split IS NULL OR o.stage <> 'pretrain' OR o.split <> l.split",
)
def _(spark, d):
    # the origin of a tuning record is the first record of its documents
    links = table(spark, d, "links").filter("key like 'document%'").select("id", "key").distinct()
    rows = table(spark, d, "samples").select("id", "stage", "split").dropDuplicates(["id"])
    derived = star_edges(links, "id", "key").select(F.col("a").alias("id"), F.col("b").alias("origin_id")).join(rows.filter("stage = 'sft'").select("id", "split"), "id")
    return views.origin_faults(derived, rows)


@query(
    "rebound_media", "V9",
    f"WITH r AS ({RECORDS}), k AS (SELECT DISTINCT id, key FROM links WHERE key LIKE 'document%'), h AS (SELECT id, min(id) OVER (PARTITION BY key) AS hub FROM k), l AS (SELECT DISTINCT h.id, hub, split, group_root FROM h JOIN r USING (id) WHERE h.id <> hub AND stage = 'sft'), f AS (SELECT l.group_root FROM l LEFT JOIN r o ON o.id = hub WHERE l.split = 'train' AND (o.split IS NULL OR o.stage <> 'pretrain' OR o.split <> l.split)) SELECT id, hub AS origin_id, group_root FROM l WHERE group_root IS NULL OR group_root NOT IN (SELECT group_root FROM f WHERE group_root IS NOT NULL)",
)
def _(spark, d):
    links = table(spark, d, "links").filter("key like 'document%'").select("id", "key").distinct()
    rows = table(spark, d, "samples").select("id", "stage", "split", "group_root").dropDuplicates(["id"])
    derived = star_edges(links, "id", "key").select(F.col("a").alias("id"), F.col("b").alias("origin_id")).join(rows.filter("stage = 'sft'").drop("stage"), "id")
    return views.rebound(derived, rows.drop("group_root")).select("id", "origin_id", "group_root")


@query("incremental_groups", "G11 X7", CC + " SELECT id AS node, root FROM m WHERE id IN (SELECT x FROM e WHERE x <> y)")
def _(spark, d):
    # a quarter of the ids arrives later; its keys bring in all their rows, older ones too
    links = table(spark, d, "links").select("id", "key").dropna().distinct()
    late = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    closed = components(star_edges(links.filter(~late), "id", "key"))
    touched = links.join(links.filter(late).select("key").distinct(), "key", "left_semi")
    return splits.incremental_groups(closed, star_edges(touched, "id", "key"))


@query("clip_frames", "L13", "SELECT p_partkey, [round_even(i * (p_size + 3)::DOUBLE / 7, 0)::INT FOR i IN generate_series(0, 7)]::VARCHAR AS frames FROM part")
def _(spark, d):
    i = F.sequence(F.lit(0), F.lit(7))
    frames = F.transform(i, lambda k: F.bround(k * (F.col("p_size") + 3).cast("double") / 7, 0).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(frames, ", "), F.lit("]")).alias("frames"))


@query("log_dates", "C12", "SELECT event_id, strftime(to_timestamp(floor(epoch(ts)))::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("row_bytes", "C16", f"WITH r AS ({RECORDS}) SELECT {SOURCE} AS source, sum(4 * coalesce(strlen(payload), 0) + strlen(text) + 1024)::BIGINT AS bytes FROM r GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "samples").select("id", "source", "payload", "text").dropDuplicates(["id"])
    size = 4 * F.coalesce(F.octet_length("payload"), F.lit(0)) + F.octet_length("text") + 1024
    return rows.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum(size.cast("long")).alias("bytes"))


@query("model_view", "V7", f"WITH r AS ({RECORDS}) SELECT id, split, 'target-1' AS model FROM r")
def _(spark, d):
    return table(spark, d, "samples").select("id", "split").dropDuplicates(["id"]).withColumn("model", F.lit("target-1"))


@query("tokenizer_comparison", "T2")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text").filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"))
    out = None
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        own = encode.encoded_documents(rows, f"{TOKENIZERS}/{name}.tiktoken", PATTERN).agg(F.lit(name).alias("tokenizer"), F.sum(F.size("tokens") - 2).alias("tokens"), F.lit(1).alias("k"))
        own = own.join(size.withColumn("k", F.lit(1)), "k").select("tokenizer", "tokens", "bytes", F.round(F.col("bytes") / F.col("tokens"), 4).alias("bytes_a_token"))
        out = own if out is None else out.unionByName(own)
    return out


@query("wrapped_lines", "C15")
def _(spark, d):
    @F.pandas_udf("int")
    def lines(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(encode.wrapped(t, 60)))

    return table(spark, d, "documents").filter("text is not null").select("doc_id", lines("text").alias("lines"))


@query("pixel_identity", "D12 D10", "SELECT p_partkey, sha256(concat(p_size, 'x', p_size + 1, ':', p_name)) AS rgb_sha256 FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", media.rgb_identity(F.col("p_size"), F.col("p_size") + 1, F.col("p_name").cast("binary")).alias("rgb_sha256"))


@query(
    "cache_plan", "S17 K10",
    f"""WITH r AS ({RECORDS}), j AS (SELECT split, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r), m AS (SELECT split, unnest((p->'media')::JSON[]) AS m FROM j WHERE json_array_length(p, '$.media') > 0),
e AS (SELECT m->>'rgb_sha256' AS sha256, max(3 * (m->>'width')::BIGINT * (m->>'height')::BIGINT) AS bytes, max((m->>'width')::BIGINT) AS used_at, bool_or(coalesce(split IN ('val', 'test'), false)) AS pinned FROM m WHERE m->>'rgb_sha256' IS NOT NULL GROUP BY 1)
SELECT sha256, bytes, pinned, pinned OR sum(bytes) OVER (ORDER BY pinned DESC, used_at DESC, sha256) <= 100000000 AS kept FROM e""",
)
def _(spark, d):
    rows = table(spark, d, "samples").select("id", "split", "payload").dropDuplicates(["id"]).filter(F.try_parse_json("payload").isNotNull())
    m = rows.select("split", F.explode(F.from_json(F.get_json_object("payload", "$.media"), "array<struct<rgb_sha256:string,width:long,height:long>>")).alias("m")).filter("m.rgb_sha256 is not null")
    held = F.coalesce(F.col("split").isin("val", "test"), F.lit(False))
    # a wider picture counts as used later
    entries = m.groupBy(F.col("m.rgb_sha256").alias("sha256")).agg(F.max(F.col("m.width") * F.col("m.height") * 3).alias("bytes"), F.max("m.width").alias("used_at"), F.bool_or(held).alias("pinned"))
    return remote.cache_plan(entries, 100_000_000).select("sha256", "bytes", "pinned", "kept")


@query(
    "multimodal_records", "T6",
    f"""WITH r AS ({RECORDS}), j AS (SELECT id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r), u AS (SELECT id, (p->'turns')::JSON[] AS t, (p->'media')::JSON[] AS m FROM j WHERE json_array_length(p, '$.turns') > 0 AND json_array_length(p, '$.media') > 0),
x AS (SELECT id, t, list_transform(m, lambda y: {{'w': (y->>'width')::DOUBLE, 'h': (y->>'height')::DOUBLE}}) AS m FROM u),
y AS (SELECT id, t, list_transform(m, lambda z: CASE WHEN ceil(z.w / 28) * ceil(z.h / 28) <= 256 THEN ceil(z.w / 28) * ceil(z.h / 28) ELSE greatest(1, floor(z.w * sqrt(256.0::DOUBLE * 28 * 28 / (z.w * z.h)) / 28)) * greatest(1, floor(z.h * sqrt(256.0::DOUBLE * 28 * 28 / (z.w * z.h)) / 28)) END) AS k FROM x)
SELECT id, len(k)::INT AS pictures, CASE WHEN len(list_filter(t, lambda z: (z->>'role') = 'user')) > 0 THEN list_sum(k) ELSE 0 END::INT AS places FROM y""",
)
def _(spark, d):
    rows = table(spark, d, "samples").select("id", "payload").dropDuplicates(["id"]).filter(F.try_parse_json("payload").isNotNull())
    rows = rows.select("id", chat.parsed_turns(F.col("payload")).alias("turns"), F.from_json(F.get_json_object("payload", "$.media"), "array<struct<width:int,height:int>>").alias("media")).filter((F.size("turns") > 0) & (F.size("media") > 0))
    s = encode.multimodal_segments(encode.control_segments(F.col("turns"), F.lit("direct"), F.lit("low")), F.col("media"))
    return rows.select("id", F.size("media").alias("pictures"), F.size(F.filter(s, lambda x: x["marker"] == encode.PATCH)).alias("places"))


@query("math_documents", "C7 S18")
def _(spark, d):
    return generators.math_documents(spark, table(spark, d, "supplier").count(), 11)


@query("embedding_pictures", "D10")
def _(spark, d):
    # no table holds pixels: the luma at (x, y) is the product of two values of a vector
    value = lambda k: F.get("embedding", F.pmod(k.cast("int"), F.size("embedding"))).cast("double")
    luma = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: value(F.floor(i / 32)) * value(i % 32 + 7))
    rows = table(spark, d, "embeddings").select("vec_id", luma.alias("luma"))
    return rows.select("vec_id", media.perceptual_hash(F.col("luma")).alias("phash"))



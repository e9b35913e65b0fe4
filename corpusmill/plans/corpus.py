"""Queries over documents and samples: filters, duplicates, groups, splits, views, contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import chat, expr
from corpusmill.functions.labels import language_key, source_key
from corpusmill.operators import decontam, dedup, filters, reports, splits, views
from corpusmill.operators.graph import star_edges
from corpusmill.plans.registry import query
from corpusmill.session import table, written
from corpusmill.sources import readers

LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
HAN = "length(regexp_replace(text, '[^㐀-鿿]', '', 'g'))"
LATIN = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'), lambda x: trim(x, ' ')), lambda x: length(x) > 20)"
REPEATED = f"CASE WHEN len({LINES}) > 0 THEN 1 - len(list_distinct({LINES}))::DOUBLE / len({LINES}) ELSE 0 END"
SOURCE = r"regexp_replace(lower(trim(source, ' ')), '[\s_]+', '-', 'g')"
LANG = r"CASE WHEN regexp_matches(lower(trim(lang, ' ')), '^[a-z]{2,3}([-_].*)?$') THEN regexp_extract(lower(trim(lang, ' ')), '^([a-z]{2,3})', 1) END"
FINGER = r"sha256(regexp_replace(text, '[ \t\n\x{0b}\f\r]+', ' ', 'g'))"


def hex_bucket(key: str, digits: int, modulo: int) -> str:
    return f"((('0x' || substr(sha256({key}), 1, {digits}))::UBIGINT) % {modulo})"


ADMISSION = f"""CASE WHEN text IS NULL OR length(text) > 2000000 OR length(text) < 20 OR contains(text, chr(65533)) THEN 'invalid_text'
     WHEN {REPEATED} > 0.4 THEN 'repeated_boilerplate' END"""
HTML = r"len(regexp_extract_all(text, '(?i)<\s*(?:script|style|div|span|html|body|nav)\b'))"
QUALITY = rf"""CASE WHEN text IS NULL THEN 'missing_payload'
     WHEN length(text) NOT BETWEEN 100 AND 100000 THEN 'length_outside_100_100000_characters'
     WHEN contains(text, chr(65533)) OR regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'invalid_encoding_or_controls'
     WHEN {HTML} > 3 THEN 'unremoved_html'
     WHEN {LETTERS} < 30 THEN 'insufficient_language_content'
     WHEN ({LANG} = 'zh' AND {HAN} < 0.4 * {LETTERS}) OR ({LANG} = 'en' AND {LATIN} < 0.7 * {LETTERS}) THEN 'language_script_mismatch' END"""
RECORDS = "SELECT DISTINCT * FROM samples"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeezed_sql(c: str) -> str:
    """NFKC, case folded, without white space, as far as full-width forms, ß and the ellipsis go: SQL has neither form."""
    return f"replace(replace(lower(regexp_replace(translate({c}, '{_FULL}', '{_PLAIN}'), '{_WHITE}', '', 'g')), 'ß', 'ss'), '…', '...')"


#: near(x, y, c, u): pairs of records, x < y, that share 85 % of their 5-character substrings, c of u.
NEAR = f"""r AS ({RECORDS}), t AS (SELECT id, s FROM (SELECT id, {squeezed_sql("text")} AS s FROM r) WHERE s <> ''),
g AS (SELECT id, unnest(list_distinct(list_transform(generate_series(1, greatest(1, length(s) - 4)), lambda i: substr(s, i, 5)))) AS g FROM t), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2), near AS (SELECT x, y, c, a.n + b.n - c AS u FROM o JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * c >= 85 * (a.n + b.n - c))"""


def _records(spark, d, *columns):
    return table(spark, d, "samples").select(*columns).dropDuplicates(["id"])


# ---------------------------------------------------------------- filters


@query("filter_admission", "F5 F6", f"SELECT doc_id, {ADMISSION} AS reason FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", filters.admission(F.col("text")).alias("reason"))


@query("filter_quality", "F7 F8 F9 F10 F11 F14", f"SELECT doc_id, {QUALITY} AS reason FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", filters.quality(F.col("text"), language_key(F.col("lang"))).alias("reason"))


@query(
    "filter_reasons_hist", "A6 F7",
    f"""WITH r AS (SELECT doc_id, {QUALITY} AS reason FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) k FROM r)
SELECT reason, count(*) AS "rows", CASE WHEN reason IS NOT NULL THEN string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE k <= 20) END AS examples FROM n GROUP BY reason""",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", filters.quality(F.col("text"), language_key(F.col("lang"))).alias("reason"))
    return filters.histogram(rows, "reason", "doc_id")


@query("boilerplate_ratio", "F6 C2", f"SELECT doc_id, round({REPEATED}, 6) AS repeated FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.round(expr.repeated_share(F.col("text")), 6).alias("repeated"))


@query(
    "script_share", "F10 F11 F28",
    f"""SELECT doc_id, {LETTERS} AS letters, {HAN} AS han, {LATIN} AS latin,
  CASE WHEN {HAN} >= 2 AND 4 * {HAN} >= {LATIN} THEN 'zh' WHEN {LATIN} >= 3 AND 4 * {LATIN} >= 3 * {LETTERS} THEN 'en' END AS script FROM documents WHERE text IS NOT NULL""",
)
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", *[f(t).cast("long").alias(n) for n, f in (("letters", expr.letters), ("han", expr.han), ("latin", expr.latin))], expr.script_language(t).alias("script"))


@query("filter_html", "F9 C2", f"SELECT doc_id, {HTML} AS tags FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", expr.count_of(F.col("text"), expr.HTML_TAG).cast("long").alias("tags"))


@query("filter_legacy_length", "F21 F1", f"SELECT {SOURCE} AS source, count(*) AS kept FROM documents WHERE length(text) BETWEEN 20 AND 24000 AND trim(group_id, ' ') <> '' GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").filter(filters.legacy_length(F.col("text"), F.col("group_id"))).groupBy(source_key(F.col("source")).alias("source")).agg(F.count("*").alias("kept"))


@query(
    "provenance_missing", "F1 C3",
    f"""WITH r AS ({RECORDS}), j AS (SELECT id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r)
SELECT missing, count(*) AS records FROM (SELECT list_aggregate(list_filter(['source','revision','item_id','group_id','license','lang','task','stage'], lambda k: coalesce(p->>k, '') = ''), 'string_agg', ',') AS missing FROM j WHERE p IS NOT NULL) GROUP BY missing""",
)
def _(spark, d):
    rows = _records(spark, d, "id", "payload")
    whole = rows.filter(F.try_parse_json("payload").isNotNull())
    fields = whole.select("id", F.from_json("payload", ", ".join(f"{k} string" for k in filters.REQUIRED)).alias("p")).select("id", "p.*")
    out = fields.select(F.when(F.size(filters.missing_provenance()) > 0, F.array_join(filters.missing_provenance(), ",")).alias("missing"))
    return out.groupBy("missing").agg(F.count("*").alias("records"))


@query("allow_list", "F31 J8", f"SELECT doc_id FROM documents WHERE {SOURCE} IN (SELECT source FROM source_specs WHERE stage = 'pretrain')")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", source_key(F.col("source")).alias("source"))
    return filters.allowed(docs, table(spark, d, "source_specs").filter("stage = 'pretrain'"), ["source"]).select("doc_id")


@query("reserved_questions", "F29 J8", f"WITH r AS ({RECORDS}) SELECT id FROM r WHERE split = 'train' AND first_question <> '' AND first_question NOT IN (SELECT first_question FROM r WHERE split IN ('val', 'test') AND first_question <> '')")
def _(spark, d):
    rows = _records(spark, d, "id", "split", "first_question").filter("first_question <> ''")
    return filters.blocked(rows.filter("split = 'train'"), rows.filter("split in ('val', 'test')"), ["first_question"]).select("id")


@query("id_slice", "F32 S8", f"WITH r AS ({RECORDS}) SELECT id, task FROM r WHERE id >= '40' AND id < 'c0' AND task IN ('code', 'dialogue')")
def _(spark, d):
    return filters.id_slice(table(spark, d, "samples").select("id", "task"), "40", "c0", ["code", "dialogue"]).distinct()


@query("identity_questions", "F30", f"WITH r AS ({RECORDS}) SELECT source, count(*) AS records FROM (SELECT {SOURCE} AS source FROM r WHERE regexp_matches(text, '(?i)自我意识|自身存在|存在的意义|存在的目的|真实来源|your (creator|identity)|are you (conscious|sentient)|你是一名')) GROUP BY source")
def _(spark, d):
    rows = _records(spark, d, "id", "source", "text")
    hit = filters.about_identity(F.col("text")) | F.contains("text", F.lit("你是一名"))
    return rows.filter(hit).groupBy(source_key(F.col("source")).alias("source")).agg(F.count("*").alias("records"))


# ---------------------------------------------------------------- duplicates


@query("exact_dedup", "P2 D1", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {FINGER}) AS kept FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", expr.plain_fingerprint(F.col("text")).alias("fp"))
    return dedup.duplicate_of(rows, "fp", "doc_id").select("doc_id", "kept")


@query("dup_clusters", "D1 D19", f"SELECT min(doc_id) AS kept, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY {FINGER} HAVING count(*) > 1")
def _(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", expr.plain_fingerprint(F.col("text")).alias("fp"))
    return rows.groupBy("fp").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1").select("kept", "copies")


@query("code_identity", "D1 P9", f"WITH r AS ({RECORDS}) SELECT sha256(concat('source-code', chr(0), text)) AS identity, min(id) AS kept, count(*) AS records FROM r WHERE task = 'code' GROUP BY 1")
def _(spark, d):
    rows = _records(spark, d, "id", "task", "text").filter("task = 'code'")
    return rows.groupBy(dedup.code_identity(F.col("text")).alias("identity")).agg(F.min("id").alias("kept"), F.count("*").alias("records"))


@query("first_question_cap", "D5", f"WITH r AS ({RECORDS}), n AS (SELECT id, first_question, row_number() OVER (PARTITION BY first_question ORDER BY id) AS k FROM r WHERE first_question <> '') SELECT id, first_question FROM n WHERE k <= 3")
def _(spark, d):
    rows = _records(spark, d, "id", "first_question").filter("first_question <> ''")
    return dedup.first_by(rows, ["first_question"], ["id"], 3)


SIM = r"CASE WHEN regexp_matches(lower(trim(simhash, ' ')), '^(0x)?[0-9a-f]{1,16}$') THEN ('0x' || lpad(regexp_replace(lower(trim(simhash, ' ')), '^0x', ''), 16, '0'))::UBIGINT END"


@query("simhash_pairs", "D4 J9 C5", f"WITH r AS ({RECORDS}), s AS (SELECT id, {SIM} AS v FROM r WHERE simhash IS NOT NULL) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND bit_count(xor(a.v, b.v)) <= 3 WHERE a.v <> 0 AND b.v <> 0")
def _(spark, d):
    rows = _records(spark, d, "id", "simhash").select("id", dedup.parsed_sim_hash(F.col("simhash")).alias("v")).filter("v <> 0")
    return dedup.band_pairs(rows, "id", "v", dedup.TEXT_BANDS, 3)


PHASH = r"('0x' || lpad(regexp_replace(lower(trim(phash, ' ')), '^0x', ''), 16, '0'))::UBIGINT"


@query("phash_neighbours", "D11 D12", f"WITH s AS (SELECT DISTINCT id, {PHASH} AS v FROM image_bands WHERE phash IS NOT NULL) SELECT DISTINCT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND bit_count(xor(a.v, b.v)) <= 6")
def _(spark, d):
    rows = table(spark, d, "image_bands").select("id", dedup.parsed_sim_hash(F.col("phash")).alias("v"))
    return dedup.band_pairs(rows, "id", "v", dedup.PICTURE_BANDS, 6)


WORDSET = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
JACCARD = f"""WITH r AS ({RECORDS}), s AS (SELECT id, split, {WORDSET} AS w FROM r), t AS (SELECT id, unnest(w) AS x FROM s),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS overlap FROM t a JOIN t b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT o.a, o.b, overlap, len(x.w) + len(y.w) - overlap AS united, x.split AS sa, y.split AS sb FROM o JOIN s x ON x.id = o.a JOIN s y ON y.id = o.b)
SELECT a, b, overlap, united FROM p WHERE 100 * overlap >= 85 * united"""


@query("jaccard_pairs", "D7 J13", JACCARD)
def _(spark, d):
    rows = table(spark, d, "samples").select("id", F.array_distinct(expr.simple_words(F.col("text"))).alias("tokens"))
    return dedup.exact_similar(rows)


@query("holdout_audit", "D8 D9 X7", JACCARD + " AND (coalesce(sa IN ('val', 'test'), false) OR coalesce(sb IN ('val', 'test'), false))")
def _(spark, d):
    rows = table(spark, d, "samples").select("id", "split", F.array_distinct(expr.simple_words(F.col("text"))).alias("tokens"))
    return dedup.exact_similar(rows, probe=F.col("split").isin("val", "test"))


@query("shingle_pairs", "D2 D7 J13", f"WITH {NEAR} SELECT x AS a, y AS b, c AS overlap, u AS united FROM near")
def _(spark, d):
    rows = table(spark, d, "samples").select("id", F.col("text").alias("x"), F.lit(True).alias("p"))
    return dedup.near_sets(rows, dedup.shingles_of)


@query("shingle_holdout_audit", "D8 D9 X7", f"WITH {NEAR} SELECT x AS a, y AS b, c AS overlap, u AS united FROM near JOIN r a ON a.id = x JOIN r b ON b.id = y WHERE coalesce(a.split IN ('val', 'test'), false) OR coalesce(b.split IN ('val', 'test'), false)")
def _(spark, d):
    held = F.coalesce(F.col("split").isin("val", "test"), F.lit(False))
    rows = table(spark, d, "samples").select("id", F.col("text").alias("x"), held.alias("p"))
    return dedup.near_sets(rows, dedup.shingles_of)


@query("admission_order", "D4 D5 D6")
def _(spark, d):
    rows = _records(spark, d, "id", "first_question", "simhash")
    conflicts = dedup.band_pairs(rows.select("id", dedup.parsed_sim_hash(F.col("simhash")).alias("v")).filter("v <> 0"), "id", "v", dedup.TEXT_BANDS, 3)
    return dedup.admitted(rows.select(F.col("id").alias("node"), F.col("first_question").alias("question")), conflicts)


@query("seen_pictures", "D13 D14 J15", "SELECT DISTINCT id FROM image_bands WHERE phash IS NOT NULL AND phash NOT IN (SELECT phash FROM image_bands WHERE id < '80' AND phash IS NOT NULL)")
def _(spark, d):
    rows = table(spark, d, "image_bands").filter("phash is not null")
    return filters.blocked(rows, rows.filter("id < '80'"), ["phash"]).select("id").distinct()


@query("transcription_dedup", "D18 D17", f"WITH r AS ({RECORDS}), n AS (SELECT id, split, row_number() OVER (PARTITION BY sha256(regexp_replace(text, '[ \\t\\n\\x{{0b}}\\f\\r]+', '', 'g')) ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, id) AS k FROM r WHERE task = 'ocr_document') SELECT id, split FROM n WHERE k = 1")
def _(spark, d):
    rows = _records(spark, d, "id", "split", "task", "text").filter("task = 'ocr_document'")
    rows = rows.select("id", "split", F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("fp"), F.when(F.col("split") == "test", 0).when(F.col("split") == "val", 1).otherwise(2).alias("p"))
    return dedup.first_by(rows, ["fp"], ["p", "id"]).select("id", "split")


@query("split_overlap", "D15 E5", f"WITH r AS ({RECORDS}) SELECT {FINGER} AS fp FROM r WHERE split = 'train' INTERSECT SELECT {FINGER} FROM r WHERE split IN ('val', 'test')")
def _(spark, d):
    rows = _records(spark, d, "id", "split", "text").select("split", expr.plain_fingerprint(F.col("text")).alias("fp"))
    return rows.filter("split = 'train'").select("fp").intersect(rows.filter("split in ('val', 'test')").select("fp"))


@query("prompt_uniqueness", "D16", f"WITH r AS ({RECORDS}) SELECT id AS node, id = min(id) OVER (PARTITION BY first_question) AS kept FROM r WHERE first_question <> ''")
def _(spark, d):
    rows = _records(spark, d, "id", "first_question").filter("first_question <> ''")
    least = rows.groupBy("first_question").agg(F.min("id").alias("b"))
    return dedup.first_independent(rows.select(F.col("id").alias("node")), rows.join(least, "first_question").filter("id <> b").select(F.col("id").alias("a"), "b"))


@query("stored_simhash_check", "D2 D3")
def _(spark, d):
    rows = _records(spark, d, "id", "text", "simhash").select("id", dedup.parsed_sim_hash(F.col("simhash")).alias("stored"), dedup.sim_hash(F.col("text")).alias("own"))
    return rows.select("id", F.when(F.col("stored").isNull(), "missing").when(F.col("stored") == F.col("own"), "equal").otherwise("differs").alias("state"))


# ---------------------------------------------------------------- groups and splits


@query(
    "hash_split", "G3 G6 G7",
    f"""WITH b AS (SELECT doc_id, {hex_bucket("concat('0:', doc_id)", 16, 10000)}::INT AS b16, {hex_bucket("concat('0:', doc_id)", 8, 100)}::INT AS b8, {hex_bucket("doc_id::VARCHAR", 8, 10000)}::INT AS b2 FROM documents)
SELECT doc_id, b16, CASE WHEN b16 < 50 THEN 'val' WHEN b16 < 100 THEN 'test' ELSE 'train' END AS split, CASE WHEN b8 < 2 THEN 'val' ELSE 'train' END AS legacy, CASE WHEN b2 < 9850 THEN 'train' WHEN b2 < 9900 THEN 'val' ELSE 'test' END AS native FROM b""",
)
def _(spark, d):
    k = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", expr.bucket(0, k).alias("b16"), splits.hashed_split(k).alias("split"), splits.two_way_split(k).alias("legacy"), splits.second_split(k).alias("native"))


@query("split_report", "A1 A2 A3 J1", f"WITH r AS ({RECORDS}) SELECT {SOURCE} AS source, split, count(*) AS records, count(DISTINCT group_root) AS groups, sum(length(text))::BIGINT AS tokens FROM r GROUP BY 1, 2")
def _(spark, d):
    rows = _records(spark, d, "id", "source", "split", "group_root", "text").select(source_key(F.col("source")).alias("source"), "split", "group_root", F.length("text").alias("tokens"))
    return reports.slice_counts(rows, ["source", "split"])


#: Components by the smallest label that reaches an id; keys are stars around their smallest id.
CC = """WITH RECURSIVE k AS (SELECT DISTINCT id, key FROM links WHERE id IS NOT NULL AND key IS NOT NULL), s AS (SELECT id, min(id) OVER (PARTITION BY key) AS hub FROM k),
e AS (SELECT id AS x, hub AS y FROM s UNION SELECT hub, id FROM s), c(x, r) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, c.r FROM c JOIN e ON c.x = e.x WHERE c.r < e.y), m AS (SELECT x AS id, min(r) AS root FROM c GROUP BY x)"""


def _all_links(spark, d):
    return table(spark, d, "links").select("id", "key").dropna().distinct()


@query("groups_cc", "G1 G2 G8", CC + " SELECT id, root AS group_root FROM m")
def _(spark, d):
    links = _all_links(spark, d)
    return splits.grouped(links, links.select("id").distinct()).select("id", "group_root")


@query(
    "group_split_locks", "G4 J4",
    f"""WITH r AS ({RECORDS}), k AS (SELECT group_root, max(CASE split WHEN 'test' THEN 2 ELSE 1 END) AS m FROM r WHERE split IN ('val', 'test') AND group_root IS NOT NULL GROUP BY 1),
h AS (SELECT id, group_root, {hex_bucket("concat('0:', group_root)", 16, 10000)} AS b FROM r WHERE group_root IS NOT NULL)
SELECT id, CASE WHEN m = 2 THEN 'test' WHEN m = 1 THEN 'val' WHEN b < 50 THEN 'val' WHEN b < 100 THEN 'test' ELSE 'train' END AS split FROM h LEFT JOIN k USING (group_root)""",
)
def _(spark, d):
    rows = _records(spark, d, "id", "group_root", "split").filter("group_root is not null")
    locks = rows.filter("split in ('val', 'test')").select("group_root", "split")
    return splits.with_locks(rows.select("id", "group_root", splits.hashed_split(F.col("group_root")).alias("split")), locks).select("id", "split")


@query("group_exclusion", "G5 B3", f"WITH r AS ({RECORDS}) SELECT id, group_root FROM r WHERE group_root IS NOT NULL AND group_root NOT IN (SELECT group_root FROM r WHERE id < '20' AND group_root IS NOT NULL)")
def _(spark, d):
    rows = _records(spark, d, "id", "group_root").filter("group_root is not null")
    return splits.without_groups(rows, rows.filter("id < '20'")).select("id", "group_root")


@query("group_conflicts", "G9 V4", CC + f", r AS ({RECORDS}) SELECT root AS group_root, count(DISTINCT split) AS splits, count(*) AS nodes FROM m JOIN r USING (id) GROUP BY root HAVING count(DISTINCT split) > 1")
def _(spark, d):
    links = _all_links(spark, d)
    own = splits.grouped(links, links.select("id").distinct()).join(_records(spark, d, "id", "split"), "id")
    return own.groupBy("group_root").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("nodes")).filter("splits > 1")


NEAR_PICTURES = f"SELECT DISTINCT a.id AS x, b.id AS y FROM (SELECT DISTINCT id, {PHASH} AS v FROM image_bands WHERE phash IS NOT NULL) a JOIN (SELECT DISTINCT id, {PHASH} AS v FROM image_bands WHERE phash IS NOT NULL) b ON a.id < b.id AND bit_count(xor(a.v, b.v)) <= 6"


@query(
    "media_identity_groups", "G10 G9",
    f"""WITH RECURSIVE r AS ({RECORDS}), k AS (SELECT DISTINCT id, key, CASE WHEN starts_with(key, 'rgb:') THEN 'exact_rgb' ELSE 'origin_alias' END AS reason FROM links WHERE key LIKE 'rgb:%' OR key LIKE 'origin_id:%'),
h AS (SELECT id, min(id) OVER (PARTITION BY key) AS hub, reason FROM k), t AS (SELECT id AS x, hub AS y, reason FROM h WHERE id <> hub UNION SELECT x, y, 'phash_neighbour' FROM ({NEAR_PICTURES})),
e AS (SELECT x, y FROM t UNION SELECT y, x FROM t), c(x, r) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, c.r FROM c JOIN e ON c.x = e.x WHERE c.r < e.y), m AS (SELECT x AS id, min(r) AS root FROM c GROUP BY x),
w AS (SELECT root, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM t JOIN m ON t.x = m.id GROUP BY root)
SELECT root AS group_root, count(DISTINCT split) AS splits, count(*) AS nodes, any_value(reasons) AS reasons FROM m JOIN r USING (id) JOIN w USING (root) GROUP BY root HAVING count(DISTINCT split) > 1""",
)
def _(spark, d):
    links = _all_links(spark, d)
    star = lambda prefix: star_edges(links.filter(F.col("key").startswith(prefix)), "id", "key")
    pictures = table(spark, d, "image_bands").select("id", dedup.parsed_sim_hash(F.col("phash")).alias("v"))
    near = dedup.band_pairs(pictures, "id", "v", dedup.PICTURE_BANDS, 6)
    nodes = _records(spark, d, "id", "split").withColumnRenamed("id", "node")
    return splits.identity_groups(nodes, [("origin_alias", star("origin_id:")), ("exact_rgb", star("rgb:")), ("phash_neighbour", near)])[1]


@query("identity_aliases", "G13", "SELECT id, string_agg(DISTINCT key, '|' ORDER BY key) AS aliases FROM links WHERE key LIKE 'rgb:%' GROUP BY id")
def _(spark, d):
    return splits.aliases(table(spark, d, "links"), "rgb:")


@query("group_fractions", "A13 A5", f"WITH r AS ({RECORDS}), e AS (SELECT source, split, count(DISTINCT group_root) AS groups FROM (SELECT {SOURCE} AS source, split, group_root FROM r WHERE split IS NOT NULL) GROUP BY 1, 2) SELECT source, split, groups, round(groups / sum(groups) OVER (PARTITION BY source), 6) AS share FROM e")
def _(spark, d):
    rows = _records(spark, d, "id", "source", "split", "group_root").filter("split is not null").withColumn("source", source_key(F.col("source")))
    return splits.group_fractions(rows)


# ---------------------------------------------------------------- views


VIEW = f"""WITH r AS ({RECORDS}), v AS (SELECT DISTINCT group_root FROM r WHERE group_root LIKE '0%'), t AS (SELECT DISTINCT group_root FROM r WHERE group_root LIKE '1%'), x AS (SELECT DISTINCT group_root FROM r WHERE group_root LIKE '2%'),
n AS (SELECT id, CASE WHEN group_root IN (FROM t) THEN 'test' WHEN group_root IN (FROM v) THEN 'val' ELSE split END AS split, task FROM r WHERE group_root IS NULL OR group_root NOT IN (FROM x))"""


def _view(spark, d):
    rows = _records(spark, d, "id", "group_root", "split", "task")
    of = lambda p: rows.filter(f"group_root like '{p}%'").select("group_root")
    return rows, views.effective(rows, of("0"), of("2"), of("1"))


@query("partition_view", "V1 V5 J3", VIEW + " SELECT id, split FROM n")
def _(spark, d):
    return _view(spark, d)[1].select("id", "split")


@query(
    "membership_delta", "E7 E1 J7",
    VIEW + """ SELECT coalesce(r.id, n.id) AS id, r.split AS old, n.split AS new,
 CASE WHEN n.id IS NULL THEN 'remove_' || r.split WHEN r.split = n.split THEN 'unchanged' WHEN n.split = 'train' OR (r.split = 'test' AND n.split = 'val') THEN 'forbidden' ELSE 'moved' END AS change
 FROM (SELECT id, split FROM r WHERE split IS NOT NULL) r LEFT JOIN n USING (id)""",
)
def _(spark, d):
    old, new = _view(spark, d)
    own = old.filter("split is not null")
    return views.delta(own, new.join(own.select("id"), "id", "left_semi"))


@query("membership_digest", "A11 T15", f"WITH r AS ({RECORDS}) SELECT split, count(*) AS records, sum((('0x' || substr(sha256(concat(id, ':', split)), 1, 15))::UBIGINT)::DECIMAL(38,0))::VARCHAR AS digest FROM r WHERE split IS NOT NULL GROUP BY split")
def _(spark, d):
    return views.membership_digest(_records(spark, d, "id", "split").filter("split is not null"))


@query("task_relabel", "V2 V6 P15 J5", f"WITH r AS ({RECORDS}) SELECT r.task AS old, CASE WHEN r.task = 'caption_or_vqa' AND contains(r.text, '?') THEN 'vqa' WHEN r.task = 'caption_or_vqa' THEN 'caption' ELSE r.task END AS new, count(*) AS records FROM r GROUP BY 1, 2 HAVING old <> new")
def _(spark, d):
    rows = _records(spark, d, "id", "task", "text")
    task = F.when(F.col("task") == "caption_or_vqa", F.when(F.contains("text", F.lit("?")), "vqa").otherwise("caption")).otherwise(F.col("task"))
    new = views.relabelled(rows, task).select("id", F.col("task").alias("new"))
    return rows.select("id", F.col("task").alias("old")).join(new, "id").filter("old <> new").groupBy("old", "new").agg(F.count("*").alias("records"))


@query(
    "reservation_faults", "V3 J2",
    f"WITH r AS ({RECORDS}), g AS (SELECT group_root, min(split) AS lo, max(split) AS hi FROM r WHERE group_root IS NOT NULL GROUP BY 1) SELECT group_root, 'val_from_held_out' AS fault FROM g WHERE group_root LIKE '0%' AND (lo <> 'train' OR hi <> 'train') UNION ALL SELECT group_root, 'test_not_from_val' FROM g WHERE group_root LIKE '1%' AND (lo <> 'val' OR hi <> 'val') UNION ALL SELECT group_root, 'excluded_held_out' FROM g WHERE group_root LIKE '2%' AND (lo <> 'train' OR hi <> 'train') UNION ALL SELECT group_root, 'unknown_group' FROM g WHERE substr(group_root, 1, 1) IN ('0', '1', '2') AND lo IS NULL",
)
def _(spark, d):
    rows = _records(spark, d, "id", "group_root", "split").filter("group_root is not null")
    of = lambda p: rows.filter(f"group_root like '{p}%'").select("group_root")
    return views.reservation_faults(rows, of("0"), of("2"), of("1"))


@query("too_few_held", "A5", f"WITH r AS ({RECORDS}), c AS (SELECT {SOURCE} AS source, count(DISTINCT group_root) AS groups, count(DISTINCT CASE WHEN split = 'val' THEN group_root END) AS held FROM r GROUP BY 1) SELECT source, groups, held, ceil(groups * 0.08::DOUBLE)::BIGINT AS needed FROM c WHERE held < needed")
def _(spark, d):
    rows = _records(spark, d, "id", "source", "group_root", "split").withColumn("source", source_key(F.col("source")))
    return views.too_few_held(rows, 0.08)


@query("except_equality", "E2 S7 L1", f"WITH r AS ({RECORDS}), a AS (SELECT id, task FROM r), b AS (SELECT id, coalesce(task, 'none') AS task FROM r) SELECT 'left' AS side, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS \"rows\" UNION ALL SELECT 'right', (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a))")
def _(spark, d):
    rows = _records(spark, d, "id", "task")
    return views.equal_rows(rows, rows.withColumn("task", F.coalesce("task", F.lit("none"))))


@query("composition_faults", "V8", f"WITH r AS ({RECORDS}) SELECT 'group_root' AS kind, group_root AS value FROM r WHERE group_root IS NOT NULL AND split IS NOT NULL GROUP BY group_root HAVING min(split) <> max(split)")
def _(spark, d):
    rows = _records(spark, d, "id", "group_root", "split").filter("split is not null")
    parts = views.composed([rows.filter("id < '80'"), rows.filter("id >= '80'")])
    return views.composition_faults(parts, ["group_root"])


@query("union_aliases", "E3 E4", f"SELECT {FINGER} AS fp, min(doc_id) AS retained, count(DISTINCT doc_id) AS members FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def _(spark, d):
    # the two slices share a third of the documents, and together hold all of them
    docs = table(spark, d, "documents").filter("text is not null").select(expr.plain_fingerprint(F.col("text")).alias("fp"), "doc_id")
    both = docs.filter("doc_id % 3 <> 1").union(docs.filter("doc_id % 3 <> 2")).distinct()
    return both.groupBy("fp").agg(F.min("doc_id").alias("retained"), F.count("*").alias("members")).filter("members > 1")


# ---------------------------------------------------------------- contamination


GRAM = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
CONTAM = f"""WITH r AS ({RECORDS}), j AS (SELECT id, group_root, split, text, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r),
t AS (SELECT *, CASE WHEN json_array_length(p, '$.turns') > 0 THEN (p->'turns')::JSON[] END AS t FROM j),
q AS (SELECT id, {GRAM("list_filter(t, lambda x: (x->>'role') = 'user')[1]->>'content'")} AS w, true AS whole FROM t WHERE split IN ('val', 'test')
  UNION ALL SELECT id, {GRAM("CASE WHEN t IS NULL THEN text ELSE list_filter(t, lambda x: (x->>'role') = 'assistant')[-1]->>'content' END")}, false FROM t WHERE split IN ('val', 'test')),
i AS (SELECT id, w, whole, array_to_string(w, ' ') AS s FROM q WHERE w IS NOT NULL),
g AS (SELECT DISTINCT array_to_string(w[k:k+12], ' ') AS gram FROM (SELECT w, unnest(generate_series(1, len(w) - 12)) AS k FROM i WHERE len(w) >= 13) WHERE length(gram) >= 64),
o AS (SELECT DISTINCT s FROM i WHERE whole AND length(s) >= 32),
n AS (SELECT id, {GRAM("text")} AS w FROM r WHERE split = 'train'),
h AS (SELECT DISTINCT id FROM (SELECT id, array_to_string(w[k:k+12], ' ') AS gram FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM n WHERE len(w) >= 13)) WHERE gram IN (FROM g)
  UNION SELECT id FROM j WHERE split = 'train' AND lower(p->>'repo_id') IN ('openai/human-eval', 'openai/grade-school-math', 'google-research/google-research') UNION SELECT n.id FROM n JOIN o ON contains(concat(' ', array_to_string(n.w, ' '), ' '), concat(' ', o.s, ' ')))"""


def _hits(spark, d):
    """Items are the held-out records: their opening question as prompt, their last answer, or the text where they have no turns, as answer."""
    spell = lambda c: F.array_join(expr.simple_words(c), " ")
    rows = table(spark, d, "samples")  # repeated rows change no match
    held = rows.filter("split in ('val', 'test')").select("id", "text", chat.parsed_turns(F.col("payload")).alias("turns"))
    last = F.try_element_at(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(-1))["content"]
    items = readers.benchmark_items(held.select(F.col("id").alias("item"), spell(chat.first_user(F.col("turns"))).alias("prompt"), spell(F.when(F.size("turns") > 0, last).otherwise(F.col("text"))).alias("answer")), "prompt", "answer", "held-out")
    train = rows.filter("split = 'train'").select("id", spell(F.col("text")).alias("text"), F.get_json_object("payload", "$.repo_id").alias("repo_id"))
    return decontam.all_matches(train, decontam.all_phrases(written(items)))  # read several times


@query("contamination_13gram", "B1 B2 S13 C4", CONTAM + " SELECT id FROM h")
def _(spark, d):
    return _hits(spark, d).select("id")


@query("contamination_groups", "B3 G5", CONTAM + " SELECT id FROM r WHERE group_root IN (SELECT group_root FROM r WHERE id IN (FROM h))")
def _(spark, d):
    return decontam.excluded(_records(spark, d, "id", "group_root"), _hits(spark, d)).select("id")


# ---------------------------------------------------------------- chats


TURNS = f"""WITH r AS ({RECORDS}), j AS (SELECT id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r), t AS (SELECT id, (p->'turns')::JSON[] AS t FROM j WHERE json_array_length(p, '$.turns') > 0)"""


@query("chat_flatten", "P5 P6", TURNS + r""", f AS (SELECT id, list_transform(t, lambda x: upper(substr(x->>'role', 1, 1)) || substr(x->>'role', 2) || ': ' || coalesce(x->>'content', '')) AS l FROM t)
SELECT id, len(l) AS turns, sha256(array_to_string(l, chr(10))) AS digest FROM f""")
def _(spark, d):
    rows = _records(spark, d, "id", "payload").select("id", chat.parsed_turns(F.col("payload")).alias("t")).filter(F.size("t") > 0)
    return rows.select("id", F.size("t").cast("long").alias("turns"), F.sha2(chat.flattened(F.col("t"), "lines"), 256).alias("digest"))


@query("chat_validity", "F3 F4 F13 F27", TURNS + r""" SELECT id, coalesce(t[-1]->>'role', '') <> 'assistant' OR trim(coalesce(t[-1]->>'content', ''), ' ') = '' AS incomplete,
 len(list_filter(t, lambda x: (x->>'role') NOT IN ('system', 'user', 'assistant', 'tool') OR ((x->>'content') IS NULL AND (x->>'tool_calls') IS NULL))) > 0 AS invalid,
 len(list_filter(t, lambda x: (x->>'role') IN ('system', 'user', 'assistant') AND (x->>'content') IS NOT NULL)) = len(t) AND (t[-1]->>'role') = 'assistant' AS dialogue,
 len(t) % 2 = 0 AND len(list_filter(t, lambda x, i: (x->>'role') = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AND (x->>'tool_calls') IS NULL AND coalesce(x->>'reasoning', '') = '')) = len(t) AS direct FROM t""")
def _(spark, d):
    rows = _records(spark, d, "id", "payload").select("id", chat.parsed_turns(F.col("payload")).alias("t")).filter(F.size("t") > 0)
    t = F.col("t")
    return rows.select("id", chat.incomplete(t).alias("incomplete"), chat.invalid(t).alias("invalid"), chat.dialogue(t).alias("dialogue"), chat.direct(t).alias("direct"))


@query("picture_counts", "A4 C3", f"""WITH r AS ({RECORDS}), j AS (SELECT split, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r), m AS (SELECT split, unnest((p->'media')::JSON[]) AS m FROM j WHERE json_array_length(p, '$.media') > 0)
SELECT split, count(DISTINCT m->>'rgb_sha256') AS media FROM m GROUP BY split""")
def _(spark, d):
    rows = _records(spark, d, "id", "split", "payload").select("split", F.from_json(F.get_json_object("payload", "$.media"), "array<struct<rgb_sha256:string>>").alias("media"))
    return reports.distinct_media(rows, "media", "rgb_sha256")


# ---------------------------------------------------------------- the whole slice


@query(
    "slice_report", "F5 F6 P2 D1 G3 A1",
    f"""WITH f AS (SELECT doc_id, {SOURCE} AS source, coalesce(group_id, doc_id::VARCHAR) AS root, length(text) AS chars, {FINGER} AS fp FROM documents WHERE ({ADMISSION}) IS NULL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS n FROM f) WHERE n = 1), s AS (SELECT *, {hex_bucket("concat('0:', root)", 16, 10000)} AS b FROM k)
SELECT source, CASE WHEN b < 50 THEN 'val' WHEN b < 100 THEN 'test' ELSE 'train' END AS split, count(*) AS records, count(DISTINCT root) AS groups, sum(chars)::BIGINT AS tokens FROM s GROUP BY 1, 2""",
)
def slice_report(spark, d):
    docs = table(spark, d, "documents").filter(filters.admission(F.col("text")).isNull())
    rows = docs.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("group_id", F.col("doc_id").cast("string")).alias("group_root"), F.length("text").alias("tokens"), expr.plain_fingerprint(F.col("text")).alias("fp"))
    kept = dedup.first_by(rows, ["fp"], ["doc_id"]).withColumn("split", splits.hashed_split(F.col("group_root")))
    return reports.slice_counts(kept, ["source", "split"])


@query("train_groups", "G8", f"SELECT count(DISTINCT group_id) AS groups FROM documents WHERE {hex_bucket("concat('7:', group_id)", 16, 10000)} >= 100")
def _(spark, d):
    return table(spark, d, "documents").filter(splits.hashed_split(F.col("group_id"), 7) == "train").agg(F.countDistinct("group_id").alias("groups"))


@query("documents_by_url_site", "P7 C2", r"SELECT regexp_replace(concat('https://', group_id, '/x#frag'), '#.*$', '') AS document_id, count(*) AS records FROM documents WHERE group_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    url = F.concat(F.lit("https://"), "group_id", F.lit("/x#frag"))
    return table(spark, d, "documents").filter("group_id is not null").groupBy(expr.without_fragment(url).alias("document_id")).agg(F.count("*").alias("records"))




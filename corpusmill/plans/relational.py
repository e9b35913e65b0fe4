"""Queries of relational shapes, verifiers, lookups and vectors on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import chat, expr
from corpusmill.operators import encode, filters, reports, retrieval, verify, views
from corpusmill.plans.registry import query
from corpusmill.session import TOKENIZERS, table, written
from corpusmill.sources import generators, readers


@query("order_revenue", "J1 J2 A1", "SELECT n_name, o_orderpriority, count(DISTINCT o_orderkey) AS orders, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1998-09-02").cast("timestamp_ntz")).select("l_orderkey", (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("r"))
    # lines of an order are summed before the joins: fewer rows meet orders and customers
    per = li.groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = per.join(o, per.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.sum("r").cast("double").alias("revenue"))


@query("left_anti_exclusion", "J3 J8", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    return filters.blocked(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("left_join_default", "J4 J6", "SELECT c_mktsegment, coalesce(o_orderstatus, 'none') AS status, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment", F.coalesce("o_orderstatus", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query("self_join_diff", "J5 A10", "SELECT a.l_orderkey, a.l_linenumber, a.l_returnflag AS old, CASE WHEN a.l_quantity > 45 THEN 'X' ELSE a.l_returnflag END AS new FROM lineitem a WHERE a.l_quantity > 45")
def _(spark, d):
    base = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    new = base.withColumn("new", F.when(F.col("l_quantity") > 45, "X").otherwise(F.col("l_returnflag")))
    # the labels differ row by row, so no join with the base is needed
    return new.filter(F.col("new") != F.col("l_returnflag")).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("old"), "new")


@query("counter_faults", "A10 A24 V10", "WITH p AS (SELECT l_returnflag, sum(l_linenumber)::BIGINT AS p FROM lineitem GROUP BY 1), r AS (SELECT l_returnflag, sum(l_linenumber)::BIGINT AS r FROM lineitem WHERE l_quantity > 40 GROUP BY 1), a AS (SELECT l_returnflag, sum(l_linenumber)::BIGINT AS a FROM lineitem WHERE l_quantity <= 40 AND l_returnflag <> 'A' GROUP BY 1) SELECT l_returnflag, p, coalesce(r, 0) AS r, coalesce(a, 0) AS a FROM p LEFT JOIN r USING (l_returnflag) LEFT JOIN a USING (l_returnflag) WHERE p - coalesce(r, 0) <> coalesce(a, 0)")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return views.counter_faults(li, li.filter("l_quantity > 40"), li.filter("l_quantity <= 40 and l_returnflag <> 'A'"), ["l_returnflag"], "l_linenumber")


@query("length_histogram", "A8 A7", "SELECT l_shipmode AS mode, class, count(*) AS records FROM (SELECT l_returnflag AS l_shipmode, CASE WHEN l_extendedprice <= 512 THEN '512' WHEN l_extendedprice <= 1024 THEN '1024' WHEN l_extendedprice <= 2048 THEN '2048' WHEN l_extendedprice <= 4096 THEN '4096' WHEN l_extendedprice <= 8192 THEN '8192' ELSE 'over' END AS class FROM lineitem) GROUP BY 1, 2")
def _(spark, d):
    return reports.length_histogram(table(spark, d, "lineitem").withColumn("mode", F.col("l_returnflag")), ["mode"], "l_extendedprice")


@query("most_frequent", "A12", "WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS k FROM c) SELECT l_returnflag, l_linenumber, n AS votes FROM r WHERE k = 1")
def _(spark, d):
    return reports.most_frequent(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber")


@query("group_advantage", "A19", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / greatest(coalesce(stddev_pop(l_quantity) OVER w, 0), 0.0001), 5) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return reports.group_advantage(rows, "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", F.round("advantage", 5).alias("advantage"))


@query("generation_summary", "A17 A21", "SELECT o_orderpriority AS domain, count(*) FILTER (WHERE o_orderstatus = 'F') AS correct, count(*) AS total, sum(o_custkey)::BIGINT AS tokens FROM orders GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("domain"), (F.col("o_orderstatus") == "F").alias("correct"), F.col("o_custkey").alias("tokens"))
    return reports.generation_summary(rows, ["domain"])


@query("preference_loss", "A18", "SELECT round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN m = 0 THEN 1.0 ELSE 0 END), 6) AS ties, round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 6) AS loss FROM (SELECT round((c_acctbal - 4000) / 1000, 1) AS m FROM customer)")
def _(spark, d):
    rows = table(spark, d, "customer").select(F.round((F.col("c_acctbal") - 4000) / 1000, 1).alias("margin"))
    return reports.preference_loss(rows).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "ties", "loss")])


@query("token_loss", "A18", "SELECT o_orderstatus AS domain, round(sum(o_totalprice) / sum(o_custkey + 1), 6) AS nll, round(sum(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) / sum(o_custkey + 1), 9) AS accuracy FROM orders GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("domain"), F.col("o_totalprice").alias("nll"), F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0).alias("correct"), (F.col("o_custkey") + 1).alias("tokens"))
    return reports.token_loss(rows, ["domain"]).select("domain", F.round("nll", 6).alias("nll"), F.round("accuracy", 9).alias("accuracy"))


@query("verify_answers", "R1 R4", r"SELECT o_orderkey, CASE WHEN regexp_matches(t, '^\s*[-+]?\d+\s*[.!。]?\s*$') AND regexp_extract(t, '([-+]?\d+)', 1)::BIGINT = o_custkey THEN 1::DOUBLE ELSE 0 END AS as_integer, CASE WHEN trim(t, ' ') = o_custkey::VARCHAR THEN 1::DOUBLE ELSE 0 END AS exact FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey || '. ' WHEN 1 THEN '+' || o_custkey WHEN 2 THEN 'it is ' || o_custkey ELSE ' ' || o_custkey END AS t FROM orders)")
def _(spark, d):
    k = F.col("o_custkey").cast("string")
    m = F.col("o_orderkey") % 4
    text = F.when(m == 0, F.concat(F.lit(" "), k, F.lit(". "))).when(m == 1, F.concat(F.lit("+"), k)).when(m == 2, F.concat(F.lit("it is "), k)).otherwise(F.concat(F.lit(" "), k))
    return table(spark, d, "orders").select("o_orderkey", verify.integer(text, F.col("o_custkey")).alias("as_integer"), verify.exact(text, k).alias("exact"))


@query("verify_tool_state", "R3", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN 1::DOUBLE ELSE 0 END AS score FROM orders")
def _(spark, d):
    state = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    errors = F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", verify.tool_state(state, F.create_map(F.lit("status"), F.lit("F")), errors).alias("score"))


@query("lookup_limit32", "L8 R5", "SELECT count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM (SELECT p_name, p_size FROM part WHERE p_type = 'SMALL' AND p_size = 7 LIMIT 32)")
def _(spark, d):
    rows = retrieval.lookup(table(spark, d, "part"), {"p_type": "SMALL", "p_size": 7}, ["p_name", "p_size"])
    return rows.agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))


@query("search_top3", "L7 R5", "SELECT p_partkey, score FROM (SELECT p_partkey, (contains(lower(p_name), 'red') AND true)::INT + contains(lower(p_name), 'widget')::INT + contains(lower(p_name), 'bolt')::INT AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 3")
def _(spark, d):
    return retrieval.search(table(spark, d, "part"), "Red widget bolt", F.col("p_name"), "p_partkey").select("p_partkey", "score")


@query(
    "embedding_recall1", "A20",
    "WITH p AS (SELECT a.vec_id AS qid, a.label AS ql, b.label AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), c AS (SELECT sum(n * n) AS s, sum(n) AS t FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) SELECT count(*) AS queries, sum(CASE WHEN ql = l THEN 1 ELSE 0 END)::BIGINT AS hits, round(sum(CASE WHEN ql = l THEN 1 ELSE 0 END) / count(*), 6) AS recall, round(any_value(s / (t * t)), 6) AS chance FROM p, c WHERE k = 1",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("ql"))
    return reports.recall_at_1(q, e.select(F.col("vec_id").alias("iid"), F.col("embedding").alias("v"), F.col("label").alias("l")))


@query("group_shares", "A23", "WITH o AS (SELECT c_mktsegment AS source, sum(c_custkey)::BIGINT AS tokens FROM customer GROUP BY 1), t(source, target) AS (VALUES ('BUILDING', 0.3::DOUBLE), ('HOUSEHOLD', 0.2::DOUBLE), ('NOWHERE', 0.5::DOUBLE)) SELECT coalesce(o.source, t.source) AS source, coalesce(tokens, 0)::BIGINT AS tokens, round(coalesce(tokens, 0) / sum(coalesce(tokens, 0)) OVER (), 6) AS share, target FROM o FULL JOIN t ON o.source = t.source")
def _(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), "c_custkey")
    targets = spark.createDataFrame([("BUILDING", 0.3), ("HOUSEHOLD", 0.2), ("NOWHERE", 0.5)], "source string, target double")
    return reports.share_profile(rows, "source", "c_custkey", targets)


@query("reconciled_counts", "A24 J7", "WITH c AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1), s AS (SELECT r_regionkey AS k, CASE WHEN r_regionkey = 2 THEN 4 ELSE 5 END::BIGINT AS n FROM region) SELECT coalesce(c.k, s.k) AS k, c.n AS computed_n, s.n AS stated_n FROM c FULL JOIN s ON c.k = s.k WHERE c.n IS DISTINCT FROM s.n")
def _(spark, d):
    c = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))
    s = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.when(F.col("r_regionkey") == 2, 4).otherwise(5).cast("long").alias("n"))
    return reports.reconciled(c, s, ["k"], ["n"])


@query("paired_controls", "F35", "SELECT s_suppkey, s_name, false AS control FROM supplier UNION ALL SELECT s_suppkey, 'blank', true FROM supplier")
def _(spark, d):
    return filters.paired_controls(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_name", F.lit("blank"))


@query("path_rewrite", "P11 P14", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') THEN '/data/' || substr(p_name, 4) ELSE p_name END AS path, replace(p_type, 'ECONOMY', 'E' || chr(8288) || 'CONOMY') AS safe FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", expr.moved_prefix(F.col("p_name"), "red", "/data/").alias("path"), expr.escaped_controls(F.col("p_type"), ["ECONOMY"]).alias("safe"))


@query("content_hashes", "P9 C6", "SELECT p_partkey, sha256(p_name) AS raw_sha256, sha1(concat('blob ', strlen(p_name), chr(0), p_name)) AS blob_sha1 FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("raw_sha256"), expr.git_blob_sha1(F.col("p_name")).alias("blob_sha1"))


@query("mode_resolution", "P16", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'thinking' WHEN 1 THEN 'direct' WHEN 2 THEN 'thinking' END AS mode, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'max' END AS effort FROM orders")
def _(spark, d):
    m = F.col("o_orderkey") % 4
    mode = F.when(m == 0, "thinking-high").when(m == 3, "unknown")
    effort = F.when(m == 2, "thinking-max")
    r = expr.mode_and_effort(mode, effort)
    return table(spark, d, "orders").select("o_orderkey", r["mode"].alias("mode"), r["effort"].alias("effort"))


@query("strict_numbers", "C11 F12", "SELECT run, count(*) FILTER (WHERE lm_loss IS NOT NULL AND NOT isnan(lm_loss) AND NOT isinf(lm_loss)) AS finite, count(*) AS n FROM run_metrics GROUP BY run")
def _(spark, d):
    return table(spark, d, "run_metrics").groupBy("run").agg(F.sum(F.when(expr.is_real(F.col("lm_loss")), 1).otherwise(0)).alias("finite"), F.count("*").alias("n"))


MEDIA = "WITH r AS (SELECT DISTINCT * FROM samples), j AS (SELECT id, text, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r), m AS (SELECT id, text, unnest((p->'media')::JSON[]) AS m FROM j WHERE json_array_length(p, '$.media') > 0)"


def _media(spark, d):
    rows = table(spark, d, "samples").select("id", "text", "payload").dropDuplicates(["id"]).filter(F.try_parse_json("payload").isNotNull())
    return rows.select("id", "text", F.explode(F.from_json(F.get_json_object("payload", "$.media"), "array<struct<kind:string,width:int,height:int,rgb_sha256:string>>")).alias("m")).select("id", "text", "m.*")


@query("image_bounds", "F24", MEDIA + " SELECT id, m->>'rgb_sha256' AS rgb, CASE WHEN w IS NULL OR h IS NULL THEN 'missing_size' WHEN 3 * w * h > 16777216 THEN 'too_many_bytes' WHEN w * h > 20000000 THEN 'too_many_pixels' WHEN least(w, h) < 32 THEN 'side_below_32' END AS reason FROM (SELECT *, (m->>'width')::BIGINT AS w, (m->>'height')::BIGINT AS h FROM m)")
def _(spark, d):
    raw = 3 * F.col("width").cast("long") * F.col("height")  # bytes of the decoded picture
    return _media(spark, d).select("id", F.col("rgb_sha256").alias("rgb"), filters.image_bounds(raw, F.col("width"), F.col("height")).alias("reason"))


@query("video_captions", "F26", MEDIA + " SELECT id FROM m WHERE length(trim(text, ' ')) BETWEEN 40 AND 16000 AND (m->>'width')::DOUBLE / 64 BETWEEN 2 AND 30 AND (m->>'height')::BIGINT BETWEEN 8 AND 3600")
def _(spark, d):
    # pictures stand in for clips: a second for 64 columns, a frame for a row
    rows = _media(spark, d)
    return rows.filter(filters.video_caption(F.col("text"), F.col("width").cast("double") / 64, F.col("height"))).select("id")


@query("over_context", "F34", "WITH r AS (SELECT DISTINCT * FROM samples) SELECT task, count(*) FILTER (WHERE length(text) > 1024) AS rejected, count(*) FILTER (WHERE length(text) <= 1024) AS kept FROM r GROUP BY task")
def _(spark, d):
    bad = filters.over_context(F.length("text"), 1_024)
    rows = table(spark, d, "samples").select("id", "task", "text").dropDuplicates(["id"])
    return rows.groupBy("task").agg(F.count(F.when(bad, 1)).alias("rejected"), F.count(F.when(~bad, 1)).alias("kept"))


@query("span_merge", "T16 T7 J6", "SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part")
def _(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return views.span_merge(old, old.filter("k % 10 = 0").withColumn("name", F.upper("name")), "k")


@query("encoded_windows", "T3 T14 S9")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text").filter("text is not null")
    enc = encode.encoded_documents(rows, RANKS, PATTERN)
    return enc.select("id", F.size("tokens").alias("tokens"), encode.supervised(F.col("labels")).alias("supervised"))


@query("encoded_chats", "T4")
def _(spark, d):
    rows = table(spark, d, "samples").select("id", chat.parsed_turns(F.col("payload")).alias("turns")).dropDuplicates(["id"])
    known = rows.filter(F.size("turns") > 0).filter(~chat.invalid(F.col("turns")))
    return encode.encoded_chats(known, RANKS, PATTERN).select("id", F.size("tokens").alias("tokens"), encode.supervised(F.col("labels")).alias("supervised"))


CHATS = """WITH r AS (SELECT DISTINCT * FROM samples), j AS (SELECT id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r), u AS (SELECT id, (p->'turns')::JSON[] AS t FROM j WHERE json_array_length(p, '$.turns') > 0),
a AS (SELECT id, t, CASE WHEN len(list_filter(t, lambda x: coalesce(x->>'reasoning', '') <> '')) > 0 THEN 'thinking' ELSE 'direct' END AS mode FROM u)"""


def _controlled(spark, d):
    """id, turns, mode, effort, fault: chats, in thinking mode at high effort if some turn has reasoning."""
    rows = table(spark, d, "samples").select("id", chat.parsed_turns(F.col("payload")).alias("turns")).dropDuplicates(["id"]).filter(F.size("turns") > 0)
    thinks = F.exists("turns", lambda t: F.coalesce(t["reasoning"], F.lit("")) != "")
    m = expr.mode_and_effort(F.when(thinks, "thinking-high"), F.lit(None).cast("string"))
    rows = rows.withColumn("m", m).select("id", "turns", F.col("m.mode").alias("mode"), F.col("m.effort").alias("effort"))
    return rows.withColumn("fault", encode.control_fault(F.col("turns"), F.col("mode")))


@query(
    "control_template", "T5 P16 P5",
    CHATS + """, f AS (SELECT *, CASE WHEN len(list_filter(t, lambda x: (x->>'role') NOT IN ('system', 'user', 'assistant', 'tool'))) > 0 THEN 'unknown_role' WHEN mode = 'thinking' AND len(list_filter(t, lambda x: (x->>'role') = 'assistant' AND coalesce(x->>'reasoning', '') = '' AND coalesce(x->>'tool_calls', '') = '')) > 0 THEN 'no_reasoning_in_thinking_mode' END AS fault FROM a)
SELECT id, mode, fault, 4 + list_sum(list_transform(t, lambda x: CASE WHEN (x->>'role') = 'assistant' THEN 5 + CASE WHEN coalesce(x->>'reasoning', '') <> '' THEN 3 ELSE 0 END WHEN (x->>'role') = 'tool' THEN 4 ELSE 3 END))::INT AS segments,
 list_sum(list_transform(t, lambda x: CASE WHEN (x->>'role') = 'assistant' THEN 3 + CASE WHEN coalesce(x->>'reasoning', '') <> '' THEN 3 ELSE 0 END ELSE 0 END))::INT AS learned,
 list_sum(list_transform(t, lambda x: CASE WHEN coalesce(x->>'tool_calls', '') <> '' AND (x->>'role') = 'assistant' THEN 0 ELSE length(coalesce(x->>'content', '')) END))::BIGINT AS plain_chars FROM f""",
)
def _(spark, d):
    rows = _controlled(spark, d).withColumn("s", encode.control_segments(F.col("turns"), F.col("mode"), F.col("effort")))
    spoken = F.filter("turns", lambda t: ~((F.coalesce(t["tool_calls"], F.lit("")) != "") & (t["role"] == "assistant")))
    plain = F.aggregate(spoken, F.lit(0).cast("long"), lambda n, t: n + F.length(F.coalesce(t["content"], F.lit(""))))
    return rows.select("id", "mode", "fault", F.size("s").alias("segments"), F.size(F.filter("s", lambda x: x["learned"])).alias("learned"), plain.alias("plain_chars"))


@query(
    "parsed_actions", "T5 T14",
    CHATS + """, x AS (SELECT id, mode, unnest(t) AS t FROM a) SELECT mode, CASE WHEN coalesce(t->>'tool_calls', '') <> '' THEN 'tool' ELSE 'final' END AS kind, count(*) AS actions, count(*) FILTER (WHERE coalesce(t->>'reasoning', '') <> '') AS thought FROM x WHERE (t->>'role') = 'assistant' GROUP BY 1, 2""",
)
def _(spark, d):
    # every assistant's turn is encoded by itself and parsed again from its learned ids
    rows = _controlled(spark, d).select("id", "mode", "effort", F.posexplode("turns").alias("i", "t")).filter("t.role = 'assistant'")
    one = rows.select(F.concat_ws("/", "mode", "id", F.col("i").cast("string")).alias("id"), encode.control_segments(F.array("t"), F.col("mode"), F.col("effort")).alias("segments"))
    learned = encode.encoded_segments(one, RANKS, PATTERN).select("id", F.filter("labels", lambda x: x != encode.IGNORED).alias("ids"))
    acts = learned.select(F.substring_index("id", "/", 1).alias("mode"), encode.parsed_action(F.col("ids"), True).alias("a"))
    return acts.groupBy("mode", F.col("a.kind").alias("kind")).agg(F.count("*").alias("actions"), F.count(F.when(F.size("a.thoughts") > 0, 1)).alias("thought"))


@query("encoding_audit", "T15 T3", "SELECT doc_id::VARCHAR AS id, 'not_a_member' AS fault FROM documents WHERE text IS NULL")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    enc = written(encode.encoded_documents(rows, RANKS, PATTERN))
    members = rows.filter("text is not null")
    return encode.audit(enc, members).unionByName(encode.round_trip_faults(enc, members, RANKS, PATTERN))


@query("encoding_reuse", "T7", r"SELECT doc_id::VARCHAR AS id, NOT regexp_matches(text, '[ \t\n\x{0b}\f\r]{2,}|[\t\n\x{0b}\f\r]') AS reuse FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    # the parent encoded texts as they are, the next corpus has runs of white space made one space
    rows = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    parent = rows.select("id", F.sha2("text", 256).alias("identity"))
    return encode.reused(rows.select("id", expr.plain_fingerprint(F.col("text")).alias("identity")), parent).select("id", "reuse")


@query("token_chunks", "C14")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    return encode.chunks(rows, RANKS, PATTERN, 256).select("id", "chunk", "begin", "end")


@query(
    "code_rules", "F15 F16 F17 F18 S4",
    """WITH r AS (SELECT DISTINCT * FROM samples), c AS (SELECT id, text, CASE WHEN json_valid(payload) THEN payload::JSON->>'repo_id' END AS repo, CASE WHEN id < '10' THEN 'third_party/' WHEN id < '18' THEN 'tests/HumanEval/' ELSE 'src/' END || id || CASE WHEN id > 'f0' THEN '.txt' ELSE '.py' END AS path, CASE WHEN id > 'e0' THEN 'gpl-3.0' ELSE 'mit' END AS declared FROM r WHERE task = 'code')
SELECT id, CASE WHEN repo IS NULL OR NOT regexp_matches(repo, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') OR NOT ends_with(path, '.py') THEN 'missing_or_invalid_origin' WHEN declared <> 'mit' THEN 'unsupported_declared_license' WHEN starts_with(path, 'third_party/') THEN 'generated_or_vendored_path' WHEN length(text) NOT BETWEEN 100 AND 100000 OR contains(text, chr(65533)) THEN 'invalid_length_or_encoding' WHEN contains(lower(path), 'humaneval') THEN 'benchmark_path' END AS reason FROM c""",
)
def _(spark, d):
    rows = table(spark, d, "samples").filter("task = 'code'").select("id", "text", F.get_json_object("payload", "$.repo_id").alias("repo"), F.try_parse_json("payload").isNotNull().alias("ok")).dropDuplicates(["id"])
    path = F.concat(F.when(F.col("id") < "10", "third_party/").when(F.col("id") < "18", "tests/HumanEval/").otherwise("src/"), "id", F.when(F.col("id") > "f0", ".txt").otherwise(".py"))
    declared = F.when(F.col("id") > "e0", "gpl-3.0").otherwise("mit")
    return rows.select("id", filters.code_origin(F.when(F.col("ok"), F.col("repo")), path, declared, F.lit(False), F.col("text")).alias("reason"))


@query("python_syntax", "F19 P10")
def _(spark, d):
    rows = table(spark, d, "samples").filter("task = 'code'").select("id", "text").dropDuplicates(["id"])
    return rows.select("id", filters.python_shape(F.col("text")).alias("s")).select("id", "s.reason", "s.ast_sha256")


@query("license_grants", "F20", "SELECT l_shipdate_year AS y, reason, count(*) AS n FROM (SELECT year(l_shipdate)::INT AS l_shipdate_year, CASE WHEN l_linenumber = 1 THEN 'missing_or_conflicting_file_grant' WHEN l_linenumber = 2 THEN 'conflicting_spdx_header' WHEN l_linenumber = 3 THEN 'no_matching_in_file_license' END AS reason FROM lineitem) GROUP BY 1, 2")
def _(spark, d):
    mit = "# Copyright 2020 A\n# Permission is hereby granted, free of charge, to deal in the Software without restriction\n# the above copyright notice and this permission notice shall be included. The software is provided as is"
    k = F.col("l_linenumber")
    header = F.when(k == 1, mit.replace("Copyright", "By").replace("copyright", "")).when(k == 2, "# SPDX-License-Identifier: GPL-3.0\n" + mit).when(k == 3, "# Copyright 2020 A").otherwise(mit)
    rows = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("y"), filters.license_grant(header, F.lit("mit")).alias("reason"))
    return rows.groupBy("y", "reason").agg(F.count("*").alias("n"))


@query(
    "preference_pairs", "F22",
    """WITH r AS (SELECT DISTINCT * FROM samples), j AS (SELECT id, first_question, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM r WHERE first_question <> ''),
t AS (SELECT first_question, id, list_transform((p->'turns')::JSON[], lambda x: {'r': x->>'role', 'c': x->>'content'}) AS t FROM j WHERE json_array_length(p, '$.turns') > 0),
q AS (SELECT first_question, arg_min(t, id) AS a, arg_max(t, id) AS b FROM t GROUP BY first_question HAVING count(*) > 1)
SELECT first_question FROM q WHERE len(a) > 1 AND len(b) > 1 AND a[:-2] = b[:-2] AND a[-1].r = 'assistant' AND b[-1].r = 'assistant' AND a[-1].c <> b[-1].c""",
)
def _(spark, d):
    # of each opening question the first and the last record by id
    rows = table(spark, d, "samples").select("id", "first_question", "payload").dropDuplicates(["id"]).filter("first_question <> ''").filter(F.try_parse_json("payload").isNotNull())
    turns = rows.select("first_question", "id", F.transform(chat.parsed_turns(F.col("payload")), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("t")).filter(F.size("t") > 0)
    pairs = turns.groupBy("first_question").agg(F.min_by("t", "id").alias("chosen"), F.max_by("t", "id").alias("rejected"), F.count("*").alias("n")).filter("n > 1")
    return pairs.filter(chat.valid_preference(F.col("chosen"), F.col("rejected"))).select("first_question")


@query("rated_turns", "F23 F25", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END::INT AS turns, o_orderkey % 2 = 0 AS two_pages FROM orders")
def _(spark, d):
    m = F.col("o_orderkey") % 4
    turn = lambda q: F.struct(F.lit(q).alias("user"), F.lit("a" * 60).alias("assistant"))
    texts = F.array(turn("What is it about?"), turn("And what else is there?"))
    rate = F.when(m == 0, F.array(F.lit(5.0))).when(m == 1, F.array(F.lit(5.0), F.lit(3.0))).otherwise(F.array(F.lit(4.0), F.lit(2.5)))
    pages = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(1)))
    n = F.size(filters.rated_turns(texts, [rate, rate, rate, rate]))
    return table(spark, d, "orders").select("o_orderkey", F.when(n >= 0, n).alias("turns"), filters.two_pages(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("x")), pages).alias("two_pages"))


@query("native_records", "F33", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'missing_domain' WHEN o_orderkey % 4 = 1 THEN 'unknown_supervision' WHEN o_orderkey % 4 = 2 THEN 'unknown_media' END AS reason FROM orders")
def _(spark, d):
    m = F.col("o_orderkey") % 4
    part = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.when(m == 2, "m9").otherwise("m1").alias("media_id"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("sample_id"), F.lit("g").alias("split_group"), F.lit("en").alias("language"), F.when(m != 0, "chat").alias("domain"),
        F.struct(F.when(m == 1, "other").otherwise("answer_ce").alias("type")).alias("supervision"),
        F.array(F.struct(F.lit("user").alias("role"), F.array(part).alias("content"))).alias("messages"),
        F.array(F.struct(F.lit("m1").alias("media_id"), F.array(F.lit("f")).alias("frames"), F.array(F.lit(0.0)).alias("timestamps"))).alias("media"),
    )
    return rows.select("o_orderkey", filters.native_reason(rows).alias("reason"))


@query("verify_structured", "R1", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE 1 END::DOUBLE AS score FROM customer")
def _(spark, d):
    m = F.col("c_custkey") % 3
    text = F.when(m == 0, '{"value": 1500, "unit": "m"}').when(m == 1, "[0.1, 0.1, 0.5, 0.52]").otherwise("about 1.5 km")
    quantity = '{"kind": "quantity", "value": 1.5, "unit": "km", "unit_factors": {"m": 1, "km": 1000}, "relative_tolerance": 1e-9}'
    box = '{"kind": "box", "expected": [0.1, 0.1, 0.5, 0.5], "max_coordinate_error": 0.05}'
    return table(spark, d, "customer").select("c_custkey", verify.structured(text, F.when(m == 1, box).otherwise(quantity)).alias("score"))


@query("fraction_documents", "S18 C7", None)
def _(spark, d):
    rows = table(spark, d, "supplier").count()
    return generators.fraction_documents(spark, rows, 3)


@query("arithmetic_tasks", "S18", None)
def _(spark, d):
    return generators.arithmetic(spark, table(spark, d, "supplier").count(), 5)


@query("device_choice", "S16 L9", "SELECT s_suppkey AS index, s_name AS name, (s_suppkey * 37 % 101)::BIGINT AS used_mib, 120::BIGINT AS total_mib, (120 - s_suppkey * 37 % 101)::BIGINT AS free_mib FROM supplier WHERE s_suppkey % 7 <> 0 ORDER BY free_mib DESC, s_suppkey LIMIT 4")
def _(spark, d):
    lines = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 7 == 0, F.concat_ws(", ", F.col("s_suppkey").cast("string"), "s_name")).otherwise(F.concat_ws(", ", F.col("s_suppkey").cast("string"), "s_name", F.concat((F.col("s_suppkey") * 37 % 101).cast("string"), F.lit(" MiB")), F.lit("120 MiB"))).alias("value"))
    return readers.free_devices(readers.devices(lines), 4, 10).withColumn("index", F.col("index").cast("long"))


@query("shuffled_scan", "S1 S2 S3 S5")
def _(spark, d):
    return readers.shuffled_parquet(spark, f"{d}/part.parquet", 7, 100, ["p_partkey"]).select("p_partkey", "place")


RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Fixed value: the piece pattern of the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

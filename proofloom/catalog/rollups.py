"""Summaries, fingerprints, stages and best-of selections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clearance
from ..operators import rollups
from . import query, table


def audit(spark, folder):
    status = F.element_at(F.array(F.lit(" clear"), F.lit("COLLISION "), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("project"), F.when(F.col("o_custkey") % 17 != 0, F.col("o_orderkey").cast("string")).otherwise(" ").alias("look_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(status).alias("status"),
    )


SQL_AUDIT = """SELECT o_orderpriority AS project, CAST(o_orderkey AS VARCHAR) AS look_id,
    CASE WHEN o_orderstatus = 'P' THEN 'REVIEW' WHEN o_orderkey % 3 = 0 THEN 'CLEAR' WHEN o_orderkey % 3 = 1 THEN 'COLLISION' ELSE 'REVIEW' END AS status FROM orders WHERE o_custkey % 17 <> 0"""


@query("status_summary", f"SELECT project, status, count(*) AS looks FROM ({SQL_AUDIT}) GROUP BY ALL")
def status_summary(spark, folder):
    return rollups.status_summary(audit(spark, folder), ["project"], "look_id")


@query("blocked_looks", f"SELECT * FROM ({SQL_AUDIT}) WHERE status <> 'CLEAR'")
def blocked_looks(spark, folder):
    return rollups.blocked_items(audit(spark, folder), "look_id")


@query("passed_projects", f"SELECT look % 700 AS project, bool_and(status = 'CLEAR') AS passed FROM (SELECT *, CAST(look_id AS BIGINT) AS look FROM ({SQL_AUDIT})) GROUP BY 1")
def passed_projects(spark, folder):
    items = rollups.audit_items(audit(spark, folder), "look_id").withColumn("project", F.col("look_id").cast("bigint") % 700)
    return rollups.all_pass(items, ["project"])


@query("expected_fields", """
    SELECT o_orderkey AS look, o_custkey % 40 AS visible, 4 * count(l_orderkey) AS expected, o_custkey % 40 >= 4 * count(l_orderkey) AS complete
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey
""")
def expected_fields(spark, folder):
    captions = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("look"))
    visible = table(spark, folder, "orders").select(F.col("o_orderkey").alias("look"), (F.col("o_custkey") % 40).alias("visible"))
    return rollups.expected_fields(captions, visible, "look")


@query("fingerprints", """
    WITH d AS (SELECT source, doc_id, CASE WHEN doc_id % 997 = 5 THEN NULL ELSE CAST(doc_id AS VARCHAR) || ':' || sha256(text) END AS v, doc_id // 400 AS chunk FROM documents),
    c AS (SELECT source, chunk, sha256(string_agg(v, chr(10) ORDER BY doc_id)) AS digest, bool_or(v IS NULL) AS gap FROM d GROUP BY 1, 2)
    SELECT source, CASE WHEN bool_or(gap) THEN '' ELSE sha256(string_agg(digest, chr(10) ORDER BY chunk)) END AS fingerprint FROM c GROUP BY 1
""")
def fingerprints(spark, folder):
    k = F.col("doc_id")
    value = F.when(k % 997 != 5, F.concat_ws(":", k.cast("string"), F.sha2("text", 256)))
    return rollups.fingerprint(table(spark, folder, "documents"), ["source"], "doc_id", value, F.floor(k / 400))


@query("cover_pages", """
    WITH p AS (SELECT l_orderkey AS book, l_linenumber AS page, CAST(max(l_quantity) AS INTEGER) % 4 AS photos FROM lineitem GROUP BY 1, 2),
    b AS (SELECT book, max(CASE WHEN page = 1 THEN photos END) AS a, max(CASE WHEN page = 2 THEN photos END) AS b FROM p GROUP BY 1)
    SELECT book, CAST(CASE WHEN a = 2 THEN 0 WHEN b = 2 THEN 1 END AS INTEGER) AS cover_pages, coalesce(a, 0) <> 2 AND coalesce(b, 0) <> 2 AS undecided FROM b
""")
def cover_pages(spark, folder):
    pages = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("page")).agg((F.max("l_quantity").cast("int") % 4).alias("photos"))
    return rollups.cover_pages(pages, ["book"], "page", "photos")


@query("page_ranges", """
    WITH p AS (SELECT DISTINCT l_suppkey AS book, l_partkey AS page FROM lineitem),
    r AS (SELECT *, page - row_number() OVER (PARTITION BY book ORDER BY page) AS run FROM p),
    i AS (SELECT book, min(page) AS first, max(page) AS last FROM r GROUP BY book, run)
    SELECT book, string_agg(CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE CAST(first AS VARCHAR) || '-' || CAST(last AS VARCHAR) END, ',' ORDER BY first) AS page_range FROM i GROUP BY 1
""")
def page_ranges(spark, folder):
    pages = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_partkey").alias("page"))
    return rollups.compact_ranges(pages, ["book"], "page", chunk_pages=500)


@query("edition_pages", """
    WITH l AS (SELECT s_nationkey AS book, CASE WHEN s_acctbal > 3000 THEN 'W' ELSE 'M' END AS edition, s_suppkey AS k FROM supplier),
    b AS (SELECT book, max(k) * 2 + 10 AS last_page FROM l GROUP BY 1),
    p AS (SELECT book, edition, unnest([2 * k + 2, 2 * k + 3]) AS page FROM l UNION ALL SELECT DISTINCT l.book, edition, x FROM l JOIN b USING (book), LATERAL (SELECT unnest([1, last_page]) AS x)),
    d AS (SELECT DISTINCT * FROM p), r AS (SELECT *, page - row_number() OVER (PARTITION BY book, edition ORDER BY page) AS run FROM d),
    i AS (SELECT book, edition, min(page) AS first, max(page) AS last FROM r GROUP BY book, edition, run),
    t AS (SELECT book, edition, string_agg(CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE CAST(first AS VARCHAR) || '-' || CAST(last AS VARCHAR) END, ',' ORDER BY first) AS page_range FROM i GROUP BY 1, 2),
    n AS (SELECT book, edition, count(*) AS pages FROM p GROUP BY 1, 2)
    SELECT b.book, e.edition, page_range, pages FROM b CROSS JOIN (VALUES ('M'), ('W')) e(edition) LEFT JOIN t ON t.book = b.book AND t.edition = e.edition LEFT JOIN n ON n.book = b.book AND n.edition = e.edition
""")
def edition_pages(spark, folder):
    k = F.col("s_suppkey")
    looks = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("book"), F.when(F.col("s_acctbal") > 3000, "w").otherwise("M").alias("excel_sheet"), (k * 2 + 2).alias("left_page"), (k * 2 + 3).alias("right_page")
    )
    sizes = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("book")).agg((F.max("s_suppkey") * 2 + 10).alias("last_page"))
    return rollups.edition_pages(looks, ["book"], sizes)


@query("phase_progress", """
    SELECT o_custkey AS project, o_orderpriority AS phase, count(*) FILTER ((o_custkey % 3 <> 0 OR o_orderkey % 2 = 0) AND o_orderstatus = 'F') AS done,
           count(*) FILTER (o_custkey % 3 <> 0 OR o_orderkey % 2 = 0) AS total FROM orders GROUP BY 1, 2
""")
def phase_progress(spark, folder):
    steps = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("phase"), F.when(F.col("o_orderstatus") == "F", "passed").otherwise("pending").alias("status"),
        (F.col("o_custkey") % 3 == 0).alias("targeted"), (F.col("o_orderkey") % 2 == 0).alias("changed"),
    )
    return rollups.progress(steps, ["project", "phase"])


@query("finished_outputs", """
    SELECT l_orderkey AS project, greatest(count(*) FILTER (l_linestatus = 'O' AND l_tax > 0.02), count(*) FILTER (l_linestatus = 'O' AND l_tax > 0)) AS complete,
           count(*) = 5 AND bool_and(l_linestatus = 'O') AND bool_or(l_quantity > 10) AS final FROM lineitem GROUP BY 1
""")
def finished_outputs(spark, folder):
    outputs = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("project"), F.col("l_linestatus").alias("format"), (F.col("l_tax") > 0.02).alias("verified"), (F.col("l_tax") > 0).alias("written"), (F.col("l_quantity") > 10).alias("finished")
    )
    return rollups.outputs_complete(outputs, "project", "O")


def stages(spark, folder):
    """Twelve stages per customer; which have passed follows from the customer's orders."""
    passed = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("project"), (F.col("o_orderkey") % 12).cast("int").alias("place")).distinct().withColumn("hit", F.lit(1))
    every = table(spark, folder, "customer").select(F.col("c_custkey").alias("project"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("place"))
    return every.join(passed, ["project", "place"], "left").select(
        "project", "place", F.concat(F.lit("stage-"), F.col("place").cast("string")).alias("stage"),
        F.when((F.col("hit") == 1) | (F.col("place") < F.col("project") % 5), "passed").when(F.col("place") == 7, "failed").otherwise("pending").alias("status"),
        F.when(F.col("place") % 2 == 0, F.lit("2024-01-01")).alias("started_at"), F.lit("2024-01-02").alias("completed_at"), F.lit("e").alias("error"),
    )


SQL_STAGES = """
    SELECT c_custkey AS project, place, 'stage-' || CAST(place AS VARCHAR) AS stage,
      CASE WHEN (c_custkey, place) IN (SELECT (o_custkey, o_orderkey % 12) FROM orders WHERE o_orderstatus = 'F') OR place < c_custkey % 5 THEN 'passed'
           WHEN place = 7 THEN 'failed' ELSE 'pending' END AS status,
      CASE WHEN place % 2 = 0 THEN '2024-01-01' END AS started_at, '2024-01-02' AS completed_at, 'e' AS error
    FROM customer CROSS JOIN generate_series(0, 11) g(place)
"""


@query("current_stages", f"""
    SELECT project, coalesce(arg_min(stage, place) FILTER (status <> 'passed'), 'stage-11') AS current, CAST(coalesce(min(place) FILTER (status <> 'passed'), 12) AS INTEGER) AS passed_prefix
    FROM ({SQL_STAGES}) GROUP BY 1
""")
def current_stages(spark, folder):
    return rollups.first_incomplete(stages(spark, folder), ["project"], "place", "stage")


@query("reset_stages", f"""
    SELECT project, stage, CASE WHEN place >= project % 12 THEN 'pending' ELSE status END AS status, CASE WHEN place < project % 12 THEN started_at END AS started_at,
           CASE WHEN place < project % 12 THEN completed_at END AS completed_at, CASE WHEN place >= project % 12 THEN '' ELSE error END AS error FROM ({SQL_STAGES})
""")
def reset_stages(spark, folder):
    return rollups.reset_from(stages(spark, folder), F.col("project") % 12, "place").drop("place")


@query("confirmed_stages", f"""
    SELECT project, stage, CASE WHEN place < project % 12 THEN 'passed' ELSE status END AS status, CASE WHEN place < project % 12 THEN coalesce(started_at, '2025-05-05') ELSE started_at END AS started_at,
           CASE WHEN place < project % 12 THEN '2025-05-05' ELSE completed_at END AS completed_at, CASE WHEN place < project % 12 THEN '' ELSE error END AS error FROM ({SQL_STAGES})
""")
def confirmed_stages(spark, folder):
    return rollups.confirm_prior(stages(spark, folder), F.col("project") % 12, "place", F.lit("2025-05-05")).drop("place")


@query("first_cards", """
    SELECT l_orderkey AS look, l_partkey AS card, min((l_linenumber, l_suppkey, l_quantity)).l_linenumber AS place FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity FROM lineitem) GROUP BY 1, 2
""".replace("min((l_linenumber, l_suppkey, l_quantity)).l_linenumber", "min(l_linenumber)"))
def first_cards(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("look"), F.col("l_partkey").alias("card"), F.col("l_linenumber").alias("place"))
    return rollups.first_per_key(rows, ["look", "card"], ["place"])


@query("latest_records", """
    SELECT user_id, arg_max(event_id, (event_type = 'signup', ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' AND value > 2 GROUP BY 1
""")
def latest_records(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("active"), "event_type", "value")
    found = rollups.latest_matching(events, (F.col("event_type") != "error") & (F.col("value") > 2), "user_id", "active", "ts", "event_id")
    return found.select("user_id", "event_id")


def shifts(spark, folder):
    coverage, component = F.col("l_discount"), F.col("l_tax") / 100
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("look"), (F.col("l_quantity") - 25).alias("shift"), (F.col("l_partkey") % 2 == 1).alias("fine"), coverage.alias("coverage"), component.alias("component"),
        clearance.clearance_status(coverage, component).alias("status"),
    )


SQL_SHIFTS = """
    SELECT l_orderkey AS look, l_quantity - 25 AS shift, l_partkey % 2 = 1 AS fine, l_discount AS coverage, l_tax / 100 AS component,
           CASE WHEN l_discount >= 0.08 OR l_tax / 100 >= 0.006 THEN 'COLLISION' WHEN l_discount >= 0.025 OR l_tax / 100 >= 0.0008 THEN 'REVIEW' ELSE 'CLEAR' END AS status FROM lineitem
"""


@query("best_shifts", f"""
    WITH s AS (SELECT *, CASE status WHEN 'CLEAR' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS r FROM ({SQL_SHIFTS})),
    c AS (SELECT look, min(r) FILTER (NOT fine) AS coarse FROM s GROUP BY 1),
    k AS (SELECT s.* FROM s JOIN c USING (look) WHERE NOT (coarse IS NOT NULL AND coarse = 0 AND fine))
    SELECT look, shift, status, coverage, component FROM k QUALIFY row_number() OVER (PARTITION BY look ORDER BY r, coverage, component, abs(shift), shift) = 1
""")
def best_shifts(spark, folder):
    return rollups.best_shift(shifts(spark, folder), "look")


@query("best_moves", """
    SELECT l_orderkey AS look, l_quantity - 25 AS shift, CASE WHEN l_returnflag = 'A' THEN 'DOWN' ELSE 'RIGHT' END AS mode, l_tax AS delta_y, l_discount AS delta_x FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25 - l_orderkey % 20), abs(l_quantity - 25 + 3), CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_tax, l_discount) = 1
""")
def best_moves(spark, folder):
    candidates = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("look"), (F.col("l_quantity") - 25).alias("shift"), F.when(F.col("l_returnflag") == "A", "DOWN").otherwise("RIGHT").alias("mode"),
        F.col("l_tax").alias("delta_y"), F.col("l_discount").alias("delta_x"), (F.col("l_orderkey") % 20).alias("preferred"), F.lit(-3).alias("current"),
    )
    return rollups.best_combined(candidates, "look", "preferred", "current")


@query("name_order", "SELECT name, row_number() OVER (ORDER BY lower(name), name) AS place FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_type AS name FROM part)")
def name_order(spark, folder):
    name = F.concat(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(" "), "p_type")
    return rollups.casefold_positions(table(spark, folder, "part").select(name.alias("name")), "name")


@query("latest_runs", "SELECT doc_id, right(text, 100000) AS text FROM documents ORDER BY doc_id DESC LIMIT 100")
def latest_runs(spark, folder):
    return rollups.latest_runs(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", 100, "text")

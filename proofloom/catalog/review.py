"""Review workflow queries: looks are customers, requests follow fixed patterns in groups of four."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import review
from . import query, table
from .joins import credits


def swap_tables(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Current map (look k owns W:k) and wanted cards: two- and three-cycles, chains, double claims."""
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(k.alias("k"), F.floor(k / 4).alias("g"), (k % 4).alias("r")).withColumn("base", F.col("g") * 4)
    current = rows.select(
        F.lit(0).alias("project"), F.col("k").alias("look_id"), F.lit("W").alias("excel_sheet"), F.col("k").cast("string").alias("excel_look_number"),
        F.when((F.col("g") % 5 == 4) & (F.col("r") == 1), "CONFIRMED").otherwise("PENDING").alias("visual_status"),
    )
    g, r, base = F.col("g") % 5, F.col("r"), F.col("base")
    target = (
        F.when(g.isin(0, 4) & (r < 2), base + 1 - r).when(g.isin(0, 4) & (r == 3), base + 2).when((g == 1) & (r == 0), base + 1)
        .when((g == 2) & (r < 3), base + (r + 1) % 3).when((g == 3) & (r == 2), base)
    )
    sheet = F.when(target.isNotNull(), "W").when(g.isin(0, 3) & (r == 2), "M").when((g == 3) & (r < 2), "M").when((g == 4) & (r == 2), "M")
    number = F.coalesce(target, F.when(g == 3, base).otherwise(F.col("k")))
    wanted = rows.select(F.lit(0).alias("project"), F.col("k").alias("look_id"), sheet.alias("excel_sheet"), number.cast("string").alias("excel_look_number"))
    return current, wanted.where(F.col("excel_sheet").isNotNull())


SQL_WANTED = """
    WITH c AS (SELECT c_custkey AS k, c_custkey // 4 * 4 AS base, (c_custkey // 4) % 5 AS g, c_custkey % 4 AS r FROM customer),
    t AS (SELECT *, CASE WHEN g IN (0, 4) AND r < 2 THEN base + 1 - r WHEN g IN (0, 4) AND r = 3 THEN base + 2 WHEN g = 1 AND r = 0 THEN base + 1
                         WHEN g = 2 AND r < 3 THEN base + (r + 1) % 3 WHEN g = 3 AND r = 2 THEN base END AS target FROM c),
    w AS (SELECT k, CASE WHEN target IS NOT NULL THEN 'W' WHEN (g IN (0, 3, 4) AND r = 2) OR (g = 3 AND r < 2) THEN 'M' END AS sheet,
                 coalesce(target, CASE WHEN g = 3 THEN base ELSE k END) AS number FROM t
          QUALIFY sheet IS NOT NULL),
    cur AS (SELECT k, CASE WHEN g = 4 AND r = 1 THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM c)
""".replace("QUALIFY sheet IS NOT NULL", "WHERE target IS NOT NULL OR (g IN (0, 3, 4) AND r = 2) OR (g = 3 AND r < 2)")


@query("closed_swaps", SQL_WANTED + """,
    r0 AS (SELECT w.* FROM w JOIN cur USING (k) WHERE status = 'PENDING' AND (sheet, number) IN (SELECT (sheet, number) FROM w GROUP BY sheet, number HAVING count(*) = 1)),
    r1 AS (SELECT * FROM r0 WHERE sheet = 'M' OR number NOT IN (SELECT k FROM cur) OR number IN (SELECT k FROM r0)),
    r2 AS (SELECT * FROM r1 WHERE sheet = 'M' OR number NOT IN (SELECT k FROM cur) OR number IN (SELECT k FROM r1)),
    r3 AS (SELECT * FROM r2 WHERE sheet = 'M' OR number NOT IN (SELECT k FROM cur) OR number IN (SELECT k FROM r2)),
    r4 AS (SELECT * FROM r3 WHERE sheet = 'M' OR number NOT IN (SELECT k FROM cur) OR number IN (SELECT k FROM r3))
    SELECT 0 AS project, k AS look_id, sheet AS excel_sheet, CAST(number AS VARCHAR) AS excel_look_number FROM r4
""")
def closed_swaps(spark, folder):
    current, wanted = swap_tables(spark, folder)
    return review.closed_swaps(wanted, current)


@query("swap_components", SQL_WANTED.replace("WITH c AS", "WITH RECURSIVE c AS") + """,
    e AS (SELECT w.k AS a, w.number AS b FROM w WHERE sheet = 'W' AND number <> w.k AND number IN (SELECT k FROM cur)),
    inside AS (SELECT a, b FROM e WHERE b IN (SELECT k FROM w)),
    ways AS (SELECT a, b FROM inside UNION SELECT b, a FROM inside),
    reach AS (SELECT k AS a, k AS b FROM w UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
    comp AS (SELECT a AS k, min(b) AS first_look FROM reach GROUP BY 1), size AS (SELECT first_look, count(*) AS size FROM comp GROUP BY 1)
    SELECT 0 AS project, k AS look_id, first_look, size,
           CASE WHEN k IN (SELECT a FROM e WHERE b NOT IN (SELECT k FROM w)) THEN 'owner outside the request' WHEN size > 2 THEN 'too many linked looks' END AS error
    FROM comp JOIN size USING (first_look)
""")
def swap_components(spark, folder):
    current, wanted = swap_tables(spark, folder)
    return review.swap_components(wanted, current, limit=2)


def swap_evidence(spark, folder):
    current, wanted = swap_tables(spark, folder)
    k = F.col("look_id")
    alternatives = wanted.where(k % 17 != 3).withColumn("evidence_file", F.concat(F.lit("alt/"), k.cast("string"))).withColumn("evidence_sha256", F.md5("evidence_file"))
    proofs = alternatives.where(k % 19 != 4).select("project", F.col("evidence_file").alias("name"), F.when(k % 23 == 5, "x").otherwise(F.col("evidence_sha256")).alias("sha256"))
    index = current.select("project", "excel_sheet", "excel_look_number").unionByName(
        wanted.where("excel_sheet = 'M'").where(k % 29 != 6).select("project", "excel_sheet", "excel_look_number").distinct()
    )
    return current, wanted, review.swap_ownership_violations(current, wanted, alternatives, proofs, index)


SQL_SWAP_VIOLATIONS = SQL_WANTED + """,
    after AS (SELECT k, sheet, number FROM w UNION ALL SELECT k, 'W', k FROM cur WHERE k NOT IN (SELECT k FROM w)),
    dup AS (SELECT sheet, number FROM after GROUP BY 1, 2 HAVING count(*) > 1),
    v AS (SELECT k, 'not pending' AS rule FROM w JOIN cur USING (k) WHERE status <> 'PENDING'
    UNION ALL SELECT k, 'no proof of the alternative' FROM w WHERE k % 17 = 3
    UNION ALL SELECT k, 'proof changed' FROM w WHERE k % 17 <> 3 AND (k % 19 = 4 OR k % 23 = 5)
    UNION ALL SELECT w.k, 'card owned outside the request' FROM w WHERE sheet = 'W' AND number IN (SELECT k FROM cur) AND number NOT IN (SELECT k FROM w)
    UNION ALL SELECT w.k, 'card not in the index' FROM w WHERE (sheet = 'W' AND number NOT IN (SELECT k FROM cur))
        OR (sheet = 'M' AND number NOT IN (SELECT number FROM w WHERE sheet = 'M' AND k % 29 <> 6))
    UNION ALL SELECT w.k, 'card would be used twice' FROM w JOIN dup USING (sheet, number))
"""


@query("swap_ownership_violations", SQL_SWAP_VIOLATIONS + " SELECT 0 AS project, k AS look_id, rule FROM v")
def swap_ownership_violations(spark, folder):
    return swap_evidence(spark, folder)[2]


@query("guarded_map", SQL_SWAP_VIOLATIONS + """
    SELECT cur.k // 4 AS project, cur.k AS look_id, CASE WHEN w.k IS NOT NULL AND cur.k // 4 NOT IN (SELECT k // 4 FROM v) THEN w.sheet ELSE 'W' END AS excel_sheet,
           CAST(CASE WHEN w.k IS NOT NULL AND cur.k // 4 NOT IN (SELECT k // 4 FROM v) THEN w.number ELSE cur.k END AS VARCHAR) AS excel_look_number, status AS visual_status
    FROM cur LEFT JOIN w ON w.k = cur.k
""")
def guarded_map(spark, folder):
    current, wanted, violations = swap_evidence(spark, folder)
    by_group = lambda df: df.withColumn("project", F.floor(F.col("look_id") / 4))
    return review.apply_guarded(by_group(current), by_group(wanted), by_group(violations), ["project", "look_id"], review.CARD)


@query("duplicate_cards", """
    WITH c AS (SELECT c_nationkey AS project, CASE WHEN c_custkey % 2 = 0 THEN 'W' ELSE 'M' END AS sheet, CAST(c_custkey // 100 AS VARCHAR) AS number, c_name AS look_id
               FROM customer WHERE c_acctbal > 0)
    SELECT *, count(*) OVER (PARTITION BY project, sheet, number) AS owners FROM c QUALIFY owners > 1
""")
def duplicate_cards(spark, folder):
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("project"), F.when(k % 2 == 0, " w").otherwise("M").alias("excel_sheet"),
        F.when(F.col("c_acctbal") > 0, F.floor(k / 100).cast("string")).otherwise("2a").alias("excel_look_number"), F.col("c_name").alias("look_id"),
    )
    return review.duplicate_cards(rows)


@query("undisputed_claims", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem
    WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_orderkey) = 1)
""")
def undisputed_claims(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return review.conflicting_claims(lines, ["l_partkey", "l_suppkey"], "l_orderkey")


@query("conflicted_documents", """
    WITH c AS (SELECT doc_id, md5(text) AS item FROM documents) SELECT doc_id, item FROM c WHERE item IN (SELECT item FROM c GROUP BY 1 HAVING count(DISTINCT doc_id) = 1)
""")
def conflicted_documents(spark, folder):
    claims = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("item"))
    return review.conflicting_claims(claims, ["item"], "doc_id")


def carried(spark, folder, mode: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer")

    def maps(number, image="img"):
        return [
            F.col("c_nationkey").alias("project"), F.col("c_name").alias("look_id"), F.lit("W").alias("excel_sheet"), number.cast("string").alias("excel_look_number"),
            F.lit(image).alias("excel_image"), F.lit("l").alias("left_filename"), F.lit("r").alias("right_filename"), F.lit("e").alias("evidence_file"),
        ]

    saved = rows.select(*maps(F.when(k % 5 == 0, k + 1).otherwise(k)), F.lit("CONFIRMED").alias("visual_status"))
    proposal = rows.select(*maps(k))
    selections = rows.where(k % 10 == 0).select(*maps(k + 1))
    return review.carry_forward_map(saved, proposal, selections, ["project", "look_id"], mode)


@query("repaired_map", """
    SELECT c_nationkey AS project, c_name AS look_id, CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 ELSE c_custkey END AS VARCHAR) AS excel_look_number,
           CASE WHEN c_custkey % 10 = 5 THEN 'PENDING' ELSE 'CONFIRMED' END AS visual_status, c_custkey % 10 = 5 AS drifted FROM customer
""")
def repaired_map(spark, folder):
    return carried(spark, folder, "repair").select("project", "look_id", "excel_look_number", "visual_status", "drifted")


@query("resumed_map", """
    SELECT c_nationkey AS project, c_name AS look_id, CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey END AS VARCHAR) AS excel_look_number,
           'CONFIRMED' AS visual_status, c_custkey % 10 = 5 AS drifted FROM customer
""")
def resumed_map(spark, folder):
    return carried(spark, folder, "resume").select("project", "look_id", "excel_look_number", "visual_status", "drifted")


@query("attempted_cards", """
    WITH o AS (SELECT l_orderkey AS look, l_partkey AS card, min(l_linenumber) AS attempt FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
    m AS (SELECT look, max(attempt) AS last FROM o GROUP BY 1),
    n AS (SELECT l_orderkey AS look, l_partkey AS card, l_linenumber + coalesce(last, 0) AS attempt FROM lineitem LEFT JOIN m ON look = l_orderkey WHERE l_returnflag = 'N')
    SELECT look, card, min(attempt) AS attempt FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1, 2
""")
def attempted_cards(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("look"), F.col("l_partkey").alias("card"), F.col("l_linenumber").alias("attempt"), "l_returnflag")
    old = lines.where("l_returnflag <> 'N'").groupBy("look", "card").agg(F.min("attempt").alias("attempt"))
    return review.accumulate_attempts(old, lines.where("l_returnflag = 'N'"), ["look"], ["card"])


@query("reserved_cards", "SELECT l_partkey AS card FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def reserved_cards(spark, folder):
    pairs = table(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("card"))
    return review.reserved_cards(pairs, table(spark, folder, "part").where("p_size < 5").select(F.col("p_partkey").alias("card")), ["card"])


@query("replaced_alternatives", """
    SELECT l_orderkey AS look, l_partkey AS card FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'
""")
def replaced_alternatives(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("look"), F.col("l_partkey").alias("card"))
    fresh = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("look"), F.col("o_custkey").alias("card"))
    return review.replace_partition_rows(rows, fresh, fresh, ["look"])


@query("review_batches", """
    SELECT o_orderstatus, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders
""")
def review_batches(spark, folder):
    return review.batches(table(spark, folder, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey", 4, chunk_rows=1000)


@query("restored_rows", """
    SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance,
           c_custkey % 7 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AS restored,
           CASE WHEN c_custkey % 11 = 0 THEN 'added' WHEN c_custkey % 13 = 0 THEN 'removed' END AS key_change
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 = 0 AND c_custkey % 3 <> 0 THEN c_acctbal + 1
                                 WHEN c_custkey % 13 = 0 AND c_custkey % 7 = 0 AND c_custkey % 3 = 0 AND c_custkey % 11 <> 0 THEN c_acctbal - 1 ELSE c_acctbal END AS c_acctbal
          FROM customer) WHERE NOT (c_custkey % 11 = 0 AND c_custkey % 13 = 0)
""")
def restored_rows(spark, folder):
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer")
    before = rows.where(k % 11 != 0).select(k.alias("k"), F.col("c_acctbal").alias("balance"))
    after = rows.where(k % 13 != 0).select(k.alias("k"), F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("balance"))
    return review.restore_frozen(before, after, rows.where(k % 3 == 0).select(k.alias("k")), ["k"], ["balance"])


@query("resume_scope", """
    WITH r AS (SELECT c_nationkey AS project, c_custkey AS look_id, c_acctbal > 5000 AS done FROM customer WHERE c_custkey % 3 = 0)
    SELECT project, look_id, project % 4 <> 1 AS resumed FROM r WHERE NOT (project % 4 <> 1 AND done)
""")
def resume_scope(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("look_id"), "c_acctbal")
    requests = rows.where("look_id % 3 = 0").withColumn("token", F.md5(F.col("look_id").cast("string")))
    saved = requests.withColumn("token", F.when(F.col("project") % 4 == 1, "old").otherwise(F.col("token")))
    card_map = rows.withColumn("visual_status", F.when(F.col("c_acctbal") > 5000, "CONFIRMED").otherwise("PENDING"))
    return review.resume_scope(requests, saved, card_map)


@query("rematch_requests", """
    SELECT c_nationkey AS project, c_name AS look_id, CAST(CASE WHEN c_custkey % 5 = 1 THEN 1 ELSE 0 END AS INTEGER) AS needs_rematch,
           CAST(CASE WHEN c_custkey % 5 = 1 THEN 0 WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS manual_override
    FROM customer WHERE c_custkey % 11 <> 1
""")
def rematch_requests(spark, folder):
    existing, _ = credits(spark, folder)
    k = F.col("c_custkey")
    rows = existing.withColumn("needs_rematch", F.lit(0)).withColumn("rematch_requested_at", F.lit(None).cast("timestamp"))
    requests = table(spark, folder, "customer").where(k % 5 < 2).select(F.col("c_nationkey").alias("project"), F.col("c_name").alias("look_id"), (k % 5 == 1).alias("requested"))
    asked = review.request_rematch(rows, requests, ["project", "look_id"], F.current_timestamp())
    return asked.select("project", "look_id", "needs_rematch", "manual_override")


@query("reviewed_notes", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cached' WHEN doc_id % 7 = 1 THEN 'limit' ELSE 'ok' END AS status,
           CASE WHEN doc_id % 3 = 0 THEN 'stored' WHEN doc_id % 7 = 1 THEN NULL ELSE lang END AS result FROM documents
""")
def reviewed_notes(spark, folder):
    from ..operators.joins import signature

    k = F.col("doc_id")
    pending = table(spark, folder, "documents").select("doc_id", "lang", F.md5("text").alias("text_md5"))
    stored = F.lit("stored")
    cache = pending.where(k % 3 == 0).select(signature("doc_id", "text_md5").alias("signature"), stored.alias("result"), F.sha2(stored, 256).alias("result_sha256"), F.lit("completed").alias("status"))

    def decide(misses: DataFrame) -> DataFrame:
        limited = k % 7 == 1
        return misses.select("signature", F.when(~limited, F.col("lang")).alias("result"), F.when(limited, "limit").otherwise("ok").alias("status"))

    return review.review_queue(pending, cache, decide, ["doc_id", "text_md5"]).select("doc_id", "status", "result")

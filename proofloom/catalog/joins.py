"""Joins, upserts and overlays over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from . import query, table


@query("expanded_credits", """
    SELECT o_orderkey AS card, o_custkey AS look, l_partkey, l_suppkey, l_linenumber AS product_pos, l_extendedprice AS price
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def expanded_credits(spark, folder):
    found, _ = joins.expand_credits(*map_and_products(spark, folder), ["card"])
    return found


def map_and_products(spark, folder) -> tuple[DataFrame, DataFrame]:
    card_map = table(spark, folder, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("look"))
    products = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("card"), "l_partkey", "l_suppkey", F.col("l_linenumber").alias("product_pos"), F.col("l_extendedprice").alias("price")
    )
    return card_map, products


@query("map_rows_without_products", "SELECT o_orderkey AS card, o_custkey AS look FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def map_rows_without_products(spark, folder):
    _, unmatched = joins.expand_credits(*map_and_products(spark, folder), ["card"])
    return unmatched


@query("unused_parts", """
    SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48 AND l_returnflag = 'A')
""")
def unused_parts(spark, folder):
    used = table(spark, folder, "lineitem").where("l_quantity >= 48 and l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"))
    return joins.without(table(spark, folder, "part").select("p_partkey"), used, ["p_partkey"])


@query("untried_cards", """
    SELECT DISTINCT l_orderkey AS look, l_partkey AS card FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_orderkey = l.l_orderkey AND a.l_partkey = l.l_partkey AND a.l_returnflag = 'A')
      AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size IN (1, 2)) AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_tax = 0)
""")
def untried_cards(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnsRenamed({"l_orderkey": "look", "l_partkey": "card"})
    reserved = table(spark, folder, "part").where("p_size in (1, 2)").select(F.col("p_partkey").alias("card"))
    return joins.untried(
        lines.select("look", "card").distinct(), lines.where("l_returnflag = 'A'"), reserved, lines.where("l_quantity = 50 and l_tax = 0"), ["look"], ["card"]
    )


@query("board_choices", """
    WITH b AS (SELECT l_orderkey AS look, CASE WHEN l_linenumber % 2 = 0 THEN 'W' ELSE 'M' END AS sheet, l_partkey AS n, l_linenumber, l_tax FROM lineitem),
    f AS (SELECT look, sheet, n, count(DISTINCT CASE WHEN l_tax = 0 THEN '0' ELSE '' END || CAST(n AS VARCHAR)) AS forms FROM b GROUP BY 1, 2, 3),
    a AS (SELECT DISTINCT look FROM f WHERE forms > 1),
    c AS (SELECT o_orderkey AS look, min(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS first, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS second
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT c.look, CASE WHEN f1.n IS NOT NULL THEN 'W' WHEN f2.n IS NOT NULL THEN 'W' END AS sheet,
           CAST(coalesce(f1.n, f2.n) AS VARCHAR) AS number, a.look IS NOT NULL AS ambiguous
    FROM c LEFT JOIN f f1 ON f1.look = c.look AND f1.sheet = 'W' AND f1.n = c.first LEFT JOIN f f2 ON f2.look = c.look AND f2.sheet = 'W' AND f2.n = c.second
    LEFT JOIN a ON a.look = c.look
""")
def board_choices(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("look", F.col("l_orderkey"))
    part = F.col("l_partkey").cast("string")
    board = lines.select(
        "look", F.when(F.col("l_linenumber") % 2 == 0, "w").otherwise(" M").alias("excel_sheet"),
        F.when(F.col("l_tax") == 0, F.concat(F.lit("0"), part)).otherwise(part).alias("excel_look_number"),
    )
    picked = lines.groupBy("look").agg(
        F.min(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("first"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_partkey"))).alias("second")
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("look"))
    choices = orders.join(picked, "look", "left").select(
        "look", F.concat(F.lit("EXCEL w:00"), F.col("first").cast("string")).alias("choice"), F.concat(F.lit("W-"), F.col("second").cast("string")).alias("label")
    )
    return joins.within_board(choices, board, ["look"], ["choice", "label"]).drop("choice", "label")


@query("visible_sources", """
    SELECT c_custkey AS look, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'ref/' || CAST(c_custkey AS VARCHAR) END
                                   WHEN c_acctbal > 0 THEN 'hires/' || c_name END AS source,
           CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 <> 0 ELSE c_acctbal <= 0 END AS missing FROM customer
""")
def visible_sources(spark, folder):
    k = F.col("c_custkey")
    customers = table(spark, folder, "customer")
    slots = customers.select(k.alias("look"), F.when(k % 5 == 0, F.concat(F.lit("dir/__MISSING_"), k.cast("string"))).otherwise(F.col("c_name")).alias("filename"))
    references = customers.where(k % 3 == 0).select(k.alias("look"), F.concat(F.lit("ref/"), k.cast("string")).alias("reference_path"))
    files = customers.where("c_acctbal > 0").select(F.col("c_name").alias("name"), F.concat(F.lit("hires/"), "c_name").alias("path"))
    return joins.visible_source(slots, references, files, ["look"]).select("look", "source", "missing")


def credits(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Existing credits and a refresh of them, both from customer."""
    k = F.col("c_custkey")
    sheet = F.when(k % 2 == 0, "W").otherwise("M")
    number = F.floor(k / 2).cast("string")
    rows = table(spark, folder, "customer")
    common = [F.col("c_nationkey").alias("project"), F.col("c_name").alias("look_id")]
    rest = [F.lit("img").alias("excel_image"), F.lit("proof").alias("evidence_file")]
    existing = rows.where(k % 11 != 1).select(
        *common, F.lower(sheet).alias("excel_sheet"), number.alias("excel_look_number"), *rest, F.lit("PENDING").alias("visual_status"),
        F.when(k % 3 == 0, "kept").otherwise("").alias("note"), F.when(k % 4 == 0, 1).otherwise(0).alias("manual_override"),
    )
    incoming = rows.where(k % 13 != 2).select(
        *common, sheet.alias("excel_sheet"), F.when(k % 7 == 0, F.lit("999")).otherwise(number).alias("excel_look_number"), *rest,
        F.lit("CONFIRMED").alias("visual_status"), F.lit("new").alias("note"),
    )
    return existing, incoming


SQL_MERGED = """
    WITH c AS (SELECT *, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'W' ELSE 'M' END AS s, CAST(c_custkey // 2 AS VARCHAR) AS n FROM customer),
    j AS (SELECT *, k % 11 <> 1 AS has_old, k % 13 <> 2 AS has_new, k % 11 <> 1 AND k % 4 = 0 AS manual, CASE WHEN k % 7 = 0 THEN '999' ELSE n END AS nn FROM c),
    d AS (SELECT *, manual AND (NOT has_new OR nn <> n) AS keep FROM j)
    SELECT c_nationkey AS project, c_name AS look_id, CASE WHEN keep THEN lower(s) ELSE s END AS excel_sheet, CASE WHEN keep THEN n ELSE nn END AS excel_look_number,
           'img' AS excel_image, 'proof' AS evidence_file, CASE WHEN keep THEN 'PENDING' ELSE 'CONFIRMED' END AS visual_status,
           CASE WHEN has_old AND k % 3 = 0 THEN 'kept' WHEN keep THEN '' ELSE 'new' END AS note, CAST(CASE WHEN keep THEN 1 ELSE 0 END AS INTEGER) AS manual_override
    FROM d WHERE keep OR has_new
"""


@query("merged_credits", SQL_MERGED)
def merged_credits(spark, folder):
    existing, incoming = credits(spark, folder)
    return joins.merge_with_override(existing, incoming, ["project", "look_id"])


@query("overlaid_groups", """
    WITH l AS (SELECT l_orderkey AS look, l_orderkey * 10 + l_linenumber AS pos, l_partkey AS part FROM lineitem),
    c AS (SELECT DISTINCT o_orderkey AS look FROM orders WHERE o_custkey % 10 = 0),
    f AS (SELECT look, min(pos) AS pos FROM l GROUP BY 1)
    SELECT look, part, pos, CAST(0 AS BIGINT) AS sub FROM l WHERE look NOT IN (SELECT look FROM c)
    UNION ALL SELECT f.look, f.look + s.sub, f.pos, s.sub FROM f JOIN c USING (look) CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (2)) s(sub)
""")
def overlaid_groups(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("look"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("part"))
    fresh = table(spark, folder, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("look"), F.explode(F.array(F.lit(1), F.lit(2))).alias("sub"))
    return joins.overlay_groups(rows, fresh.withColumn("part", F.col("look") + F.col("sub")), "look", "pos", "sub")


@query("unknown_overlay_keys", "SELECT DISTINCT o_orderkey AS look FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def unknown_overlay_keys(spark, folder):
    rows = table(spark, folder, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("look"))
    return joins.overlay_unknown(rows, table(spark, folder, "orders").select(F.col("o_orderkey").alias("look")), "look")


@query("overlaid_artifacts", """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'new-' || CAST(l.quality AS VARCHAR) ELSE md5(d.text) END AS artifact, l.doc_id IS NOT NULL AS replaced
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def overlaid_artifacts(spark, folder):
    baseline = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("artifact"))
    changed = table(spark, folder, "labels").select("doc_id", F.concat(F.lit("new-"), F.col("quality").cast("string")).alias("artifact"))
    return joins.overlay_by_key(baseline, changed, ["doc_id"], ["artifact"])


@query("key_differences", """
    SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id + 3 FROM labels)
    UNION ALL SELECT doc_id + 3, 'extra' FROM labels WHERE doc_id + 3 NOT IN (SELECT doc_id FROM documents)
""")
def key_differences(spark, folder):
    shifted = table(spark, folder, "labels").select((F.col("doc_id") + 3).alias("doc_id"))
    return joins.same_keys(table(spark, folder, "documents"), shifted, ["doc_id"])


@query("cache_hits", """
    SELECT doc_id, CASE WHEN doc_id % 6 NOT IN (1, 2, 3) THEN 'r' || CAST(doc_id AS VARCHAR) END AS result FROM documents
""")
def cache_hits(spark, folder):
    k = F.col("doc_id")
    requests = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.lit("policy-2").alias("policy"))
    result = F.concat(F.lit("r"), k.cast("string"))
    cache = requests.withColumn("policy", F.when(k % 6 == 1, "policy-1").otherwise(F.col("policy"))).select(
        joins.signature("doc_id", "text_sha256", "policy").alias("signature"), result.alias("result"),
        F.when(k % 6 == 2, "damaged").otherwise(F.sha2(result, 256)).alias("result_sha256"), F.when(k % 6 == 3, "running").otherwise("completed").alias("status"),
    )
    return joins.cache_lookup(requests, cache, ["doc_id", "text_sha256", "policy"]).select("doc_id", "result")


@query("manual_photos", """
    WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN '__missing_1' ELSE 'L' || CAST(c_custkey AS VARCHAR) END AS l, 'R' || CAST(c_custkey AS VARCHAR) AS r FROM customer),
    a AS (SELECT *, k % 4 = 0 AND k % 3 <> 1 AND k % 5 <> 1 AS applied FROM c)
    SELECT k AS look, CASE WHEN applied THEN 'X' || CAST(k AS VARCHAR) ELSE l END AS left_filename, CASE WHEN applied THEN 'Y' || CAST(k AS VARCHAR) ELSE r END AS right_filename,
           applied, NOT applied AND k % 9 = 0 AS unresolved FROM a
""")
def manual_photos(spark, folder):
    k = F.col("c_custkey")
    text = k.cast("string")
    registry = table(spark, folder, "customer").select(
        k.alias("look"), F.when(k % 9 == 0, "__missing_1").otherwise(F.concat(F.lit("L"), text)).alias("left_filename"), F.concat(F.lit("R"), text).alias("right_filename")
    )
    manual = table(spark, folder, "customer").where(k % 4 == 0).select(
        k.alias("look"), F.when(k % 3 == 1, "").otherwise(F.concat(F.lit("X"), text)).alias("left_filename"),
        F.concat(F.when(k % 5 == 1, "X").otherwise("Y"), text).alias("right_filename"),
    )
    return joins.apply_manual(registry, manual, ["look"])

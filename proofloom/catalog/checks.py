"""Integrity checks over tables derived from orders, lineitem and customer, with seeded faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks
from . import query, table


def registry(spark, folder) -> DataFrame:
    """One project with a look per customer and seeded faults."""
    k, p = F.col("c_custkey"), F.col("c_custkey") + 1
    return table(spark, folder, "customer").select(
        F.lit(0).alias("project"), p.alias("position"),
        F.when(k % 31 == 3, "LOOK_X").otherwise(checks.look_name(p)).alias("look_id"),
        F.when(k % 37 == 5, p + 1).otherwise(p).alias("spread_order"), p.alias("pdf_spread"),
        F.when(k % 41 == 7, F.lit("shared-left.jpg")).otherwise(F.concat(F.lit("L"), p.cast("string"))).alias("left_filename"),
        F.when(k % 41 == 7, F.lit("shared-right.jpg")).when(k % 43 == 9, F.concat(F.lit("L"), p.cast("string"))).otherwise(F.concat(F.lit("R"), p.cast("string"))).alias("right_filename"),
        (p * 2).alias("indd_left_page"), F.when(k % 47 == 11, p * 2 + 2).otherwise(p * 2 + 1).alias("indd_right_page"),
    )


SQL_NAME = "'LOOK_' || CASE WHEN {p} < 1000 THEN lpad(CAST({p} AS VARCHAR), 3, '0') ELSE CAST({p} AS VARCHAR) END"
SQL_REGISTRY = f"""
    SELECT 0 AS project, c_custkey AS k, c_custkey + 1 AS position, CASE WHEN c_custkey % 31 = 3 THEN 'LOOK_X' ELSE {SQL_NAME.format(p='(c_custkey + 1)')} END AS look_id,
      CASE WHEN c_custkey % 37 = 5 THEN c_custkey + 2 ELSE c_custkey + 1 END AS spread_order,
      CASE WHEN c_custkey % 41 = 7 THEN 'shared-left.jpg' ELSE 'L' || CAST(c_custkey + 1 AS VARCHAR) END AS l,
      CASE WHEN c_custkey % 41 = 7 THEN 'shared-right.jpg' WHEN c_custkey % 43 = 9 THEN 'L' || CAST(c_custkey + 1 AS VARCHAR) ELSE 'R' || CAST(c_custkey + 1 AS VARCHAR) END AS r,
      (c_custkey + 1) * 2 AS lp, CASE WHEN c_custkey % 47 = 11 THEN (c_custkey + 1) * 2 + 2 ELSE (c_custkey + 1) * 2 + 1 END AS rp FROM customer
"""


def photo_files(spark, folder) -> DataFrame:
    """Files of the registry, without the ones lost for some looks."""
    rows = registry(spark, folder)
    names = rows.select("project", F.explode(F.array("left_filename", "right_filename")).alias("name"))
    return names.where(~F.col("name").rlike("^R[0-9]*77$")).distinct().withColumn("sha256", F.md5("name"))


@query("registry_violations", f"""
    WITH g AS ({SQL_REGISTRY}), pg AS (SELECT position, lp AS page FROM g UNION ALL SELECT position, rp FROM g),
    n AS (SELECT position, l AS name FROM g UNION ALL SELECT position, r FROM g)
    SELECT 0 AS project, position, 'look id' AS rule FROM g WHERE k % 31 = 3
    UNION ALL SELECT 0, position, 'spread order' FROM g WHERE spread_order <> position
    UNION ALL SELECT 0, position, 'same file twice' FROM g WHERE l = r
    UNION ALL SELECT 0, position, 'pages' FROM g WHERE rp <> position * 2 + 1
    UNION ALL SELECT 0, position, 'file missing' FROM n WHERE regexp_matches(name, '^R[0-9]*77$')
    UNION ALL SELECT 0, position, 'pair repeated' FROM g WHERE (l, r) IN (SELECT (l, r) FROM g GROUP BY l, r HAVING count(*) > 1)
    UNION ALL SELECT 0, position, 'page repeated' FROM pg WHERE page IN (SELECT page FROM pg GROUP BY page HAVING count(*) > 1)
""")
def registry_violations(spark, folder):
    return checks.check_registry(registry(spark, folder), photo_files(spark, folder))


@query("caption_violations", """
    WITH c AS (SELECT l_orderkey AS look, CASE WHEN l_quantity = 50 THEN '' ELSE l_returnflag END AS kind,
                      CASE WHEN l_linenumber = 7 AND l_discount = 0.1 THEN NULL ELSE l_extendedprice END AS price FROM lineitem),
    o AS (SELECT o_orderkey AS look FROM orders WHERE o_orderpriority <> '1-URGENT')
    SELECT look, 'blank field' AS rule FROM c WHERE kind = '' OR price IS NULL
    UNION ALL SELECT DISTINCT look, 'unknown look' FROM c WHERE look NOT IN (SELECT look FROM o)
    UNION ALL SELECT look, 'no rows' FROM o WHERE look NOT IN (SELECT look FROM c)
""")
def caption_violations(spark, folder):
    captions = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("look"), F.when(F.col("l_quantity") == 50, " ").otherwise(F.col("l_returnflag")).alias("kind"),
        F.when(~((F.col("l_linenumber") == 7) & (F.col("l_discount") == 0.1)), F.col("l_extendedprice")).alias("price"),
    )
    looks = table(spark, folder, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("look"))
    return checks.check_captions(captions, looks, "look", ["kind", "price"])


def card_map(spark, folder) -> DataFrame:
    k, p = F.col("position") - 1, F.col("position")
    digits = (F.floor(p / 2) + 1).cast("string")
    number = F.when(k % 29 == 2, "0").when(k % 53 == 4, "7a").when(k % 59 == 6, "12").otherwise(digits)
    sheet = F.when(k % 61 == 8, "X").when(p % 2 == 0, "W").otherwise("M")
    image = F.concat("excel_sheet", F.lit("_"), F.lpad("excel_look_number", F.greatest(F.lit(3), F.char_length("excel_look_number")), F.lit("0")), F.lit("_01.jpg"))
    return (
        registry(spark, folder).withColumn("excel_look_number", number).withColumn("excel_sheet", sheet)
        .withColumn("excel_image", F.when(k % 67 == 10, "other.jpg").otherwise(image))
        .withColumn("evidence_file", F.concat(F.lit("proof/"), p.cast("string")))
        .withColumn("visual_status", F.when(k % 71 == 12, "PENDING").otherwise("CONFIRMED"))
        .withColumn("left_filename", F.when(k % 73 == 14, "swapped.jpg").otherwise(F.col("left_filename")))
    )


SQL_MAP = f"""
    SELECT *, CASE WHEN k % 73 = 14 THEN 'swapped.jpg' ELSE l END AS ml,
       sheet || '_' || CASE WHEN length(number) < 3 THEN lpad(number, 3, '0') ELSE number END || '_01.jpg' AS plain_image
    FROM (SELECT *, CASE WHEN k % 29 = 2 THEN '0' WHEN k % 53 = 4 THEN '7a' WHEN k % 59 = 6 THEN '12' ELSE CAST(position // 2 + 1 AS VARCHAR) END AS number,
                 CASE WHEN k % 61 = 8 THEN 'X' WHEN position % 2 = 0 THEN 'W' ELSE 'M' END AS sheet FROM ({SQL_REGISTRY}))
"""
SQL_MAP_COMPLETE = f"""
    WITH m AS ({SQL_MAP})
    SELECT 0 AS project, position, 'look id' AS rule FROM m WHERE k % 31 = 3
    UNION ALL SELECT 0, position, 'not confirmed' FROM m WHERE k % 71 = 12
    UNION ALL SELECT 0, position, 'card repeated' FROM m WHERE (sheet, number) IN (SELECT (sheet, number) FROM m GROUP BY sheet, number HAVING count(*) > 1)
"""


@query("caption_map_violations", SQL_MAP_COMPLETE + """
    UNION ALL SELECT 0, position, 'card' FROM m WHERE sheet = 'X' OR number IN ('0', '7a')
    UNION ALL SELECT 0, position, 'photo pair' FROM m WHERE ml <> l
    UNION ALL SELECT 0, position, 'image name' FROM m WHERE k % 67 = 10 AND number <> '7a'
    UNION ALL SELECT 0, position, 'file missing or too small' FROM m WHERE position % 97 = 0 OR position % 101 = 0
    UNION ALL SELECT 0, position, 'evidence changed' FROM m WHERE position % 97 = 0 OR position % 103 = 0
""")
def caption_map_violations(spark, folder):
    rows = card_map(spark, folder)
    p = F.col("position")
    proofs = rows.where(p % 97 != 0).select(
        "project", F.col("evidence_file").alias("name"), F.when(p % 101 == 0, 1000).otherwise(2000).alias("bytes"), F.md5("evidence_file").alias("sha256")
    )
    images = rows.select("project", F.col("excel_image").alias("name"), F.lit(5000).alias("bytes"), F.md5("excel_image").alias("sha256")).distinct()
    manifest = rows.select("project", "position", F.col("evidence_file").alias("name"), F.when(p % 103 == 0, "old").otherwise(F.md5("evidence_file")).alias("sha256"))
    return checks.check_caption_map(rows, registry(spark, folder), proofs.unionByName(images), manifest)


@query("map_completeness", SQL_MAP_COMPLETE + " UNION ALL SELECT 0, position, 'card' FROM m WHERE sheet = 'X' OR number = '7a'")
def map_completeness(spark, folder):
    return checks.check_map_complete(card_map(spark, folder))


@query("plan_violations", """
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS t FROM orders)
    SELECT k, 'orientation' AS rule FROM o WHERE c % 19 = 1
    UNION ALL SELECT k, 'photo pair' FROM o WHERE c % 23 = 2 AND c % 101 <> 0
    UNION ALL SELECT k, 'not ready' FROM o WHERE s = 'P' AND c % 101 <> 0
    UNION ALL SELECT k, 'shift' FROM o WHERE (k % 200 - 100 > 72 OR k % 200 - 100 < -72) AND c % 101 <> 0
    UNION ALL SELECT k, 'no plan' FROM o WHERE c % 101 = 0
""".replace("c % 19 = 1", "c % 19 = 1 AND c % 101 <> 0"))
def plan_violations(spark, folder):
    orders = table(spark, folder, "orders")
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    left, right = F.concat(F.lit("L"), key.cast("string")), F.concat(F.lit("R"), key.cast("string"))
    pairs = orders.select(key.alias("k"), left.alias("left_filename"), right.alias("right_filename"))
    plan = orders.where(c % 101 != 0).select(
        key.alias("k"), F.when(c % 19 == 1, "OTHER").otherwise(checks.ORIENTATION).alias("orientation"),
        F.when(key % 2 == 0, left).otherwise(right).alias("left_image_filename"),
        F.when(c % 23 == 2, "x").when(key % 2 == 0, right).otherwise(left).alias("right_image_filename"),
        (key % 200 - 100).cast("string").alias("photo_adjustment_points"), F.when(F.col("o_orderstatus") == "P", "DRAFT").otherwise("READY").alias("plan_status"),
    )
    return checks.check_plan(plan, pairs, ["k"])


@query("frame_move_violations", """
    WITH m AS (SELECT l_orderkey AS look, CASE WHEN l_returnflag = 'A' THEN 'DOWN' WHEN l_returnflag = 'R' THEN 'RIGHT' ELSE 'UP' END AS mode,
                      CASE WHEN (l_returnflag = 'A') = (l_linestatus = 'O') THEN 'STYLE' ELSE 'RIGHT_ALIGN' END AS al,
                      l_quantity - 5 AS dy, CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE l_discount * 10 END AS dx, l_tax FROM lineitem)
    SELECT look, 'mode' AS rule FROM m WHERE mode = 'UP'
    UNION ALL SELECT look, 'alignment' FROM m WHERE (mode = 'DOWN' AND al <> 'STYLE') OR (mode = 'RIGHT' AND al <> 'RIGHT_ALIGN')
    UNION ALL SELECT look, 'bounds' FROM m WHERE l_tax = 0
    UNION ALL SELECT look, 'direction' FROM m WHERE (mode = 'DOWN' AND dy <= 0.05) OR (mode = 'RIGHT' AND (dx <= 0.05 OR dy < -0.05))
    UNION ALL SELECT look, 'repeated' FROM m WHERE look IN (SELECT look FROM m GROUP BY look HAVING count(*) > 1)
    UNION ALL SELECT look, 'unknown look' FROM m WHERE look NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def frame_move_violations(spark, folder):
    flag = F.col("l_returnflag")
    style = (flag == "A") == (F.col("l_linestatus") == "O")
    moves = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("look"), F.when(flag == "A", "DOWN").when(flag == "R", "RIGHT").otherwise("UP").alias("mode"),
        F.when(style, "STYLE").otherwise("RIGHT_ALIGN").alias("paragraph_alignment"),
        F.lit(0.0).alias("from_top"), F.lit(0.0).alias("from_left"), F.lit(50.0).alias("from_bottom"), F.lit(50.0).alias("from_right"),
        (F.col("l_quantity") - 5).alias("to_top"), F.when(flag == "A", 0.0).otherwise(F.col("l_discount") * 10).alias("to_left"),
        F.when(F.col("l_tax") == 0, F.col("l_quantity") - 6).otherwise(F.lit(100.0)).alias("to_bottom"), F.lit(100.0).alias("to_right"),
    )
    known = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("look")).distinct()
    return checks.check_frame_moves(moves, known, "look")


@query("applied_violations", """
    WITH o AS (SELECT o_orderkey AS k, o_custkey % 40 AS c FROM orders)
    SELECT k, 'not applied' AS rule FROM o WHERE c = 1
    UNION ALL SELECT k, 'not planned' FROM o WHERE c = 2
    UNION ALL SELECT k, 'files' FROM o WHERE c = 3
    UNION ALL SELECT k, 'recorded shift' FROM o WHERE c = 4
    UNION ALL SELECT k, 'vertical change' FROM o WHERE c = 5
    UNION ALL SELECT k, 'crop shift' FROM o WHERE c = 6
    UNION ALL SELECT k, 'frame left' FROM o WHERE c = 7
""")
def applied_violations(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40).alias("c")).withColumn("shift", (F.col("k") % 90).cast("double"))
    off = lambda code, by: F.when(F.col("c") == code, by).otherwise(0.0)
    frames = [F.lit(10.0).alias("frame_top"), F.lit(20.0).alias("frame_left"), F.lit(30.0).alias("frame_bottom"), F.lit(40.0).alias("frame_right")]
    planned = rows.where("c <> 2").select("k", "shift", F.lit("a").alias("left_file"), F.lit("b").alias("right_file"), *frames)
    applied = rows.where("c <> 1").select(
        "k", (F.col("shift") + off(4, 0.02)).alias("shift"), F.when(F.col("c") == 3, "z").otherwise("a").alias("left_file"), F.lit("b").alias("right_file"),
        F.lit(0.0).alias("before_top"), F.lit(0.0).alias("before_left"), F.lit(9.0).alias("before_bottom"), F.lit(9.0).alias("before_right"),
        F.lit(0.0).alias("after_top"), (F.col("shift") + off(6, 0.3)).alias("after_left"), (9.0 + off(5, 0.5)).alias("after_bottom"), (F.col("shift") + 9.05).alias("after_right"),
        F.lit(10.2).alias("frame_top"), (20.4 + off(7, 1.0)).alias("frame_left"), F.lit(30.0).alias("frame_bottom"), F.lit(40.0).alias("frame_right"),
    )
    return checks.check_applied(planned, applied, ["k"])


@query("confirmation_violations", """
    WITH l AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS lo FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_custkey AS c FROM orders),
    i AS (SELECT * FROM o WHERE c % 50 <> 3)
    SELECT k, 'not confirmed' AS rule FROM i WHERE k NOT IN (SELECT k FROM l)
    UNION ALL SELECT k, 'unknown item' FROM l WHERE k NOT IN (SELECT k FROM i)
    UNION ALL SELECT k, 'repeated' FROM l WHERE n > 1
    UNION ALL SELECT DISTINCT l_orderkey, 'stale' FROM lineitem JOIN i ON k = l_orderkey WHERE l_quantity = 50
    UNION ALL SELECT DISTINCT l_orderkey, 'short note' FROM lineitem JOIN i ON k = l_orderkey WHERE l_linenumber = 2
""")
def confirmation_violations(spark, folder):
    items = table(spark, folder, "orders").where("o_custkey % 50 <> 3").select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_orderkey").cast("string")).alias("proof_sha256"))
    key = F.col("l_orderkey")
    confirmations = table(spark, folder, "lineitem").select(
        key.alias("k"), F.when(F.col("l_quantity") == 50, "old").otherwise(F.md5(key.cast("string"))).alias("proof_sha256"),
        F.when(F.col("l_linenumber") == 2, "looks fine").otherwise("white blazer and black leather tote").alias("note"),
    )
    return checks.check_confirmations(items, confirmations, ["k"], ["proof_sha256"])


@query("reference_manifest_violations", f"""
    WITH g AS (SELECT * FROM ({SQL_REGISTRY}) WHERE k % 31 <> 3)
    SELECT 0 AS project, look_id, 'no item' AS rule FROM g WHERE k % 109 = 1
    UNION ALL SELECT 0, look_id, 'page' FROM g WHERE k % 107 = 2 AND k % 109 <> 1
    UNION ALL SELECT 0, look_id, 'photo pair' FROM g WHERE k % 113 = 4 AND k % 109 <> 1
    UNION ALL SELECT 0, look_id, 'photo changed' FROM g WHERE k % 109 <> 1 AND regexp_matches(r, '^R[0-9]*77$')
    UNION ALL SELECT 0, look_id, 'photo changed' FROM g WHERE k % 109 <> 1 AND k % 113 = 4
    UNION ALL SELECT 0, look_id, 'page repeated' FROM (SELECT *, CASE WHEN k % 107 = 2 THEN position + 2 ELSE position + 1 END AS page FROM g WHERE k % 109 <> 1)
        QUALIFY count(*) OVER (PARTITION BY page) > 1
    UNION ALL SELECT 0, NULL, 'page range' FROM (SELECT max(CASE WHEN k % 107 = 2 THEN position + 2 ELSE position + 1 END) AS hi,
        min(CASE WHEN k % 107 = 2 THEN position + 2 ELSE position + 1 END) AS lo, count(*) AS n FROM g WHERE k % 109 <> 1) WHERE lo <> 2 OR hi <> n + 1
""")
def reference_manifest_violations(spark, folder):
    rows = registry(spark, folder).where("look_id <> 'LOOK_X'")
    k, p = F.col("position") - 1, F.col("position")
    left = F.when(k % 113 == 4, "unknown.jpg").otherwise(F.col("left_filename"))
    manifest = rows.where(k % 109 != 1).select(
        "project", "look_id", F.when(k % 107 == 2, p + 2).otherwise(p + 1).alias("reference_page"), left.alias("left_filename"), "right_filename",
        F.md5(left).alias("left_sha256"), F.md5("right_filename").alias("right_sha256"),
    )
    return checks.check_reference_manifest(manifest, rows, photo_files(spark, folder), 1)


@query("override_violations", """
    WITH c AS (SELECT c_nationkey AS project, c_name AS look_id, CASE WHEN c_acctbal < 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN 'W' ELSE 'w ' END AS s,
                      CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '2a' ELSE CAST(c_custkey // 40 AS VARCHAR) END AS n FROM customer),
    f AS (SELECT * FROM c WHERE trim(s) <> '' AND n IS NOT NULL)
    SELECT project, look_id, 'incomplete' AS rule FROM c WHERE trim(s) = '' OR n IS NULL
    UNION ALL SELECT project, look_id, 'number' FROM c WHERE n = '2a'
    UNION ALL SELECT project, look_id, 'card repeated' FROM f QUALIFY count(*) OVER (PARTITION BY project, n) > 1
""")
def override_violations(spark, folder):
    k = F.col("c_custkey")
    credits = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("project"), F.col("c_name").alias("look_id"),
        F.when(F.col("c_acctbal") < 0, " ").when(k % 2 == 0, "W").otherwise("w ").alias("excel_sheet"),
        F.when(k % 17 != 0, F.when(k % 19 == 0, "2a").otherwise(F.floor(k / 40).cast("string"))).alias("excel_look_number"),
    )
    return checks.check_overrides(credits)


@query("census_violations", """
    WITH i AS (SELECT conv_id AS project, turn, CASE turn WHEN 0 THEN 'FRONT' WHEN 1 THEN 'LEFT' WHEN 2 THEN 'RIGHT' WHEN 3 THEN 'CREDITS' WHEN 4 THEN 'LEGAL' ELSE 'BACK' END AS label,
                      CASE WHEN turn >= 4 THEN 4 ELSE turn + 1 END AS page FROM conversations),
    b AS (SELECT project, count(*) FILTER (label = 'FRONT') AS f, count(*) FILTER (label = 'BACK') AS b, count(*) FILTER (label = 'LEGAL') AS l FROM i GROUP BY 1)
    SELECT project, NULL AS look_id, 'front' AS rule FROM b WHERE f <> 1
    UNION ALL SELECT project, NULL, 'back' FROM b WHERE b <> 1
    UNION ALL SELECT project, NULL, 'legal' FROM b WHERE l <> 1
    UNION ALL SELECT project, NULL, 'page count' FROM b WHERE project % 10 = 9
    UNION ALL SELECT b.project, 'LOOK_001', lower(x.label) || ' item' FROM b CROSS JOIN (VALUES ('LEFT'), ('RIGHT'), ('CREDITS')) x(label)
        WHERE (SELECT count(*) FROM i WHERE i.project = b.project AND i.label = x.label) <> 1
    UNION ALL SELECT project, 'LOOK_002', lower(x.label) || ' item' FROM b CROSS JOIN (VALUES ('LEFT'), ('RIGHT'), ('CREDITS')) x(label) WHERE project % 10 = 9
""")
def census_violations(spark, folder):
    turn = F.col("turn")
    label = F.element_at(F.array(*[F.lit(x) for x in ("FRONT", "LEFT", "RIGHT", "CREDITS", "LEGAL", "BACK")]), F.least(turn + 1, F.lit(6)).cast("int"))
    items = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("project"), F.when((turn >= 1) & (turn <= 3), "LOOK_001").alias("look_id"), label.alias("label"),
        F.least(turn + 1, F.lit(4)).alias("page"), F.concat("text", F.lit(" 5 МАЯ")).alias("text"), F.lit(4).alias("last_page"), F.lit("5 МАЯ").alias("date_text"),
    )
    projects = items.select("project").distinct()
    looks = projects.select("project", F.explode(F.when(F.col("project") % 10 == 9, F.array(F.lit("LOOK_001"), F.lit("LOOK_002"))).otherwise(F.array(F.lit("LOOK_001")))).alias("look_id"))
    return checks.check_census(items, looks)

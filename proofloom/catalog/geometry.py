"""Page geometry and clearance over boxes derived from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clearance, notes
from ..operators import geometry
from ..operators.joins import styling_warning
from ..plans.chunks import number_rows
from . import query, table

PAGE = {"left": 0.0, "bottom": 0.0, "right": 16.0, "top": 12.0}
DRAW_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def draws(spark, folder):
    """One page per order; draws in the order's line order, a few of them skewed."""
    lines = number_rows(table(spark, folder, "lineitem"), ["l_orderkey"], F.col("l_linenumber"), [F.col(c) for c in DRAW_ORDER], "z")
    return lines.select(
        F.col("l_orderkey").alias("page_id"), "z", (F.floor(F.col("l_quantity") / 5) + 3).cast("double").alias("a"),
        F.when((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "A"), 1.0).otherwise(0.0).alias("b"), F.lit(0.0).alias("c"),
        (F.col("l_partkey") % 10 + 3).cast("double").alias("d"), (F.col("l_suppkey") % 18 - 2).cast("double").alias("e"), (F.round(F.col("l_discount") * 100) - 1).alias("f"),
    )


SQL_DRAWS = """
    SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS z, floor(l_quantity / 5) + 3 AS a,
           CASE WHEN l_quantity = 50 AND l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS b, CAST(l_partkey % 10 + 3 AS DOUBLE) AS d, CAST(l_suppkey % 18 - 2 AS DOUBLE) AS e, round(l_discount * 100) - 1 AS f FROM lineitem
"""
SQL_BOXES = f"SELECT *, e AS x0, f + least(b, 0.0) AS y0, e + a AS x1, f + d + b AS y1 FROM ({SQL_DRAWS})"


@query("draw_bounds", f"""
    SELECT page_id, z, x0 AS "left", y0 AS bottom, x1 AS "right", y1 AS top, least(x1, 16) - greatest(x0, 0) > 1e-6 AND least(y1, 12) - greatest(y0, 0) > 1e-6 AS on_page FROM ({SQL_BOXES})
""")
def draw_bounds(spark, folder):
    box = geometry.affine_bounds(*[F.col(name) for name in "abcdef"])
    page = {side: F.lit(value) for side, value in PAGE.items()}
    return draws(spark, folder).select("page_id", "z", *[box[side].alias(side) for side in geometry.SIDES], geometry.intersects_page(box, page).alias("on_page"))


@query("visible_draws", f"""
    WITH x AS (SELECT *, greatest(x0, 0) AS l, greatest(y0, 0) AS bt, least(x1, 16) AS r, least(y1, 12) AS t FROM ({SQL_BOXES})),
    p AS (SELECT * FROM x WHERE r - l > 1e-6 AND t - bt > 1e-6),
    rot AS (SELECT page_id, max(z) AS zr FROM x WHERE b > 0 GROUP BY 1),
    u AS (SELECT p.page_id, z, unnest(generate_series(CAST(l AS BIGINT), CAST(r AS BIGINT) - 1)) AS ux, bt, t FROM p LEFT JOIN rot ON rot.page_id = p.page_id WHERE b = 0 AND (zr IS NULL OR z > zr)),
    v AS (SELECT page_id, z, ux, unnest(generate_series(CAST(bt AS BIGINT), CAST(t AS BIGINT) - 1)) AS uy FROM u),
    c AS (SELECT DISTINCT v.page_id, v.z, ux, uy FROM v JOIN x o ON o.page_id = v.page_id AND o.z > v.z AND o.x0 - 1 <= ux AND o.x1 + 1 >= ux + 1 AND o.y0 - 1 <= uy AND o.y1 + 1 >= uy + 1),
    s AS (SELECT page_id, z, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT p.page_id, p.z FROM p LEFT JOIN s ON s.page_id = p.page_id AND s.z = p.z WHERE coalesce(n, 0) < 0.95 * (r - l) * (t - bt)
""")
def visible_draws(spark, folder):
    rows = draws(spark, folder)
    pages = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page_id"), *[F.lit(value).alias(side) for side, value in PAGE.items()])
    return geometry.drop_occluded(rows, pages, cell=8.0).select("page_id", "z")


@query("caption_bounds", 'SELECT l_orderkey AS look, min(l_quantity) AS top, min(l_discount) AS "left", max(l_quantity) + 5 AS bottom, max(l_tax) + 1 AS "right" FROM lineitem GROUP BY 1')
def caption_bounds(spark, folder):
    regions = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("look"), F.col("l_quantity").alias("top"), F.col("l_discount").alias("left"), (F.col("l_quantity") + 5).alias("bottom"), (F.col("l_tax") + 1).alias("right")
    )
    return geometry.union_bounds(regions, ["look"])


@query("fitted_images", """
    WITH b AS (SELECT p_partkey, p_size * 13 AS iw, p_partkey % 977 + 1 AS ih, 200 AS bw, p_partkey % 211 AS bh FROM part),
    s AS (SELECT *, least((bw - 38) / CAST(iw AS DOUBLE), (bh - 38) / CAST(ih AS DOUBLE)) AS k FROM b)
    SELECT p_partkey, CAST(floor(iw * k) AS BIGINT) AS width, CAST(floor(ih * k) AS BIGINT) AS height, CAST(floor((bw - floor(iw * k)) / 2) AS BIGINT) AS x_offset,
           CAST(floor((bh - floor(ih * k)) / 2) AS BIGINT) AS y_offset FROM s WHERE bh > 38
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL FROM s WHERE bh <= 38
""")
def fitted_images(spark, folder):
    fitted = geometry.fit_in_box(F.col("p_size") * 13, F.col("p_partkey") % 977 + 1, F.lit(200), F.col("p_partkey") % 211, 19)
    return table(spark, folder, "part").select("p_partkey", fitted.alias("fit")).select("p_partkey", "fit.*")


@query("image_owners", """
    WITH i AS (SELECT o_custkey % 20 AS sheet, o_orderkey AS image, CAST(floor(o_totalprice) AS BIGINT) % 900 AS s, CAST(floor(o_totalprice) AS BIGINT) % 900 + o_orderkey % 5 AS e FROM orders),
    a AS (SELECT c_custkey % 20 AS sheet, c_custkey // 20 * 12 + 2 AS lo, c_custkey // 20 * 12 + 9 AS hi, c_custkey // 20 AS number FROM customer),
    h AS (SELECT i.*, number FROM i JOIN a ON a.sheet = i.sheet AND lo <= e AND s <= hi),
    w AS (SELECT i.*, number FROM i JOIN a ON a.sheet = i.sheet AND lo <= e + 2 AND s - 2 <= lo WHERE image NOT IN (SELECT image FROM h)),
    u AS (SELECT * FROM h UNION ALL SELECT * FROM w), g AS (SELECT image, count(DISTINCT number) AS found, min(number) AS number FROM u GROUP BY 1)
    SELECT sheet, i.image, s AS start, e AS "end", CASE WHEN found = 1 THEN number END AS owner, coalesce(found, 0) AS found FROM i LEFT JOIN g ON g.image = i.image
""")
def image_owners(spark, folder):
    start = F.floor("o_totalprice") % 900
    images = table(spark, folder, "orders").select((F.col("o_custkey") % 20).alias("sheet"), F.col("o_orderkey").alias("image"), start.alias("start"), (start + F.col("o_orderkey") % 5).alias("end"))
    number = F.floor(F.col("c_custkey") / 20)
    blocks = table(spark, folder, "customer").select((F.col("c_custkey") % 20).alias("sheet"), (number * 12 + 2).alias("first"), (number * 12 + 9).alias("last"), number.alias("number"))
    return geometry.image_owner(images, blocks, blocks.select("sheet", F.col("first").alias("row"), "number"), ["sheet"], bucket=64)


@query("clearance_verdicts", """
    WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_discount AS cov, l_tax / 100 AS comp, l_quantity AS q, l_linenumber AS n, l_returnflag = 'A' AND l_linenumber = 1 AS over FROM lineitem),
    m AS (SELECT *, CASE WHEN cov >= 0.08 OR comp >= 0.006 THEN 'COLLISION' WHEN cov >= 0.025 OR comp >= 0.0008 THEN 'REVIEW' ELSE 'CLEAR' END AS measured,
                 CASE WHEN cov >= 0.08 OR cov >= 0.006 THEN 'COLLISION' WHEN cov >= 0.0008 THEN 'REVIEW' ELSE 'CLEAR' END AS planned FROM l)
    SELECT l_orderkey, l_partkey, l_suppkey, planned, s AS status, CAST(CASE s WHEN 'CLEAR' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'COLLISION' THEN 2 ELSE 3 END AS BIGINT) AS rank FROM
        (SELECT *, CASE WHEN over OR q < n * 4 THEN 'OVERFLOW' WHEN q < 9.5 OR n > 6.5 THEN 'REVIEW' ELSE measured END AS s FROM m)
""")
def clearance_verdicts(spark, folder):
    coverage, component = F.col("l_discount"), F.col("l_tax") / 100
    frame = {"top": F.col("l_quantity"), "left": F.lit(0.0), "bottom": F.lit(50.0), "right": F.col("l_linenumber")}
    safe = {"top": F.lit(10.0), "left": F.lit(0.0), "bottom": F.lit(50.0), "right": F.lit(6.0)}
    overset = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)
    status = clearance.audited_status(clearance.clearance_status(coverage, component), overset, F.col("l_quantity"), F.col("l_linenumber") * 4, frame, safe)
    judged = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", clearance.clearance_status(coverage).alias("planned"), status.alias("status"))
    return judged.withColumn("rank", clearance.status_rank(F.col("status")))


@query("split_plans", """
    SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_discount < 0.025 THEN l_quantity ELSE l_tax END AS shift, l_discount >= 0.025 AS unresolved FROM lineitem
""")
def split_plans(spark, folder):
    plan = clearance.split_plan(F.col("l_quantity"), F.col("l_tax"), clearance.clearance_status(F.col("l_discount"), F.lit(0.0)))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", plan.alias("plan")).select("l_orderkey", "l_partkey", "l_suppkey", "plan.*")


@query("prior_positions", """
    SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_tax = 0 THEN 1.0 WHEN abs(l_quantity - 30) <= 0.5 THEN NULL WHEN abs(l_quantity - 10) > 0.5 THEN l_quantity ELSE 1.0 END AS prior_top FROM lineitem
""")
def prior_positions(spark, folder):
    box = lambda top: F.array(top, F.lit(0.0), F.lit(60.0), F.lit(60.0))
    actual = F.when(F.col("l_tax") != 0, box(F.col("l_quantity")))
    prior = clearance.prior_bounds(actual, box(F.lit(10.2)), box(F.lit(30.0)), box(F.lit(1.0)))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", prior[0].alias("prior_top"))


@query("reliable_caption_bounds", """
    WITH l AS (SELECT *, l_linenumber * 4 AS expected, l_partkey % 30 AS visible FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN expected >= 4 AND visible >= expected AND (l_quantity < greatest(8.0, least(50.0, expected * 1.5)) OR 40.0 < greatest(20.0, least(60.0, expected * 1.5)))
        THEN 100.0 ELSE l_quantity END AS bottom FROM l
""")
def reliable_caption_bounds(spark, folder):
    visible = F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(40.0))
    frame = F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(120.0))
    bounds = clearance.reliable_bounds(visible, frame, F.col("l_partkey") % 30, F.col("l_linenumber") * 4)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", bounds[2].alias("bottom"))


@query("styling_warnings", """
    SELECT doc_id, CASE WHEN doc_id % 5 <> 1 AND doc_id % 7 <> 2 AND doc_id % 3 = 0 THEN 'scarf; ' || trim(text, ' ' || chr(10)) END AS warning FROM documents
""")
def styling_warnings(spark, folder):
    k = F.col("doc_id")
    documents = table(spark, folder, "documents")
    rows = documents.select("doc_id", F.when(k % 5 == 1, "PENDING").otherwise("CONFIRMED").alias("visual_status"), F.md5("text").alias("proof_sha256"))
    observed = documents.select(
        "doc_id", F.when(k % 7 == 2, "old").otherwise(F.md5("text")).alias("proof_sha256"),
        F.when(k % 3 == 0, F.concat(F.lit(f"white blazer. {notes.STYLING_MARKER} scarf; "), F.trim("text"))).otherwise(F.col("text")).alias("description"),
    )
    return styling_warning(rows, observed, ["doc_id"], "proof_sha256").select("doc_id", "warning")

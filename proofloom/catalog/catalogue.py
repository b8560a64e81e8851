"""Catalogue cleaning, strict tables and exact copies over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prices, text
from ..operators import cleaning
from ..plans.lineage import scratch_folder
from ..sources import assets, files
from . import query, table

NBSP, NNBSP = " ", " "
WS = text.WHITESPACE


def sql_squash(value: str) -> str:
    return f"trim(regexp_replace({value}, '{WS}+', ' ', 'g'))"


def sql_price(value: str) -> str:
    """The accepted price styles in RE2 syntax, as a DECIMAL or NULL."""
    bare = f"regexp_replace(regexp_replace({value}, '(?i)(?:₽|руб\\.?|р\\.|rub|rur)', '', 'g'), '{WS}', '', 'g')"
    digits = f"replace(replace({bare}, ',', ''), '.', '')"
    cents = f"regexp_extract({bare}, '[.,]([0-9]{{1,2}})$', 1)"
    whole = f"regexp_replace({bare}, '[.,][0-9]{{1,2}}$', '')"
    whole_digits = f"replace(replace({whole}, ',', ''), '.', '')"
    return f"""CAST(CASE
        WHEN regexp_full_match({bare}, '[0-9]+') THEN {bare}
        WHEN regexp_full_match({bare}, '[0-9]{{1,3}}((,[0-9]{{3}})+|(\\.[0-9]{{3}})+)') THEN {digits}
        WHEN regexp_full_match({bare}, '[0-9]+[.,][0-9]{{1,2}}') THEN replace({bare}, ',', '.')
        WHEN regexp_full_match({bare}, '[0-9]{{1,3}}((\\.[0-9]{{3}})+,[0-9]{{1,2}}|(,[0-9]{{3}})+\\.[0-9]{{1,2}})')
        THEN {whole_digits} || '.' || {cents} END AS DECIMAL(18,2))"""


@query("squash_whitespace", f"""
    WITH t AS (SELECT doc_id, {sql_squash(f"replace(text, ', ', ',{NBSP} {NNBSP}') || '{NBSP}'")} AS s FROM documents)
    SELECT doc_id, length(s) AS chars, md5(s) AS squashed_md5 FROM t
""")
def squash_whitespace(spark, folder):
    spaced = F.concat(F.replace("text", F.lit(", "), F.lit(f",{NBSP} {NNBSP}")), F.lit(NBSP))
    squashed = text.squash_ws(spaced)
    return table(spark, folder, "documents").select(
        "doc_id", F.char_length(squashed).cast("bigint").alias("chars"), F.md5(squashed).alias("squashed_md5")
    )


@query("canonical_headers", """
    SELECT p_partkey, regexp_replace(replace(lower('Ёлка № ' || p_name || ' (' || p_type || ')'), 'ё', 'е'),
                                     '[^а-яa-z0-9]', '', 'g') AS header
    FROM part
""")
def canonical_headers(spark, folder):
    label = F.concat(F.lit("Ёлка № "), "p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, folder, "part").select("p_partkey", text.canon_header(label).alias("header"))


@query("column_letters", """
    WITH a AS (SELECT p_partkey, p_partkey + 1 AS n FROM part),
    b AS (SELECT *, (n - 1) // 26 AS n1 FROM a), c AS (SELECT *, (n1 - 1) // 26 AS n2 FROM b WHERE true),
    d AS (SELECT *, CASE WHEN n1 > 0 THEN n2 ELSE 0 END AS m2 FROM c),
    e AS (SELECT *, CASE WHEN m2 > 0 THEN (m2 - 1) // 26 ELSE 0 END AS m3 FROM d),
    f AS (SELECT *, CASE WHEN m3 > 0 THEN (m3 - 1) // 26 ELSE 0 END AS m4 FROM e)
    SELECT p_partkey, (CASE WHEN m4 > 0 THEN chr(CAST((m4 - 1) % 26 + 65 AS INTEGER)) ELSE '' END)
        || (CASE WHEN m3 > 0 THEN chr(CAST((m3 - 1) % 26 + 65 AS INTEGER)) ELSE '' END)
        || (CASE WHEN m2 > 0 THEN chr(CAST((m2 - 1) % 26 + 65 AS INTEGER)) ELSE '' END)
        || (CASE WHEN n1 > 0 THEN chr(CAST((n1 - 1) % 26 + 65 AS INTEGER)) ELSE '' END)
        || chr(CAST((n - 1) % 26 + 65 AS INTEGER)) AS letters, n AS col
    FROM f
""")
def column_letters(spark, folder):
    letters = text.col_letter(F.col("p_partkey") + 1)
    return (
        table(spark, folder, "part")
        .select("p_partkey", letters.alias("letters"))
        .withColumn("col", text.col_index(F.col("letters")))
    )


def localized_prices(spark, folder) -> DataFrame:
    """p_retailprice written in five styles, one of them not acceptable."""
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    whole = F.floor(cents / 100)
    fraction = F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    style = F.col("p_partkey") % 5
    written = (
        F.when(style == 0, F.concat(F.translate(grouped, ",", NBSP), F.lit(","), fraction, F.lit(f"{NNBSP}₽")))
        .when(style == 1, F.concat(grouped, F.lit("."), fraction))
        .when(style == 2, F.concat(F.translate(grouped, ",", "."), F.lit(","), fraction, F.lit(" руб.")))
        .when(style == 3, F.concat(F.lit(" RUB "), whole.cast("string")))
        .otherwise(F.concat(whole.cast("string"), F.lit("."), fraction, F.lit("00")))
    )
    return table(spark, folder, "part").withColumn("written", written)


SQL_LOCALIZED = f"""
    SELECT *, CASE p_partkey % 5
        WHEN 0 THEN replace(format('{{:,}}', whole), ',', '{NBSP}') || ',' || fraction || '{NNBSP}₽'
        WHEN 1 THEN format('{{:,}}', whole) || '.' || fraction
        WHEN 2 THEN replace(format('{{:,}}', whole), ',', '.') || ',' || fraction || ' руб.'
        WHEN 3 THEN ' RUB ' || CAST(whole AS VARCHAR)
        ELSE CAST(whole AS VARCHAR) || '.' || fraction || '00' END AS written
    FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) // 100 AS whole,
                 lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS fraction FROM part)
"""


@query("parse_prices", f"""
    SELECT p_partkey, written, CAST({sql_price('written')} AS DOUBLE) AS amount,
           CASE WHEN {sql_price('written')} IS NULL THEN 'ambiguous' END AS error
    FROM ({SQL_LOCALIZED})
""")
def parse_prices(spark, folder):
    written = F.col("written")
    return localized_prices(spark, folder).select(
        "p_partkey", "written", prices.parse_price(written).cast("double").alias("amount"),
        prices.price_error(written).alias("error"),
    )


@query("format_prices", """
    SELECT o_orderkey, CASE WHEN v = floor(v) THEN replace(format('{:,}', CAST(v AS BIGINT)), ',', ' ') || ' ₽'
                            ELSE CAST(v AS VARCHAR) END AS price
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE floor(o_totalprice) END AS v FROM orders)
""")
def format_prices(spark, folder):
    value = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.floor("o_totalprice").cast("double"))
    return table(spark, folder, "orders").select(
        "o_orderkey", prices.format_price(value, value.cast("string")).alias("price")
    )


@query("normalize_articles", """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR)
                           ELSE lpad(CAST(p_partkey AS VARCHAR), 12, '0') END AS article FROM part
""")
def normalize_articles(spark, folder):
    numeric = F.col("p_size") % 2 == 0
    key = F.col("p_partkey").cast("string")
    value = F.when(numeric, F.concat(key, F.lit(".0"))).otherwise(F.concat(F.lit("  "), F.lpad(key, 12, "0"), F.lit(NBSP)))
    return table(spark, folder, "part").select(
        "p_partkey", prices.normalize_article(value, F.when(numeric, "n").otherwise("s")).alias("article")
    )


@query("strict_tsv_round_trip", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer
""")
def strict_tsv_round_trip(spark, folder):
    path = scratch_folder(spark)
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("c_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "   ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    files.write_tsv(rows, path)
    return files.read_strict_tsv(spark, path, ["c_custkey", "c_name", "c_mktsegment"])


def document_assets(spark, folder) -> DataFrame:
    """Documents as files: unique names, some with a copy ending."""
    ending = F.element_at(F.array(F.lit(" copy"), F.lit("-Копия 2"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ending, F.lit(".jpg"))
    return assets.content_identity(table(spark, folder, "documents"), name, F.col("text"))


SQL_ASSETS = """
    SELECT source || '_' || CAST(doc_id AS VARCHAR) || (CASE doc_id % 3 WHEN 0 THEN ' copy' WHEN 1 THEN '-Копия 2' ELSE '' END)
               || '.jpg' AS name,
           CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents
"""


def preferred():
    return F.lower("name").startswith("src1")


SQL_REPRESENTATIVES = f"""
    SELECT length, sha256, count(*) AS members,
           arg_min(name, (NOT starts_with(lower(name), 'src1'),
                          regexp_matches(lower(regexp_replace(name, '\\.[^.]*$', '')), '[ _-](copy|копия)(\\s*\\([0-9]+\\)|\\s+[0-9]+)?$'),
                          lower(name), name)) AS selected
    FROM ({SQL_ASSETS}) GROUP BY length, sha256
"""


@query("asset_identity", SQL_ASSETS)
def asset_identity(spark, folder):
    return document_assets(spark, folder)


@query("distinct_assets", SQL_REPRESENTATIVES)
def distinct_assets(spark, folder):
    return assets.dedupe_exact(document_assets(spark, folder), preferred())


@query("exact_copies", f"""
    SELECT a.length, a.sha256, a.name, r.selected FROM ({SQL_ASSETS}) a
    JOIN ({SQL_REPRESENTATIVES}) r ON a.length = r.length AND a.sha256 = r.sha256
    WHERE r.members > 1 AND a.name <> r.selected
""")
def exact_copies(spark, folder):
    files_ = document_assets(spark, folder)
    return assets.exact_copies(files_, assets.dedupe_exact(files_, preferred()))


@query("manifest_totals", f"""
    WITH r AS ({SQL_REPRESENTATIVES}),
    u AS (SELECT DISTINCT name FROM ({SQL_ASSETS}) WHERE name LIKE '%copy.jpg')
    SELECT CAST(sum(members) AS BIGINT) AS available, count(*) AS unique_files,
           CAST(sum(members - 1) AS BIGINT) AS duplicate_files, count(u.name) AS used_files,
           count(*) - count(u.name) AS unused_files
    FROM r LEFT JOIN u ON u.name = r.selected
""")
def manifest_totals(spark, folder):
    files_ = document_assets(spark, folder)
    return assets.manifest_totals(files_, files_.where(F.col("name").endswith("copy.jpg")).select("name"), preferred())


# ---- a workbook per brand, built from part ----
HEADER_ROW = {3: "Наименование", 4: " Бренд ", 5: "АРТИКУЛ", 6: "Код цвета", 7: "Цена"}


def workbook_cells(spark, folder) -> DataFrame:
    """Long cell table: one sheet per brand, the price column marked, blank or absent by brand."""
    parts = localized_prices(spark, folder).withColumn("row", F.col("p_partkey") + 2)
    brand_number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    text_cell = lambda col, value: F.struct(F.lit(col).alias("col"), F.lit("s").alias("ctype"), value.alias("value"))
    body = F.array(
        text_cell(2, F.when(F.col("p_partkey") % 5 == 0, F.floor(F.col("p_partkey") / 5).cast("string"))),
        text_cell(3, F.when(F.col("p_size") != 13, F.col("p_name"))),
        text_cell(4, F.col("p_brand")),
        F.struct(F.lit(5).alias("col"), F.when(F.col("p_size") == 17, "e").otherwise("s").alias("ctype"),
                 F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("value")),
        text_cell(6, F.col("p_type")),
        text_cell(7, F.format_number(F.col("p_retailprice"), 2)),
        text_cell(9, F.when(brand_number % 3 != 2, F.col("written"))),
    )
    cells = parts.select(F.col("p_brand").alias("sheet"), "row", F.inline(body))
    head = [text_cell(col, F.lit(label)) for col, label in HEADER_ROW.items()]
    head.append(text_cell(9, F.when(brand_number % 3 == 0, "Корректная  цена")))
    headers = (
        parts.select("p_brand").distinct().select(F.col("p_brand").alias("sheet"), F.lit(1).cast("bigint").alias("row"), F.inline(F.array(*head)))
    )
    return headers.unionByName(cells).where(F.col("value").isNotNull())


SQL_BRAND = "CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER)"


@query("price_columns", f"""
    WITH p AS (SELECT *, {SQL_BRAND} % 3 AS kind FROM ({SQL_LOCALIZED})),
    s AS (SELECT * FROM p WHERE p_size <> 13),
    v AS (SELECT p_brand, any_value(kind) AS kind, count(*) AS n,
                 count(CASE WHEN kind <> 2 THEN {sql_price('written')} END) AS valid FROM s GROUP BY 1)
    SELECT b.p_brand AS sheet, CAST(CASE WHEN b.kind = 0 THEN 9 WHEN b.kind = 1 AND valid >= greatest(1, n * 0.5) THEN 9
                                         ELSE 7 END AS INTEGER) AS price_col, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT DISTINCT p_brand, kind FROM p) b LEFT JOIN v USING (p_brand)
""")
def price_columns(spark, folder):
    rows = cleaning.sheet_rows(workbook_cells(spark, folder), ["sheet"])
    sheets = cleaning.infer_price_column(rows, ["sheet"], cleaning.find_headers(rows, ["sheet"]))
    return sheets.select("sheet", "price_col", "error")


def workbook_products(spark, folder) -> DataFrame:
    rows = cleaning.sheet_rows(workbook_cells(spark, folder), ["sheet"])
    sheets = cleaning.infer_price_column(rows, ["sheet"], cleaning.find_headers(rows, ["sheet"]))
    return cleaning.product_rows(rows, ["sheet"], sheets)


SQL_PRODUCTS = f"""
    WITH p AS (SELECT *, {SQL_BRAND} % 3 AS kind FROM ({SQL_LOCALIZED})),
    s AS (SELECT * FROM p WHERE p_size <> 13),
    v AS (SELECT p_brand, count(*) AS n, count(CASE WHEN kind <> 2 THEN {sql_price('written')} END) AS valid
          FROM s GROUP BY 1),
    c AS (SELECT p.*, CASE WHEN kind = 0 OR (kind = 1 AND valid >= greatest(1, n * 0.5)) THEN written
                           ELSE format('{{:,.2f}}', p_retailprice) END AS raw_price
          FROM p LEFT JOIN v USING (p_brand)),
    products AS (SELECT p_brand AS sheet, p_partkey + 2 AS row, p_partkey,
        CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey // 5 AS VARCHAR) END AS number,
        CASE WHEN p_size <> 13 THEN p_name END AS name, p_brand AS brand, {sql_squash('raw_price')} AS price,
        lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS article, p_size = 17 AS bad_article FROM c)
"""


@query("product_rows", SQL_PRODUCTS + "SELECT sheet, row, number, name, brand, price, article FROM products")
def product_rows(spark, folder):
    return workbook_products(spark, folder).select("sheet", "row", "number", "name", "brand", "price", "article")


@query("product_violations", SQL_PRODUCTS + f"""
    SELECT sheet, row, 'field name' AS rule FROM products WHERE name IS NULL
    UNION ALL SELECT sheet, row, 'field article' FROM products WHERE bad_article
    UNION ALL SELECT sheet, row, 'price not an amount' FROM products WHERE {sql_price('price')} IS NULL
""")
def product_violations(spark, folder):
    return cleaning.check_products(workbook_products(spark, folder), ["sheet"])


@query("forward_filled_groups", """
    WITH r AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'W' ELSE 'M' END AS sheet, conv_id * 100 + turn AS row, role,
                      CASE WHEN turn = 0 THEN conv_id END AS n FROM conversations)
    SELECT sheet, row, role, CAST(last_value(n IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row) AS VARCHAR) AS look_number FROM r
""")
def forward_filled_groups(spark, folder):
    rows = table(spark, folder, "conversations").select(
        F.when(F.col("conv_id") % 2 == 0, "W").otherwise("M").alias("sheet"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("row"),
        "role",
        F.when(F.col("turn") == 0, F.concat(F.lit(" 00"), F.col("conv_id").cast("string"))).alias("cell"),
    )
    return cleaning.forward_fill_group(rows, ["sheet"], "row", "cell", "look_number").drop("cell")


@query("groups_until_blank", """
    WITH r AS (SELECT conv_id, turn, CASE WHEN length(text) % 4 <> 0 THEN role END AS kind,
                      CASE WHEN length(text) % 4 NOT IN (0, 1) THEN length(text) END AS chars FROM conversations),
    b AS (SELECT *, kind IS NULL AND chars IS NULL AS blank FROM r),
    f AS (SELECT conv_id, min(turn) AS first_turn FROM b WHERE NOT blank GROUP BY 1),
    e AS (SELECT b.conv_id, min(b.turn) AS end_turn FROM b JOIN f USING (conv_id) WHERE blank AND turn > first_turn GROUP BY 1)
    SELECT b.conv_id, b.turn, b.kind, b.chars, kind IS NULL OR chars IS NULL AS partial
    FROM b LEFT JOIN e USING (conv_id) WHERE NOT blank AND (end_turn IS NULL OR b.turn < end_turn)
""")
def groups_until_blank(spark, folder):
    size = F.char_length("text")
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(size % 4 != 0, F.col("role")).alias("kind"),
        F.when(~(size % 4).isin(0, 1), size.cast("bigint")).alias("chars"),
    )
    return cleaning.group_until_blank(rows, ["conv_id"], "turn", ["kind", "chars"])


@query("numbered_files", """
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
           CASE WHEN o_custkey % 2 = 0 THEN 'W' ELSE 'M' END || '_'
             || CASE WHEN o_custkey < 1000 THEN lpad(CAST(o_custkey AS VARCHAR), 3, '0') ELSE CAST(o_custkey AS VARCHAR) END AS stem
    FROM orders
""")
def numbered_files(spark, folder):
    key = F.col("o_custkey").cast("string")
    stem = F.concat(
        F.when(F.col("o_custkey") % 2 == 0, "W_").otherwise("M_"), F.lpad(key, F.greatest(F.lit(3), F.char_length(key)), F.lit("0"))
    )
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", stem.alias("stem"))
    return cleaning.number_in_group(rows, ["o_custkey"], "o_orderkey", "n")

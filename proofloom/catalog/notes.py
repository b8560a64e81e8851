"""Notes, decisions, labels and codes over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, notes, text
from . import dealt_table, query, table
from .catalogue import sql_squash

LABELLED_LINES = [
    "garment=белый жакет; bag=black leather tote; odd",
    "garment=unknown; bag=none;",
    "color: rich teal; accessories = <item>;",
    "model=; shoes=нет; pose: full-length",
    "clothing=тренч\nбез метки",
]


def labelled_notes(spark, folder) -> DataFrame:
    """Whole document text with labelled review lines after it."""
    line = F.element_at(F.array(*[F.lit(line) for line in LABELLED_LINES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", F.concat("text", F.lit("\n"), line).alias("note"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_NOTES = "SELECT doc_id, text || chr(10) || CASE doc_id % 5 " + " ".join(
    f"WHEN {i} THEN " + sql_text(line).replace("\n", "' || chr(10) || '") for i, line in enumerate(LABELLED_LINES)
) + " END AS note FROM documents"
SQL_LABEL = r"(?:^|[^\pL\pN_])(" + "|".join(notes.LABELS) + r")\s*[:=]\s*([^;\n]*)(?:;|$)"


def sql_cue_pattern(category: str) -> str:
    """Words with Unicode edges, phrases and stems of a category in RE2 syntax."""
    words = notes.CUE_WORDS[category] + (["full[- ]length", "side[- ]pose"] if category == "pose" else [])
    return sql_text(rf"(?:^|[^\pL\pN_])(?:{'|'.join(words)})(?:[^\pL\pN_]|$)|{notes.CUE_STEMS[category]}")


SQL_GROUNDED = (
    "length({v}) >= 3 AND regexp_matches({v}, '\\pL') AND {v} NOT IN (" + ", ".join(sql_text(f) for f in notes.FILLERS)
    + ") AND NOT regexp_full_match({v}, '<.*>|\\[.*\\]')"
)
SQL_CATEGORIES = f"""
    WITH n AS ({SQL_NOTES}), l AS (SELECT doc_id, note, lower(note) AS low FROM n),
    s AS (SELECT *, regexp_extract_all(low, {sql_text(SQL_LABEL)}, 1) AS names,
                 list_transform(regexp_extract_all(low, {sql_text(SQL_LABEL)}, 2), lambda v: trim(v)) AS vals,
                 string_split_regex(low, {sql_text(SQL_LABEL)}) AS pieces FROM l),
    p AS (SELECT doc_id, note,
            list_filter(list_transform(generate_series(1, len(names)), lambda i: CASE WHEN {SQL_GROUNDED.format(v='vals[i]')}
                THEN CASE names[i] WHEN 'color' THEN 'colour' WHEN 'accessories' THEN 'accessory' WHEN 'clothing' THEN 'garment' ELSE names[i] END END),
                lambda x: x IS NOT NULL) AS named,
            array_to_string(list_transform(generate_series(1, len(pieces)), lambda i: pieces[i] || ' ' ||
                CASE WHEN i <= len(vals) AND {SQL_GROUNDED.format(v='vals[i]')} THEN vals[i] ELSE '' END), ' ') AS prose FROM s),
    c AS (SELECT doc_id, note, list_sort(list_distinct(list_concat(named, list_filter([{', '.join(
        f"CASE WHEN regexp_matches(prose, {sql_cue_pattern(name)}) THEN '{name}' END" for name in notes.CUE_WORDS
    )}], lambda x: x IS NOT NULL)))) AS categories FROM p)
"""


@query("cue_categories", SQL_CATEGORIES + """
    SELECT doc_id, array_to_string(categories, ',') AS categories, len(categories) >= 2 AND length(trim(note)) >= 28 AS specific FROM c
""")
def cue_categories(spark, folder):
    found = labelled_notes(spark, folder).select("doc_id", F.char_length(F.trim("note")).alias("chars"), notes.cue_categories(F.col("note")).alias("found"))
    return found.select(
        "doc_id", F.array_join("found", ",").alias("categories"), ((F.size("found") >= 2) & (F.col("chars") >= notes.SPECIFIC_CHARS)).alias("specific")
    )


@query("sanitized_notes", f"""
    SELECT conv_id, turn, {sql_squash("replace(replace(text, '. ', '||'), '||', ';')")} AS note,
           length({sql_squash("replace(replace(text, '. ', '||'), '||', ';')")}) >= 25 AS long_enough FROM conversations
""")
def sanitized_notes(spark, folder):
    note = text.sanitize_note(F.replace("text", F.lit(". "), F.lit("||")))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", note.alias("note"), text.note_long_enough(note).alias("long_enough")
    )


@query("negative_notes", r"""
    SELECT doc_id, regexp_matches(lower(n), 'no (?:shown |supplied |visible )?card matches|none (?:of .*? )?match|(?:card|outfit) (?:does not|doesn''t) match|нет (?:подходящ|совпадающ)|ни одн[\pL\pN_]*.*не совпад') AS negative
    FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' No visible card matches.' WHEN 1 THEN ' ни одна карточка не совпадает' WHEN 2 THEN ' None of these match' ELSE ' одна' END AS n FROM documents)
""")
def negative_notes(spark, folder):
    endings = [" No visible card matches.", " ни одна карточка не совпадает", " None of these match", " одна"]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", notes.is_negative_note(F.concat("text", ending)).alias("negative"))


@query("mentioned_looks", r"""
    WITH t AS (SELECT doc_id, text || ' Look_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ', LOOK_' || CAST(doc_id + 1000 AS VARCHAR) || ' look_12 look_'
                      || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS n FROM documents)
    SELECT doc_id, 'LOOK_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ',LOOK_' || CAST(doc_id + 1000 AS VARCHAR) AS looks FROM t
    WHERE len(regexp_extract_all(upper(n), '\bLOOK_[0-9]{3,}\b')) = 3
""")
def mentioned_looks(spark, folder):
    short = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    full = F.concat("text", F.lit(" Look_"), short, F.lit(", LOOK_"), (F.col("doc_id") + 1000).cast("string"), F.lit(" look_12 look_"), short)
    return table(spark, folder, "documents").select("doc_id", F.array_join(text.extract_ids(full), ",").alias("looks"))


@query("stable_errors", f"""
    SELECT conv_id, turn, regexp_replace({sql_squash("text || ' at 2024-01-0' || CAST(turn % 9 + 1 AS VARCHAR) || 'T10:00:00.5+00:00' || chr(10) || ' retry'")},
        '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9:.+-]+\\b', '<time>', 'g') AS error FROM conversations
""")
def stable_errors(spark, folder):
    stamped = F.concat("text", F.lit(" at 2024-01-0"), (F.col("turn") % 9 + 1).cast("string"), F.lit("T10:00:00.5+00:00\n retry"))
    return table(spark, folder, "conversations").select("conv_id", "turn", text.stable_error_text(stamped).alias("error"))


@query("parsed_decisions", f"""
    WITH d AS (SELECT conv_id, turn, text, turn % 3 <> 2 AS verdict, turn % 4 = 3 AS contradicted, turn % 2 = 0 AS labelled FROM conversations),
    e AS (SELECT *, CASE WHEN labelled THEN 'garment=white blazer; bag=black tote; ' || text ELSE text END AS raw_note FROM d),
    n AS (SELECT *, {sql_squash("replace(raw_note, '||', ';')")} AS clean,
          labelled OR {' + '.join(f"CASE WHEN regexp_matches(lower(text), {sql_cue_pattern(c)}) THEN 1 ELSE 0 END" for c in notes.CUE_WORDS)} >= 2 AS two FROM e),
    j AS (SELECT *, verdict AND NOT contradicted AS accepted FROM n),
    r AS (SELECT conv_id, turn, accepted, CASE WHEN accepted THEN clean || CASE WHEN turn % 5 = 1 THEN ' Проверить товары: scarf; belt' ELSE '' END ELSE trim(raw_note, chr(10) || ' ') END AS note,
          CASE WHEN turn = 7 THEN 'not requested' WHEN accepted AND NOT (two AND length(trim(raw_note)) >= 28) THEN 'vague note' WHEN accepted AND length(clean) < 25 THEN 'short note' END AS error FROM j
          UNION ALL SELECT DISTINCT conv_id, 99, false, 'match not confirmed', 'no decision' FROM conversations WHERE conv_id % 6 = 0)
    SELECT conv_id, CAST(turn AS VARCHAR) AS item, accepted, md5(note) AS note_md5, error,
           count(error) OVER (PARTITION BY conv_id) = 0 AS batch_ok FROM r
""")
def parsed_decisions(spark, folder):
    turns = table(spark, folder, "conversations")
    note = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("garment=white blazer; bag=black tote; "), "text")).otherwise(F.col("text"))
    decision = F.struct(
        F.col("turn").cast("string").alias("look_id"), (F.col("turn") % 3 != 2).alias("accepted"), note.alias("note"),
        F.when(F.col("turn") % 4 == 3, F.array(F.lit("other shoes"))).otherwise(F.array().cast("array<string>")).alias("contradictions"),
        F.when(F.col("turn") % 5 == 1, F.array(F.lit(" scarf"), F.lit(""), F.lit("belt"))).otherwise(F.array().cast("array<string>")).alias("styling_differences"),
    )
    # One response per turn: a batch is answered in several responses, none of them unbounded.
    responses = turns.select("conv_id", F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(decision).alias("decisions"))), F.lit(" done")).alias("raw"))
    asked = turns.where("turn <> 7").select("conv_id", F.col("turn").cast("string").alias("item"))
    extra = turns.where("conv_id % 6 = 0").select("conv_id", F.lit("99").alias("item"))
    judged = notes.parse_decisions(responses, asked.unionByName(extra), "conv_id", "item", "raw")
    return judged.select("conv_id", "item", "accepted", F.md5("note").alias("note_md5"), "error", "batch_ok")


@query("card_labels", """
    SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'W' ELSE 'M' END END AS sheet,
           CASE WHEN p_size % 3 < 2 THEN CAST(p_partkey AS VARCHAR) END AS number FROM part
""")
def card_labels(spark, folder):
    sheet = F.when(F.col("p_partkey") % 2 == 0, "w").otherwise("M")
    mark = F.element_at(F.array(F.lit(" : 00"), F.lit("-"), F.lit(" № ")), (F.col("p_size") % 3 + 1).cast("int"))
    label = notes.parse_card_label(F.concat(F.lit(" excel "), sheet, mark, F.col("p_partkey").cast("string")))
    return table(spark, folder, "part").select("p_partkey", label["sheet"].alias("sheet"), label["number"].alias("number"))


@query("parsed_assignments", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN 'repeated' WHEN o_orderkey % 7 = 2 THEN 'syntax' WHEN o_orderkey % 7 = 3 THEN 'shared card' END AS error,
           'LOOK_' || CAST(o_orderkey AS VARCHAR) AS look_id, CASE WHEN o_custkey % 2 = 0 THEN 'W' ELSE 'M' END AS sheet, CAST(o_custkey AS VARCHAR) AS number FROM orders
""")
def parsed_assignments(spark, folder):
    key, card = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    sheet = F.when(F.col("o_custkey") % 2 == 0, "w").otherwise("m")
    first = F.concat(F.lit("look_"), key, F.lit(" = "), sheet, F.lit(": "), card)
    kind = F.col("o_orderkey") % 7
    rest = (
        F.when(kind == 1, F.concat(F.lit("LOOK_"), key, F.lit("=W:999999999")))
        .when(kind == 2, F.lit("LOOK_1=X:5"))
        .when(kind == 3, F.concat(F.lit("LOOK_0"), key, F.lit("="), sheet, F.lit(":"), card))
        .otherwise(F.lit(""))
    )
    parsed = notes.parse_assignments(F.concat_ws(",", first, rest))
    item = parsed["items"][0]
    return table(spark, folder, "orders").select("o_orderkey", parsed["error"].alias("error"), item["look_id"].alias("look_id"), item["sheet"].alias("sheet"), item["number"].alias("number"))


@query("parsed_observations", """
    SELECT p_partkey, 2 AS items, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'keys' WHEN 2 THEN 'vague' ELSE 'syntax' END AS error,
           'garment=' || p_name || ' coat; bag=' || p_brand || ' tote' AS first_note FROM part
""")
def parsed_observations(spark, folder):
    good = F.concat(F.lit("garment="), "p_name", F.lit(" coat; bag="), "p_brand", F.lit(" tote"))
    kind = F.col("p_partkey") % 4
    second = F.when(kind == 2, "LOOK_2=looks right").when(kind == 3, "LOOK_2 nothing").otherwise(F.concat(F.lit("LOOK_2="), good))
    requested = F.when(kind == 1, F.array(F.lit("LOOK_1"))).otherwise(F.array(F.lit("LOOK_1"), F.lit("LOOK_2")))
    parsed = notes.parse_observations(F.concat(F.lit("look_1 = "), good, F.lit(" || "), second), requested)
    return dealt_table(spark, folder, "part").select(
        "p_partkey", F.size(parsed["items"]).alias("items"), parsed["error"].alias("error"), parsed["items"][0]["note"].alias("first_note")
    )


@query("requested_ids", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'repeated' WHEN o_orderkey % 5 = 2 THEN 'syntax' WHEN o_orderkey % 5 = 3 THEN 'count' END AS error FROM orders
""")
def requested_ids(spark, folder):
    key = F.concat(F.lit("look_"), F.col("o_orderkey").cast("string"))
    kind = F.col("o_orderkey") % 5
    listed = F.when(kind == 1, F.concat_ws(" , ", key, F.lit("LOOK_9"), F.lit("look_9"))).when(kind == 2, F.concat_ws(",", key, F.lit("LOOK_x"))).when(
        kind == 3, F.concat_ws(",", key, F.lit("LOOK_A1"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"))).otherwise(key)
    return table(spark, folder, "orders").select("o_orderkey", notes.parse_id_list(listed, 5)["error"].alias("error"))


@query("product_blocks", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'uneven' END AS error,
           CASE WHEN p_partkey % 3 <> 2 THEN concat_ws(chr(10), p_name, p_brand, CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR)) || chr(10) || chr(10)
               || concat_ws(chr(10), p_type, p_brand, CAST(p_size AS VARCHAR), '00' || CAST(p_partkey AS VARCHAR)) END AS written FROM part
""")
def product_blocks(spark, folder):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    raw = F.concat_ws("\r\n", F.concat(F.lit(" "), "p_name"), "p_brand", size, key, F.lit("  "), "p_type", "p_brand", size, F.when(F.col("p_partkey") % 3 != 2, F.concat(F.lit("00"), key)))
    parsed = notes.parse_product_blocks(raw)
    return dealt_table(spark, folder, "part").select("p_partkey", parsed["error"].alias("error"), notes.format_product_blocks(parsed["products"]).alias("written"))


@query("project_dates", """
    SELECT o_orderkey, 'PRJ-0' || strftime(o_orderdate, '%y%m%d') AS code, CAST(o_orderdate AS DATE) AS parsed,
           CAST(day(o_orderdate) AS VARCHAR) || ' ' || (['ЯНВАРЯ','ФЕВРАЛЯ','МАРТА','АПРЕЛЯ','МАЯ','ИЮНЯ','ИЮЛЯ','АВГУСТА','СЕНТЯБРЯ','ОКТЯБРЯ','НОЯБРЯ','ДЕКАБРЯ'])[month(o_orderdate)] AS printed
    FROM (SELECT o_orderkey, o_orderdate + INTERVAL 10 YEAR AS o_orderdate FROM orders)
""")
def project_dates(spark, folder):
    day = F.to_date(F.col("o_orderdate") + F.expr("INTERVAL 10 YEAR"))
    return table(spark, folder, "orders").select(
        "o_orderkey", codes.date_code(day).alias("code"), codes.code_date(F.concat(F.lower(codes.date_code(day)), F.lit("_LB_WA_01.indd"))).alias("parsed"),
        codes.visible_date(day).alias("printed"),
    )


@query("next_revisions", """
    SELECT p_partkey, replace(p_name, ' ', '_') || '_' || CASE WHEN p_partkey + 1 < 100 THEN lpad(CAST(p_partkey + 1 AS VARCHAR), 2, '0') ELSE CAST(p_partkey + 1 AS VARCHAR) END AS next FROM part
""")
def next_revisions(spark, folder):
    key = F.col("p_partkey").cast("string")
    stem = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.lpad(key, F.greatest(F.lit(2), F.char_length(key)), F.lit("0")))
    return table(spark, folder, "part").select("p_partkey", text.next_revision(stem).alias("next"))


@query("token_estimates", "SELECT doc_id, greatest(1, CAST(strlen(text) AS BIGINT) // 4) + (doc_id % 3) * 4096 AS tokens FROM documents")
def token_estimates(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.estimate_tokens(F.col("text"), F.col("doc_id") % 3).alias("tokens"))


@query("reported_tokens", """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS input_tokens,
           CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS output_tokens FROM events
""")
def reported_tokens(spark, folder):
    k = F.get_json_object("props", "$.k")
    fields = F.when(F.col("event_type") == "click", F.concat(F.lit('{"usage": {"prompt_tokens": '), k, F.lit(', "completion_tokens": '), k, F.lit("}}")))
    fields = fields.when(F.col("event_type") == "view", F.concat(F.lit('{"usageMetadata": {"promptTokenCount": '), k, F.lit("}}")))
    fields = fields.when(F.col("event_type") == "error", F.concat(F.lit('{"usage": {"input_tokens": '), k, F.lit("}}"))).otherwise(F.col("props"))
    return table(spark, folder, "events").select(
        "event_id", codes.usage_tokens(fields, codes.INPUT_FIELDS).alias("input_tokens"), codes.usage_tokens(fields, codes.OUTPUT_FIELDS).alias("output_tokens")
    )


@query("pages_in_range", """
    SELECT l_orderkey, l_partkey, l_suppkey, (l_quantity BETWEEN 1 AND 3) OR l_quantity = 7 OR (l_quantity BETWEEN l_linenumber AND l_linenumber * 5) AS included FROM lineitem
""")
def pages_in_range(spark, folder):
    pages = F.concat(F.lit("1-3, 7,x-9,,"), F.col("l_linenumber").cast("string"), F.lit(" - "), (F.col("l_linenumber") * 5).cast("string"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", codes.page_in_range(pages, F.col("l_quantity").cast("bigint")).alias("included"))


@query("rebased_paths", """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'control/work/' || p WHEN 1 THEN 'control/work/_mat/' || p ELSE 'control/work/' || string_split(p, '/')[-1] END AS path
    FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)
""")
def rebased_paths(spark, folder):
    inner = F.regexp_replace("url", "^[a-z]+://", "")
    prefix = F.element_at(F.array(F.lit("control/work/"), F.lit("_mat/"), F.lit("old\\")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, folder, "pages").select("page_id", codes.rebase_path(F.concat(prefix, inner)).alias("path"))

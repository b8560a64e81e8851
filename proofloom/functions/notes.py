"""Review notes and decisions: visual cues, card labels, assignments, product blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITESPACE, sanitize_note, strip_ws

# The visual categories of a note, the whole English words and the Russian stems that name them.
CUE_WORDS = {
    "model": ["model", "woman", "man", "female", "male", "person"],
    "garment": [
        "coat", "trench", "jacket", "blazer", "shirt", "top", "dress", "skirt", "trouser", "pants", "jeans", "shorts", "jumpsuit",
        "vest", "suit", "cardigan", "hoodie", "sweater", "polo", "swimwear", "bikini", "bodysuit", "gown", "cape", "poncho",
        "shearling", "turtleneck", "pullover",
    ],
    "colour": [
        "black", "white", "grey", "gray", "brown", "beige", "pink", "blue", "red", "green", "yellow", "orange", "purple", "gold",
        "silver", "denim", "colour", "color", "mustard", "burgundy", "khaki", "cream", "navy", "ivory", "camel",
    ],
    "bag": ["bag", "tote", "clutch", "pouch", "handbag", "crossbody"],
    "shoes": ["shoe", "shoes", "sandal", "boot", "sneaker", "heel", "loafer", "pump", "ballet", "trainer"],
    "accessory": [
        "glasses", "sunglasses", "scarf", "belt", "bracelet", "necklace", "earring", "hat", "cap", "jewelry", "jewellry", "watch",
    ],
    "pose": ["standing", "seated", "sitting", "pose"],
}
CUE_STEMS = {
    "model": "модел|женщин|мужчин|девушк|парен",
    "garment": (
        "пальто|плащ|куртк|жакет|пиджак|рубаш|топ|плать|юбк|брюк|джинс|шорт|комбинез|жилет|костюм|кардиган|худи|свитер|"
        "поло|купаль|боди|накидк|пончо|дубл[её]н|водолаз|джемпер"
    ),
    "colour": (
        "ч[её]рн|бел|сер|корич|беж|розов|син|голуб|красн|зел[её]н|желт|оранж|фиолет|золот|серебр|деним|цвет|горчич|бордов|"
        "хаки|кремов|молочн|ж[её]лт"
    ),
    "bag": "сумк|клатч|тоут|ридикюл",
    "shoes": "туфл|босонож|ботин|сапог|кроссов|лофер|балетк|обув",
    "accessory": "очк|шарф|платок|рем[её]н|браслет|колье|серьг|шляп|кепк|украшен|час[ыов]",
    "pose": rf"в{WHITESPACE}+полный{WHITESPACE}+рост|сидит|стоит|поза",
}
CUE_PHRASES = {"pose": r"(?U)\b(?:full[- ]length|side[- ]pose)\b"}
LABELS = ["model", "garment", "clothing", "colour", "color", "bag", "shoes", "accessory", "accessories", "pose"]
LABEL_ALIASES = {"color": "colour", "accessories": "accessory", "clothing": "garment"}
FILLERS = [
    "unknown", "none", "n/a", "same", "matching", "matches", "present", "not visible", "не видно", "нет", "совпадает", "одинаковые",
]
NEGATIVE_NOTE = (
    r"(?iu)no (?:shown |supplied |visible )?card matches|none (?:of .*? )?match|(?:card|outfit) (?:does not|doesn't) match|"
    r"нет (?:подходящ|совпадающ)|ни одн[\p{L}\p{N}_]*.*не совпад"
)
SPECIFIC_CHARS = 28
STYLING_MARKER = "Проверить товары:"

LABELLED = (
    r"(?d)(?<![\p{L}\p{N}_])(" + "|".join(LABELS) + f"){WHITESPACE}*[:=]{WHITESPACE}*" + r"([^;\n]*)(?:;|$)"
)


def _grounded(value: Column) -> Column:
    return (
        (F.char_length(value) >= 3) & value.rlike(r"\p{L}") & ~value.isin(FILLERS) & ~value.rlike(r"^(?:<.*>|\[.*\])$")
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _dictionary_cues(prose: Column) -> Column:
    """Categories named by a whole word, or by a stem where the text has Cyrillic letters at all."""
    every_word = F.array(*[F.lit(word) for words in CUE_WORDS.values() for word in words])
    known_words = F.array_intersect(F.split(prose, r"[^\p{L}\p{N}_]+"), every_word)
    cyrillic = prose.rlike("[а-яё]")
    # Stems are tried only where a Cyrillic letter stands.
    stem = lambda category: prose.rlike(f"(?=[а-яё])(?:{CUE_STEMS[category]})")

    def named(words: Column) -> Column:
        hits = []
        for category, known in CUE_WORDS.items():
            hit = F.arrays_overlap(words, F.array(*[F.lit(word) for word in known]))
            if category in CUE_PHRASES:
                hit = hit | prose.rlike(CUE_PHRASES[category])
            hits.append(F.when(hit | (cyrillic & stem(category)), category))
        return F.array(*hits)

    return _let(known_words, named)


def cue_categories(note: Column) -> Column:
    """Sorted visual categories a note names, by grounded label or by dictionary word.

    Labelled spans give their value to the dictionary search, or nothing when it is a filler.
    """
    aliases = F.create_map(*[F.lit(word) for pair in LABEL_ALIASES.items() for word in pair])

    def from_text(lowered: Column) -> Column:
        spans = F.regexp_extract_all(lowered, F.lit(LABELLED), F.lit(0))
        names = F.transform(spans, lambda span: F.regexp_extract(span, "^[a-z]+", 0))
        raw = F.transform(spans, lambda span: F.regexp_extract(span, "^[^:=]*[:=]([^;]*)", 1))
        # A value that says nothing becomes an empty string.
        values = F.transform(raw, lambda value: _let(strip_ws(value), lambda text: F.when(_grounded(text), text).otherwise("")))

        def from_labels(grounded: Column) -> Column:
            labelled = F.zip_with(names, grounded, lambda name, value: F.when(value != "", F.coalesce(F.try_element_at(aliases, name), name)))
            pieces = F.zip_with(F.split(lowered, LABELLED, -1), grounded, lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))))
            return F.concat(labelled, _let(F.array_join(pieces, ""), _dictionary_cues))

        return F.when(lowered.rlike("[:=]"), _let(values, from_labels)).otherwise(_dictionary_cues(lowered))

    return F.array_sort(F.array_distinct(F.array_compact(_let(F.lower(note), from_text))))


def note_is_specific(note: Column, minimum: int = SPECIFIC_CHARS) -> Column:
    return (F.char_length(strip_ws(note)) >= minimum) & (F.size(cue_categories(note)) >= 2)


def is_negative_note(note: Column) -> Column:
    return note.rlike(NEGATIVE_NOTE)


def styling_text(description: Column) -> Column:
    """Text after the first styling marker; null without one."""
    return F.when(
        description.contains(STYLING_MARKER), strip_ws(F.regexp_extract(description, f"(?s){STYLING_MARKER}(.*)$", 1))
    )


def parse_card_label(label: Column) -> Column:
    """``EXCEL W: 007`` to (sheet W, number 7); null when it is no card label."""
    text = F.upper(strip_ws(label))
    pattern = r"(?U)^(?:EXCEL\s*)?([WM])\s*[:/_-]\s*0*([0-9]+)$"
    parsed = F.struct(F.regexp_extract(text, pattern, 1).alias("sheet"), F.regexp_extract(text, pattern, 2).alias("number"))
    return F.when(text.rlike(pattern), parsed)


def _parts(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator, -1), strip_ws), lambda part: part != "")


def parse_id_list(text: Column, maximum: int) -> Column:
    """Ids of ``K,K`` and the first rule broken: count, repeated, syntax."""
    ids = F.transform(_parts(text, ","), F.upper)
    error = (
        F.when((F.size(ids) == 0) | (F.size(ids) > maximum), "count")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated")
        .when(F.exists(ids, lambda value: ~value.rlike("^LOOK_[0-9]+$")), "syntax")
    )
    return F.struct(ids.alias("ids"), error.alias("error"))


def parse_assignments(text: Column, maximum: int = 5) -> Column:
    """Assignments of ``K=W:12,…`` and the first rule broken: syntax, repeated, count, shared card."""
    shape = r"^[^=]*=[^:]*:[^:]*$"

    def assignment(part: Column) -> Column:
        card = F.regexp_extract(part, "^[^=]*=(.*)$", 1)
        return F.struct(
            F.upper(strip_ws(F.regexp_extract(part, "^([^=]*)=", 1))).alias("look_id"),
            F.upper(strip_ws(F.substring_index(card, ":", 1))).alias("sheet"),
            F.upper(strip_ws(F.substring_index(card, ":", -1))).alias("number"),
            (part.rlike(shape) & ~F.regexp_extract(part, "^([^=]*)=", 1).contains(":")).alias("shaped"),
        )

    items = F.transform(_parts(text, ","), assignment)
    sound = lambda item: (
        item["shaped"] & item["look_id"].rlike("^LOOK_[0-9]+$") & item["sheet"].isin("W", "M") & item["number"].rlike("^[0-9]+$")
    )
    looks = F.transform(items, lambda item: item["look_id"])
    cards = F.transform(items, lambda item: F.struct(item["sheet"], item["number"]))
    error = (
        F.when(F.exists(items, lambda item: ~sound(item)), "syntax")
        .when(F.size(F.array_distinct(looks)) != F.size(looks), "repeated")
        .when((F.size(items) == 0) | (F.size(items) > maximum), "count")
        .when(F.size(F.array_distinct(cards)) != F.size(cards), "shared card")
    )
    return F.struct(F.transform(items, lambda item: item.dropFields("shaped")).alias("items"), error.alias("error"))


def parse_observations(text: Column, requested: Column) -> Column:
    """Notes of ``K=note||…`` and the first rule broken: syntax, repeated, keys, vague."""
    def observation(part: Column) -> Column:
        return F.struct(
            F.upper(strip_ws(F.regexp_extract(part, "(?s)^([^=]*)=", 1))).alias("look_id"),
            strip_ws(F.regexp_extract(part, "(?s)^[^=]*=(.*)$", 1)).alias("note"),
            part.contains("=").alias("shaped"),
        )

    items = F.transform(_parts(text, r"\|\|"), observation)
    looks = F.transform(items, lambda item: item["look_id"])
    error = (
        F.when(F.exists(items, lambda item: ~item["shaped"]), "syntax")
        .when(F.size(F.array_distinct(looks)) != F.size(looks), "repeated")
        .when(F.sort_array(looks) != F.sort_array(F.array_distinct(requested)), "keys")
        .when(F.exists(items, lambda item: ~note_is_specific(item["note"])), "vague")
    )
    return F.struct(F.transform(items, lambda item: item.dropFields("shaped")).alias("items"), error.alias("error"))


PRODUCT_PARTS = ["type", "brand", "price", "article"]


def parse_product_blocks(text: Column) -> Column:
    """Products of four non-blank lines each, and the error of an empty or uneven text."""
    lines = F.filter(
        F.transform(F.split(text, "\r\n|\r|\n", -1), lambda line: F.replace(strip_ws(line), F.lit("\t"), F.lit(" "))),
        lambda line: line != "",
    )

    def product(index: Column) -> Column:
        return F.struct(*[F.get(lines, index * 4 + offset).alias(name) for offset, name in enumerate(PRODUCT_PARTS)])

    complete = (F.size(lines) > 0) & (F.size(lines) % 4 == 0)
    products = F.when(complete, F.transform(F.sequence(F.lit(0), (F.size(lines) / 4).cast("int") - 1), product))
    error = F.when(F.size(lines) == 0, "empty").when(F.size(lines) % 4 != 0, "uneven")
    return F.struct(products.alias("products"), error.alias("error"))


def format_product_blocks(products: Column) -> Column:
    block = lambda item: F.concat_ws("\n", *[item[name] for name in PRODUCT_PARTS])
    return F.array_join(F.transform(products, block), "\n\n")


DECISION_SCHEMA = (
    "decisions ARRAY<STRUCT<look_id STRING, accepted BOOLEAN, `match` BOOLEAN, note STRING, contradictions ARRAY<STRING>, "
    "styling_differences ARRAY<STRING>, excel_observation STRING, reference_observation STRING>>"
)
REJECTED_NOTE = "match not confirmed"


def json_span(raw: Column) -> Column:
    """Text from the first opening to the last closing brace."""
    return F.regexp_extract(raw, r"(?s)(\{.*\})", 1)


def parse_decisions(responses: DataFrame, expected: DataFrame, batch: str, item: str, raw: str, credit_notes: bool = True) -> DataFrame:
    """Decisions of each response, checked against the items the batch was asked for.

    One row per expected or returned (batch, item): accepted, note, error.  Errors: no decision,
    not requested, repeated, no verdict, no observation, vague note, short note.  A contradiction
    rejects; a rejection needs no note.  ``batch_ok`` is false for every row of a batch with an error.
    """
    parsed = responses.withColumn("_d", F.explode_outer(F.from_json(json_span(F.col(raw)), DECISION_SCHEMA)["decisions"]))
    d = F.col("_d")
    returned = parsed.where(d.isNotNull()).select(
        batch, strip_ws(F.coalesce(d["look_id"], F.lit(""))).alias(item), d["note"].alias("_note"), F.coalesce(d["accepted"], d["match"]).alias("_verdict"),
        F.exists(F.coalesce(d["contradictions"], F.array().cast("array<string>")), lambda c: strip_ws(F.coalesce(c, F.lit(""))) != "").alias("_contradicted"),
        F.filter(F.transform(F.coalesce(d["styling_differences"], F.array().cast("array<string>")), strip_ws), lambda s: s != "").alias("_styling"),
        d["excel_observation"].alias("_seen_card"), d["reference_observation"].alias("_seen_reference"),
    )
    times = returned.groupBy(batch, item).agg(F.count("*").alias("_times"))
    joined = (
        expected.select(batch, item).distinct().withColumn("_asked", F.lit(True))
        .join(returned.join(times, [batch, item]), [batch, item], "full_outer")
    )
    accepted = F.coalesce(F.col("_verdict"), F.lit(False)) & ~F.coalesce(F.col("_contradicted"), F.lit(False))
    observations = F.col("_seen_card").isNotNull() | F.col("_seen_reference").isNotNull()
    blank = lambda name: strip_ws(F.coalesce(F.col(name), F.lit(""))) == ""
    with_styling = F.when(
        F.lit(credit_notes) & (F.size("_styling") > 0), F.concat(sanitize_note(F.col("_note")), F.lit(f" {STYLING_MARKER} "), F.array_join("_styling", "; "))
    ).otherwise(F.col("_note"))
    error = (
        F.when(F.col("_times").isNull(), "no decision")
        .when(F.col("_asked").isNull(), "not requested")
        .when(F.col("_times") > 1, "repeated")
        .when(F.col("_verdict").isNull(), "no verdict")
        .when(accepted & observations & (blank("_seen_card") | blank("_seen_reference")), "no observation")
        .when(accepted & F.lit(credit_notes) & ~F.coalesce(note_is_specific(F.col("_note")), F.lit(False)), "vague note")
        .when(accepted & ~F.coalesce(F.char_length(sanitize_note(F.col("_note"))) >= 25, F.lit(False)), "short note")
    )
    note = F.when(accepted, sanitize_note(with_styling)).otherwise(
        F.when(blank("_note"), REJECTED_NOTE).otherwise(strip_ws(F.col("_note")))
    )
    judged = joined.select(batch, item, accepted.alias("accepted"), note.alias("note"), error.alias("error"))
    bad = judged.where(F.col("error").isNotNull()).select(batch).distinct().withColumn("_bad", F.lit(True))
    return judged.join(bad, batch, "left").withColumn("batch_ok", F.col("_bad").isNull()).drop("_bad")

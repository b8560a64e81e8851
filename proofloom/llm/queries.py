"""The operators over whole tables, one query each, with SQL where SQL can express it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filter_audit, html_extraction, language, line_runs, mixing, ngram_join, periodic_runs, quality_classifier, quality_rules, sentencepieces, sharding, toxicity, vector_search
from .common import in_fold

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_PHRASES = "|".join(quality_rules.BOILERPLATE)


@query("op1_language_id")
def op1_language_id(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", in_fold(F.col("doc_id"), 5, 0))
    model = language.fit_language_model(docs.where(~F.col("held_out")))
    return language.identify_languages(docs, model, keep=("held_out",))


@query("op2_quality_rules", rf"""
    WITH lines AS (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
                   FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
    judged AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM lines),
    sized AS (SELECT *, CAST(len(words) AS BIGINT) AS n FROM judged WHERE len(words) > 0),
    verdict AS (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS again, (
        NOT contains('.!?…:;,"'')]' || chr(125) || '»”’', right(words[len(words)], 1))
        OR ((len(line) - len(replace(line, '!!', ''))) // 2 >= 3 AND (len(line) - len(replace(line, '!!', ''))) // 2 * 4 >= n)
        OR (len(list_filter(words, lambda w: w IN ('|', '»', '›', '>', '•', '·', '/'))) >= 2 AND len(list_filter(words, lambda w: w IN ('|', '»', '›', '>', '•', '·', '/'))) * 4 >= n)
        OR (len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) >= 3 AND len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 2 >= n)
        OR (n <= 40 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}'))) AS fails FROM sized),
    by_line AS (SELECT rid, sum(n) AS n_words, sum(len(array_to_string(words, ''))) AS word_chars,
                       sum(CAST(again AS INT)) AS n_dup_lines, sum(CASE WHEN fails THEN n ELSE 0 END) AS removed FROM verdict GROUP BY rid),
    words AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos
              FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
    windows AS (SELECT rid, pos, word, lead(word, 1) OVER o AS word2, lead(word, 2) OVER o AS word3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
    twice AS (SELECT rid, pos, word3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, word2, word3) > 1 AS repeated FROM windows),
    covered AS (SELECT rid, repeated OR coalesce(lag(repeated, 1) OVER o, FALSE) OR coalesce(lag(repeated, 2) OVER o, FALSE) AS inside
                FROM twice WINDOW o AS (PARTITION BY rid ORDER BY pos)),
    by_word AS (SELECT rid, sum(CAST(inside AS INT)) AS n_repeat_words FROM covered GROUP BY rid),
    counted AS (SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
                       CAST(coalesce(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                       CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_words
                FROM (SELECT *, row_number() OVER () AS rid FROM documents) d LEFT JOIN by_line USING (rid) LEFT JOIN by_word USING (rid)),
    based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
    SELECT *, NOT base_failed AND 100 * n_removed_words <= 50 * n_words AS kept FROM based
""")
def op2_quality_rules(spark, folder):
    return quality_rules.clean_lines(table(spark, folder, "documents"), with_text=False)


@query("op4_mixing", r"""
    WITH told AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
    sized AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, digest) AS number FROM told),
    sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM sums),
    stops AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS stop FROM weighed),
    levels AS (SELECT *, ((SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER before, 0.0)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0.0)) AS level
               FROM stops WINDOW before AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    shared AS (SELECT arg_min(level, stop) AS level FROM levels WHERE level <= stop),
    targets AS (SELECT source, source_size, least(cap, shared.level * weight) AS target FROM stops, shared),
    rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 1.0::DOUBLE END AS rate FROM targets),
    drawn AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
                     CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || digest || ':' || number), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE AS share
              FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN share < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM drawn
""")
def op4_mixing(spark, folder):
    plan = mixing.mixing_plan(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark, folder):
    return sentencepieces.encode_documents(table(spark, folder, "documents"), outputs=("ids_sha256", "decoded_sha256"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", in_fold(F.col("doc_id"), 4, 2))
    labelled = quality_classifier.labelled_texts(docs.where(~F.col("held_out")), table(spark, folder, "labels"), "quality")
    return quality_classifier.score_quality(docs, quality_classifier.fit_quality_model(labelled), keep=("held_out",))


@query("op7_toxicity")
def op7_toxicity(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", in_fold(F.col("doc_id"), 5, 0))
    labelled = quality_classifier.labelled_texts(docs.where(~F.col("held_out")), table(spark, folder, "labels"), "toxic")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity_model(labelled), keep=("held_out",))


@query("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark, folder):
    return ngram_join.similar_classes(table(spark, folder, "documents")).drop("text_hash")


@query("op9_vector_search")
def op9_vector_search(spark, folder):
    return vector_search.nearest_vectors(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_sharding")
def op3_sharding(spark, folder):
    placed = sharding.pack_shards(table(spark, folder, "documents"))
    law = [F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return placed.select("doc_id", "size", "text_crc32", *law)


@query("op8_html_extraction")
def op8_html_extraction(spark, folder):
    pages = html_extraction.extract_main_text(table(spark, folder, "pages"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def looped_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op11: in one document of ten, from some word on, a stretch of the words again and again."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op11_periodic_runs")
def op11_periodic_runs(spark, folder):
    found = periodic_runs.periodic_runs(table(spark, folder, "documents"), with_text=False, rewrite=looped_words)
    # Longest first, then the smallest start, then the smallest period.
    ranked = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = found.withColumn("best", F.get(ranked, F.lit(0)))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.shorter") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op12_line_dedup", rf"""
    WITH rows AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows),
    keyed AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
    judged AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o USING (key))
    SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged JOIN rows USING (rid) GROUP BY rid
""")
def op12_line_dedup(spark, folder):
    return line_runs.drop_frequent_lines(table(spark, folder, "documents"), with_text=False)


@query("op13_filter_audit", r"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    counted AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
    judged AS (SELECT doc_id, part, [
        len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
        coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, FALSE)] AS fails FROM counted),
    marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    counts AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
               FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
               WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    firsts AS (SELECT *, list_position([fails[ascii(x) - 64] FOR x IN string_split(filter_order, '')], TRUE) AS hit FROM counts, orders),
    steps AS (SELECT part, filter_order, CAST(step AS INT) AS step, filter_order[step] AS letter,
                     CAST(coalesce(sum(n) FILTER (hit IS NULL OR hit > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit = step), 0) AS BIGINT) AS removed,
                     CAST(coalesce(sum(n) FILTER (hit < step AND fails[ascii(filter_order[step]) - 64]), 0) AS BIGINT) AS redundant,
                     CAST(coalesce(sum(n) FILTER (fails[ascii(filter_order[step]) - 64] AND len(list_filter(fails, lambda f: f)) = 1), 0) AS BIGINT) AS unique_fails,
                     CAST(coalesce(sum(good) FILTER (hit = step), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (hit = step), 0) AS BIGINT) AS toxic_lost
              FROM firsts, range(1, 6) AS r(step) GROUP BY ALL)
    SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM steps
""")
def op13_filter_audit(spark, folder):
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))

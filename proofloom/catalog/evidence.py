"""Snapshots, staleness, cascades and revision history over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from ..plans.lineage import scratch_folder
from ..sources import assets, files, state
from . import query, table


def versions(spark, folder):
    """Documents as frozen files and as found later: some changed, some gone, some new."""
    k = F.col("doc_id")
    documents = table(spark, folder, "documents")
    path = F.concat(F.when(k % 9 == 0, "_MAT/hires/").otherwise("control/"), k.cast("string"))
    now = F.when(k % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    identity = lambda content: [F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("length")]
    frozen = assets.snapshot_manifest(documents.select(path.alias("name"), *identity(F.col("text"))))
    current = assets.snapshot_manifest(documents.where(k % 50 != 3).select(path.alias("name"), *identity(now)))
    return documents, frozen, current


@query("snapshot_problems", """
    SELECT 'control/' || CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 50 = 3 THEN 'missing' ELSE 'changed' END AS problem
    FROM documents WHERE doc_id % 9 <> 0 AND (doc_id % 50 = 3 OR doc_id % 7 = 0)
    UNION ALL SELECT 'control/' || CAST(d AS VARCHAR), 'required absent' FROM (SELECT DISTINCT doc_id + 20 AS d FROM labels) WHERE d NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0)
""")
def snapshot_problems(spark, folder):
    _, frozen, current = versions(spark, folder)
    required = table(spark, folder, "labels").select(F.concat(F.lit("control/"), (F.col("doc_id") + 20).cast("string")).alias("path"))
    return assets.verify_snapshot(frozen, current, ["control/work/_mat/hires/", "_MAT/hires/"], required)


def gates(spark, folder):
    """Ten gates per source of documents, each binding the hashes of its documents."""
    k = F.col("doc_id")
    documents = table(spark, folder, "documents").withColumn("gate", F.floor(k / 20) % 10)
    bindings = documents.select(F.col("source").alias("project"), "gate", k.alias("artifact"), F.sha2("text", 256).alias("sha256"))
    found = documents.where(k % 211 != 3).select(
        F.col("source").alias("project"), k.alias("artifact"), F.sha2(F.when(k % 97 == 0, F.lit("new")).otherwise(F.col("text")), 256).alias("sha256")
    )
    projects = documents.select(F.col("source").alias("project")).distinct()
    number = F.regexp_extract("project", "([0-9]+)$", 1).cast("int")
    proofs = projects.select("project", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("gate")).select(
        "project", "gate", F.col("gate").alias("place"), F.lit("s").alias("session_id"), F.when((number == 4) & (F.col("gate") == 6), "old").otherwise("n").alias("nonce"),
        F.lit("n").alias("armed"), ((number != 5) | (F.col("gate") != 2)).alias("passed"), (F.col("gate") >= 8).alias("final"), F.lit("m1").alias("master"),
    )
    live = projects.select("project", F.when(number == 6, "other").otherwise("s").alias("session_id"), F.when(number == 7, "m2").otherwise("m1").alias("master"))
    return proofs, bindings, found, live


@query("gate_validity", """
    WITH d AS (SELECT source AS project, doc_id // 20 % 10 AS gate, doc_id FROM documents),
    p AS (SELECT DISTINCT project, CAST(regexp_extract(project, '([0-9]+)$', 1) AS INTEGER) AS n FROM d),
    f AS (SELECT project, gate, bool_and(doc_id % 97 <> 0 AND doc_id % 211 <> 3) AS fresh FROM d GROUP BY 1, 2),
    v AS (SELECT p.project, g.gate, coalesce(fresh, true) AND n <> 6 AND NOT (n = 4 AND g.gate = 6) AND NOT (n = 5 AND g.gate = 2) AND NOT (n = 7 AND g.gate >= 8) AS valid
          FROM p CROSS JOIN generate_series(0, 9) g(gate) LEFT JOIN f ON f.project = p.project AND f.gate = g.gate)
    SELECT project, gate, gate AS place, valid, bool_and(valid) OVER (PARTITION BY project ORDER BY gate) AS in_passed_prefix FROM v
""")
def gate_validity(spark, folder):
    return evidence.stale_evidence(*gates(spark, folder))


ARTIFACTS = ["caption_map", "caption_provenance", "caption_data", "structure"]


@query("invalidated_gates", """
    WITH c AS (SELECT doc_id AS project, doc_id % 4 AS a FROM documents WHERE doc_id % 7 = 0 OR doc_id % 50 = 3)
    SELECT project, 'map' AS dependent FROM c WHERE a < 3
    UNION ALL SELECT project, d FROM c CROSS JOIN (VALUES ('captions'), ('visual'), ('release'), ('pdf')) x(d) WHERE a = 2
""")
def invalidated_gates(spark, folder):
    documents, frozen, current = versions(spark, folder)
    name = F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint").alias("project")
    artifact = F.element_at(F.array(*[F.lit(a) for a in ARTIFACTS]), (F.col("project") % 4 + 1).cast("int")).alias("artifact")
    recorded = frozen.select(name, "sha256").select("project", artifact, "sha256")
    now = current.select(name, "sha256").select("project", artifact, "sha256")
    changed = evidence.changed_inputs(recorded, now, ["project", "artifact"])
    return evidence.invalidate(changed, evidence.cascade_edges(documents), ["project"], "artifact")


def revisions(spark, folder):
    """Orders of a customer as successive revisions, each starting where the last one ended, mostly."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("look"), F.col("o_orderkey").alias("revision"), (F.col("o_orderkey") % 3).alias("before"), (F.floor(F.col("o_totalprice")) % 3).alias("after")
    )


@query("composed_history", """
    SELECT o_custkey AS look, arg_min(o_orderkey % 3, o_orderkey) AS before, arg_max(CAST(floor(o_totalprice) AS BIGINT) % 3, o_orderkey) AS after, count(*) AS revisions FROM orders GROUP BY 1
""")
def composed_history(spark, folder):
    return evidence.compose_history(revisions(spark, folder), ["look"], "revision", "before", "after")


@query("history_breaks", """
    SELECT look, revision FROM (SELECT o_custkey AS look, o_orderkey AS revision, o_orderkey % 3 AS before,
        lag(CAST(floor(o_totalprice) AS BIGINT) % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prior FROM orders) WHERE prior IS NOT NULL AND prior <> before
""")
def history_breaks(spark, folder):
    return evidence.history_breaks(revisions(spark, folder), ["look"], "revision", "before", "after", chunk_revisions=1000)


@query("undeclared_changes", """
    WITH l AS (SELECT l_orderkey AS look, l_linenumber AS n, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem),
    a AS (SELECT look, pos, CASE WHEN look % 11 = 2 AND pos = 2 THEN -1 ELSE l_partkey END AS part FROM l WHERE look % 13 <> 5 AND NOT (look % 17 = 6 AND pos = 1) UNION ALL SELECT -look, pos, l_partkey FROM l WHERE look % 300 = 1),
    d AS (SELECT look, pos, CASE WHEN look % 11 = 2 AND pos = 2 THEN -1 ELSE l_partkey END AS part FROM l WHERE look % 5 = 0),
    e AS (SELECT look, pos, l_partkey AS part FROM l WHERE look % 5 <> 0 UNION ALL SELECT * FROM d),
    w AS (SELECT DISTINCT coalesce(e.look, a.look) AS look FROM e FULL JOIN a ON e.look = a.look AND e.pos = a.pos WHERE e.part IS DISTINCT FROM a.part)
    SELECT look, CASE WHEN look < 0 THEN 'key added' WHEN look NOT IN (SELECT look FROM a) THEN 'key lost' WHEN look % 5 = 0 THEN 'not as declared' ELSE 'undeclared change' END AS problem FROM w
""")
def undeclared_changes(spark, folder):
    from ..plans.chunks import number_rows

    order = [F.col(name) for name in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    lines = table(spark, folder, "lineitem").withColumn("look", F.col("l_orderkey"))
    rows = number_rows(lines, ["look"], F.col("l_linenumber"), order, "pos").select("look", "pos", F.col("l_partkey").alias("part"))
    look, pos = F.col("look"), F.col("pos")
    edited = F.when((look % 11 == 2) & (pos == 2), -1).otherwise(F.col("part")).cast("bigint").alias("part")
    actual = rows.where((look % 13 != 5) & ~((look % 17 == 6) & (pos == 1))).select("look", "pos", edited).unionByName(
        rows.where(look % 300 == 1).select((-look).alias("look"), "pos", "part")
    )
    return evidence.diff_declared_only(rows, actual, rows.where(look % 5 == 0).select("look", "pos", edited), ["look"], "pos", ["part"])


@query("reconciled_outputs", """
    WITH d AS (SELECT doc_id, doc_id % 4 <> 1 AS attested, doc_id % 50 = 3 AS gone, doc_id % 7 = 0 AS edited, sha256(text) AS sha, n_chars FROM documents),
    s AS (SELECT *, CASE WHEN NOT attested THEN 'pending' WHEN gone THEN 'missing' WHEN edited THEN 'changed' ELSE 'unchanged' END AS state FROM d)
    SELECT doc_id, state, attested AND state = 'unchanged' AS attested, CASE WHEN state IN ('pending', 'unchanged') THEN sha END AS sha256,
           CASE WHEN state IN ('pending', 'unchanged') THEN n_chars END AS page_count FROM s
""")
def reconciled_outputs(spark, folder):
    k = F.col("doc_id")
    documents = table(spark, folder, "documents").withColumn("path", k.cast("string"))
    plan = documents.select("doc_id", "path", (k % 4 != 1).alias("attested"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("page_count"), F.lit("2024").alias("verified_at"))
    found = documents.where(k % 50 != 3).select("doc_id", "path", F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return evidence.reconcile_outputs(plan, found, ["doc_id"]).select("doc_id", "state", "attested", "sha256", "page_count")


@query("changed_specs", """
    SELECT c_custkey AS output, CASE WHEN c_custkey % 11 = 0 THEN 'added' WHEN c_custkey % 13 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer
    WHERE (c_custkey % 11 = 0) <> (c_custkey % 13 = 0) OR (c_custkey % 7 = 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0)
""")
def changed_specs(spark, folder):
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(k.alias("output"), F.col("c_name").alias("path"), F.lit(300).alias("raster_ppi"), "c_custkey")
    planned = rows.where(k % 13 != 0).withColumn("raster_ppi", F.when(k % 7 == 0, 220).otherwise(300))
    return evidence.spec_changes(rows.where(k % 11 != 0), planned, ["output"], ["path", "raster_ppi"])


@query("merged_drafts", """
    SELECT c_custkey AS look, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'base' END AS before, CASE WHEN c_custkey % 2 = 0 THEN 'edit' ELSE 'draft' END AS after
    FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0
""")
def merged_drafts(spark, folder):
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(k.alias("look"))
    draft = rows.where("look % 3 = 0").select("look", F.lit("old").alias("before"), F.lit("draft").alias("after"))
    edits = rows.where("look % 2 = 0").select("look", F.lit("base").alias("before"), F.lit("edit").alias("after"))
    return evidence.draft_merge(draft, edits, ["look"])


@query("derived_stages", """
    WITH s AS (SELECT o_custkey AS project, o_orderpriority AS stage, o_orderkey AS required FROM orders),
    e AS (SELECT l_orderkey AS name, bool_and(l_linestatus = 'F' OR l_quantity > 5) AS complete FROM lineitem GROUP BY 1)
    SELECT project, stage, CASE WHEN bool_and(coalesce(complete, false)) THEN 'passed' ELSE 'pending' END AS status FROM s LEFT JOIN e ON name = required GROUP BY 1, 2
""")
def derived_stages(spark, folder):
    required = table(spark, folder, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("required"))
    done = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.bool_and((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 5)).alias("complete"))
    owned = required.select("project", F.col("required").alias("name")).join(done, "name")
    return evidence.status_from_evidence(required, owned, ["project", "stage"])


ROLES = ["reference", "workbook", "template"]


@query("source_inventory", """
    WITH f AS (SELECT page_id % 10 AS project, lower(regexp_replace(url, '[?#].*$', '')) AS path, CASE WHEN url LIKE '%/de/%' THEN 'reference' WHEN url LIKE '%/en/%' THEN 'workbook' WHEN url LIKE '%/fr/%' THEN 'template' END AS role FROM pages),
    c AS (SELECT project, role, count(DISTINCT path) AS n FROM f WHERE role IS NOT NULL AND NOT (role = 'reference' AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), 'review|10mb|20mb|40mb')) GROUP BY 1, 2)
    SELECT p.project, r.role, coalesce(n, 0) AS found FROM (SELECT DISTINCT page_id % 10 AS project FROM pages) p CROSS JOIN (VALUES ('reference'), ('workbook'), ('template')) r(role)
    LEFT JOIN c ON c.project = p.project AND c.role = r.role WHERE coalesce(n, 0) <> 1
""")
def source_inventory(spark, folder):
    url = F.col("url")
    path = F.regexp_replace(url, "[?#].*$", "")
    found = table(spark, folder, "pages").select((F.col("page_id") % 10).alias("project"), F.when(F.col("page_id") % 2 == 0, F.upper(path)).otherwise(path).alias("path"), url)
    role = F.when(url.contains("/de/"), "reference").when(url.contains("/en/"), "workbook").when(url.contains("/fr/"), "template")
    return evidence.source_inventory(found, found, role, ROLES)


@query("distinct_paths", "SELECT min(u) AS path FROM (SELECT CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE url END AS u FROM pages UNION ALL SELECT url FROM pages) GROUP BY lower(u)")
def distinct_paths(spark, folder):
    pages = table(spark, folder, "pages")
    mixed = pages.select(F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.col("url")).alias("path"))
    return evidence.union_distinct_paths([mixed, pages.select(F.col("url").alias("path"))], [])


@query("damaged_evidence", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'
""")
def damaged_evidence(spark, folder):
    damaged = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props"))
    broken = table(spark, folder, "events").select("event_id", damaged.alias("raw"))
    return files.parse_evidence(broken, "raw", "k BIGINT", "parsed").select("event_id", "parsed.k")


@query("state_round_trip", """
    SELECT CAST(c_nationkey AS VARCHAR) AS project_id, c_name AS look_id, CAST(c_custkey AS INTEGER) AS spread_order, CAST(NULL AS VARCHAR) AS note FROM customer
""")
def state_round_trip(spark, folder):
    path = scratch_folder(spark)
    looks = table(spark, folder, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("look_id"), F.col("c_custkey").alias("spread_order"))
    state.write_state(looks, path, "looks")
    return state.read_state(spark, path, "looks").select("project_id", "look_id", "spread_order", "note")

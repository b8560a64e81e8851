"""Evidence lineage: staleness, cascades, revision history, declared-only changes, output plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bounds import broadcast_if_small
from ..plans.chunks import following, position_chunk
from ..plans.lineage import cut_lineage
from .checks import union_all

# What must be proven again after an input changed.  Only new caption text reaches
# the pages; structure, dates, frames and images keep their proof.
CASCADE = [
    ("caption_map", "map"), ("caption_provenance", "map"), ("caption_data", "map"), ("caption_data", "captions"),
    ("captions", "visual"), ("visual", "release"), ("release", "pdf"),
]


def stale_evidence(evidence: DataFrame, bindings: DataFrame, current: DataFrame, state: DataFrame, project: str = "project") -> DataFrame:
    """Validity of each gate's evidence and whether every gate before it is valid too.

    ``evidence``: project, gate, place (from 0), session_id, nonce, passed, final, master.
    ``bindings``: project, gate, artifact, sha256.  ``current``: project, artifact, sha256.
    ``evidence`` also carries ``armed``, the nonce the gate was last armed with.  ``state``: project, session_id, master.
    """
    gate = [project, "gate"]
    now = current.select(project, "artifact", F.col("sha256").alias("_now"))
    bound = bindings.join(now, [project, "artifact"], "left").groupBy(*gate).agg(F.bool_and(F.col("sha256").eqNullSafe(F.col("_now"))).alias("_fresh"))
    live = state.select(project, F.col("session_id").alias("_session"), F.col("master").alias("_master"))
    valid = (
        F.col("session_id").eqNullSafe(F.col("_session")) & F.coalesce("passed", F.lit(False)) & F.col("nonce").eqNullSafe(F.col("armed"))
        & F.coalesce("_fresh", F.lit(True)) & (~F.col("final") | F.col("master").eqNullSafe(F.col("_master")))
    )
    judged = evidence.join(bound, gate, "left").join(live, project, "left").select(*gate, "place", valid.alias("valid"))
    broken = judged.where(~F.col("valid")).groupBy(project).agg(F.min("place").alias("_broken"))
    return judged.join(broken, project, "left").select(
        *gate, "place", "valid", (F.col("_broken").isNull() | (F.col("place") < F.col("_broken"))).alias("in_passed_prefix")
    )


def cascade_edges(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(CASCADE, "source string, dependent string")


def invalidate(changed: DataFrame, edges: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Everything that depends on the changed nodes, directly or through others: keys, dependent.

    ``edges``: source, dependent.  One join per step of the longest chain of dependents.
    """
    steps = broadcast_if_small(edges.select(F.col("source").alias(node), "dependent").distinct())
    frontier = cut_lineage(changed.select(*keys, node).distinct())
    reached = None
    while True:
        found = frontier.join(steps, node).select(*keys, "dependent").distinct()
        if reached is not None:
            found = found.join(reached, [*keys, "dependent"], "left_anti")
        found = cut_lineage(found)
        if found.isEmpty():
            return found if reached is None else reached
        reached = found if reached is None else cut_lineage(reached.unionByName(found))
        frontier = found.withColumnRenamed("dependent", node)


def changed_inputs(recorded: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded inputs whose hash is no longer the current one (or which are gone)."""
    now = current.select(*keys, F.col("sha256").alias("_now"))
    return recorded.join(now, keys, "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).select(*keys)


def compose_history(revisions: DataFrame, keys: list[str], revision: str, before: str, after: str) -> DataFrame:
    """Cumulative change per key: what it was before the first and after the last revision."""
    return revisions.groupBy(*keys).agg(
        F.min_by(before, revision).alias(before), F.max_by(after, revision).alias(after), F.count("*").alias("revisions")
    )


def history_breaks(revisions: DataFrame, keys: list[str], revision: str, before: str, after: str, chunk_revisions: int = 100_000) -> DataFrame:
    """Revisions that do not start from what the key's previous revision left."""
    start = revisions.withColumn("_start", F.struct(F.col(before), F.col(revision)))
    chained = following(start, keys, position_chunk(F.col(revision), chunk_revisions), [F.col(revision)], "_start", "_next")
    broken = F.col("_next").isNotNull() & ~F.col(after).eqNullSafe(F.col(f"_next.{before}"))
    return chained.where(broken).select(*keys, F.col(f"_next.{revision}").alias(revision))


def diff_declared_only(baseline: DataFrame, actual: DataFrame, declared: DataFrame, keys: list[str], position: str, values: list[str]) -> DataFrame:
    """Keys that changed without being declared, or not as declared.

    Each input is read once and reduced place by place, so no key's rows are gathered.  ``declared``: keys,
    position and values that the declared keys must have afterwards.
    """
    sides = {"b": baseline, "a": actual, "d": declared}

    def tagged(side: str) -> DataFrame:
        row = F.struct(*values)
        return sides[side].select(*keys, position, *[(row if name == side else F.lit(None)).alias(f"_{name}") for name in sides])

    by_place = union_all([tagged(side) for side in sides]).groupBy(*keys, position).agg(*[F.max(f"_{name}").alias(f"_{name}") for name in sides])
    per_key = by_place.groupBy(*keys).agg(
        *[F.bool_or(F.col(f"_{name}").isNotNull()).alias(f"_has_{name}") for name in sides],
        F.bool_or(~F.col("_b").eqNullSafe(F.col("_a"))).alias("_changed"), F.bool_or(~F.col("_d").eqNullSafe(F.col("_a"))).alias("_undone"),
    )
    problem = (
        F.when(~F.col("_has_b") & F.col("_has_a"), "key added").when(F.col("_has_b") & ~F.col("_has_a"), "key lost")
        .when(F.col("_has_d") & F.col("_undone"), "not as declared").when(~F.col("_has_d") & F.col("_changed"), "undeclared change")
    )
    return per_key.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


ATTESTATION = ["sha256", "page_count", "verified_at"]


def reconcile_outputs(plan: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Attested outputs against the files: unchanged, missing or changed; the latter two lose their attestation.

    ``plan``: keys, path, attested, sha256, page_count, verified_at.  ``files``: keys, path, sha256.
    """
    now = files.select(*keys, "path", F.col("sha256").alias("_now"))
    state = (
        F.when(~F.col("attested"), "pending").when(F.col("_now").isNull(), "missing")
        .when(F.col("sha256") == F.col("_now"), "unchanged").otherwise("changed")
    )
    joined = plan.join(now, [*keys, "path"], "left").withColumn("state", state)
    lost = F.col("state").isin("missing", "changed")
    for name in ATTESTATION:
        joined = joined.withColumn(name, F.when(~lost, F.col(name)))
    return joined.withColumn("attested", F.col("attested") & ~lost).drop("_now")


def spec_changes(previous: DataFrame, planned: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Outputs whose planned specification differs from the recorded one, or that only one plan has."""
    old = previous.select(*keys, F.struct(*fields).alias("_old"))
    new = planned.select(*keys, F.struct(*fields).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return old.join(new, keys, "full_outer").select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def draft_merge(draft: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Add edits to a draft: the original ``before`` stays, ``after`` is the newest."""
    new = edits.select(*keys, F.col("before").alias("_before"), F.col("after").alias("_after"), F.lit(True).alias("_edited"))
    return draft.withColumn("_drafted", F.lit(True)).join(new, keys, "full_outer").select(
        *keys, F.when(F.col("_drafted"), F.col("before")).otherwise(F.col("_before")).alias("before"),
        F.when(F.col("_edited"), F.col("_after")).otherwise(F.col("after")).alias("after"),
    )


def status_from_evidence(stages: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Stage status derived from evidence: passed where all of it is present and complete.

    ``stages``: keys, required evidence name.  ``evidence``: project keys, name, complete.
    """
    joined = stages.join(evidence.select(keys[0], F.col("name").alias("required"), "complete"), [keys[0], "required"], "left")
    return joined.groupBy(*keys).agg(
        F.when(F.bool_and(F.coalesce("complete", F.lit(False))), "passed").otherwise("pending").alias("status")
    )


# Files never taken as a project's reference.
REFERENCE_EXCLUDED = "review|10mb|20mb|40mb"


def union_distinct_paths(files: list[DataFrame], keys: list[str], path: str = "path") -> DataFrame:
    """Union of file lists without paths that differ only in case; the least path is kept."""
    return union_all(files).groupBy(*keys, F.lower(path).alias("_folded")).agg(F.min(path).alias(path)).drop("_folded")


def source_inventory(files: DataFrame, projects: DataFrame, role_of: Column, roles: list[str], project: str = "project", path: str = "path") -> DataFrame:
    """Roles that a project does not fill with exactly one file: project, role, found.

    Temporary files and, for references, exported copies do not count.
    """
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    usable = files.withColumn("role", role_of).where(
        F.col("role").isNotNull() & ~name.startswith("~$") & ~((F.col("role") == "reference") & name.rlike(REFERENCE_EXCLUDED))
    )
    counts = union_distinct_paths([usable.select(project, "role", path)], [project, "role"], path).groupBy(project, "role").agg(F.count("*").alias("found"))
    wanted = projects.select(project).distinct().select(project, F.explode(F.array(*[F.lit(role) for role in roles])).alias("role"))
    return wanted.join(counts, [project, "role"], "left").select(project, "role", F.coalesce("found", F.lit(0)).alias("found")).where("found <> 1")

"""Review workflow over tables: swaps, carried-forward maps, guarded updates, attempts, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.chunks import number_rows, position_chunk
from ..plans.components import connected_components
from ..plans.lineage import cut_lineage
from .checks import union_all

CARD = ["excel_sheet", "excel_look_number"]
IDENTITY = ["excel_sheet", "excel_look_number", "excel_image", "left_filename", "right_filename", "evidence_file"]
SWAP_LIMIT = 5
MIN_PROOF_BYTES = 1024


def duplicate_cards(card_map: DataFrame, project: str = "project", look: str = "look_id") -> DataFrame:
    """Looks sharing a logical card, one row per look: project, sheet, number, look, owners."""
    cards = card_map.select(
        project, F.upper(F.trim("excel_sheet")).alias("sheet"), F.trim("excel_look_number").alias("number"), look
    ).where(F.col("sheet").isin("W", "M") & F.col("number").rlike("^[0-9]+$"))
    shared = cards.groupBy(project, "sheet", "number").agg(F.count("*").alias("owners")).where("owners > 1")
    return cards.join(shared, [project, "sheet", "number"])


def conflicting_claims(claims: DataFrame, item: list[str], claimant: str) -> DataFrame:
    """Claims on items that only one claimant wants; all others are dropped, not arbitrated."""
    wanted = claims.groupBy(*item).agg(F.count_distinct(claimant).alias("_n")).where("_n = 1").drop("_n")
    return claims.join(wanted, item, "left_semi")


def closed_swaps(wanted: DataFrame, current: DataFrame, project: str = "project", look: str = "look_id") -> DataFrame:
    """Requests that can be applied together: each wanted card is free or its owner also moves.

    Cards wanted twice and looks that are not PENDING drop out first.  Every remaining look then
    points at its card's owner; following doubled pointers finds, in logarithmically many rounds,
    the chains that end at a look which stays.
    """
    claims = wanted.groupBy(project, *CARD).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    pending = current.where("visual_status = 'PENDING'").select(project, look)
    ready = wanted.join(claims, [project, *CARD], "left_semi").join(pending, [project, look], "left_semi")
    owners = current.select(project, *CARD, F.col(look).alias("_owner"))
    movers = ready.select(project, F.col(look).alias("_owner"), F.lit(True).alias("_moves"))
    state = cut_lineage(
        ready.select(project, look, *CARD).join(owners, [project, *CARD], "left").join(movers, [project, "_owner"], "left")
        .select(
            project, look, *CARD, F.col("_owner").alias("next"),
            F.when(F.col("_owner").isNull(), "free").when(F.col("_moves").isNull(), "stays").alias("end"),
        )
    )
    open_chains = state.where("end is null").count()
    while open_chains:
        ahead = state.select(project, F.col(look).alias("next"), F.col("next").alias("_next"), F.col("end").alias("_end"))
        state = cut_lineage(
            state.join(ahead, [project, "next"], "left")
            .select(
                project, look, *CARD, F.when(F.col("end").isNull(), F.col("_next")).otherwise(F.col("next")).alias("next"),
                F.coalesce("end", "_end").alias("end"),
            )
        )
        still_open = state.where("end is null").count()
        if still_open == open_chains:  # only cycles are left
            break
        open_chains = still_open
    return state.where("end is null or end = 'free'").select(project, look, *CARD)


def swap_components(wanted: DataFrame, current: DataFrame, project: str = "project", look: str = "look_id", limit: int = SWAP_LIMIT) -> DataFrame:
    """Linked groups of requested looks: component, size, error.

    Errors: the wanted card belongs to a look outside the request, or more than ``limit`` looks
    are linked and cannot be confirmed as one batch.
    """
    card = [F.lower("excel_sheet").alias("_sheet"), F.col("excel_look_number").alias("_number")]
    owners = current.select(project, *card, F.col(look).alias("_owner"))
    asked = wanted.select(project, look, *card)
    linked = asked.join(owners, [project, "_sheet", "_number"], "left").where(F.col("_owner").isNotNull() & (F.col("_owner") != F.col(look)))
    inside = linked.join(asked.select(project, F.col(look).alias("_owner")), [project, "_owner"], "left_semi")
    outside = linked.join(asked.select(project, F.col(look).alias("_owner")), [project, "_owner"], "left_anti").select(project, look, F.lit(True).alias("_foreign"))
    node = lambda name: F.to_json(F.struct(F.col(project), F.col(name).alias("look")))
    labels = connected_components(inside.select(node(look).alias("a"), node("_owner").alias("b")), "a", "b")
    named = asked.select(project, look, node(look).alias("node")).join(labels, "node", "left")
    component = F.coalesce("label", "node")
    sizes = named.groupBy(component.alias("component")).agg(F.count("*").alias("size"), F.min(look).alias("first_look"))
    error = F.when(F.col("_foreign"), "owner outside the request").when(F.col("size") > limit, "too many linked looks")
    return (
        named.withColumn("component", component).join(sizes, "component").join(outside, [project, look], "left")
        .select(project, look, "first_look", "size", error.alias("error"))
    )


def swap_ownership_violations(
    current: DataFrame, wanted: DataFrame, alternatives: DataFrame, proofs: DataFrame, index: DataFrame, project: str = "project", look: str = "look_id"
) -> DataFrame:
    """Rules a set of alternative selections must meet before the map may change.

    ``alternatives``: look, card, evidence_file, evidence_sha256.  ``proofs``: name, sha256.
    """
    keys = [project, look]
    pending = current.where("visual_status = 'PENDING'").select(*keys)
    proven = wanted.join(alternatives, [*keys, *CARD])
    hashes = proofs.select(project, F.col("name").alias("evidence_file"), F.col("sha256").alias("_now"))
    changed = proven.join(hashes, [project, "evidence_file"], "left").where(~F.col("_now").eqNullSafe(F.col("evidence_sha256")))
    owner = current.select(project, *CARD, F.col(look).alias("_owner"))
    owned = wanted.join(owner, [project, *CARD])
    stolen = owned.join(wanted.select(project, F.col(look).alias("_owner")), [project, "_owner"], "left_anti")
    after = current.join(wanted, keys, "left_anti").select(*keys, *CARD).unionByName(wanted.select(*keys, *CARD))
    shared = after.groupBy(project, *CARD).count().where("count > 1").drop("count")

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("rule")).distinct()

    return union_all([
        rule(wanted.join(pending, keys, "left_anti"), "not pending"),
        rule(wanted.join(alternatives, [*keys, *CARD], "left_anti"), "no proof of the alternative"),
        rule(changed, "proof changed"),
        rule(stolen, "card owned outside the request"),
        rule(wanted.join(index, [project, *CARD], "left_anti"), "card not in the index"),
        rule(wanted.join(shared, [project, *CARD], "left_semi"), "card would be used twice"),
    ])


def apply_guarded(rows: DataFrame, updates: DataFrame, violations: DataFrame, keys: list[str], values: list[str], project: str = "project") -> DataFrame:
    """Updated rows of every project without a violation; a project with one keeps all its rows."""
    sound = updates.join(violations.select(project).distinct(), project, "left_anti")
    new = sound.select(*keys, F.struct(*values).alias("_new"))
    return rows.join(new, keys, "left").select(
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name) if name in values else F.col(name) for name in rows.columns]
    )


def photo_decision_violations(decisions: DataFrame, slots: DataFrame, files: DataFrame, frozen: DataFrame, project: str = "project") -> DataFrame:
    """Photo recoveries (project, look_id, side, filename, sha256, note) that may not be applied.

    ``slots``: filename now in each slot, blank when open.  ``frozen``: looks that must not change.
    """
    keys = [project, "look_id", "side"]
    now = files.select(project, F.col("name").alias("filename"), F.col("sha256").alias("_now"))
    slot = slots.select(*keys, F.col("filename").alias("_held"))
    used = slots.where(F.trim(F.coalesce("filename", F.lit(""))) != "").select(project, "filename").distinct()
    joined = decisions.join(now, [project, "filename"], "left").join(slot, keys, "left")
    twice = decisions.groupBy(project, "filename").count().where("count > 1").drop("count")

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("rule"))

    return union_all([
        rule(joined.where(~F.col("_now").eqNullSafe(F.col("sha256"))), "photo changed"),
        rule(joined.where(F.char_length(F.trim(F.coalesce("note", F.lit("")))) < 25), "short note"),
        rule(joined.where(F.trim(F.coalesce("_held", F.lit(""))) != ""), "slot not open"),
        rule(decisions.join(used, [project, "filename"], "left_semi"), "photo in use"),
        rule(decisions.join(twice, [project, "filename"], "left_semi"), "photo claimed twice"),
        rule(decisions.join(frozen, [project, "look_id"], "left_semi"), "look frozen"),
    ])


def carry_forward_map(saved: DataFrame, proposal: DataFrame, selections: DataFrame, keys: list[str], mode: str = "check") -> DataFrame:
    """Saved rows against a new proposal: a row holds if it equals the proposal or a recorded selection.

    ``check`` reports drift, ``repair`` replaces drifted rows by the pending proposal, ``resume``
    keeps every saved row.  Adds ``drifted``.
    """
    if mode not in ("check", "repair", "resume"):
        raise ValueError(mode)
    new = proposal.select(*keys, F.struct(*IDENTITY).alias("_new"))
    chosen = selections.select(*keys, F.struct(*IDENTITY[:-1]).alias("_chosen"))
    joined = saved.join(new, keys, "full_outer").join(chosen, keys, "left")
    same = F.struct(*IDENTITY).eqNullSafe(F.col("_new"))
    registered = F.coalesce(F.struct(*IDENTITY[:-1]).eqNullSafe(F.col("_chosen")) & F.col("_chosen").isNotNull(), F.lit(False))
    drifted = ~same & ~registered
    replace = drifted & F.lit(mode == "repair")
    values = [F.when(replace, F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name) for name in IDENTITY]
    return joined.select(
        *keys, *values, F.when(replace, "PENDING").otherwise(F.col("visual_status")).alias("visual_status"), drifted.alias("drifted")
    )


def accumulate_attempts(old: DataFrame, new: DataFrame, look: list[str], card: list[str], order: str = "attempt") -> DataFrame:
    """Attempted cards per look, one row each, at the place they were first tried."""
    last = old.groupBy(*look).agg(F.max(order).alias("_last"))
    appended = new.join(last, look, "left").withColumn(order, F.col(order) + F.coalesce("_last", F.lit(0))).drop("_last")
    return old.select(*look, *card, order).unionByName(appended.select(*look, *card, order)).groupBy(*look, *card).agg(F.min(order).alias(order))


def reserved_cards(pairs: DataFrame, locked: DataFrame, card: list[str]) -> DataFrame:
    return pairs.select(*card).unionByName(locked.select(*card)).distinct()


def replace_partition_rows(rows: DataFrame, fresh: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of all other keys and the new rows of the requested ones."""
    return rows.join(requested.select(*keys), keys, "left_anti").unionByName(fresh.select(rows.columns))


def batches(rows: DataFrame, keys: list[str], position: str, size: int, out: str = "batch", chunk_rows: int = 100_000) -> DataFrame:
    """Fixed-size consecutive batches in the given order, numbered from 0."""
    numbered = number_rows(rows, keys, position_chunk(F.col(position), chunk_rows), [F.col(position)], "_n")
    return numbered.withColumn(out, F.floor((F.col("_n") - 1) / size)).drop("_n")


def restore_frozen(before: DataFrame, after: DataFrame, targets: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """After a targeted change: rows outside the targets take their earlier values back.

    Adds ``restored`` and ``key_change`` (added or removed), which callers treat as a failed run.
    """
    old = before.select(*keys, F.struct(*values).alias("_old"))
    new = after.select(*keys, F.struct(*values).alias("_new"))
    marked = targets.select(*keys).distinct().withColumn("_target", F.lit(True))
    joined = old.join(new, keys, "full_outer").join(marked, keys, "left")
    key_change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
    restored = F.col("_target").isNull() & ~F.col("_old").eqNullSafe(F.col("_new")) & key_change.isNull()
    picked = F.when(restored | F.col("_new").isNull(), F.col("_old")).otherwise(F.col("_new"))
    return joined.select(*keys, *[picked[name].alias(name) for name in values], restored.alias("restored"), key_change.alias("key_change"))


def resume_scope(requests: DataFrame, saved: DataFrame, card_map: DataFrame, project: str = "project", look: str = "look_id") -> DataFrame:
    """Looks still to rematch; a project resumes only if its saved requests are exactly the current ones.

    ``requests`` and ``saved``: project, look, token.  Adds ``resumed``.
    """
    keys = [project, look]
    both = requests.select(*keys, F.col("token").alias("_now")).join(saved.select(*keys, F.col("token").alias("_then")), keys, "full_outer")
    differs = both.where(~F.col("_now").eqNullSafe(F.col("_then"))).select(project).distinct().withColumn("_differs", F.lit(True))
    done = card_map.where("visual_status = 'CONFIRMED'").select(*keys, F.lit(True).alias("_done"))
    marked = requests.join(differs, project, "left").join(done, keys, "left").withColumn("resumed", F.col("_differs").isNull())
    return marked.where(~(F.col("resumed") & F.coalesce("_done", F.lit(False)))).select(*keys, "resumed")


def request_rematch(credits: DataFrame, requests: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Set or clear the rematch flag; a request also clears the manual override."""
    asked = requests.select(*keys, F.col("requested").alias("_asked"))
    joined = credits.join(asked, keys, "left")
    known, on = F.col("_asked").isNotNull(), F.coalesce("_asked", F.lit(False))
    return (
        joined.withColumn("needs_rematch", F.when(known, on.cast("int")).otherwise(F.col("needs_rematch")))
        .withColumn("rematch_requested_at", F.when(on, at).when(known, F.lit(None)).otherwise(F.col("rematch_requested_at")))
        .withColumn("manual_override", F.when(on, 0).otherwise(F.col("manual_override"))).drop("_asked")
    )


def review_queue(pending: DataFrame, cache: DataFrame, decide, inputs: list[str]) -> DataFrame:
    """Cached decisions for pending items, and fresh ones from ``decide`` for the rest.

    ``decide(misses)`` is the caller's provider: it returns ``signature``, ``result`` and
    ``status`` (ok, limit or error) and never fails for a single row, so partial results stay.
    """
    from .joins import cache_lookup

    looked_up = cache_lookup(pending, cache, inputs)
    hits = looked_up.where(F.col("result").isNotNull()).withColumn("status", F.lit("cached"))
    misses = looked_up.where(F.col("result").isNull()).drop("result")
    # Items with one signature are one question: it is asked once, and its first answer serves them all.
    decided = decide(misses.dropDuplicates(["signature"])).select("signature", "result", "status")
    answers = decided.groupBy("signature").agg(F.min(F.struct("status", "result")).alias("_answer")).select("signature", "_answer.result", "_answer.status")
    fresh = misses.join(answers, "signature", "left")
    return hits.unionByName(fresh.withColumn("status", F.coalesce("status", F.lit("error"))))

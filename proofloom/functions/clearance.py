"""Verdicts on the space a caption needs, and corrections of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coverage and largest-component limits, safe-area tolerance, status order.
COLLISION_COVERAGE, COLLISION_COMPONENT = 0.08, 0.006
REVIEW_COVERAGE, REVIEW_COMPONENT = 0.025, 0.0008
SAFE_TOLERANCE, BOUNDS_TOLERANCE = 0.5, 0.5
STATUS_ORDER = ["CLEAR", "REVIEW", "COLLISION", "OVERFLOW"]


def clearance_status(coverage: Column, component: Column | None = None) -> Column:
    """Verdict from total and contiguous foreground; planning passes the coverage alone."""
    largest = coverage if component is None else component
    return (
        F.when((coverage >= COLLISION_COVERAGE) | (largest >= COLLISION_COMPONENT), "COLLISION")
        .when((coverage >= REVIEW_COVERAGE) | (largest >= REVIEW_COMPONENT), "REVIEW")
        .otherwise("CLEAR")
    )


def audited_status(measured: Column, overset: Column, visible: Column, expected: Column, frame: dict[str, Column], safe: dict[str, Column]) -> Column:
    """Missing text overrules every verdict, then a frame outside the safe box does."""
    outside = (
        (frame["top"] < safe["top"] - SAFE_TOLERANCE) | (frame["left"] < safe["left"] - SAFE_TOLERANCE)
        | (frame["bottom"] > safe["bottom"] + SAFE_TOLERANCE) | (frame["right"] > safe["right"] + SAFE_TOLERANCE)
    )
    return F.when(overset | (visible < expected), "OVERFLOW").when(outside, "REVIEW").otherwise(measured)


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in STATUS_ORDER]), status) - 1


def split_plan(shift: Column, baseline: Column, predicted: Column) -> Column:
    """Planned shift when its prediction is clear, else the recorded baseline and unresolved."""
    clear = predicted.eqNullSafe(F.lit("CLEAR"))
    return F.struct(F.when(clear, shift).otherwise(baseline).alias("shift"), (~clear).alias("unresolved"))


def _near(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda a, b: F.abs(a - b) <= BOUNDS_TOLERANCE)
    return (F.size(left) == 4) & (F.size(right) == 4) & F.forall(gaps, lambda near: near)


def prior_bounds(actual: Column, origin: Column, target: Column, prior: Column) -> Column:
    """Prior position to record: none at the target, the actual one when at neither end."""
    return F.when(actual.isNull(), prior).when(_near(actual, target), F.lit(None)).when(~_near(actual, origin), actual).otherwise(prior)


def reliable_bounds(visible: Column, frame: Column, visible_fields: Column, expected_fields: Column) -> Column:
    """Text bounds (top, left, bottom, right), or the frame's when they are impossibly small."""
    height, width = visible[2] - visible[0], visible[3] - visible[1]
    least = lambda floor, extent: F.greatest(F.lit(floor), F.least(extent * 0.5, expected_fields * 1.5))
    degenerate = (expected_fields >= 4) & (visible_fields >= expected_fields) & (
        (height < least(8.0, frame[2] - frame[0])) | (width < least(20.0, frame[3] - frame[1]))
    )
    return F.when(degenerate, frame).otherwise(visible)

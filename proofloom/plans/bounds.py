"""Size checks for what gets broadcast or handed to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting that the side has at most ``rows`` narrow rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

"""Small plan helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lookup tables up to this many rows are broadcast; larger ones are joined
# with a shuffle (AQE may still convert at run time from real sizes).
BROADCAST_MAX_ROWS = 1_000_000


def broadcast_checked(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``small`` only after counting it; otherwise return it as is.

    The table is persisted first so the count and the join read the same rows
    (recomputed from lineage if an executor is lost)."""
    small = small.persist()
    n = small.count()
    return F.broadcast(small) if n <= max_rows else small

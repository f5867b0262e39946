"""Column names, table schemas and argument checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

USER = "personId"
ITEM = "contentId"
VALUE = "result"

# The column names of every input file.
TRIPLET_COLUMNS = ("row", "col", "data")

TRIPLET = T.StructType(
    [
        T.StructField("row", T.StringType()),
        T.StructField("col", T.StringType()),
        T.StructField("data", T.DoubleType()),
    ]
)

RECS = "model string, personId string, rank int, contentId string, score double"


def validate_columns(present: Iterable[str], required: Iterable[str], source: str) -> None:
    """Raise ``ValueError`` naming the required columns that ``source`` lacks."""
    missing = [name for name in required if name not in set(present)]
    if missing:
        raise ValueError(f"{source} lacks the columns {', '.join(missing)}")


def check_k(k: int, name: str = "k") -> int:
    """Reject a non-positive list length or rank."""
    if int(k) != k or k <= 0:
        raise ValueError(f"{name} must be a positive whole number, got {k}")
    return int(k)

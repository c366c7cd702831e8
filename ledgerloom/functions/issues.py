"""Row-local checks that turn into issue rows with one scan."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE_COLUMNS = [
    "kind", "src_row", "row_number", "field_name", "issue_type", "message",
    "actual_value", "entry_id",
]


def _text(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(value).cast("string")


def check(
    failed: Column, issue_type: str, field, message, actual=None, kind: str = "error",
    row_number: Column | None = None,
) -> tuple[Column, Column]:
    """(does the check fail, the issue it yields)."""
    number = F.lit(0) if row_number is None else F.coalesce(row_number, F.lit(0))
    return F.coalesce(failed, F.lit(False)), F.struct(
        F.lit(kind).alias("kind"), number.cast("bigint").alias("row_number"),
        _text(field).alias("field_name"), F.lit(issue_type).alias("issue_type"),
        _text(message).alias("message"), _text(actual).alias("actual_value"))


def any_failed(checks: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a | b, [failed for failed, _ in checks])


def emit(df: DataFrame, checks: list[tuple[Column, Column]], entry_id="entry_id", src_row="src_row") -> DataFrame:
    """The issues of every row. Rows that pass all checks are dropped before any text is built."""
    owner = F.col(entry_id) if isinstance(entry_id, str) else entry_id
    place = F.col(src_row) if isinstance(src_row, str) else src_row
    found = [F.when(failed, issue) for failed, issue in checks]
    rows = df.filter(any_failed(checks)).select(
        place.cast("bigint").alias("src_row"), owner.cast("string").alias("entry_id"),
        (F.explode(F.array(*found)) if len(found) > 1 else found[0]).alias("i"))
    return rows.filter(F.col("i").isNotNull()).select(
        "i.kind", "src_row", "i.row_number", "i.field_name", "i.issue_type", "i.message",
        "i.actual_value", "entry_id")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select(*ISSUE_COLUMNS)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*ISSUE_COLUMNS))
    return out

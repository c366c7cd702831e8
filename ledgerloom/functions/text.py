"""Column expressions for lenient parsing of book-keeping text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space at the ends of a cell.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Format order decides ambiguous dates: file readers read 03/04/2024 month first,
# the row model reads it day first.
_TIME = "[[' ']['T']H:mm[:ss[.SSSSSSSSS]]]"
READER_DATE_FORMATS = (
    f"yyyy-M-d{_TIME}", f"yyyy/M/d{_TIME}", f"yyyy.M.d{_TIME}", "yyyyMMdd", f"M/d/yyyy{_TIME}", f"d/M/yyyy{_TIME}", "M/d/yy", "d/M/yy", "MMM d[','] yyyy", "d MMM yyyy",
)
MODEL_DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy")


def strip(text) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


def parse_date(text: Column, formats=READER_DATE_FORMATS) -> Column:
    """First format that reads the whole text wins; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(strip(text), F.lit(f)) for f in formats])


def to_double(text: Column) -> Column:
    """Number in a text, NULL for anything else."""
    bare = strip(text.cast("string"))
    return F.when(bare.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def to_int(text: Column) -> Column:
    """Whole part of a number in a text ("2024.0" reads 2024)."""
    return to_double(text).try_cast("int")


def truthy(text: Column) -> Column:
    return F.lower(text).isin("true", "yes", "1", "y")


def parse_money(text: Column) -> Column:
    """First signed number after removing thousands separators and currency signs, else 0."""
    bare = F.regexp_replace(strip(text), "[,¥￥]", "")
    found = F.regexp_extract(bare, r"-?[\d.]+", 0)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def account_key(text: Column) -> Column:
    """Numeric account keys lose their decimals ("1100.0" becomes "1100"), others are trimmed."""
    return F.coalesce(to_double(text).try_cast("bigint").cast("string"), strip(text))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN counts as missing everywhere in the books."""
    return df.select(*[
        F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def utf8_audit(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per cell: is the text valid UTF-8, how many bytes, and its lossy re-encoding."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns
    ])).alias("cell")
    return (
        df.select(F.col(key), cells)
        .select(key, "cell.column_name", "cell.value")
        .filter(F.col("value").isNotNull())
        .select(
            key, "column_name",
            F.is_valid_utf8("value").alias("is_valid"),
            F.octet_length("value").cast("bigint").alias("n_bytes"),
            F.char_length("value").cast("bigint").alias("n_chars"),
            F.make_valid_utf8("value").alias("repaired"),
            F.decode(F.encode(F.make_valid_utf8("value"), "UTF-8"), "UTF-8").alias("round_trip"),
        )
    )

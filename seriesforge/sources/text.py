"""Text that holds tables: delimited lines, CSV with quality flags, header cards of fixed width."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.scalars import col, finite


def fields(line, sep: str, names: list[str]) -> Column:
    """A struct of the trimmed fields of a delimited line; blank and missing ones are NULL."""
    parts = F.split(col(line), "\\Q" + sep + "\\E")
    return F.struct(*[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_delimited(spark: SparkSession, path: str, sep: str, required: list[str]) -> DataFrame:
    """A file with a header line; raises if a required column is missing. All columns are strings, blank ones NULL."""
    rows = spark.read.csv(path, sep=sep, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def measured(df: DataFrame, value: str, flag: str | None = None) -> DataFrame:
    """Rows whose value is a number (cast to double). With a flag column, a row whose flag is neither blank nor zero stays, with the flag in
    `note`: that something was flagged is another statement than that nobody looked."""
    out = df.withColumn(value, F.col(value).cast("string").try_cast("double")).where(F.col(value).isNotNull() & ~F.isnan(value))
    if flag is None:
        return out
    text = F.trim(F.coalesce(F.col(flag).cast("string"), F.lit("")))
    return out.withColumn("note", F.when(text.isin("", "0"), "").otherwise(F.concat(F.lit(f"{flag}="), text)))


def observations(df: DataFrame, own_codes: list[str], own_markers: list[str]) -> DataFrame:
    """jd, mag, err, band, observer, is_own, is_limit, note of an observers' database with the columns JD, mag, uncert, band, by, comment,
    fainterThan and obsType, all strings; missing ones count as blank, but for JD and mag, without which this raises.

    Rows whose date or magnitude is no finite number go: nothing is put in their place. A row is one's own by its observer's code or
    by a marker in its comment, in any case.
    """
    if missing := [c for c in ("JD", "mag") if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")
    number = lambda c: finite(text(c).try_cast("double"))
    marked = F.lit(False)
    for m in own_markers:
        marked = marked | F.upper(text("comment")).contains(m.upper())
    own = F.upper(text("by")).isin([c.upper() for c in own_codes]) | marked
    out = df.select(number("JD").alias("jd"), number("mag").alias("mag"), number("uncert").alias("err"), F.coalesce(F.nullif(text("band"), F.lit("")), F.lit("?")).alias("band"), text("by").alias("observer"), own.alias("is_own"), (text("fainterThan") == "1").alias("is_limit"), text("obsType").alias("note"))
    return out.where("jd IS NOT NULL AND mag IS NOT NULL")


def cards(block, width: int = 80) -> Column:
    """array<struct<key, value>> of a header block: eight characters of a key, '= ', a value and perhaps a comment behind a slash.
    Text values lose their quotes ('' inside stands for one); a card without a value sign is left out, and so is all behind END."""
    # Each step is bound to a name of a lambda: a column that is named again would be worked out again, and inside a lambda for each card.
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def split(text: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / width).cast("int") - 1, F.lit(0))), lambda i: F.substring(text, i * width + 1, F.lit(width)))

    def upto_end(all_: Column) -> Column:
        end = F.array_position(F.transform(all_, lambda x: F.rtrim(x)), F.lit("END")).cast("int")
        return F.slice(all_, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(all_)))

    own = F.filter(bound(bound(col(block), split), upto_end), lambda x: F.substring(x, 9, 2) == "= ")

    def value(x: Column) -> Column:
        return bound(F.trim(F.substring(x, 11, width)), plain)

    def plain(rest: Column) -> Column:
        quoted = F.rtrim(F.replace(F.regexp_extract(rest, r"^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'")))
        return F.when(rest.startswith("'"), quoted).otherwise(F.nullif(F.trim(F.split_part(rest, F.lit("/"), F.lit(1))), F.lit("")))

    return F.transform(own, lambda x: F.struct(F.rtrim(F.substring(x, 1, 8)).alias("key"), value(x).alias("value")))


def card(found, key: str) -> Column:
    """The value of the first card of that key in what cards() gave."""
    return F.get(F.filter(col(found), lambda x: x["key"] == key), F.lit(0))["value"]


def is_compressed(found) -> Column:
    return F.coalesce(card(found, "ZIMAGE") == "T", F.lit(False))


def geometry(found) -> tuple[Column, Column]:
    """The image's axes: of a compressed header those of the image, not of the table that holds it. NULL unless both are positive numbers."""
    axis = lambda i: F.when(is_compressed(found), card(found, f"ZNAXIS{i}")).otherwise(card(found, f"NAXIS{i}")).try_cast("int")
    ok = (axis(1) > 0) & (axis(2) > 0)
    return F.when(ok, axis(1)), F.when(ok, axis(2))

"""Column expressions that parse, normalise and print single values.  No Python function runs on rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that the trimming rules know, in ASCII and beyond.
_SPACE = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Spellings of numbers.
_DECIMAL = r"^[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$"
_PREFIXED = {16: r"^0[xX][0-9a-fA-F]+$", 8: r"^0[oO][0-7]+$", 2: r"^0[bB][01]+$"}
_ISO_DAY = r"^\d{4}(-\d{2}(-\d{2}([T ].*)?)?)?$"
#: Cells of the usual kind, which need none of the other rules: digits with thousands commas, and days.
_USUAL_NUMBER = r"^[0-9][0-9,]*(\.[0-9]+)?$"
_USUAL_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_DAY_FORMATS = ["yyyy/M/d", "M/d/yyyy", "MMM d, yyyy"]


def trimmed(col: Column) -> Column:
    """Without white space at the ends, that outside ASCII too."""
    return F.btrim(col, F.lit(_SPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def parse_number(col: Column) -> Column:
    """struct(value, bad) of a cell: commas do not count, blank is null, what is no number is bad."""
    usual = F.coalesce(col.rlike(_USUAL_NUMBER), F.lit(False))
    bare = F.replace(trimmed(F.coalesce(col, F.lit(""))), F.lit(","), F.lit(""))
    text = trimmed(bare)
    value = F.when(bare == "", None).when(text == "", 0.0).when(text.rlike(_DECIMAL), text.try_cast("double"))
    for base, pattern in _PREFIXED.items():
        value = value.when(text.rlike(pattern), F.conv(F.substring(text, 3, 64), base, 10).try_cast("double"))
    bad = F.when(usual, False).otherwise((bare != "") & value.isNull())
    value = F.when(usual, F.replace(col, F.lit(","), F.lit("")).try_cast("double")).otherwise(value)
    return F.struct(value.alias("value"), bad.alias("bad"))


def parse_trade_date(col: Column) -> Column:
    """A UTC instant, or null: ISO spellings, then y/m/d, m/d/y and 'Jan 2, 2026'."""
    text = trimmed(col)
    iso = F.when(text.rlike(_ISO_DAY), text.try_cast("timestamp"))
    usual = F.when(col.rlike(_USUAL_DAY), col.try_cast("timestamp"))
    return F.coalesce(usual, iso, *(F.try_to_timestamp(text, F.lit(f)) for f in _DAY_FORMATS))


def utc_wall_time(col: Column) -> Column:
    """The instant as a time without zone, in UTC whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))


def normalize_email(col: Column) -> Column:
    return F.lower(F.trim(col))


def normalize_symbol(col: Column) -> Column:
    return F.upper(trimmed(col))


def stored_filename(name: Column, epoch_ms: Column) -> Column:
    """<ms>-<base, odd characters as '-'><extension in lower case>.  The base loses the lower-case extension only, so an
    upper-case one stays in it."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    dot = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    extension = F.when(dot == "", ".pdf").otherwise(F.lower(dot))
    cut = F.when(base.endswith(extension) & (base != extension), F.substring(base, F.lit(1), F.length(base) - F.length(extension))).otherwise(base)
    return F.concat(epoch_ms.cast("string"), F.lit("-"), F.regexp_replace(cut, "[^a-zA-Z0-9_-]", "-"), extension)


def number_text(col: Column) -> Column:
    """As a script prints it: whole numbers without '.0'."""
    return F.regexp_replace(col.cast("string"), r"\.0$", "")


def apply_default(col: Column, value) -> Column:
    return F.coalesce(col, F.lit(value))

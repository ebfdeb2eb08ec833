"""Text as columns: tokens, cleaning, chunks, windows and rendering, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    # Splitting at everything else is a good deal faster than extracting the runs.
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), "")


def collapse(text: Column) -> Column:
    """White space (of any kind) as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def corpus_text(title: Column, text: Column) -> Column:
    """Title and text on lines of their own, without white space at the ends."""
    return F.regexp_replace(F.concat_ws("\n", F.coalesce(title, F.lit("")), text), r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of chunks of so many words; the last one is where the tail is reached."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def window_starts(n: Column, width: int, stride: int) -> Column:
    """0, stride, ... and the last full window if these do not reach it; a short series is one window."""
    full = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), F.lit(stride))
    return F.when(n <= width, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(full, F.array(n - width))))


def window_count(n: Column, width: Column | int, stride: Column | int) -> Column:
    return F.when(n <= width, 1).otherwise(1 + F.ceil((n - width) / stride)).cast("long")


def segments(text: Column) -> Column:
    """Parts between . ! ? ; : and line breaks, cleaned, none empty."""
    return F.filter(F.transform(F.split(text, r"[.!?;:\n]"), collapse), lambda s: s != "")


def render_map(m: Column) -> Column:
    """key=value in order of the keys, blank keys and values left out."""
    entries = F.filter(F.transform(F.map_entries(m), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")


def render_fields(fields: dict[str, Column]) -> Column:
    """name: value lines in the given order, blank values left out."""
    parts = [F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, F.concat(F.lit(f"{n}: "), F.trim(c))) for n, c in fields.items()]
    return F.concat_ws("\n", *parts)


def bpe_normalize(text: Column) -> Column:
    """Letters and digits in lower case, all else a space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", " ")


def shortest_number(value: Column) -> Column:
    """A double in the fewest digits that tell it apart; with an exponent (of two digits at least) below 1e-4 and from 1e6 on."""
    plain = F.abs(value).cast("string")
    mantissa, power = F.regexp_extract(plain, r"^([0-9.]+)", 1), F.coalesce(F.nullif(F.regexp_extract(plain, r"E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    joined = F.replace(mantissa, F.lit("."), F.lit(""))
    digits = F.rtrim(F.ltrim(joined, F.lit("0")), F.lit("0"))
    lost = F.length(joined) - F.length(F.ltrim(joined, F.lit("0")))
    point = F.instr(mantissa, ".") - 1 + power - lost  # digits before the point, if the first one isn't zero
    exponent = point - 1
    scientific = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    whole = F.when(point <= 0, "0").otherwise(F.rpad(F.substr(digits, F.lit(1), F.greatest(point, F.lit(0))), F.greatest(point, F.lit(1)), F.lit("0")))
    rest = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substr(digits, point + 1))
    fixed = F.when(F.length(rest) > 0, F.concat(whole, F.lit("."), rest)).otherwise(whole)
    text = F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(fixed)
    return F.when(value == 0, "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), text))

"""Scalar text functions as Column -> Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINGERPRINT = 60
#: Unicode white space; Spark's own \s and trim() know ASCII white space and blanks only.
_SPACE = r"(?U)\s+"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NUMBER_WORD = r"(?i)^[+-]?(inf|infinity|nan)$"


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lowered(c: Column | str) -> Column:
    """The text that words() of operators/arrow.py cuts into the words of tokens()."""
    return F.lower(F.coalesce(_text(c), F.lit("")))


def tokens(c: Column | str) -> Column:
    """Lower-case words, hyphens split, punctuation kept, repeats kept; null gives no words."""
    words = F.split(F.replace(lowered(c), F.lit("-"), F.lit(" ")), _SPACE)
    return F.filter(words, lambda w: w != "")


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def normalized(c: Column | str) -> Column:
    """Lower case, runs of white space one blank, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_text(c), F.lit(""))), _SPACE, " "))


def fingerprint(c: Column | str, length: int = FINGERPRINT) -> Column:
    return F.substring(normalized(c), 1, length)


def categorical(c: Column | str) -> Column:
    """Lower case with letters a-z and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(_text(c), F.lit(""))), "[^a-z0-9]", "")


def slug(c: Column | str) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("root"))


def text_hash(c: Column | str) -> Column:
    return F.sha2(_text(c).cast("binary"), 256)


def number(c: Column | str) -> Column:
    """The number that a string holds (commas dropped), else null."""
    s = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.when(s.rlike(_NUMBER) | s.rlike(_NUMBER_WORD), s.try_cast("double"))


def boolean(c: Column | str) -> Column:
    s = F.lower(strip(c))
    return F.when(s.isin("true", "yes", "1"), F.lit(True)).when(s.isin("false", "no", "0"), F.lit(False))


def partial_date(c: Column | str) -> Column:
    """struct(y, m, d) of strings from the beginning YYYY[-M[M][-D[D]]] of a text, null without a year."""
    s, pattern = strip(c), r"^([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?"
    part = [F.nullif(F.regexp_extract(s, pattern, g), F.lit("")) for g in (1, 2, 3)]
    return F.when(part[0].isNotNull(), F.struct(part[0].alias("y"), part[1].alias("m"), part[2].alias("d")))


def dates_match(a: Column, b: Column) -> Column:
    """Equal years; months, then days, only if both have them."""
    days = a["d"].isNull() | b["d"].isNull() | (a["d"] == b["d"])
    months = a["m"].isNull() | b["m"].isNull() | ((a["m"] == b["m"]) & days)
    return (a["y"] == b["y"]) & F.coalesce(months, F.lit(False))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 if one is a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def section_matches(section: Column, expected: Column) -> Column:
    """The expected path is part of the section's path, or its last part is within one of the section's parts."""
    have, want = normalized(section), normalized(expected)
    last = F.trim(F.element_at(F.split(want, " > "), -1))
    return (want == "") | F.contains(have, want) | F.exists(F.split(have, " > "), lambda part: F.contains(part, last))


def text_matches(text: Column, quote: Column, length: int = FINGERPRINT) -> Column:
    mark = fingerprint(quote, length)
    return (mark != "") & F.contains(normalized(text), mark)


def span_in_chunk(section: Column, text: Column, expected_section: Column, quote: Column) -> Column:
    return section_matches(section, expected_section) & text_matches(text, quote)


def unfenced(c: Column | str) -> Column:
    """Model output without a code fence around it."""
    s = strip(F.coalesce(_text(c), F.lit("")))
    inside = F.regexp_replace(F.regexp_replace(s, "^`+|`+$", ""), "(?i)^json", "")
    return F.when(F.startswith(s, F.lit("```")), strip(inside)).otherwise(s)


def parsed_json(c: Column | str) -> Column:
    """The VARIANT of a whole JSON text, else null; Spark's own parser ignores what follows the first value."""
    mark = "\\u0001end"
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), _text(c), F.lit(f',"{mark}"]'))), "$", "array<variant>")
    whole = (F.size(pair) == 2) & (F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == "\x01end")
    return F.when(whole, F.get(pair, F.lit(0)))


def parsed_object(c: Column | str) -> Column:
    """struct(value VARIANT, error): the JSON object in a model's answer, or why there is none."""
    v = parsed_json(unfenced(c))
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    error = F.when(v.isNull(), F.lit("invalid JSON")).when(~is_object, F.lit("expected a JSON object"))
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def document_of(query_id: Column | str) -> Column:
    return F.substring_index(_text(query_id), "-", 1)


def file_name_of(model: Column | str) -> Column:
    """A model's file name; not one to one, so tables are keyed by the model itself."""
    return F.concat(F.translate(_text(model), ":/", "--"), F.lit(".json"))


def band(score: Column, high: float = 0.9, middle: float = 0.7) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "mid").otherwise("low")


def shown(value: Column) -> Column:
    """A metric with four decimals, "(null)" for null."""
    return F.coalesce(F.format_string("%.4f", value.cast("double")), F.lit("(null)")) if value is not None else F.lit("(null)")

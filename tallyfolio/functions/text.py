"""Text expressions: usable-text gate, normal forms for comparison, name helpers."""
from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# What counts as readable text, and how much of it a document needs.
READABLE = string.ascii_letters + string.digits + " \n\t.,:;/$%#-()&@'\""
MIN_CHARS = 20
MIN_READABLE_SHARE = 0.6

# Three-letter month names to month numbers.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
          "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}

# Fixed value: every character that counts as white space at the ends of a text.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind (plain ``trim`` only knows the blank)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def readable_share(stripped: Column) -> Column:
    """Share of readable characters; null for empty text."""
    rest = F.translate(stripped, READABLE, "")
    size = F.length(stripped)
    return F.when(size > 0, (size - F.length(rest)) / size)


def is_usable_text(text: Column, min_chars: int = MIN_CHARS,
                   min_share: float = MIN_READABLE_SHARE) -> Column:
    """True where a text layer is long and clean enough to be read as text."""
    s = strip(text)
    return F.coalesce((F.length(s) >= min_chars) & (readable_share(s) >= min_share), F.lit(False))


def text_or_fallback(text: Column, ocr_text: Column) -> Column:
    """The text layer, else the recognised text; null where neither has any character."""
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(ocr_text, F.lit("")))


def norm_str(value: Column) -> Column:
    """Lower case, letters digits ``@ .`` only, single blanks; null becomes empty."""
    # A run of anything else, blanks included, becomes one blank.
    return F.coalesce(F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9@.]+", " ")), F.lit(""))


def words_of(norm: Column) -> Column:
    """Distinct words of a normal form; the empty text has none."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))


def tokens(value: Column) -> Column:
    return words_of(norm_str(value))


def norm_currency(value: Column) -> Column:
    """Printed currency to ISO code; unknown ones keep their first three letters."""
    s = F.upper(strip(value))
    letters = F.substring(F.regexp_replace(s, "[^A-Z]", ""), 1, 3)
    return (F.when(value.isNull(), "")
            .when(s.contains("CA") | (s == "C$"), "CAD")
            .when(s.contains("US") | (s == "$"), "USD")
            .when(letters != "", letters)
            .otherwise(s))


def norm_date(value: Column) -> Column:
    """Printed date to ``yyyy-MM-dd`` where one of three shapes is found, else the text itself.

    Shapes in order: ISO, month name with day and year, US numeric. Calendar validity is not
    checked; only the first hit of each shape counts.
    """
    s = F.lower(strip(value))
    # The three shapes.
    iso = F.nullif(F.regexp_extract(s, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))

    named = r"([a-z]{3,})[\p{L}\p{N}_]*\.?\s+(\d{1,2}),?\s+(\d{4})"
    month_of = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(month_of, F.substring(F.regexp_extract(s, named, 1), 1, 3))
    named_date = F.concat(  # null where the month is not one
        F.regexp_extract(s, named, 3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"),
        F.lit("-"), F.lpad(F.regexp_extract(s, named, 2), 2, "0"))

    numeric = r"(\d{1,2})/(\d{1,2})/(\d{2,4})"
    year = F.regexp_extract(s, numeric, 3).try_cast("int")
    numeric_date = F.concat(  # null where there is no such date
        F.lpad(F.when(year < 100, year + 2000).otherwise(year).cast("string"), 4, "0"),
        F.lit("-"), F.lpad(F.regexp_extract(s, numeric, 1), 2, "0"),
        F.lit("-"), F.lpad(F.regexp_extract(s, numeric, 2), 2, "0"))

    return F.coalesce(iso, named_date, numeric_date, s, F.lit(""))


def as_bool(value: Column) -> Column:
    """'true' in any case is true, other text false, null stays null."""
    return F.lower(value) == "true"


def page_number(source: Column) -> Column:
    """Number after the last ``page=`` of a source reference."""
    return F.substring_index(source, "page=", -1).try_cast("int")


def file_stem(path: Column) -> Column:
    """File name without folder and without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def data_uri(content: Column) -> Column:
    """PNG bytes as a data URI (the line breaks of chunked base64 are taken out)."""
    return F.concat(F.lit("data:image/png;base64,"),
                    F.regexp_replace(F.base64(content), r"\r\n", ""))


def quoted_name(name: Column) -> Column:
    """A name in quotes as the trail prints it (double ones around a single quote); absent is None."""
    mark = F.when(name.contains("'") & ~name.contains('"'), '"').otherwise("'")
    body = F.regexp_replace(name, r"\\", r"\\\\")
    body = F.when(name.contains("'") & name.contains('"'), F.replace(body, F.lit("'"), F.lit("\\'"))).otherwise(body)
    return F.coalesce(F.concat(mark, body, mark), F.lit("None"))

"""Expressions over one nested invoice record: conformance, derived tax, reconciliation.

All of them look at a single row, so they need no shuffle whatever the size of the table.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tallyfolio.functions.money import two_decimals
from tallyfolio.schemas import HEADER_MONEY, HEADER_TEXT, INVOICE, ITEM_NUMBERS

# Labels that mark a tax line, as whole words in any case.
TAX_LABELS = ("gst", "hst", "pst", "qst", "tps", "tvq", "vat", "sales tax")
# A given tax this close to the itemised one stands; reconciliation tolerances.
TAX_TOLERANCE = 0.01
ABS_TOLERANCE = 0.02
REL_TOLERANCE = 0.01
# Fixed value: the warning's wording.
WARNING_FORMAT = "line items sum to %s but the total is %s — the extracted amounts may be wrong"

# Numbers may come as text: digits with sign, point, exponent, or a non-finite word.
_NUMERIC_TEXT = r"(?i)\A\s*[+-]?((\d+(_\d+)*)(\.\d*)?|\.\d+)(e[+-]?\d+)?\s*\z|\A\s*[+-]?(inf|infinity|nan)\s*\z"


def is_tax_line(description: Column) -> Column:
    return F.coalesce(
        F.regexp_like(description, F.lit(r"(?i)\b(" + "|".join(TAX_LABELS) + r")\b")), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times inside a lambda body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ------------------------------------------------------------------ amounts of one record

def _sum(items: Column, counts: Callable[[Column], Column] = lambda i: F.lit(True)) -> Column:
    """Sum to the cent, in line order, of the amounts of lines that count; null where there is none.

    One fold over the lines: the list is gone through once, nothing is copied.
    """
    def add(total: Column, i: Column) -> Column:
        return F.when(i["amount"].isNotNull() & counts(i), F.coalesce(total, F.lit(0.0)) + i["amount"]).otherwise(total)

    return F.round(F.aggregate(items, F.lit(None).cast("double"), add), 2)


def line_sum(items: Column) -> Column:
    """Sum of the line amounts to the cent; null where there is none to add."""
    return _sum(items)


def itemised_tax(items: Column) -> Column:
    """Sum of the tax lines to the cent; null where no tax line carries an amount."""
    return _sum(items, lambda i: is_tax_line(i["description"]))


# ------------------------------------------------------------------ rules on plain columns

def derived_tax(given: Column, itemised: Column) -> Column:
    """The itemised tax replaces a given one that differs from it."""
    agrees = F.coalesce(F.abs(given - itemised) <= TAX_TOLERANCE, F.lit(False))
    return F.when(itemised.isNull() | agrees, given).otherwise(itemised)


def mismatch(total: Column, summed: Column, abs_tol: float = ABS_TOLERANCE,
             rel_tol: float = REL_TOLERANCE) -> Column:
    """True where lines and total are both known and apart by more than the tolerance."""
    allowed = F.greatest(F.lit(abs_tol), F.abs(total) * rel_tol)
    return F.coalesce(F.abs(summed - total) > allowed, F.lit(False))


def mismatch_warning(total: Column, summed: Column, abs_tol: float = ABS_TOLERANCE,
                     rel_tol: float = REL_TOLERANCE) -> Column:
    """The warning text, or null where the record is consistent."""
    text = F.format_string(WARNING_FORMAT, two_decimals(summed), two_decimals(total))
    return F.when(mismatch(total, summed, abs_tol, rel_tol), text)


# ------------------------------------------------------------------ rules on a record

def normalize(invoice: Column) -> Column:
    """The record with its tax derived from itemised tax lines where it has any."""
    fixed = invoice.withField("tax", let(
        itemised_tax(invoice["line_items"]), lambda itemised: derived_tax(invoice["tax"], itemised)))
    return F.when(invoice.isNotNull(), fixed)


def reconcile(invoice: Column, abs_tol: float = ABS_TOLERANCE,
              rel_tol: float = REL_TOLERANCE) -> Column:
    """Array of warnings, empty where lines and total agree or cannot be compared."""
    return let(line_sum(invoice["line_items"]), lambda summed: F.array_compact(F.array(
        mismatch_warning(invoice["total"], summed, abs_tol, rel_tol))))


# ------------------------------------------------------------------ schema conformance
#
# Written as SQL text: the checks are many and alike, and one parsed expression is far quicker
# to build than hundreds of column objects. ``doc`` names a VARIANT column.

def _kind(doc: str, path: str) -> str:
    """Type name at a path: VOID for an explicit null, null where the path is absent."""
    return f"schema_of_variant(try_variant_get({doc}, '$.{path}', 'variant'))"


def _text_fault(doc: str, name: str) -> str:
    return f"CASE WHEN {_kind(doc, name)} NOT IN ('STRING', 'VOID') THEN '{name}' END"


def _number_fault(doc: str, name: str) -> str:
    kind = _kind(doc, name)
    as_text = f"try_variant_get({doc}, '$.{name}', 'string')"
    return (f"CASE WHEN coalesce({kind}, 'VOID') RLIKE '^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|BOOLEAN|VOID)$' THEN NULL "
            f"WHEN NOT ({kind} = 'STRING' AND {as_text} RLIKE r'{_NUMERIC_TEXT}') THEN '{name}' END")


def _number(doc: str, name: str) -> str:
    as_text = f"try_variant_get({doc}, '$.{name}', 'string')"
    return (f"coalesce(try_variant_get({doc}, '$.{name}', 'double'), "
            f"try_cast(trim(replace({as_text}, '_', '')) AS DOUBLE))")


def parse_response(response_json: Column) -> Column:
    """Response text as a VARIANT; null where it is empty or not JSON."""
    return F.try_parse_json(response_json)


def response_fault(doc: str) -> Column:
    """Why a parsed response does not fit the record layout; null where it fits.

    Text fields must be text, money fields numeric (or numeric text), lines objects with a
    description. Unknown keys and absent fields are fine. Each field is asked for its own type: that
    is far quicker than the schema of the whole and a pattern over its text.
    """
    item_check = (f"CASE WHEN coalesce({_kind('i', 'description')}, '') = 'STRING' "
                  f"THEN coalesce({', '.join(_number_fault('i', n) for n in ITEM_NUMBERS)}) "
                  "WHEN NOT startswith(schema_of_variant(i), 'OBJECT') THEN 'not an object' ELSE 'description' END")
    checks = ", ".join([*[_text_fault(doc, n) for n in HEADER_TEXT],
                        *[_number_fault(doc, n) for n in HEADER_MONEY]])
    items = f"try_variant_get({doc}, '$.line_items', 'array<variant>')"
    # Only where there is no list of lines does the whole have to be looked at.
    return F.expr(f"""coalesce(
        CASE WHEN {doc} IS NULL THEN 'not JSON' END,
        CASE WHEN {items} IS NULL AND NOT startswith(schema_of_variant({doc}), 'OBJECT') THEN 'not an object' END,
        {checks},
        CASE WHEN {items} IS NULL AND NOT startswith({_kind(doc, 'line_items')}, 'ARRAY') THEN 'line_items' END,
        'line_items: ' || get(filter(transform({items}, i -> {item_check}), f -> f IS NOT NULL), 0))""")


_PLAIN_NUMBER = r"(?:BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT|BOOLEAN|VOID)"


def _plain_layout() -> str:
    """Pattern over ``schema_of_variant`` of a record whose every field has its own type.

    Unknown keys may hold plain values; keys that are no plain words are quoted in the schema, so
    that no key can pass for another. What the pattern leaves out is looked at field by field.
    """
    def one_of(names: tuple[str, ...]) -> str:
        return "(?:" + "|".join(names) + ")"

    def layout(elements: list[str]) -> str:
        any_ = "(?:" + "|".join(elements) + ")"
        return f"OBJECT<(?:{any_}(?:, {any_})*+)?>"

    def other(known: tuple[str, ...]) -> str:
        return rf"(?!{one_of(known)}:)[A-Za-z_]\w*+: (?:STRING|{_PLAIN_NUMBER})"

    item = layout(["description: STRING", f"{one_of(ITEM_NUMBERS)}: {_PLAIN_NUMBER}", other(("description", *ITEM_NUMBERS))])
    return "^" + layout([
        f"{one_of(HEADER_TEXT)}: (?:STRING|VOID)", f"{one_of(HEADER_MONEY)}: {_PLAIN_NUMBER}",
        f"line_items: ARRAY<(?:VOID|{item})>", other((*HEADER_TEXT, *HEADER_MONEY, "line_items"))]) + "$"


PLAIN_LAYOUT = _plain_layout()


def _layout(fields: Sequence[str] | None) -> StructType:
    """The record, or of it ``fields`` and what its amounts are checked by."""
    if fields is None or "line_items" in fields:
        return INVOICE if fields is None else StructType([f for f in INVOICE if f.name in {*fields, "tax", "total"}])
    lines = ArrayType(StructType([f for f in INVOICE["line_items"].dataType.elementType if f.name in ("description", "amount")]))
    return StructType([StructField(f.name, lines) if f.name == "line_items" else f
                       for f in INVOICE if f.name in {*fields, "tax", "total", "line_items"}])


def response_read(doc: str, fields: Sequence[str] | None = None) -> Column:
    """One typed read of a parsed response; what it gives is the record where ``response_is_plain``."""
    return F.expr(f"try_variant_get({doc}, '$', '{_layout(fields).simpleString()}')")


def response_is_plain(doc: str, read: str) -> Column:
    """Whether every field plainly has its own type, so that ``read`` holds the record.

    The schema of the whole says it in one pass, but for lines without a description, which the
    typed read shows.
    """
    return F.expr(f"""coalesce(schema_of_variant({doc}) RLIKE r'{PLAIN_LAYOUT}', false)
        AND NOT coalesce(exists({read}.line_items, i -> i.description IS NULL), false)""")


def plain_invoice(read: str, fields: Sequence[str] | None = None) -> Column:
    """The record of a plain response: absent lines are no lines."""
    kept = ", ".join(f"'{n}', {read}.{n}" if n != "line_items" else f"'{n}', CAST(array() AS {t.simpleString()})"
                     for n, t in ((f.name, f.dataType) for f in _layout(fields)))
    return F.expr(f"CASE WHEN {read}.line_items IS NOT NULL THEN {read} ELSE named_struct({kept}) END")


def response_invoice(doc: str, response: str, fields: Sequence[str] | None = None) -> Column:
    """A parsed response as a typed record; call it only where ``response_fault`` is null.

    One typed read gives the record; where lines are absent, or the text has digits joined by a low
    line, which no cast takes, it is read field by field.
    """
    layout = _layout(fields)
    numbers = ", ".join(f"'{n}', {_number('i', n)}" for n in layout["line_items"].dataType.elementType.names if n in ITEM_NUMBERS)
    items = (f"transform(coalesce(try_variant_get({doc}, '$.line_items', 'array<variant>'), "
             f"CAST(array() AS array<variant>)), i -> named_struct("
             f"'description', try_variant_get(i, '$.description', 'string'), {numbers}))")
    made = []
    for name in layout.names:
        value = (items if name == "line_items" else _number(doc, name) if name in HEADER_MONEY
                 else f"try_variant_get({doc}, '$.{name}', 'string')")
        made.append(f"'{name}', {value}")
    listed = f"try_variant_get({doc}, '$.line_items', 'variant') IS NOT NULL AND NOT {response} RLIKE '[0-9]_[0-9]'"
    return F.expr(f"""coalesce(CASE WHEN {listed} THEN try_variant_get({doc}, '$', '{layout.simpleString()}') END,
        named_struct({', '.join(made)}))""")


def conform(df: DataFrame, response: str, fault: str = "fault", invoice: str = "invoice",
            answered: Column | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """Add ``invoice`` and ``fault`` for a column of response texts; exactly one of them is null.

    Both are null where a row is not ``answered``. A plain record takes one parse, one look at its
    schema and one typed read; others are checked and read field by field. ``fields`` as in
    ``read_calls``: what of the record is read, its layout is checked as a whole.
    """
    answered = F.lit(True) if answered is None else answered
    df = df.withColumn("_doc", F.when(answered, parse_response(F.col(response))))
    df = df.withColumn("_read", response_read("_doc", fields))
    df = df.withColumn("_plain", F.when(answered, response_is_plain("_doc", "_read")))
    df = df.withColumn(fault, F.when(~F.col("_plain"), response_fault("_doc")))
    made = F.when(F.col("_plain"), plain_invoice("_read", fields)).when(
        F.col("_plain").isNotNull() & F.col(fault).isNull(), response_invoice("_doc", response, fields))
    return df.withColumn(invoice, made).drop("_doc", "_read", "_plain")

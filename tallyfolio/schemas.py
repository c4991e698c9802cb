"""Record and table layouts, as Spark types."""
from __future__ import annotations

from pyspark.sql import types as T

STRING, DOUBLE, BOOLEAN, LONG, INT = (
    T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(), T.IntegerType())

LINE_ITEM = T.StructType([
    T.StructField("description", STRING, False),
    T.StructField("quantity", DOUBLE),
    T.StructField("unit_price", DOUBLE),
    T.StructField("amount", DOUBLE),
])

# Field order is the record's own; everything but a line's description may be absent.
HEADER_TEXT = ("invoice_number", "invoice_date", "due_date", "purchase_order", "vendor",
               "bill_to", "currency", "payment_method")
HEADER_MONEY = ("subtotal", "tax", "total")
ITEM_NUMBERS = ("quantity", "unit_price", "amount")

INVOICE = T.StructType([
    T.StructField("invoice_number", STRING),
    T.StructField("invoice_date", STRING),
    T.StructField("due_date", STRING),
    T.StructField("purchase_order", STRING),
    T.StructField("vendor", STRING),
    T.StructField("bill_to", STRING),
    T.StructField("currency", STRING),
    T.StructField("subtotal", DOUBLE),
    T.StructField("tax", DOUBLE),
    T.StructField("total", DOUBLE),
    T.StructField("payment_method", STRING),
    T.StructField("line_items", T.ArrayType(LINE_ITEM)),
])

PENDING, RUNNING, SUCCEEDED, FAILED = "PENDING", "RUNNING", "SUCCEEDED", "FAILED"
STATUSES = (PENDING, RUNNING, SUCCEEDED, FAILED)
TERMINAL = (SUCCEEDED, FAILED)

ATTEMPTS = T.StructType([
    T.StructField("job_id", STRING, False),
    T.StructField("tier", STRING, False),
    T.StructField("purpose", STRING, False),
    T.StructField("attempt_no", INT, False),
    T.StructField("response_json", STRING),
    T.StructField("error_class", STRING),
    T.StructField("error_text", STRING),
    T.StructField("latency_s", DOUBLE),
    T.StructField("tokens_in", LONG),
    T.StructField("tokens_out", LONG),
])

JOBS = T.StructType([
    T.StructField("id", STRING, False),
    T.StructField("status", STRING, False),
    T.StructField("filename", STRING),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("was_scan", BOOLEAN),
    T.StructField("source_path", STRING),
    T.StructField("tier_used", STRING),
    T.StructField("result", INVOICE),
    T.StructField("warnings", T.ArrayType(STRING)),
    T.StructField("error", STRING),
])

AUDIT_EVENTS = T.StructType([
    T.StructField("event_id", STRING, False),
    T.StructField("job_id", STRING, False),
    T.StructField("seq", INT, False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("stage", STRING),
    T.StructField("detail", STRING),
])

GOLD_FILE = T.StructType([
    T.StructField("source", STRING),
    T.StructField("doc_type", STRING),
    T.StructField("notes", STRING),
    T.StructField("invoice", INVOICE),
])

"""The same results in DuckDB's SQL: records, cascade, scoring, text reading."""
from __future__ import annotations

from tallyfolio.plans.oracle_documents import norm_str

TAX_WORDS = r"\b(gst|hst|pst|qst|tps|tvq|vat|sales tax)\b"
WEIGHTS = (("invoice_number", 2), ("total", 2), ("vendor", 1.5), ("tax", 1.5), ("subtotal", 1),
           ("currency", 1), ("invoice_date", 1), ("bill_to", 1), ("payment_method", 1),
           ("due_date", 0.5), ("purchase_order", 0.5))
TEXT_FIELDS = ("invoice_number", "invoice_date", "due_date", "purchase_order", "vendor", "bill_to",
               "currency", "payment_method")


def cents(x: str) -> str:
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || (abs({x}) // 100)::VARCHAR || '.' || "
            f"lpad((abs({x}) % 100)::VARCHAR, 2, '0'))")


def line(desc: str, c: str, qty: str = "NULL", unit: str = "NULL") -> str:
    return (f"{{'d': {desc}, 'a': ({c}) / 100.0::DOUBLE, 'q': ({qty})::DOUBLE, "
            f"'u': ({unit}) / 100.0::DOUBLE}}")


def lines(sign: str, goods: str, again: str = "NULL") -> str:
    return f"""list_filter([{goods},
        CASE WHEN disc_c > 0 THEN {line("'Discount'", f"-{sign} * disc_c")} END,
        CASE WHEN tps_c > 0 THEN {line("'TPS'", f"{sign} * tps_c")} END,
        CASE WHEN tax_c > tps_c THEN {line("tax_label", f"{sign} * (tax_c - tps_c)")} END,
        CASE WHEN tip_c > 0 THEN {line("'Tip'", f"{sign} * tip_c")} END, {again}], lambda x: x IS NOT NULL)"""


def goods_line(sign: str) -> str:
    return line("goods_label", f"{sign} * goods_c", "qty", "(goods_c + qty // 2) // qty")


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm_str(x)}, ' '), lambda w: w <> ''))"


def norm_currency(x: str) -> str:
    s = f"upper(trim({x}))"
    return f"""CASE WHEN {x} IS NULL THEN '' WHEN contains({s}, 'CA') OR {s} = 'C$' THEN 'CAD'
        WHEN contains({s}, 'US') OR {s} = '$' THEN 'USD'
        WHEN regexp_replace({s}, '[^A-Z]', '', 'g') <> '' THEN left(regexp_replace({s}, '[^A-Z]', '', 'g'), 3)
        ELSE {s} END"""


def norm_date(x: str) -> str:
    s = f"lower(trim({x}))"
    named = r"([a-z]{3,})[\p{L}\p{N}_]*\.?\s+(\d{1,2}),?\s+(\d{4})"
    numeric = r"(\d{1,2})/(\d{1,2})/(\d{2,4})"
    month = (f"nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], "
             f"left(regexp_extract({s}, '{named}', 1), 3)), 0)")
    year = f"try_cast(regexp_extract({s}, '{numeric}', 3) AS INT)"
    return rf"""CASE WHEN {x} IS NULL THEN ''
        WHEN regexp_matches({s}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN regexp_extract({s}, '\d{{4}}-\d{{2}}-\d{{2}}')
        WHEN {month} IS NOT NULL THEN regexp_extract({s}, '{named}', 3) || '-' || lpad({month}::VARCHAR, 2, '0')
             || '-' || lpad(regexp_extract({s}, '{named}', 2), 2, '0')
        WHEN {year} IS NOT NULL THEN lpad((CASE WHEN {year} < 100 THEN {year} + 2000 ELSE {year} END)::VARCHAR, 4, '0')
             || '-' || lpad(regexp_extract({s}, '{numeric}', 1), 2, '0')
             || '-' || lpad(regexp_extract({s}, '{numeric}', 2), 2, '0')
        ELSE {s} END"""


def money_eq(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL ELSE abs({a} - {b}) <= 0.01::DOUBLE END)"


def correct(name: str, p: str, g: str, strict: bool = False) -> str:
    if name in ("total", "tax", "subtotal"):
        return money_eq(p, g)
    if name in ("invoice_date", "due_date"):
        return f"(({norm_date(p)}) = ({norm_date(g)}))"
    if name == "currency":
        return f"(({norm_currency(p)}) = ({norm_currency(g)}))"
    np, ng = norm_str(p), norm_str(g)
    if name in ("vendor", "bill_to", "payment_method"):
        extra = f" AND {np} <> ''" if strict else ""
        return (f"(CASE WHEN {ng} = '' THEN {np} = '' ELSE (contains({np}, {ng}) OR contains({ng}, {np}) "
                f"OR list_has_all({tokens(p)}, {tokens(g)})){extra} END)")
    return f"({np} = {ng})"


def worded(items: str) -> str:
    return f"list_transform({items}, lambda i: {{'a': i.a, 'w': {tokens('i.d')}}})"


def greedy(pred: str, gold: str) -> str:
    hit = (f"list_position(list_transform(st.free, lambda gd: {money_eq('pr.a', 'gd.a')} "
           f"AND list_has_any(pr.w, gd.w)), true)")
    return (f"list_reduce({worded(pred)}, lambda st, pr: CASE WHEN coalesce({hit}, 0) = 0 THEN st ELSE "
            f"{{'free': list_filter(st.free, lambda gd, i: i <> {hit}), 'm': st.m + 1}} END, "
            f"{{'free': {worded(gold)}, 'm': 0}}).m")


def amount_sum(items: str, where: str = "true") -> str:
    kept = f"list_filter({items}, lambda i: i.a IS NOT NULL AND {where})"
    return f"CASE WHEN len({kept}) > 0 THEN round(list_sum(list_transform({kept}, lambda i: i.a)), 2) END"


def warning(total: str, summed: str) -> str:
    return (f"CASE WHEN abs({summed} - {total}) > greatest(0.02::DOUBLE, abs({total}) * 0.01::DOUBLE) THEN "
            f"'line items sum to ' || printf('%.2f', {summed}) || ' but the total is ' || printf('%.2f', {total}) "
            f"|| ' — the extracted amounts may be wrong' END")


def taxed(given: str, itemised: str) -> str:
    return (f"CASE WHEN {itemised} IS NULL OR coalesce(abs({given} - {itemised}) <= 0.01::DOUBLE, false) "
            f"THEN {given} ELSE {itemised} END")


IS_TAX = f"regexp_matches(i.d, '{TAX_WORDS}', 'i')"
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def json_fault(j: str) -> str:
    """First field of a JSON text that does not fit; null where all do."""
    def kind(p: str) -> str:
        return f"json_type({j}, '$.{p}')"

    whens = [f"WHEN {kind(n)} NOT IN ('VARCHAR', 'NULL') THEN '{n}'" for n in TEXT_FIELDS]
    whens += [f"WHEN {kind(n)} IN ('ARRAY', 'OBJECT') OR ({kind(n)} = 'VARCHAR' AND NOT "
              f"regexp_matches(json_extract_string({j}, '$.{n}'), '{NUMERIC}')) THEN '{n}'"
              for n in ("subtotal", "tax", "total")]
    return f"""CASE WHEN {j} IS NULL OR NOT json_valid({j}) THEN 'not JSON'
        WHEN json_type({j}) <> 'OBJECT' THEN 'not an object' {' '.join(whens)}
        WHEN {kind('line_items')} <> 'ARRAY' THEN 'line_items'
        WHEN len(list_filter(json_extract({j}, '$.line_items[*]'),
             lambda i: coalesce(json_type(i, '$.description'), '') <> 'VARCHAR')) > 0 THEN 'line_items: description' END"""


def json_record(j: str, fit: str) -> str:
    """Fields of a fitting JSON text as a struct."""
    def number(p: str, of: str = j) -> str:
        return f"json_extract_string({of}, '$.{p}')::DOUBLE"
    return f"""CASE WHEN {fit} THEN {{'number': json_extract_string({j}, '$.invoice_number'),
        'vendor': json_extract_string({j}, '$.vendor'), 'currency': json_extract_string({j}, '$.currency'),
        'tax': {number('tax')}, 'total': {number('total')},
        'items': list_transform(coalesce(json_extract({j}, '$.line_items[*]'), []),
            lambda i: {{'d': json_extract_string(i, '$.description'), 'a': {number('amount', 'i')}}})}} END"""


def response(number: str, mid: str, total: str, items: str) -> str:
    return f"""('{{"invoice_number":' || {number} || {mid} || ',"total":' || {total} || ',"line_items":[' || {items} || ']}}')"""


def quoted(x: str) -> str:
    return f"""coalesce('"' || {x} || '"', 'null')"""


def middle(vendor: str, tax: str, sign: str) -> str:
    return (f"""(',"vendor":' || {quoted(vendor)} || ',"bill_to":' || {quoted('bill_to')} || ',"invoice_date":' || {quoted('printed_date')}"""
            f""" || ',"due_date":' || {quoted('due')} || ',"purchase_order":' || {quoted('po')} || ',"currency":' || {quoted('printed_currency')}"""
            f""" || ',"payment_method":' || {quoted('paid_by')} || ',"subtotal":' || {cents(f'({sign} * net_c)')} || ',"tax":' || {cents(f'({tax})')})""")


def json_line(desc: str, c: str) -> str:
    return f"""('{{"description":"' || {desc} || '","amount":' || {cents(f'({c})')} || '}}')"""


def json_lines(sign: str, goods: str, again: str = "NULL") -> str:
    return f"""concat_ws(',', {goods}, CASE WHEN disc_c > 0 THEN {json_line("'Discount'", f'-{sign} * disc_c')} END,
        CASE WHEN tps_c > 0 THEN {json_line("'TPS'", f'{sign} * tps_c')} END,
        CASE WHEN tax_c > tps_c THEN {json_line('tax_label', f'{sign} * (tax_c - tps_c)')} END,
        CASE WHEN tip_c > 0 THEN {json_line("'Tip'", f'{sign} * tip_c')} END, {again})"""


SIGN = "(CASE WHEN variant = 8 THEN -1 ELSE 1 END)"


def call(tier: str, purpose: str, no: int, text: str = "NULL", cls: str = "NULL", err: str = "NULL") -> str:
    return (f"{{'tier': '{tier}', 'purpose': '{purpose}', 'attempt_no': {no}, 'response': {text}, "
            f"'error_class': {cls}, 'error_text': {err}, 'latency_s': (5 + (k + n + {no}) % 7)::DOUBLE, "
            f"'tokens_in': 1500 + p % 500, 'tokens_out': 400 + s % 200}}")


LIMIT, SLOW, DOWN = ("'rate_limit'", "'rate limit reached'"), ("'timeout'", "'request timed out'"), (
    "'server_error'", "'service unavailable'")

CTES = {
    "bills": """
        SELECT *, concat_ws('-', k, n, p, s, qty, goods_c) AS job_id, (k * 7 + p + n) % 20 AS variant,
               net_c + tax_c + tip_c AS total_c,
               CASE WHEN flag = 'N' THEN tax_c // 3 ELSE 0 END AS tps_c,
               CASE flag WHEN 'A' THEN 'GST (5%)' WHEN 'N' THEN 'TVQ' ELSE 'Sales Tax' END AS tax_label,
               CASE WHEN k % 10 <> 9 THEN concat_ws('-', 'INV', k, n, p, s) END AS number,
               strftime(shipped, '%Y-%m-%d') AS iso_date,
               CASE WHEN p % 4 = 0 THEN strftime(shipped + INTERVAL 30 DAY, '%Y-%m-%d') END AS due,
               CASE WHEN s % 3 = 0 THEN 'PO ' || p END AS po,
               'Supplier#' || lpad(s::VARCHAR, 9, '0') AS vendor, 'Customer of order ' || k AS bill_to,
               CASE k % 3 WHEN 0 THEN 'CAD' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
               CASE k % 3 WHEN 0 THEN 'CA$' WHEN 1 THEN '$' ELSE 'EUR' END AS printed_currency,
               CASE k % 3 WHEN 0 THEN strftime(shipped, '%Y-%m-%d') WHEN 1 THEN strftime(shipped, '%B %-d, %Y')
                    ELSE strftime(shipped, '%-m/%-d/%y') END AS printed_date,
               CASE WHEN n % 2 = 1 THEN 'Visa ending in ' || lpad((k % 10000)::VARCHAR, 4, '0') END AS paid_by,
               'Parts lot ' || p AS goods_label,
               (net_c + tax_c + tip_c) * 105 // 100 + 100 AS off_c
        FROM (SELECT *, (net_c * tax_pct + 50) // 100 AS tax_c, CASE WHEN n = 7 THEN 300 ELSE 0 END AS tip_c
              FROM (SELECT *, goods_c - disc_c AS net_c
                    FROM (SELECT *, (goods_c * disc_pct + 50) // 100 AS disc_c
                          FROM (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s,
                                       l_quantity::BIGINT AS qty, round(l_extendedprice * 100)::BIGINT AS goods_c,
                                       round(l_discount * 100)::BIGINT AS disc_pct,
                                       round(l_tax * 100)::BIGINT AS tax_pct,
                                       l_returnflag AS flag, l_shipdate AS shipped FROM lineitem))))""",
    "readings": f"""
        SELECT job_id, k, n, p, s, variant, shipped, number AS g_invoice_number, iso_date AS g_invoice_date, due AS g_due_date,
               po AS g_purchase_order, vendor AS g_vendor, bill_to AS g_bill_to, currency AS g_currency,
               net_c / 100.0::DOUBLE AS g_subtotal, tax_c / 100.0::DOUBLE AS g_tax, total_c / 100.0::DOUBLE AS g_total,
               paid_by AS g_payment_method, {lines('1', goods_line('1'))} AS g_items,
               CASE WHEN variant = 12 THEN iso_date ELSE number END AS p_invoice_number,
               printed_date AS p_invoice_date, due AS p_due_date, po AS p_purchase_order,
               CASE WHEN variant = 11 THEN '' ELSE upper(vendor) || ', Inc.' END AS p_vendor, bill_to AS p_bill_to,
               printed_currency AS p_currency, {SIGN} * net_c / 100.0::DOUBLE AS p_subtotal,
               CASE WHEN variant = 6 THEN goods_c ELSE {SIGN} * tax_c END / 100.0::DOUBLE AS p_tax,
               CASE WHEN variant IN (0, 1, 7) THEN off_c ELSE {SIGN} * total_c END / 100.0::DOUBLE AS p_total,
               paid_by AS p_payment_method,
               CASE WHEN variant IN (15, 19) THEN [] ELSE {lines(SIGN,
                   f"CASE WHEN variant <> 13 THEN {goods_line(SIGN)} END",
                   f"CASE WHEN variant = 14 THEN {goods_line(SIGN)} END")} END AS p_items
        FROM bills""",
    "matched": f"""
        SELECT *, CASE WHEN n_pred > 0 THEN m / n_pred WHEN n_gold = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prec,
               CASE WHEN n_gold > 0 THEN m / n_gold ELSE 1.0::DOUBLE END AS rec
        FROM (SELECT *, ({greedy('p_items', 'g_items')})::DOUBLE AS m, len(p_items) AS n_pred,
                     len(g_items) AS n_gold FROM readings)""",
    "fscored": "SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0::DOUBLE END AS f1 FROM matched",
    "normed": f"""
        SELECT * REPLACE ({taxed('p_tax', f"({amount_sum('p_items', IS_TAX)})")} AS p_tax) FROM fscored""",
    "checked": "SELECT *, " + ", ".join(
        f"{correct(n, f'p_{n}', f'g_{n}')} AS ok_{n}" for n, _ in WEIGHTS) + " FROM normed",
    "scores": "SELECT *, CASE WHEN variant = 3 THEN 0.0::DOUBLE ELSE round_even((" + " + ".join(
        f"CASE WHEN ok_{n} THEN {w}::DOUBLE ELSE 0 END" for n, w in WEIGHTS) +
        " + 3 * f1) / 16.0::DOUBLE, 4) END AS overall FROM checked",
    "responses": f"""
        SELECT job_id, k, n, p, s, flag, variant,
               CASE variant
                 WHEN 2 THEN {response('num1', 'mid1', "'\"N/A\"'", 'lines1')}
                 WHEN 3 THEN '{{"vendor":5,"total":' || total1 || '}}'
                 WHEN 9 THEN {response('k::VARCHAR', 'mid1', 'total1', 'lines1')}
                 WHEN 10 THEN '{{"invoice_number":' || num1 || mid1
                 WHEN 15 THEN {response('num1', 'mid1', 'total1', "''")}
                 WHEN 16 THEN ''
                 WHEN 17 THEN {response('num1', 'mid1', quoted('total1'), 'lines1')}
                 WHEN 18 THEN {response('num1', 'mid1', 'total1', 'bare')}
                 WHEN 19 THEN '{{"invoice_number":' || num1 || mid1 || ',"confidence":0.9,"total":' || total1 || '}}'
                 ELSE {response('num1', 'mid1', 'total1', 'lines1')} END AS first,
               {response('num', 'mid', 'total2', 'lines2')} AS good, {response('num', 'mid', 'off2', 'lines2')} AS off
        FROM (SELECT *, {quoted("CASE WHEN variant = 12 THEN iso_date ELSE number END")} AS num1, {quoted('number')} AS num,
                     {cents(f"(CASE WHEN variant IN (0, 1, 7) THEN off_c ELSE {SIGN} * total_c END)")} AS total1,
                     {cents('total_c')} AS total2, {cents('off_c')} AS off2,
                     {middle("CASE WHEN variant = 11 THEN '' ELSE upper(vendor) END",
                             f"CASE WHEN variant = 6 THEN goods_c ELSE {SIGN} * tax_c END", SIGN)} AS mid1,
                     {middle('upper(vendor)', 'tax_c', '1')} AS mid,
                     {json_lines(SIGN, f"CASE WHEN variant <> 13 THEN {json_line('goods_label', f'{SIGN} * goods_c')} END",
                                 f"CASE WHEN variant = 14 THEN {json_line('goods_label', f'{SIGN} * goods_c')} END")} AS lines1,
                     {json_lines('1', json_line('goods_label', 'goods_c'))} AS lines2,
                     {json_lines('1', f"('{{\"quantity\":1,\"amount\":' || {cents('goods_c')} || '}}')")} AS bare
              FROM bills)""",
    "attempts": f"""
        SELECT job_id, unnest(list_filter([
            CASE WHEN variant IN (4, 5) THEN {call('tier-1', 'extract', 1, 'NULL', *LIMIT)} ELSE {call('tier-1', 'extract', 1, 'first')} END,
            CASE WHEN variant IN (4, 5) THEN {call('tier-1', 'extract', 2, 'NULL', *SLOW)} END,
            CASE WHEN variant = 4 THEN {call('tier-1', 'extract', 3, 'first')}
                 WHEN variant = 5 THEN {call('tier-1', 'extract', 3, 'NULL', *DOWN)} END,
            CASE WHEN variant IN (2, 9, 18) THEN {call('tier-2', 'extract', 1, 'good')}
                 WHEN variant = 10 THEN {call('tier-2', 'extract', 1, 'off')}
                 WHEN variant = 3 THEN {call('tier-2', 'extract', 1, 'first')}
                 WHEN variant = 16 THEN {call('tier-2', 'extract', 1, 'NULL', *LIMIT)} END,
            CASE WHEN variant = 16 THEN {call('tier-2', 'extract', 2, 'good')} END,
            CASE WHEN variant IN (0, 10, 13) THEN {call('tier-2', 'reconcile', 1, 'good')}
                 WHEN variant = 1 THEN {call('tier-2', 'reconcile', 1, 'off')}
                 WHEN variant = 7 THEN {call('tier-2', 'reconcile', 1, 'NULL', "'bad_request'", "'image input not supported'")}
                 WHEN variant = 14 THEN {call('tier-2', 'reconcile', 1, 'NULL', *SLOW)} END,
            CASE WHEN variant = 14 THEN {call('tier-2', 'reconcile', 2, 'NULL', *LIMIT)} END,
            CASE WHEN variant = 14 THEN {call('tier-2', 'reconcile', 3, 'NULL', *DOWN)} END
        ], lambda x: x IS NOT NULL AND NOT (p % 13 = 5 AND x.tier = 'tier-2') AND NOT (p % 17 = 3 AND x.attempt_no > 1)), recursive := true)
        FROM responses""",
    "deciding": """
        SELECT * FROM (
            SELECT *, coalesce(error_class IN ('connection', 'timeout', 'rate_limit', 'server_error'), false) AS passing,
                   row_number() OVER (PARTITION BY job_id, tier, purpose ORDER BY
                       coalesce(error_class IN ('connection', 'timeout', 'rate_limit', 'server_error'), false),
                       CASE WHEN coalesce(error_class IN ('connection', 'timeout', 'rate_limit', 'server_error'), false)
                            THEN -attempt_no ELSE attempt_no END) AS place
            FROM attempts WHERE attempt_no <= 3) WHERE place = 1""",
    "faulted": f"""
        SELECT *, CASE WHEN error_class IS NULL THEN {json_fault('response')} END AS fault FROM deciding""",
    "conformed": f"""
        SELECT job_id, tier, purpose, error_text, fault, passing AND attempt_no < 3 AS open,
               {json_record('response', 'error_class IS NULL AND fault IS NULL')} AS rec FROM faulted""",
    "extracted": """
        SELECT a.job_id, coalesce(a.rec, CASE WHEN a.fault IS NOT NULL THEN b.rec END) AS rec,
               CASE WHEN a.rec IS NOT NULL THEN 'tier-1' WHEN a.fault IS NOT NULL AND b.rec IS NOT NULL THEN 'tier-2' END AS tier,
               a.fault IS NOT NULL AND b.fault IS NOT NULL AS unfit,
               a.open OR (a.fault IS NOT NULL AND coalesce(b.open, true)) AS waiting,
               CASE WHEN a.rec IS NOT NULL THEN true WHEN a.fault IS NOT NULL THEN false END AS first_fits,
               CASE WHEN a.rec IS NOT NULL OR a.open OR (a.fault IS NOT NULL AND coalesce(b.open, true)) THEN NULL
                    WHEN a.fault IS NULL THEN a.error_text
                    WHEN b.rec IS NOT NULL THEN NULL
                    WHEN b.fault IS NOT NULL THEN 'schema validation failed after escalation: ' || b.fault
                    ELSE coalesce(b.error_text, 'no response recorded') END AS error
        FROM (SELECT * FROM conformed WHERE tier = 'tier-1') a
        LEFT JOIN (SELECT * FROM conformed WHERE tier = 'tier-2' AND purpose = 'extract') b USING (job_id)""",
    "ruled": f"""
        SELECT job_id, purpose, rec, {taxed('rec.tax', f"({amount_sum('rec.items', IS_TAX)})")} AS tax,
               {warning('rec.total', f"({amount_sum('rec.items')})")} AS warn
        FROM (SELECT job_id, 'read' AS purpose, rec FROM extracted WHERE rec IS NOT NULL
              UNION ALL SELECT job_id, 'premium', rec FROM conformed WHERE purpose = 'reconcile' AND rec IS NOT NULL)""",
    "premium_calls": "SELECT job_id, error_text, fault, rec, open FROM conformed WHERE purpose = 'reconcile'",
    "submissions": """
        SELECT job_id, CASE WHEN p % 11 <> 0 THEN 'statement_' || k || '_p' || n || '.pdf' END AS filename,
               flag <> 'R' AS has_text,
               CASE WHEN flag <> 'R' OR p % 50 = 0 THEN 0 ELSE 1 + n % 3 END AS n_images FROM bills""",
    "settled": """
        SELECT s.job_id, s.filename, s.has_text, s.n_images, NOT s.has_text AS was_scan,
               '/documents/' || s.job_id || '/' || coalesce(s.filename, 'document.pdf') AS source_path,
               NOT s.has_text AND s.n_images = 0 AS no_pages,
               CASE WHEN NOT s.has_text AND s.n_images = 0 THEN 'scanned PDF produced no renderable pages'
                    ELSE e.error END AS error,
               e.first_fits, e.waiting OR (r.warn IS NOT NULL AND coalesce(pc.open, true)) AS waiting,
               e.unfit AND NOT (NOT s.has_text AND s.n_images = 0) AS unfit, e.tier AS read_tier,
               r.rec AS read_rec, r.tax AS read_tax, r.warn AS first_warning,
               r.warn IS NOT NULL AND pr.rec IS NOT NULL AND pr.warn IS NULL AS accepted,
               pr.rec AS premium_rec, pr.tax AS premium_tax,
               CASE WHEN r.warn IS NOT NULL AND pr.rec IS NULL THEN
                    coalesce(pc.fault, pc.error_text, 'no response recorded') END AS premium_problem
        FROM submissions s LEFT JOIN extracted e USING (job_id)
        LEFT JOIN (SELECT * FROM ruled WHERE purpose = 'read') r USING (job_id)
        LEFT JOIN (SELECT * FROM ruled WHERE purpose = 'premium') pr USING (job_id)
        LEFT JOIN premium_calls pc USING (job_id)""",
    "outcomes": """
        SELECT job_id, CASE WHEN error IS NOT NULL THEN 'FAILED' WHEN waiting THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status, filename, was_scan,
               source_path, n_images, has_text, no_pages, unfit, error, first_fits,
               CASE WHEN error IS NULL AND NOT waiting THEN CASE WHEN accepted THEN 'tier-2' ELSE read_tier END END AS tier_used,
               CASE WHEN error IS NULL AND NOT waiting THEN CASE WHEN accepted THEN premium_rec ELSE read_rec END END AS rec,
               CASE WHEN error IS NULL AND NOT waiting THEN CASE WHEN accepted THEN premium_tax ELSE read_tax END END AS tax,
               CASE WHEN error IS NULL AND NOT waiting AND NOT accepted THEN first_warning END AS warn,
               CASE WHEN error IS NULL AND NOT waiting THEN first_warning END AS first_warning,
               error IS NULL AND NOT waiting AND accepted AS escalated,
               CASE WHEN error IS NULL AND NOT waiting THEN premium_problem END AS premium_problem FROM settled""",
    "flat_jobs": """
        SELECT job_id, status, coalesce(filename, '') AS filename, was_scan, source_path,
               coalesce(tier_used, '') AS tier_used, coalesce(rec.number, '') AS invoice_number,
               coalesce(rec.currency, '') AS currency, tax, rec.total AS total,
               coalesce(len(rec.items), 0)::BIGINT AS n_items, coalesce(warn, '') AS warnings,
               coalesce(error, '') AS error FROM outcomes""",
    "trail": """
        SELECT job_id, unnest(range(len(events))) AS seq, unnest(events) AS e FROM (
            SELECT job_id, list_filter([
                {'stage': 'RECEIVED', 'detail': 'job created for ' || coalesce('''' || filename || '''', 'None')},
                {'stage': 'RUNNING', 'detail': 'extraction started'},
                {'stage': 'STORED', 'detail': 'raw PDF retained at ' || source_path},
                CASE WHEN NOT no_pages THEN {'stage': 'READ', 'detail': CASE WHEN has_text
                    THEN 'text layer found -> text model'
                    ELSE 'no usable text; ' || n_images || ' page(s) -> vision model' END} END,
                CASE WHEN first_warning IS NOT NULL THEN {'stage': 'RECONCILE_WARNING',
                    'detail': first_warning || '; escalating to tier-2'} END,
                CASE WHEN escalated THEN {'stage': 'ESCALATED', 'detail': 'premium (tier-2) reconciled'}
                     WHEN premium_problem IS NOT NULL THEN {'stage': 'ESCALATION_UNAVAILABLE',
                          'detail': 'premium tier could not re-read: ' || premium_problem} END,
                CASE WHEN warn IS NOT NULL THEN {'stage': 'FLAGGED_FOR_REVIEW', 'detail': warn} END,
                CASE WHEN status = 'SUCCEEDED' THEN {'stage': 'SUCCEEDED', 'detail':
                         coalesce(nullif(rec.number, ''), '(no number)') || ' ' || coalesce(rec.currency, '') || ' '
                         || coalesce(rec.total::VARCHAR, 'None') || ' via ' || tier_used
                         || CASE WHEN warn IS NOT NULL THEN ' [needs review]' ELSE '' END}
                     WHEN unfit THEN {'stage': 'FAILED',
                          'detail': 'unparseable output after re-ask + escalation (quarantined)'}
                     WHEN status = 'FAILED' THEN {'stage': 'FAILED', 'detail': 'error: ' || error} END
            ], lambda x: x IS NOT NULL) AS events FROM outcomes)""",
    "order_lines": """
        SELECT k AS doc_id, net_c AS amount_c, 0 AS tax_line_c, false AS is_tax FROM bills
        UNION ALL SELECT k, tax_c, tax_c, true FROM bills WHERE tax_c > 0""",
    "order_headers": """
        SELECT o_orderkey AS doc_id, round(o_totalprice * 100)::BIGINT / 100.0::DOUBLE AS total,
               CASE WHEN o_orderpriority = '1-URGENT' THEN (round(o_totalprice * 100)::BIGINT // 20) / 100.0::DOUBLE END AS tax
        FROM orders""",
    "line_sums": """
        SELECT doc_id, count(*) AS n_lines, sum(amount_c)::BIGINT / 100.0::DOUBLE AS line_sum,
               (sum(tax_line_c) FILTER (WHERE is_tax))::BIGINT / 100.0::DOUBLE AS itemised
        FROM order_lines GROUP BY doc_id""",
    "printed_facts": """
        SELECT *, format('{:,.2f}', ((goods_c + qty // 2) // qty) / 100.0::DOUBLE) AS unit_text FROM bills""",
}

ORACLE = {
    "reconcile_orders": f"""
        SELECT h.doc_id, h.total, {taxed('h.tax', 'l.itemised')} AS tax, coalesce(l.n_lines, 0) AS n_lines,
               l.line_sum, coalesce({warning('h.total', 'l.line_sum')}, '') AS warning
        FROM order_headers h LEFT JOIN line_sums l USING (doc_id)""",
    "derive_tax": f"""
        SELECT job_id, p_tax AS given, {taxed('p_tax', 'itemised')} AS tax, itemised
        FROM (SELECT job_id, p_tax, {amount_sum('p_items', IS_TAX)} AS itemised FROM readings)""",
    "reconcile_records": f"""
        SELECT job_id, line_sum, coalesce({warning('p_total', 'line_sum')}, '') AS warning
        FROM (SELECT job_id, p_total, {amount_sum('p_items')} AS line_sum FROM readings)""",
    "schema_conformance": f"""
        SELECT job_id, coalesce(fault, '') AS fault, rec.total AS total, rec.tax AS tax, coalesce(rec.vendor, '') AS vendor,
               coalesce(len(rec.items), -1)::BIGINT AS n_items, {amount_sum('rec.items')} AS line_sum
        FROM (SELECT job_id, fault, {json_record('first', 'fault IS NULL')} AS rec
              FROM (SELECT job_id, first, {json_fault('first')} AS fault FROM responses))""",
    "retry_policy": """
        SELECT job_id, tier, purpose, attempt_no::BIGINT AS attempt_no,
               CASE WHEN error_class IS NULL THEN 'answered' WHEN passing THEN 'exhausted' ELSE 'failed' END AS outcome,
               coalesce(error_text, '') AS error_text, coalesce(length(response), -1)::BIGINT AS n_chars FROM deciding""",
    "extraction_escalation": """
        SELECT job_id, coalesce(tier, '') AS tier, coalesce(error, '') AS error, rec.total AS total,
               coalesce(rec.number, '') AS invoice_number FROM extracted""",
    "job_outcomes": "SELECT * FROM flat_jobs",
    "review_queue": "SELECT * FROM flat_jobs WHERE warnings <> ''",
    "quarantine": "SELECT job_id, error FROM outcomes WHERE status = 'FAILED'",
    "audit_trail": """
        SELECT sha256(job_id || '|' || e.stage || '|' || seq) AS event_id, job_id, seq::BIGINT AS seq, e.stage AS stage, e.detail AS detail FROM trail""",
    "normal_forms": f"""
        SELECT job_id, {norm_str('p_vendor')} AS vendor, {norm_str('p_payment_method')} AS paid,
               {norm_currency('p_currency')} AS currency, {norm_date('p_invoice_date')} AS date,
               {norm_date('p_due_date')} AS due FROM readings""",
    "field_checks": "SELECT job_id, " + ", ".join(
        f"{correct(n, f'p_{n}', f'g_{n}')} AS {n}" for n, _ in WEIGHTS) +
        f", {correct('vendor', 'p_vendor', 'g_vendor', True)} AS vendor_strict FROM readings",
    "item_matching": """
        SELECT job_id, m::BIGINT AS matched, round_even(prec, 3) AS precision, round_even(rec, 3) AS recall,
               round_even(f1, 3) AS f1 FROM fscored""",
    "text_line_matching": f"""
        SELECT doc_id, len(items)::BIGINT AS n_items, ({greedy('list_reverse(items)', 'items')})::BIGINT AS matched
        FROM (SELECT doc_id, list_transform(string_split(text, chr(10)),
                  lambda x: {{'d': x, 'a': (length(x) // 40)::DOUBLE}}) AS items FROM documents)""",
    "prediction_scores": """
        SELECT job_id, overall AS metric, CASE WHEN variant = 3 THEN 0.0::DOUBLE ELSE round_even(f1, 3) END AS f1,
               CASE WHEN variant = 3 THEN 0 ELSE """ + " + ".join(f"ok_{n}::INT" for n, _ in WEIGHTS) + """ END::BIGINT AS n_correct
        FROM scores""",
    "field_accuracy": " UNION ALL ".join(
        f"SELECT '{n}' AS field, count(*) AS n_docs, sum(ok_{n}::INT)::BIGINT AS n_correct, "
        f"round_even(sum(ok_{n}::INT) / count(*), 4) AS accuracy FROM checked WHERE variant <> 3" for n, _ in WEIGHTS),
    "text_reading": """
        SELECT job_id, coalesce(number, '') AS invoice_number, printed_date AS invoice_date, coalesce(due, '') AS due_date,
               coalesce(po, '') AS purchase_order, vendor, bill_to, currency, coalesce(paid_by, '') AS payment_method,
               net_c / 100.0::DOUBLE AS subtotal, CASE WHEN tax_c > 0 THEN tax_c / 100.0::DOUBLE END AS tax,
               total_c / 100.0::DOUBLE AS total,
               (1 + (disc_c > 0)::INT + (tps_c > 0)::INT + (tax_c > tps_c)::INT + (tip_c > 0)::INT)::BIGINT AS n_items,
               total_c / 100.0::DOUBLE AS line_sum, qty::DOUBLE AS quantity,
               replace(unit_text, ',', '')::DOUBLE AS unit_price
        FROM printed_facts""",
    "text_reading_scores": """
        SELECT overall, count(*) AS n_docs FROM (
            -- lost points: a tax of nothing is not printed; two-digit years are read as 20xx
            SELECT round_even((16 - CASE WHEN tax_c = 0 THEN 1.5::DOUBLE ELSE 0 END
                - CASE WHEN k % 3 = 2 AND year(shipped) < 2000 THEN 1 ELSE 0 END) / 16.0::DOUBLE, 4) AS overall FROM bills)
        GROUP BY overall""",
    "live_cascade": """
        SELECT job_id, tier, purpose, 1::BIGINT AS attempt_no,
               CASE WHEN n % 11 = 0 THEN '' WHEN tier = 'tier-1'
                    THEN '{"total": ' || n || ', "line_items": [{"description": "x", "amount": 1}]}'
                    ELSE '{"total": ' || n || ', "line_items": [{"description": "x", "amount": ' || n || '}]}' END AS response,
               CASE WHEN n % 11 = 0 THEN 'cannot read this' ELSE '' END AS error_text
        FROM (SELECT doc_id::VARCHAR AS job_id, length(coalesce(text, '')) AS n FROM documents),
             (VALUES ('tier-1', 'extract'), ('tier-2', 'reconcile')) t(tier, purpose)
        WHERE tier = 'tier-1' OR (n % 11 <> 0 AND n <> 1)""",
    "model_calls": """
        WITH sized AS (SELECT doc_id::VARCHAR AS job_id, length('document ' || doc_id || chr(10) || text) AS n FROM documents),
        tried AS (SELECT job_id, n, unnest(range(1, 4)) AS attempt_no,
                         CASE WHEN n % 5 = 0 THEN 1 + n % 4 ELSE 0 END AS fails FROM sized)
        SELECT job_id, attempt_no, 
               CASE WHEN attempt_no > fails AND n % 7 <> 0 THEN '{"total": ' || n || '}' ELSE '' END AS response,
               CASE WHEN attempt_no <= fails THEN 'timeout' WHEN n % 7 = 0 THEN 'bad_request' ELSE '' END AS error_class,
               CASE WHEN attempt_no <= fails THEN 'request timed out'
                    WHEN n % 7 = 0 THEN 'cannot read ' || n || ' characters' ELSE '' END AS error_text,
               CASE WHEN attempt_no > fails AND n % 7 <> 0 THEN n ELSE 0 END::BIGINT AS tokens_in
        FROM tried WHERE attempt_no <= least(3, fails + 1)""",
}

"""The same results in DuckDB's SQL: documents, pages, words."""
from __future__ import annotations

# Fixed values, once more for the other engine: the readable characters as a class.
NOT_READABLE = r"""[^A-Za-z0-9 \n\t.,:;/$%#()&@''"-]"""


def norm_str(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({x}), '[^a-z0-9@. ]+', ' ', 'g').regexp_replace(' +', ' ', 'g')), '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+$', '', 'g')"


def usable(x: str, share: float) -> str:
    s = strip(x)
    return (f"coalesce(length({s}) >= 20 AND length(regexp_replace({s}, '{NOT_READABLE}', '', 'g'))"
            f" >= {share} * length({s}), false)")


FILE = """CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'scan' || doc_id
    ELSE 'batch.v2_' || doc_id || '.pdf' END"""

CTES = {
    "doc_pages": f"""
        SELECT doc_id, {FILE} AS filename, u.i - 1 AS page_index, u.line AS line,
               least(1.0::DOUBLE, length(u.line) / 200.0::DOUBLE) AS ink
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d,
             LATERAL (SELECT unnest(d.lines) AS line, generate_subscripts(d.lines, 1) AS i) u""",
    "page_choice": """
        SELECT *, max(ink) OVER (PARTITION BY doc_id) AS top,
               sum((ink >= 0.01)::INT) OVER (PARTITION BY doc_id) AS n_content,
               sum((ink > 0.002)::INT) OVER (PARTITION BY doc_id) AS n_inked,
               row_number() OVER (PARTITION BY doc_id ORDER BY ink DESC, page_index) AS rn
        FROM doc_pages""",
    "kept_pages": """
        SELECT *, greatest(n_content, 1) AS n_invoices,
               CASE WHEN greatest(n_content, 1) = 1 THEN coalesce(filename, 'document.pdf')
                    WHEN filename IS NULL THEN 'document_p' || page_index || '.pdf'
                    WHEN filename LIKE '%.pdf' THEN left(filename, length(filename) - 4) || '_p' || page_index || '.pdf'
                    ELSE filename || '_p' || page_index || '.' || filename END AS page_name
        FROM page_choice WHERE ink >= 0.01 OR (n_content = 0 AND rn = 1)""",
    "layered": f"""
        SELECT doc_id, text AS original,
               CASE WHEN doc_id % 10 = 0 THEN regexp_replace(text, '[A-Za-z]', chr(1), 'g')
                    WHEN doc_id % 10 IN (1, 2) THEN NULL ELSE text END AS text
        FROM documents""",
    "routed": f"""
        SELECT l.doc_id, l.text, {usable('l.text', 0.6)} AS has_text, i.n_images, i.densest, i.line
        FROM layered l LEFT JOIN (
            SELECT doc_id, count(*) AS n_images, arg_min(page_index, rn) AS densest, arg_min(line, rn) AS line
            FROM page_choice WHERE doc_id % 10 <> 2 AND (ink > 0.002 OR (n_inked = 0 AND rn = 1))
            GROUP BY doc_id) i USING (doc_id)""",
    "ocr_words": """
        SELECT doc_id, CASE WHEN raw < 0 THEN raw WHEN doc_id % 6 = 0 THEN raw // 3
                            ELSE least(100, raw + 60) END AS conf
        FROM (SELECT doc_id, (doc_id * 31 + (unnest(range(len(string_split(text, ' '))))) * 17) % 101 - 1 AS raw
              FROM documents)""",
    "confidence": """
        SELECT doc_id, coalesce(avg(conf) FILTER (WHERE conf >= 0), 0.0) AS mean_conf
        FROM ocr_words GROUP BY doc_id""",
}

ORACLE = {
    "document_intake": """
        SELECT doc_id, CASE WHEN n_chars < 20 THEN 'empty file'
                 WHEN source = 'src7' THEN 'could not read PDF: text is not UTF-8' ELSE '' END AS reject_reason,
               CASE WHEN n_chars < 20 THEN 0 WHEN source = 'src7' THEN strlen(text) + 1
                    ELSE strlen(text) END::BIGINT AS n_bytes
        FROM documents""",
    "text_gate": f"""
        SELECT doc_id, {usable('text', 0.6)} AS usable, {usable('text', 0.8)} AS usable_strict,
               length(regexp_replace({strip('text')}, '{NOT_READABLE}', '', 'g'))::BIGINT AS n_readable
        FROM documents""",
    "reader_routing": """
        SELECT doc_id, CASE WHEN has_text THEN 'text' WHEN n_images > 0 THEN 'vision' ELSE 'none' END AS reader,
               NOT has_text AS was_scan,
               CASE WHEN has_text THEN 0 ELSE coalesce(n_images, 0) END::BIGINT AS n_images,
               CASE WHEN has_text THEN -1 ELSE coalesce(densest, -1) END::BIGINT AS densest_page,
               CASE WHEN has_text OR n_images > 0 THEN ''
                    ELSE 'scanned PDF produced no renderable pages' END AS route_error
        FROM routed""",
    "vision_inputs": """
        SELECT doc_id, CASE WHEN has_text THEN 'text' ELSE 'vision' END AS reader,
               sha256(CASE WHEN has_text THEN text
                           ELSE 'data:image/png;base64,' || to_base64(encode(line)) END) AS input_sha
        FROM routed WHERE has_text OR n_images > 0""",
    "split_documents": """
        SELECT doc_id, page_index::BIGINT AS page_index, page_name, n_invoices::BIGINT AS n_invoices,
               sha256(doc_id || '#' || page_index) AS job_id, length(line)::BIGINT AS n_chars
        FROM kept_pages""",
    "ingest_summary": """
        SELECT doc_id, coalesce(any_value(filename), '') AS document, count(*) AS invoices,
               string_agg(page_name, '|' ORDER BY page_index) AS job_files
        FROM kept_pages GROUP BY doc_id""",
    "split_page_rows": """
        SELECT doc_id, page_index, ink, greatest(n_content, 1)::BIGINT AS n_invoices FROM (
            SELECT *, sum((ink >= 0.5)::INT) OVER (PARTITION BY doc_id) AS n_content,
                   row_number() OVER (PARTITION BY doc_id ORDER BY ink DESC, page_index) AS rn
            FROM (SELECT conv_id AS doc_id, turn AS page_index,
                         least(1.0::DOUBLE, length(text) / 400.0::DOUBLE) AS ink FROM conversations))
        WHERE ink >= 0.5 OR (n_content = 0 AND rn = 1)""",
    "vision_pages": """
        SELECT doc_id, string_agg(page_index::VARCHAR, ',' ORDER BY rn) AS page_order
        FROM page_choice WHERE ink > 0.002 OR (n_inked = 0 AND rn = 1) GROUP BY doc_id""",
    "joined_text": "SELECT doc_id, sha256(text) AS text_sha FROM documents",
    "page_ink": r"""
        SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE -
                 length(regexp_replace(text, '[^ \nÿ]', '', 'g'))::DOUBLE / length(text) END AS ink,
               length(text)::BIGINT AS n_bytes
        FROM documents""",
    "ocr_confidence": """
        SELECT doc_id, round_even(mean_conf, 6) AS mean_conf,
               CASE WHEN mean_conf >= 70 THEN 'ocr' ELSE 'vlm' END AS path FROM confidence""",
    "text_source": """
        SELECT doc_id, doc_id % 5 = 2 AS skipped,
               sha256(CASE doc_id % 5 WHEN 0 THEN 'ocr: ' || text WHEN 1 THEN 'ocr: ' || text WHEN 2 THEN ''
                      ELSE text END) AS text_sha
        FROM documents""",
    "retained_paths": f"""
        SELECT doc_id, '/documents/job-' || doc_id || '/' || coalesce({FILE}, 'document.pdf') AS path
        FROM documents""",
    "normalized_text": f"SELECT doc_id, sha256({norm_str('text')}) AS norm_sha FROM documents",
    "encoded_pages": """
        SELECT page_id, sha256('data:image/png;base64,' || to_base64(encode(html))) AS uri_sha FROM pages""",
    "source_names": r"""
        SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*', ''), '[^/]*$'),
                                       '(.)\.[^.]*$', '\1') AS stem,
               coalesce(try_cast(list_last(string_split(regexp_replace(url, '[&#].*', ''), 'page=')) AS INT), -1)::BIGINT AS page
        FROM pages""",
}

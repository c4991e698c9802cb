"""The same results in DuckDB's SQL: whole documents, parties, links, vectors."""
from __future__ import annotations

from tallyfolio.operators.intake import REDACTIONS, UNKNOWN
from tallyfolio.operators.linking import LEAST, LONG
from tallyfolio.operators.parties import LEGAL_FORMS
from tallyfolio.plans.ladder import CHUNK_WORDS, SIGNALS, THRESHOLD


def redacted(text: str) -> str:
    for name, pattern in REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '[{name}]', 'g')"
    return text


def hits(i: int) -> str:
    return f"least(h{i}, {SIGNALS[i].most})"


KINDS = list(dict.fromkeys(s.kind for s in SIGNALS))
COUNTS = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{s.pattern}')) AS h{i}" for i, s in enumerate(SIGNALS))
SCORES = {k: "(" + " + ".join(f"{s.weight} * {hits(i)}" for i, s in enumerate(SIGNALS) if s.kind == k) + ")" for k in KINDS}
TOP = f"greatest({', '.join(SCORES.values())})"
FIRED = ", ".join(f"CASE WHEN h{i} > 0 THEN '{s.name}' END" for i, s in enumerate(SIGNALS))
PARTY = (f"trim(regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9#]+', ' ', 'g')), '( ({'|'.join(LEGAL_FORMS)}))+$', '', 'g'))")

CTES = {
    "asked": "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0",
    "neighbours": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank
            FROM (SELECT query_id, vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS similarity
                  FROM embeddings, asked)) WHERE rank <= 5""",
    "party_rows": f"""
        SELECT name, {PARTY} AS party_key FROM (
            SELECT DISTINCT unnest([vendor, upper(vendor) || ', Inc.', vendor || ' Corp.']) AS name FROM bills)""",
}

ORACLE = {
    "redacted_documents": f"""
        SELECT doc_id, md5(clean) AS digest, length(clean) AS n_chars, clean <> text AS changed
        FROM (SELECT doc_id, text, {redacted('text')} AS clean FROM documents)""",
    "resubmitted_documents": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n_copies,
               doc_id <> min(doc_id) OVER (PARTITION BY text) AS resubmitted
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "document_kinds": f"""
        SELECT doc_id, CASE WHEN top < {THRESHOLD} THEN '{UNKNOWN}' {' '.join(f"WHEN {SCORES[k]} = top THEN '{k}'" for k in KINDS)} END AS kind,
               top AS score, concat_ws(', ', {FIRED}) AS fired
        FROM (SELECT *, {TOP}::BIGINT AS top FROM (SELECT doc_id, {COUNTS} FROM documents))""",
    "document_chunks": f"""
        SELECT doc_id, source, lang, page, chunk, md5(array_to_string(w[chunk * {CHUNK_WORDS} + 1 : (chunk + 1) * {CHUNK_WORDS}], ' ')) AS digest
        FROM (SELECT *, unnest(range(0, (len(w) - 1) // {CHUNK_WORDS} + 1)) AS chunk
              FROM (SELECT doc_id, source, lang, page - 1 AS page, list_filter(string_split(line, ' '), lambda x: x <> '') AS w
                    FROM (SELECT doc_id, source, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS page
                          FROM (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))
              WHERE len(w) > 0)""",
    "party_names": """
        SELECT name, party_key, min(name) OVER (PARTITION BY party_key) AS canonical,
               count(*) OVER (PARTITION BY party_key) AS n_names FROM party_rows""",
    "linked_documents": """
        SELECT * FROM (SELECT job_id AS doc_id, po, min(job_id) OVER (PARTITION BY po) AS first_doc,
                              count(*) OVER (PARTITION BY po) AS n_docs FROM bills WHERE po IS NOT NULL) WHERE n_docs > 1""",
    "linked_groups": """
        SELECT * FROM (WITH RECURSIVE lines AS (
            SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
        held AS (SELECT DISTINCT doc_id, key FROM (
            SELECT doc_id, unnest(['f' || md5(ls[1]), 'l' || md5(ls[-1])]) AS key FROM lines) WHERE key IS NOT NULL),
        tops AS (SELECT key, min(doc_id) AS top, count(*) AS n FROM held GROUP BY key HAVING count(*) > 1),
        pairs AS (SELECT doc_id AS a, top AS b FROM held JOIN tops USING (key) UNION SELECT top, doc_id FROM held JOIN tops USING (key)),
        reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
        named AS (SELECT a AS doc_id, min(b) AS group_id FROM reach GROUP BY a),
        counted AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_links FROM held JOIN tops USING (key) GROUP BY doc_id)
        SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS n_docs, coalesce(n_links, 0) AS n_links
        FROM named LEFT JOIN counted USING (doc_id))""",
    "similar_parties": f"""
        SELECT * FROM (WITH RECURSIVE spelt AS (
            SELECT name, {PARTY} AS party_key FROM (SELECT DISTINCT unnest([vendor, left(vendor, 2) || substr(vendor, 4),
                replace(vendor, 'lier', 'liar') || ' Inc.']) AS name FROM bills)),
        ks AS (SELECT DISTINCT party_key AS k, regexp_replace(party_key, '[^0-9]', '', 'g') AS digits FROM spelt),
        pairs AS (SELECT a.k AS a, b.k AS b FROM ks a JOIN ks b ON a.digits = b.digits AND a.k <> b.k
                  AND levenshtein(a.k, b.k) <= CASE WHEN least(length(a.k), length(b.k)) < {LEAST} THEN 0
                                                    WHEN least(length(a.k), length(b.k)) < {LONG} THEN 1 ELSE 2 END),
        reach AS (SELECT k AS a, k AS b FROM ks UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
        named AS (SELECT a AS party_key, min(b) AS root FROM reach GROUP BY a)
        SELECT name, party_key, min(name) OVER (PARTITION BY root) AS canonical, count(*) OVER (PARTITION BY root) AS n_names
        FROM spelt JOIN named USING (party_key))""",
    "near_vectors": "SELECT query_id, rank, vec_id, label, round(similarity, 6) AS similarity FROM neighbours",
    "indexed_vectors": "SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM neighbours",
    "near_vector_votes": """
        SELECT query_id, label, votes FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS place
            FROM (SELECT query_id, label, count(*) AS votes FROM neighbours GROUP BY ALL)) WHERE place = 1""",
    "prediction_label_join": """
        SELECT CASE WHEN variant IN (3, 5) THEN 'label only' WHEN n = 6 THEN 'prediction only' ELSE 'both' END AS state, count(*) AS n_docs,
               round_even(sum(CASE WHEN variant NOT IN (3, 5) AND n <> 6 THEN overall::DECIMAL(20, 4) END)::DOUBLE
                          / nullif(count(*) FILTER (WHERE variant NOT IN (3, 5) AND n <> 6), 0), 4) AS overall
        FROM scores WHERE NOT (variant IN (3, 5) AND n = 6) GROUP BY 1""",
}

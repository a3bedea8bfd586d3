"""SQL for DuckDB that says what the registered queries should return."""

from __future__ import annotations

from codexlake.catalog import BM25_K, CASE_HEADS, CONTEXT, DENSE_K, HYBRID_K, PHRASES, RERANK_K
from codexlake.corpora import ASKED_FROM, ASKED_LINES, DOCUMENT_PARTS, LITERAL, STATUTE_LINE, STATUTE_PAGE
from codexlake.functions import metadata, query_text
from codexlake.functions.text import EMBEDDING_LABELS, STOP_WORDS, TOKEN
from codexlake.operators import evidence, fusion, lexical, vectors
from codexlake.operators.structure import BOUNDARIES, CLEARED_BY, PATTERNS, STICKY


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern without Java's Unicode flag, which RE2 does not know."""
    return pattern.replace("(?iuU)", "(?i)").replace("(?iU)", "(?i)").replace("(?U)", "")


#: Letters beyond ASCII, which are parts of words to Java and not to RE2.
LETTER = r"\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"


def plain(text: str) -> str:
    """A text whose words with such letters are one mark each, so that they are no words to RE2 either."""
    return f"regexp_replace({text}, '[0-9A-Za-z_]*[{LETTER}][0-9A-Za-z_{LETTER}]*', '·', 'g')"


def tokens(text: str) -> str:
    """The search tokens of a text."""
    return f"list_transform(regexp_extract_all(coalesce({plain(text)}, ''), {lit(re2(TOKEN))}, 0), lambda x: lower(x))"


HASH = "sha256({} || chr(31))"
DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
LITERALS = f"literals(query_id, query) AS (VALUES {', '.join(f'({i}, {lit(q)})' for i, q in LITERAL)})"
STATUTE = (
    f"statute AS (SELECT 'statute ' || (p_partkey // {DOCUMENT_PARTS}) AS document_id, row_number() OVER (PARTITION BY p_partkey // {DOCUMENT_PARTS} ORDER BY p_partkey) AS line_no, "
    f"p_partkey AS line_id, {STATUTE_LINE.format(string='VARCHAR')} AS text FROM part)"
)


def bm25(docs: str, queries: str, k: int) -> str:
    """CTEs up to bm(query_id, rank, id, score) over tables of (id, text) and (query_id, query)."""
    return f"""
tok AS (SELECT id, {tokens("text")} AS t FROM {docs}),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens("query")}) AS term FROM {queries}) GROUP BY ALL),
sc AS (
  SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a)))), 9) AS score
  FROM post JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


BM = f"WITH {DOCS}, {QUERIES}, {bm25('docs', 'queries', BM25_K)}"


def dense(where: str, k: int = DENSE_K) -> str:
    return f"""de AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
    FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND {where}) QUALIFY rank <= {k})"""


PACK = f"""{BM},
info AS (SELECT doc_id AS id, text, source || '.txt' AS document_name, lang AS section, (doc_id % 7)::INTEGER AS page_start, (doc_id % 7 + doc_id % 2)::INTEGER AS page_end FROM documents),
ov AS (
  SELECT bm.query_id, bm.rank AS before, bm.id, bm.score AS hybrid_score, info.* EXCLUDE (id),
    round(len(list_intersect(list_distinct({tokens("query")}), list_distinct({tokens("info.text")}))) / greatest(len(list_distinct({tokens("query")})), 1), 9) AS rerank_score
  FROM bm JOIN info USING (id) JOIN queries USING (query_id)),
pack AS (SELECT *, '[' || rank || ']' AS citation_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, before) AS rank FROM ov) WHERE rank <= {RERANK_K}),
{LITERALS},
asked AS (SELECT query_id::BIGINT AS query_id, query FROM queries UNION ALL SELECT query_id::BIGINT, query FROM literals)"""

GATE = f"""{PACK},
best AS (SELECT query_id, max(rerank_score) AS top_score FROM pack GROUP BY query_id),
gate AS (
  SELECT asked.query_id, top_score, CASE WHEN best.query_id IS NULL THEN 'none' WHEN top_score < LEAST_SCORE THEN 'low' WHEN top_score > 0.5 THEN 'high' ELSE 'medium' END AS confidence
  FROM asked LEFT JOIN best ON asked.query_id = best.query_id)"""

PROSE = rf"""lines AS (
  SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n
  FROM (SELECT doc_id, source, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]') AS l FROM documents)),
prose AS (
  SELECT sha256('corpus' || chr(31) || source || chr(31) || doc_id || chr(31)) AS document_id, doc_id, source || '/' || doc_id || '.txt' AS relative_path, (n // 4)::INTEGER AS page_index,
    string_agg(line, chr(10) ORDER BY n) AS text, sha256(string_agg(line, chr(10) ORDER BY n) || chr(31)) AS h
  FROM lines GROUP BY doc_id, source, n // 4),
real AS (SELECT * FROM prose WHERE trim(text) <> '')"""


def analysis() -> str:
    found = ", ".join(f"regexp_extract_all({plain('q')}, {lit(re2(p))}, 0)" for p in query_text.REFERENCES)
    kind = " ".join(rf"WHEN regexp_matches(lower({plain('q')}), {lit(chr(92) + 'b' + k + chr(92) + 'b')}) THEN {lit(v)}" for k, v in query_text.DOCUMENT_TYPES)
    domain = " ".join(f"WHEN contains(lower(q), {lit(k)}) THEN {lit(v)}" for k, v in query_text.DOMAINS)
    return rf"""
WITH {LITERALS},
u AS (SELECT DISTINCT (conv_id * 100 + turn)::BIGINT + 100000 AS query_id, text AS query FROM conversations WHERE role = 'user'),
n AS (SELECT query_id, trim(regexp_replace(query, '\s+', ' ', 'g')) AS q FROM (SELECT query_id::BIGINT AS query_id, query FROM literals UNION ALL SELECT * FROM u)),
f AS (SELECT *, list_transform(flatten([{found}]), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS r FROM n)
SELECT query_id, q AS normalized_query, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), '|') AS refs,
  CASE {kind} END AS doc_type, CASE {domain} END AS domain
FROM f"""


def boosted() -> str:
    refs = " UNION ALL ".join(
        f"SELECT query_id, lower(unnest(regexp_extract_all(query, {lit(re2(p))}, 0))) AS whole, lower(unnest(regexp_extract_all(query, {lit(re2(p))}, 1))) AS part, {lit(label)} AS label FROM literals"
        for p, label in fusion.BOOST_REFERENCES
    )
    acts = " UNION ALL ".join(f"SELECT query_id, {lit(n)} AS d FROM literals WHERE regexp_matches(query, {lit(re2(p))})" for p, names in fusion.ACTS for n in names)
    return rf"""
WITH {LITERALS.replace("literals(", "fixed(")}, {STATUTE},
literals AS (SELECT query_id::BIGINT AS query_id, query FROM fixed UNION ALL SELECT line_id + {ASKED_FROM}, text FROM statute WHERE line_id % {ASKED_LINES} = 0),
rows_ AS (SELECT line_id AS id, text FROM statute), {bm25("rows_", "literals", HYBRID_K)},
about AS (
  SELECT line_id AS id, lower(text) AS text, CASE line_id % 3 WHEN 0 THEN 'patents_act.pdf' WHEN 1 THEN 'tk_guidelines.pdf' ELSE 'biodiversity_rules.pdf' END AS name,
    CASE WHEN line_id % 2 = 0 THEN 'section ' || (line_id % 20) ELSE '' END AS section FROM statute),
hits AS (SELECT bm.query_id, bm.rank, bm.score, about.* FROM bm JOIN about USING (id)),
refs AS (SELECT query_id, whole, regexp_extract(part, '^(\d+[a-z]?)', 1) AS num, label FROM ({refs})),
acts AS ({acts}),
g AS (
  SELECT h.query_id, h.id, sum(
    CASE WHEN contains(text, whole) THEN 0.020 WHEN contains(text, label || ' ' || num) OR contains(text, label || '. ' || num) THEN 0.012 ELSE 0 END
    + CASE WHEN section <> '' AND contains(section, num) THEN 0.010 ELSE 0 END) AS gain FROM hits h JOIN refs USING (query_id) GROUP BY ALL),
a AS (
  SELECT h.query_id, h.id, CASE WHEN bool_or(contains(name, d)) THEN 0.015 WHEN any_value(contains(name, 'guidelines')) AND NOT bool_or(contains(d, 'guidelines')) THEN -0.005 ELSE 0 END AS gain
  FROM hits h JOIN acts USING (query_id) GROUP BY ALL),
x AS (
  SELECT query_id, id, rank, score, round(score + (coalesce(g.gain, 0) + coalesce(a.gain, 0))::DOUBLE, 12) AS b, query_id IN (SELECT query_id FROM refs UNION SELECT query_id FROM acts) AS active
  FROM hits LEFT JOIN g USING (query_id, id) LEFT JOIN a USING (query_id, id))
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN active THEN b END DESC NULLS LAST, rank)::INTEGER AS rank, id AS line_id, round(score, 6) AS hybrid_score, round(b, 6) AS boosted_score
FROM x"""


def case_heads() -> str:
    picks = [f"[{', '.join(map(lit, of))}][((doc_id // {4**k}) % 4 + 1)::INTEGER]" for k, of in enumerate(CASE_HEADS)]
    lines = rf"list_concat([{', '.join(picks)}], string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]')[1:3], ['Other v. Another', 'Suit No. 99', 'Court of Late'])"
    first = ", ".join(
        rf"trim(regexp_replace(list_filter(list_transform(l, lambda x: regexp_extract(x, {lit(re2(p))}, 1)), lambda x: x <> '')[1], '\s+', ' ', 'g')) AS {k}" for k, p in STICKY.items()
    )
    return f"SELECT doc_id, {first} FROM (SELECT doc_id, {lines} AS l FROM documents)"


def classes() -> str:
    key = " ".join(f"WHEN regexp_matches(text, {lit(re2(p))}) THEN {lit(k)}" for k, p, _ in PATTERNS)
    value = " ".join(
        f"WHEN {lit(k)} THEN coalesce({', '.join(f'nullif(regexp_extract(text, {lit(re2(p))}, {g}), {lit(chr(0)[:0])})' for g in range(1, n + 1))})" for k, p, n in PATTERNS
    )
    return rf"""{STATUTE},
keyed AS (SELECT *, CASE {key} END AS key FROM statute),
classed AS (SELECT *, CASE WHEN key = 'section' THEN 'Section ' || v ELSE v END AS value FROM (SELECT *, trim(regexp_replace(CASE key {value} END, '\s+', ' ', 'g')) AS v FROM keyed))"""


def contexts() -> str:
    over = "OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    out = []
    for k in dict.fromkeys((*CONTEXT, *BOUNDARIES)):
        value = f"last_value(CASE WHEN key = {lit(k)} THEN value END IGNORE NULLS) {over}"
        at = lambda keys: f"coalesce(max(CASE WHEN key IN ({', '.join(map(lit, keys))}) THEN line_no END) {over}, 0)"
        out.append(f"CASE WHEN {at([k])} > {at(CLEARED_BY[k])} THEN {value} END AS \"{k}\"" if k in CLEARED_BY else f"{value} AS \"{k}\"")
    return f"{classes()},\ncontext AS (SELECT document_id, line_no, line_id, text, {', '.join(out)} FROM classed)"


def blocks() -> str:
    new = " OR ".join(f'("{k}" IS NOT NULL AND "{k}" IS DISTINCT FROM lag("{k}") OVER w)' for k in BOUNDARIES)
    return f"""
WITH {contexts()},
begun AS (SELECT *, row_number() OVER w = 1 OR {new} AS begins FROM context WHERE trim(text) <> '' WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
numbered AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY document_id ORDER BY line_no)::BIGINT AS block_no FROM begun)
SELECT document_id, block_no, count(*) AS n_paras, arg_max(coalesce(section, ''), line_no) AS section_, sha256(string_agg(text, chr(10) || chr(10) ORDER BY line_no) || chr(31)) AS text_sha256
FROM numbered GROUP BY document_id, block_no"""


def described() -> str:
    any_of = lambda c, ps: "(" + " OR ".join(f"regexp_matches({plain(c)}, {lit(re2(p[1:]))})" if p[0] == "~" else f"contains({c}, {lit(p)})" for p in ps) + ")"
    rules = [(k, tuple(p.replace(r"\z", "$") for p in ps)) for k, ps in metadata.TYPE_RULES]
    types = " ".join(f"WHEN {any_of('ev', ps)} THEN {lit(k)}" for k, ps in rules)
    domains = ", ".join(f"CASE WHEN {any_of('ev2', ps)} THEN {lit(k)} END" for k, ps in metadata.DOMAIN_RULES)
    places, phrases = (*metadata.COLLECTIONS, "Other"), PHRASES
    inside = lambda names: ", ".join(map(lit, names))
    return rf"""
WITH d AS (
  SELECT doc_id, [{inside(places)}][(doc_id % {len(places)})::INTEGER + 1] AS place, 'x' || chr(10) || [{inside(phrases)}][(doc_id % {len(phrases)})::INTEGER + 1] || chr(10) || text AS t
  FROM documents),
e AS (
  SELECT *, 'file_' || doc_id || '.pdf' AS filename, lower('file_' || doc_id || '.pdf' || chr(10) || substr(t, 1, 5000)) AS ev, lower('file_' || doc_id || '.pdf' || chr(10) || substr(t, 1, 10000)) AS ev2, lower(substr(t, 1, 5000)) AS head,
    list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 8 AND 180)[1:40] AS usable FROM d),
f AS (SELECT *, CASE WHEN place IN ({inside(metadata.INTERNATIONAL)}) THEN 'International' WHEN contains(ev, 'india') OR place IN ({inside(metadata.NATIONAL)}) THEN 'India' END AS jurisdiction FROM e)
SELECT doc_id, sha256('corpus' || chr(31) || place || chr(31) || place || '/' || filename || chr(31)) AS document_id,
  coalesce(regexp_replace(list_filter(usable, lambda x: regexp_matches({plain('x')}, {lit(re2(metadata.TITLE_WORDS))}))[1], '\s+', ' ', 'g'), 'file ' || doc_id) AS title,
  CASE {types} WHEN place IN ({inside(metadata.INTERNATIONAL)}) THEN 'Treaty' ELSE 'Other' END AS document_type, jurisdiction,
  CASE WHEN jurisdiction = 'India' AND (contains(head, 'government of india') OR contains(head, 'ministry') OR contains(head, 'gazette of india')) THEN 'Government of India'
    WHEN contains(head, 'world intellectual property organization') OR contains(head, 'wipo') THEN 'WIPO'
    WHEN contains(head, 'convention on biological diversity') OR contains(head, 'cbd') THEN 'Convention on Biological Diversity' END AS authority,
  array_to_string(list_filter([{domains}], lambda x: x IS NOT NULL), '|') AS domains, CASE WHEN regexp_matches(t, '[A-Za-z]{{20,}}') THEN 'en' END AS language
FROM f"""


CHECKED = f"""
WITH {PROSE},
docs AS (SELECT document_id, doc_id, relative_path, CASE WHEN doc_id % 11 = 0 THEN count(*) + 1 ELSE count(*) END AS page_count FROM prose GROUP BY document_id, doc_id, relative_path),
pages AS (SELECT *, doc_id % 13 = 0 AND page_index = 0 AS failed, CASE WHEN doc_id % 13 = 0 AND page_index = 0 THEN '' ELSE text END AS t FROM prose WHERE NOT (doc_id % 17 = 0 AND page_index = 0)),
chunks AS (SELECT document_id, page_index, len(regexp_extract_all(t, '\\S+')) * 5 AS tokens FROM pages WHERE doc_id % 19 <> 0),
p AS (SELECT document_id, count(*) AS n, count(DISTINCT page_index) AS d, min(page_index) AS lo, max(page_index) AS hi, count(*) FILTER (trim(t) = '') AS empty, count(*) FILTER (failed) AS failed FROM pages GROUP BY 1),
c AS (SELECT document_id, count(*) AS chunks FROM chunks GROUP BY 1),
x AS (SELECT docs.*, coalesce(n, 0) AS n, d, lo, hi, coalesce(empty, 0) AS empty, coalesce(failed, 0) AS failed, coalesce(chunks, 0) AS chunks FROM docs LEFT JOIN p USING (document_id) LEFT JOIN c USING (document_id)),
found AS (
  SELECT 'CRITICAL' AS severity, 'PAGE_COUNT_MISMATCH' AS code, relative_path || ': the file''s number of pages is not that of the pages read' AS message, document_id FROM x WHERE page_count <> n
  UNION ALL SELECT 'CRITICAL', 'PAGE_SEQUENCE_GAP', relative_path || ': pages are missing or out of order', document_id FROM x WHERE n > 0 AND (lo <> 0 OR hi <> n - 1 OR d <> n)
  UNION ALL SELECT 'WARNING', 'EMPTY_PAGES', relative_path || ': ' || empty || ' blank pages', document_id FROM x WHERE empty > 0
  UNION ALL SELECT 'CRITICAL', 'FAILED_PAGES', relative_path || ': ' || failed || ' pages could not be read', document_id FROM x WHERE failed > 0
  UNION ALL SELECT 'CRITICAL', 'NO_CHUNKS', relative_path || ': nothing was cut into chunks', document_id FROM x WHERE chunks = 0 AND n > 0
  UNION ALL SELECT 'WARNING', 'OVERSIZE_CHUNK', relative_path || ': ' || tokens || ' words in chunk ' || page_index, document_id FROM chunks JOIN docs USING (document_id) WHERE tokens > 900),
statuses AS (
  SELECT docs.document_id, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'FAILED' WHEN bool_or(severity = 'WARNING') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status
  FROM docs LEFT JOIN found USING (document_id) GROUP BY 1)""".replace("\\\\S", "\\S")

VERSIONS = """
WITH x AS (SELECT doc_id::VARCHAR AS document_id, doc_id, sha256(text || chr(31)) AS h FROM documents),
new AS (SELECT * FROM x WHERE doc_id % 29 <> 0),
old AS (SELECT document_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE h END AS h FROM x WHERE doc_id % 5 <> 0)"""

JUDGED = """
WITH x AS (
  SELECT doc_id::VARCHAR AS chunk_id, source AS document_id, 'p' || (doc_id % 97) AS path, CASE WHEN source = 'src2' THEN '' WHEN doc_id % 23 = 0 THEN ' ' ELSE text END AS t, text
  FROM documents),
g(path, collision_group_id) AS (
  SELECT 'p3', sha256('collision' || chr(31) || 'p3' || chr(31) || 'p5' || chr(31)) UNION ALL SELECT 'p5', sha256('collision' || chr(31) || 'p5' || chr(31) || 'p7' || chr(31))
  UNION ALL SELECT 'p7', sha256('collision' || chr(31) || 'p5' || chr(31) || 'p7' || chr(31))),
j AS (SELECT x.*, collision_group_id, CASE WHEN collision_group_id IS NOT NULL THEN 'content_collision' WHEN trim(t) = '' OR trim(text) = '' THEN 'empty_text_or_embedding_text' END AS reason FROM x LEFT JOIN g USING (path))"""

VALIDATION = """
WITH d AS (SELECT doc_id, doc_id::VARCHAR AS id, text FROM documents), e AS (SELECT * FROM d WHERE doc_id % 37 <> 0),
points AS (SELECT CASE WHEN doc_id % 61 = 0 THEN NULL WHEN doc_id % 67 = 0 THEN 'x' || id ELSE id END AS id FROM d)
SELECT severity, code, key FROM (
  SELECT 'EMBEDDING_CHUNK_ID_MISMATCH' AS code, '' AS key
  UNION ALL SELECT 'EMBEDDING_DIMENSION_MISMATCH', id FROM e WHERE doc_id % 47 = 0
  UNION ALL SELECT 'EMBEDDING_MODEL_MISMATCH', id FROM e WHERE doc_id % 53 = 0
  UNION ALL SELECT 'INVALID_EMBEDDING_VALUE', id FROM e WHERE doc_id % 43 = 0
  UNION ALL SELECT 'EMBEDDING_INPUT_HASH_MISMATCH', id FROM e WHERE doc_id % 59 = 0
  UNION ALL SELECT 'ZERO_LENGTH_TEXT_INDEXED', id FROM d WHERE doc_id % 31 = 0
  UNION ALL SELECT 'INVALID_PROVENANCE', id FROM d WHERE doc_id % 41 = 0
  UNION ALL SELECT 'BM25_COUNT_MISMATCH', '' UNION ALL SELECT 'BM25_INDEX_CHUNK_ORDER_MISMATCH', '' UNION ALL SELECT 'SOURCE_CORPUS_MANIFEST_HASH_MISMATCH', ''
  UNION ALL SELECT 'VECTOR_PAYLOAD_MISSING_CHUNK_ID', '' FROM points WHERE id IS NULL
  UNION ALL SELECT 'VECTOR_UNKNOWN_CHUNK_ID', id FROM points WHERE id LIKE 'x%'
  UNION ALL SELECT 'VECTOR_PAYLOAD_CHUNK_ID_MISMATCH', ''), (SELECT 'CRITICAL' AS severity)"""


def _labels() -> str:
    names = {"title": "document_id", "document_type": "'Statute'", "jurisdiction": "''", "chapter": "chapter", "section": "section", "article": "article"}
    parts = [f"CASE WHEN {names[n]} <> '' THEN '{label}:' || chr(10) || {names[n]} END" for label, n in EMBEDDING_LABELS if n in names]
    return ", ".join([*parts, "CASE WHEN text <> '' THEN 'CONTENT:' || chr(10) || text END"])


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(map(lit, STOP_WORDS))
    tier = "CASE WHEN confidence IN ('none', 'low') THEN 'Insufficient' WHEN confidence = 'high' THEN 'High' ELSE 'Medium' END"
    gated = f"""{GATE.replace("LEAST_SCORE", "0.15")},
said AS (SELECT query_id, string_agg('Based on ' || document_name || ' ' || citation_id || ': ' || substr(text, 1, 200) || '...', chr(10) ORDER BY rank) AS a FROM pack GROUP BY query_id)
SELECT query_id, CASE WHEN confidence IN ('none', 'low') THEN {lit(evidence.ABSTENTION)} ELSE a END AS answer, CASE WHEN confidence IN ('none', 'low') THEN confidence ELSE 'dummy' END AS confidence,
  confidence NOT IN ('none', 'low') AS grounded FROM gate LEFT JOIN said USING (query_id)"""
    prompt = f"""{PACK},
ev AS (
  SELECT query_id, string_agg('--- ' || citation_id || ' ' || document_name || CASE WHEN coalesce(section, '') <> '' THEN ' — ' || section ELSE '' END || ' (p.' || page_start
    || CASE WHEN page_end <> 0 AND page_end <> page_start THEN '-' || page_end ELSE '' END || ')' || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS e FROM pack GROUP BY query_id)
SELECT query_id, concat_ws(chr(10), 'QUESTION: ' || query || chr(10) || chr(10) || 'EVIDENCE DOCUMENTS:' || chr(10), e, {lit(evidence.CLOSING)}) AS prompt FROM asked LEFT JOIN ev USING (query_id)"""
    cards = f"""{PACK}
SELECT query_id, citation_id, document_name AS title, CASE WHEN page_end <> page_start THEN 'pp. ' || page_start || '–' || page_end ELSE 'p. ' || page_start END AS page_label,
  CASE WHEN l <> '' THEN l ELSE '—' END AS section_label, CASE WHEN sn <> '' THEN sn ELSE 'See indexed chunk in corpus.' END AS snippet
FROM (SELECT *, concat_ws(' · ', nullif(section, ''), CASE WHEN id % 3 = 0 THEN 'CHAPTER I' END) AS l,
  CASE WHEN id % 5 = 0 THEN '' WHEN length(text) > 280 THEN trim(substr(text, 1, 277)) || '…' ELSE trim(text) END AS sn FROM pack)"""
    state = f"""{GATE.replace("LEAST_SCORE", "0.9")},
names AS (SELECT query_id, list(document_name ORDER BY rank) AS l FROM pack GROUP BY query_id)
SELECT query_id, {tier} AS tier, CASE WHEN confidence IN ('none', 'low') THEN '—' WHEN confidence = 'high' THEN 'High' ELSE 'Medium' END AS score_label,
  coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], '|'), 'Query processed against indexed corpus') AS documents
FROM gate LEFT JOIN names USING (query_id)"""
    repeated = rf"""WITH {PROSE},
a AS (SELECT document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM prose),
e AS (SELECT document_id, unnest(list_concat(l[1:3], l[greatest(len(l) - 2, 1):])) AS line FROM a),
s AS (SELECT document_id, count(*) AS pages FROM a GROUP BY 1 HAVING count(*) >= 4)
SELECT document_id, line, count(*) AS n FROM e JOIN s USING (document_id) GROUP BY document_id, line, pages
HAVING count(*) >= greatest(3, floor(pages * 0.45)) AND length(line) <= 140 AND NOT regexp_matches(line, '(?i)\b(section|article|rule|chapter)\b')"""
    profile = rf"""WITH {PROSE},
a AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM prose)
SELECT document_id, page_index, length(text)::BIGINT AS n_chars, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_words, length(trim(text)) < 40 OR len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) < 8 AS low_text,
  regexp_replace(list_filter(list_concat(l[1:5], l[greatest(len(l) - 4, 1):]), lambda x: regexp_matches(x, '(?i)^(?:Page\s*)?\d{{1,4}}$'))[1], '\D', '', 'g')::INTEGER AS printed FROM a"""
    sets = f"""WITH {PROSE},
s AS (SELECT document_id, array_to_string(list_sort(list(DISTINCT h)), '') AS pages, count(DISTINCT h)::BIGINT AS n_pages FROM real GROUP BY 1),
k AS (SELECT document_id, min(document_id) OVER (PARTITION BY pages) AS class_id, n_pages FROM s)"""
    collide = f"""{sets},
r AS (SELECT DISTINCT document_id AS id, h, n_pages FROM real JOIN k USING (document_id) WHERE document_id = class_id)
SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared, round(count(*) / least(a.n_pages, b.n_pages), 6) AS overlap FROM r a JOIN r b ON a.h = b.h AND a.id < b.id
GROUP BY a.id, b.id, a.n_pages, b.n_pages HAVING count(*) * 100 >= 80 * least(a.n_pages, b.n_pages)
UNION ALL SELECT class_id, document_id, n_pages, 1.0 FROM k WHERE document_id <> class_id"""
    flagged = lambda by, n: f"WITH {PROSE} SELECT document_id, page_index, h AS hash FROM real WHERE {by} IN (SELECT {by} FROM real GROUP BY ALL HAVING {n} > 1)"
    return {
        "content_hash": "SELECT doc_id, sha256(text || chr(31)) AS text_sha256 FROM documents",
        "bm25_topk": f"{BM} SELECT query_id, rank::INTEGER AS rank, id AS doc_id, round(score, 6) AS score FROM bm",
        "bm25_topk_all": f"WITH {DOCS}, {QUERIES}, {bm25('docs', 'queries', lexical.TOP_K)} SELECT query_id, rank::INTEGER AS rank, id AS doc_id, round(score, 6) AS score FROM bm",
        "dense_topk_all": f"WITH {dense('true', vectors.TOP_K)} SELECT query_id, rank::INTEGER AS rank, id AS vec_id, round(score, 6) AS score FROM de",
        "bm25_term_stats": f"{BM} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st",
        "token_counts": f"WITH {DOCS}, t AS (SELECT id, list_filter({tokens('text')}, lambda x: x NOT IN ({stop})) AS t FROM docs) SELECT id AS doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM t",
        "dense_topk": f"WITH {dense('true')} SELECT query_id, rank::INTEGER AS rank, id AS vec_id, round(score, 6) AS score FROM de",
        "dense_topk_filtered": f"WITH {dense('v.label IN (1, 3, 5)')} SELECT query_id, rank::INTEGER AS rank, id AS vec_id, round(score, 6) AS score FROM de",
        "rrf_fusion": f"""{BM}, {dense("true")},
two AS (SELECT 0 AS l, query_id, id, rank FROM bm UNION ALL SELECT 1, query_id, id, rank FROM de),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s, min(l * 1000000 + rank) AS first, max(rank) FILTER (l = 0) AS bm25_rank, max(rank) FILTER (l = 1) AS dense_rank FROM two GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first))::INTEGER AS rank, id AS doc_id, bm25_rank::INTEGER AS bm25_rank, dense_rank::INTEGER AS dense_rank, round(s, 6) AS hybrid_score FROM f QUALIFY rank <= {HYBRID_K}""",
        "fusion_bm25_only": f"{BM} SELECT query_id, rank::INTEGER AS rank, id AS doc_id, rank::INTEGER AS bm25_rank, NULL::INTEGER AS dense_rank, round(score, 6) AS hybrid_score FROM bm",
        "query_analysis": analysis(),
        "metadata_filter": "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, true) AND coalesce(toxic = 0, true)",
        "reference_boost": boosted(),
        "rerank_overlap": f"{PACK} SELECT query_id, rank::INTEGER AS rank, id AS doc_id, round(rerank_score, 6) AS rerank_score FROM pack",
        "rerank_passthrough": f"{BM} SELECT query_id, rank::INTEGER AS rank, id AS doc_id, round(score, 6) AS hybrid_score FROM bm WHERE rank <= {RERANK_K}",
        "evidence_pack": f"{PACK} SELECT query_id, citation_id, id AS doc_id, round(hybrid_score, 6) AS hybrid_score, round(rerank_score, 6) AS rerank_score FROM pack",
        "grounding_gate": f"{GATE.replace("LEAST_SCORE", "0.9")} SELECT query_id, round(top_score, 6) AS top_score, confidence, confidence NOT IN ('none', 'low') AS grounded FROM gate",
        "extractive_answer": gated,
        "prompt_text": prompt,
        "citation_cards": cards,
        "response_state": state,
        "sanitized_texts": f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR regexp_matches(text, '(?i)LLM generation failed|urlopen error|Errno|Name or service not known|ECONNREFUSED|timed out') THEN {lit(evidence.UNREACHABLE)} ELSE text END AS shown FROM documents",
        "repeated_lines": repeated,
        "page_profile": profile,
        "dup_files": "SELECT sha256(text || chr(31)) AS hash, count(*) OVER (PARTITION BY text) AS n, min(doc_id::VARCHAR) OVER (PARTITION BY text) AS first_path, doc_id::VARCHAR AS relative_path FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1",
        "dup_pages_within": flagged("(document_id, h)", "count(*)").replace("SELECT (document_id, h) FROM real GROUP BY ALL", "SELECT (document_id, h) FROM real GROUP BY document_id, h"),
        "dup_pages_across": flagged("h", "count(DISTINCT document_id)"),
        "doc_page_classes": f"{sets} SELECT document_id, class_id, n_pages FROM k",
        "doc_collisions": collide,
        "dup_chunks": f"WITH {PROSE} SELECT count(*) AS n_duplicated_hashes FROM (SELECT h FROM prose GROUP BY h HAVING count(*) > 1)",
        "document_findings": f"{CHECKED} SELECT * FROM found",
        "severity_counts": f"{CHECKED} SELECT severity, count(*) AS n FROM found GROUP BY 1",
        "doc_status": f"{CHECKED} SELECT * FROM statuses",
        "manifest_totals": f"""{CHECKED}
SELECT count(*) AS documents_total, count(*) FILTER (status <> 'FAILED') AS documents_successful, count(*) FILTER (status = 'FAILED') AS documents_failed, (SELECT count(*) FROM pages) AS pages_total, (SELECT count(*) FROM pages WHERE doc_id % 6 = 0) AS ocr_pages,
  (SELECT count(*) FROM chunks) AS chunks_total, (SELECT count(*) FROM found WHERE severity = 'WARNING') AS warnings, (SELECT count(*) FROM found WHERE severity = 'CRITICAL') AS critical_errors, 'FAILED' AS validation_status FROM statuses""",
        "manifest_documents": f"""{CHECKED}
SELECT docs.document_id, doc_id || '.txt' AS filename, relative_path, split_part(relative_path, '/', 1) AS dataset_id, page_count, sha256(relative_path) AS source_sha256, coalesce(chunks, 0)::BIGINT AS chunk_count, status AS validation_status
FROM docs JOIN statuses USING (document_id) LEFT JOIN c USING (document_id)""",
        "case_heads": case_heads(),
        "ingest_reuse": f"""WITH {STATUTE},
files AS (SELECT regexp_extract(document_id, '[0-9]+')::INTEGER AS n, 'Dataset_1/' || replace(document_id, ' ', '_') || '_act_.pdf' AS path, (count(*) + {STATUTE_PAGE - 1}) // {STATUTE_PAGE} AS pages FROM statute GROUP BY document_id),
acts AS (
  SELECT *, sha256('corpus' || chr(31) || 'Dataset_1' || chr(31) || path || chr(31)) AS document_id, n % 6 = 3 AND n % 5 <> 4 AS bad,
    CASE WHEN n % 5 = 4 THEN 'remove' WHEN n % 5 = 1 OR n % 3 = 0 THEN 'process' ELSE 'reuse' END AS action FROM files)
SELECT document_id, action, CASE WHEN action <> 'remove' THEN CASE WHEN bad THEN 0 ELSE pages END END::BIGINT AS page_count, CASE WHEN action <> 'remove' THEN CASE WHEN bad THEN 'FAILED' ELSE 'PASS' END END AS validation_status,
  CASE WHEN action <> 'remove' THEN CASE WHEN bad THEN 'DOCUMENT_PROCESSING_FAILED' ELSE 'DOCUMENT_PROCESSED' END END AS codes
FROM acts""",
        "ingest_findings": f"""WITH {STATUTE},
files AS (SELECT 'Dataset_1/' || replace(document_id, ' ', '_') || '_act_.pdf' AS path, (count(*) + {STATUTE_PAGE - 1}) // {STATUTE_PAGE} AS pages FROM statute GROUP BY document_id)
SELECT 'INFO' AS severity, 'DOCUMENT_PROCESSED' AS code, path || ': ' || pages || ' pages were read' AS message, sha256('corpus' || chr(31) || 'Dataset_1' || chr(31) || path || chr(31)) AS document_id, path AS relative_path, NULL::INTEGER AS page_index FROM files""",
        "embedding_reuse": """WITH x AS (SELECT doc_id, sha256(text || chr(31)) AS h FROM documents WHERE doc_id % 29 <> 0)
SELECT doc_id::VARCHAR AS key, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 6 <> 0 AS cached, h AS embedding_input_sha256, 8 AS n FROM x""",
        "vector_sync": f"{VERSIONS} SELECT document_id AS key, CASE WHEN new.h IS NULL THEN 'delete' WHEN old.h IS NULL THEN 'insert' WHEN new.h = old.h THEN 'keep' ELSE 'update' END AS action, new.h AS content_hash FROM new FULL JOIN old USING (document_id)",
        "provenance": f"""{BM}
SELECT query_id, rank::INTEGER AS rank, id::VARCHAR AS chunk_id, source AS document_id, source || '.txt' AS document_name, 'set' AS dataset_id, 'bm25' AS retrieval_method, 'p' || (id % 97) AS source_path,
  (id % 7)::INTEGER AS pdf_page_start, (id % 7 + 1)::INTEGER AS pdf_page_end, NULL::INTEGER AS printed_page_start, (id % 7 + 3)::INTEGER AS printed_page_end, CASE WHEN id % 3 = 1 THEN 'Section ' || (id % 20) ELSE 'of the metadata' END AS section,
  CASE WHEN id % 4 = 0 THEN 'Article 3' END AS article, source AS chapter, NULL::VARCHAR AS subsection, CASE WHEN id % 9 = 0 THEN 'Rule 2' END AS rule, NULL::VARCHAR AS regulation, 'Act' AS document_type, NULL::VARCHAR AS jurisdiction,
  lang AS legal_domains, id % 5 = 0 AS content_collision, CASE WHEN id % 5 = 0 THEN 'g' END AS collision_group_id
FROM bm JOIN documents ON doc_id = id""",
        "payloads": """
SELECT '1.0.0' AS indexing_version, doc_id::VARCHAR AS chunk_id, source AS document_id, 'set' AS dataset_id, source || '.txt' AS document_name, sha256(text || chr(31)) AS text, sha256(text || chr(31)) AS embedding_text_hash, 'Act' AS document_type,
  NULL::VARCHAR AS jurisdiction, lang AS legal_domains, 'p' || (doc_id % 97) AS source_path, (doc_id % 7)::INTEGER AS page_start, (doc_id % 7 + 1)::INTEGER AS page_end, NULL::INTEGER AS printed_page_start, (doc_id % 7 + 3)::INTEGER AS printed_page_end,
  CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'Section ' || (doc_id % 20) END AS section, NULL::VARCHAR AS subsection, CASE WHEN doc_id % 4 = 0 THEN 'Article 3' END AS article, NULL::VARCHAR AS chapter,
  doc_id % 5 = 0 AS content_collision, CASE WHEN doc_id % 5 = 0 THEN 'g' END AS collision_group_id
FROM documents""",
        "point_ids": """
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17])::INTEGER & 3) + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id
FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunks:' || doc_id)) AS h FROM documents)""",
        "line_classes": f"WITH {classes()} SELECT document_id, line_no, key, value FROM classed",
        "structure_context": f"WITH {contexts()} SELECT document_id, line_no, {', '.join(CONTEXT)} FROM context",
        "page_structure": f"WITH {contexts()} SELECT document_id, ((line_no - 1) // {STATUTE_PAGE})::INTEGER AS page_index, {', '.join(f'arg_max(struct_pack(v := {k}), line_no).v AS {k}' for k in CONTEXT)} FROM context GROUP BY document_id, (line_no - 1) // {STATUTE_PAGE}",
        "page_counts": rf"""WITH {PROSE}, a AS (SELECT * FROM prose), r AS (SELECT * FROM a WHERE trim(text) <> ''),
w AS (SELECT document_id, h FROM r GROUP BY ALL HAVING count(*) > 1), x AS (SELECT h FROM r GROUP BY h HAVING count(DISTINCT document_id) > 1)
SELECT document_id, count(*) FILTER (trim(text) <> '' AND ((document_id, h) IN (SELECT (document_id, h) FROM w) OR h IN (SELECT h FROM x))) AS duplicate_pages, count(*) FILTER (trim(text) = '') AS empty_pages,
  count(*) FILTER (length(trim(text)) < 40 OR len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) < 8) AS suspicious_pages FROM a GROUP BY 1""",
        "page_findings": rf"""WITH {PROSE}, a AS (SELECT * FROM prose)
SELECT 'WARNING' AS severity, 'OCR_NEEDED_BUT_DISABLED' AS code, document_id, page_index FROM a WHERE length(trim(text)) < 40 OR len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) < 8
UNION ALL SELECT 'WARNING', 'EMPTY_PAGE_TEXT', document_id, page_index FROM a WHERE trim(text) = ''""",
        "manifest_hashes": "SELECT source, sha256(CASE WHEN length(source) % 3 <> 0 THEN source || ':' || count(*) ELSE 'missing-corpus-manifest' END || chr(31)) AS manifest_hash FROM documents GROUP BY source",
        "structural_blocks": f"SELECT document_id, block_no, n_paras, nullif(section_, '') AS section, text_sha256 FROM ({blocks()})",
        "doc_metadata": described(),
        "embedding_text": f"WITH {contexts()} SELECT line_id AS chunk_id, sha256(concat_ws(chr(10) || chr(10), {_labels()}) || chr(31)) AS embedding_text_sha256 FROM context",
        "incremental_plan": f"{VERSIONS} SELECT document_id AS key, CASE WHEN new.h IS NULL THEN 'remove' WHEN new.h = old.h THEN 'reuse' ELSE 'process' END AS action FROM new FULL JOIN old USING (document_id)",
        "embed_cache_plan": f"{VERSIONS} SELECT document_id AS key, CASE WHEN new.h = old.h THEN 'hit' ELSE 'miss' END AS action FROM new LEFT JOIN old USING (document_id)",
        "vector_sync_plan": f"{VERSIONS} SELECT document_id AS key, CASE WHEN new.h IS NULL THEN 'delete' WHEN old.h IS NULL THEN 'insert' WHEN new.h = old.h THEN 'keep' ELSE 'update' END AS action FROM new FULL JOIN old USING (document_id)",
        "eligible_chunks": f"{JUDGED} SELECT chunk_id, collision_group_id IS NOT NULL AS content_collision, collision_group_id, reason FROM j",
        "skipped_documents": f"""{JUDGED}
SELECT d.document_id, CASE WHEN count(j.chunk_id) = 0 THEN 'zero_chunks' ELSE string_agg(DISTINCT reason, ',' ORDER BY reason) END AS reason
FROM (SELECT DISTINCT source AS document_id FROM documents UNION ALL SELECT 'no chunks') d LEFT JOIN j USING (document_id) GROUP BY 1 HAVING count(*) FILTER (j.chunk_id IS NOT NULL AND reason IS NULL) = 0""",
        "index_validation": VALIDATION,
    }

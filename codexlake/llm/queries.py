"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm import chat_format, decontaminate, html_extract, language_id, minhash, prefix_trie, quality_rules
from codexlake.llm import secret_scan, simhash_dedup, source_mix, token_output, url_filter, vector_codes
from codexlake.llm.shared import documents

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(documents(spark, sf_dir))


#: The added conversation, whose texts hold the template's control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    turns = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    hard = spark.range(1).select(turns.alias("t")).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("t.turn").cast(kinds["turn"]).alias("turn"), "t.role", F.lit(HARD_TEXT).alias("text"))
    return chat_format.format_report(rows.unionByName(hard))


#: The rules of the query.
RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = [f"{n}.example.{top}" for n in BLOCKED_NAMES for top in ("com", "net", "org")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.filtered(pages, RULES, BLOCKED_HOSTS).select("page_id", "url_filter.*")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract.with_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination_report(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokenized(documents(spark, sf_dir), tokenizer_path())


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_report(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
line_counts AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY r),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN line_counts USING (r) LEFT JOIN covered USING (r)),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 100 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_dup_lines // greatest(n_lines, 1) AS line_rate,
    1000 * greatest(n_symbols - 2 * sqrt(n_symbols), 0) / greatest(n_words, 1) AS sure_symbols, 1000 * greatest(n_dup_lines - 2 * sqrt(n_dup_lines), 0) / greatest(n_lines, 1) AS sure_lines
  FROM m),
v AS (
  SELECT lang, source, 'symbol_rate' AS measure, symbol_rate AS x FROM j WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'word_length', word_length FROM j WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'line_rate', line_rate FROM j WHERE NOT base_failed),
b AS (
  SELECT lang, source, measure, ((x::BIGINT) >> s) << s AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(x::BIGINT)) - 7, 0)::INTEGER AS s FROM v) GROUP BY ALL),
bl AS (SELECT lang, measure, bucket, sum(n)::BIGINT AS n, sum(sum(n)) OVER (PARTITION BY lang, measure)::BIGINT AS a FROM b GROUP BY lang, measure, bucket),
bw AS (SELECT measure, bucket, sum(n)::BIGINT AS n, sum(sum(n)) OVER (PARTITION BY measure)::BIGINT AS a FROM b GROUP BY measure, bucket),
blend AS (
  SELECT g.lang, g.source, g.measure, bw.bucket, 1000 * coalesce(b.n, 0) + coalesce(100000 * bl.n // bl.a, 0) + 10000 * bw.n // bw.a AS n
  FROM (SELECT DISTINCT lang, source, measure FROM b) g JOIN bw ON g.measure = bw.measure
  LEFT JOIN bl ON bl.lang IS NOT DISTINCT FROM g.lang AND bl.measure = g.measure AND bl.bucket = bw.bucket
  LEFT JOIN b ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source AND b.measure = g.measure AND b.bucket = bw.bucket),
q AS (
  SELECT lang, source, measure, min(CASE WHEN 4 * below >= a THEN bucket END) AS q1, min(CASE WHEN 4 * below >= 3 * a THEN bucket END) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY lang, source, measure) AS a FROM blend) GROUP BY ALL),
f AS (
  SELECT lang, source, measure, q1 - reach AS low, q3 + reach AS high
  FROM (SELECT *, 3 * (q3 - q1 + (1::BIGINT << greatest(length(bin(q3::BIGINT)) - 7, 0)::INTEGER)) AS reach FROM q)),
t AS (
  SELECT lang, source, max(high) FILTER (measure = 'symbol_rate') AS sh, max(high) FILTER (measure = 'word_length') AS wh,
    max(low) FILTER (measure = 'word_length') AS wl, max(high) FILTER (measure = 'line_rate') AS lh
  FROM f GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(sure_symbols <= sh AND word_length <= wh AND word_length >= wl AND sure_lines <= lh, false) AS kept
FROM j LEFT JOIN t ON j.lang IS NOT DISTINCT FROM t.lang AND j.source IS NOT DISTINCT FROM t.source
"""

OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '(<)(\\*)(/?s>|</?(?:SYS|ROLE)>>)|(\[)(\\*)(/?INST\])', '\1\4\\\2\5\3\6', 'g') AS escaped FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 20 WHEN 'assistant' THEN 6 ELSE 27 + length(role) END)::BIGINT AS formatted_chars,
  'messages role text' AS layout
FROM e GROUP BY conv_id
"""

OP3_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u),
r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (
  SELECT page_id, rh || rp AS rule, v FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f USING (page_id)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, w, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents)),
b AS (
  SELECT item_id, len(w) AS n_words, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS s
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, n_words, unnest(s) AS x FROM b),
hits AS (SELECT doc_id, s, item_id, greatest(1, n_words - 4) AS n, pos FROM (SELECT doc_id, s, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM d) JOIN bs USING (x)),
wins AS (SELECT DISTINCT doc_id, item_id, start, s[start:start + n - 1] AS win FROM (SELECT *, greatest(1, least(pos, len(s) - n + 1)) AS start FROM hits)),
c AS (SELECT doc_id, item_id, start, win, x, count(*) AS k FROM (SELECT *, unnest(win) AS x FROM wins) GROUP BY ALL),
i AS (SELECT item_id, x, count(*) AS k FROM (SELECT item_id, unnest(s) AS x FROM b) GROUP BY ALL),
o AS (SELECT doc_id, item_id, start, win, sum(least(c.k, i.k)) AS shared FROM c JOIN i USING (item_id, x) GROUP BY ALL),
r AS (SELECT doc_id, o.item_id, start - 1 AS start, shared / (len(win) + len(b.s) - shared) AS similarity FROM o JOIN b ON o.item_id = b.item_id WHERE 9 * shared >= 4 * (len(win) + len(b.s)))
SELECT doc_id, item_id, start::BIGINT AS start, round(similarity, 6) AS similarity FROM r
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k, n) AS i, k, n
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
b AS (SELECT conv_id, generate_subscripts(s, 1) AS i, ascii(unnest(s)) AS b FROM (SELECT DISTINCT conv_id, string_split(conv_id::VARCHAR, '') AS s FROM t)),
-- CRC-32 byte by byte, in the usual reversed form
c AS (
  SELECT conv_id, 0::BIGINT AS i, 4294967295 AS c FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL SELECT c.conv_id, c.i + 1, list_reduce(list_concat([xor(c.c, b.b::BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
  FROM c JOIN b ON b.conv_id = c.conv_id AND b.i = c.i + 1),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(max_by(c, i), 4294967295) % 6 AS h FROM c GROUP BY conv_id),
p AS (
  SELECT h.conv_id, list(k ORDER BY i) FILTER (k IS NOT NULL) AS k, list(n ORDER BY i) FILTER (k IS NOT NULL) AS n
  FROM h LEFT JOIN LATERAL (
    SELECT i, k, n FROM t WHERE t.conv_id = h.head AND t.i <= h.h UNION ALL SELECT i, k, n FROM t WHERE t.conv_id = h.conv_id AND t.i > h.h) x ON true
  GROUP BY h.conv_id),
m AS (
  SELECT conv_id, d, coalesce(len(k), 0) = d AS ends, md5(coalesce(array_to_string(k[:d], ' '), '')) AS node, CASE WHEN d > 0 THEN md5(coalesce(array_to_string(k[:d - 1], ' '), '')) END AS parent, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, coalesce(len(k), 0) + 1)) AS d FROM p)),
nodes AS (
  SELECT node, d AS depth, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (SELECT DISTINCT a.node AS top, d.node FROM m a JOIN m d ON a.conv_id = d.conv_id AND a.d <= d.d),
sums AS (
  SELECT top, count(*) FILTER (kids.node IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM under JOIN nodes USING (node) LEFT JOIN kids ON kids.node = nodes.node GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.node LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.top = n.node
"""


def _op13_sql() -> str:
    """The rounds written out one after the other; x has a row for each vector, part and place."""
    steps = ["""
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
x AS MATERIALIZED (SELECT r, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS w FROM v, range(4) AS g(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS j, w FROM x WHERE r <= 256)"""]
    for k in range(5):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, x.p, min({{'d': list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'j': b.j}}) AS a
  FROM x JOIN book{k} b USING (p) GROUP BY r, x.p)""")
        if k < 4:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT p, j, coalesce(m, b.w) AS w FROM book{k} b LEFT JOIN (
    SELECT p, j, list(floor_mean ORDER BY i) AS m FROM (
      SELECT p, a.j AS j, i, (sum(w[i]) - ((sum(w[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
      FROM near{k} JOIN x USING (r, p), range(1, 1000) AS g(i) WHERE i <= len(w) GROUP BY ALL) GROUP BY p, j) USING (p, j))""")
    return f"""WITH {','.join(steps)},
codes AS (SELECT r, string_agg(printf('%02x', a.j), '' ORDER BY p) AS code, sum(a.d)::BIGINT AS error FROM near4 GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, j)) AS s FROM book4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT s FROM sha) AS codebooks_sha256 FROM v JOIN codes USING (r)
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_chat_format": op2_chat_format,
        "op3_url_filter": op3_url_filter,
        "op4_quality_rules": op4_quality_rules,
        "op5_decontamination": op5_decontamination,
        "op6_token_files": op6_token_files,
        "op7_html_text": op7_html_text,
        "op8_language_id": op8_language_id,
        "op9_source_mix": op9_source_mix,
        "op10_secret_scan": op10_secret_scan,
        "op11_minhash": op11_minhash,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_quality_rules": OP4_SQL, "op5_decontamination": OP5_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}

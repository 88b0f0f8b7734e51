"""One registered query per operator: it applies the operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import chains, chat, decontaminate, lexical, lines, maxscore, neardup, packing, quality, repair, simple8b, urls, warc
from footfall.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_simple8b_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Write every document's ids in token files, read them back and digest them."""
    files = simple8b.write_token_files(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return simple8b.read_token_files(files)


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pack all documents into sequences of 1,024 ids."""
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query
def op5_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """Archive every page, index the archives and read each page's record back through the index."""
    return warc.archive_and_read(table(spark, folder, "pages"))


ORACLES["op5_warc_index"] = """
WITH d AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest),
j AS (SELECT d.*, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j"""


@query
def op6_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Drop conversations that a longer one continues and render the others."""
    return chat.format_chats(table(spark, folder, "conversations"))


ORACLES["op6_chat_snapshots"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
k AS (SELECT *, coalesce('=' || conv_id, '-' || row_number() OVER ()) AS conv FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
 '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM k),
c AS (SELECT conv, any_value(conv_id) AS conv_id, count(*) AS n,
 list(coalesce('=' || role, '-') || chr(1) || coalesce('=' || text, '-') ORDER BY position) AS l FROM p GROUP BY conv),
gone AS (SELECT a.conv FROM c a JOIN c b ON a.l[1] = b.l[1] AND a.conv <> b.conv AND b.n >= a.n AND list_slice(b.l, 1, a.n) = a.l
 WHERE b.n > a.n OR coalesce(b.conv_id < a.conv_id, b.conv_id IS NOT NULL))
SELECT conv_id, position, role, rendered,
 CAST(sum(length(rendered)) OVER (PARTITION BY conv ORDER BY position) - length(rendered) AS BIGINT) AS start,
 CAST(length(rendered) AS BIGINT) AS n_chars, coalesce(role = 'assistant', false) AS trained
FROM p WHERE conv NOT IN (SELECT conv FROM gone)"""


# Fixed values of the query: host, path start, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# Pages with junk marks in the title are taken as the list of bad URLs.
JUNK_TITLE = r"(?s)<title>[^<]*[%*#$]{3}"


@query
def op9_url_bloom(spark: SparkSession, folder: str) -> DataFrame:
    """Judge every page's URL by the rules, and where none fits by the list of URLs of pages with junk titles."""
    pages = table(spark, folder, "pages")
    return urls.judge(pages, pages.where(F.col("html").rlike(JUNK_TITLE)).select("url"), URL_RULES)


ORACLES["op9_url_bloom"] = r"""
WITH p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*[?]([^#]*)', 1), '') AS params FROM pages),
c AS (SELECT *, list_sort(list_filter(string_split(params, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept FROM p),
k AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key FROM c),
bad AS (SELECT DISTINCT key FROM k WHERE key IS NOT NULL AND regexp_matches(html, '(?s)<title>[^<]*[%*#$]{3}')),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN key IN (SELECT key FROM bad) THEN 'block' ELSE 'allow' END AS verdict,
 coalesce(rule IS NULL AND key IN (SELECT key FROM bad), false) AS listed FROM r"""


@query
def op4_winnowed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Delete later repeated runs of lines from every document."""
    return lines.dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "words", "words_removed", "text")


ORACLES["op4_winnowed_lines"] = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
x AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM d),
l AS (SELECT doc_id, text, line, trim(body, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare,
 len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words FROM x WHERE trim(body, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
c AS (SELECT *, row_number() OVER w AS pos, CAST(sum(words) OVER w - words AS BIGINT) AS ahead, CAST(sum(words) OVER (PARTITION BY doc_id, text) AS BIGINT) AS total
 FROM l WINDOW w AS (PARTITION BY doc_id, text ORDER BY line ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, list(bare) OVER r AS held, max(line) OVER r AS last FROM c WINDOW r AS (PARTITION BY doc_id, text ORDER BY ahead RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
o AS (SELECT doc_id, text, pos, pos + len(held) - 1 AS upto, row_number() OVER s AS nth, first_value(doc_id) OVER s AS from_id, first_value(text) OVER s AS from_text, first_value(pos) OVER s AS from_pos
 FROM h WHERE ahead + 50 <= total WINDOW s AS (PARTITION BY held ORDER BY doc_id NULLS LAST, text, pos)),
q AS (SELECT doc_id, text, list(bare ORDER BY pos) AS bares, list(line ORDER BY pos) AS ls FROM c GROUP BY doc_id, text),
e AS (SELECT o.*, a.ls,
 coalesce(list_position(list_transform(range(1, 50), lambda i: coalesce(a.bares[o.upto + i] <> b.bares[o.from_pos + o.upto - o.pos + i], true)), true), 50) - 1 AS up,
 coalesce(list_position(list_transform(range(1, 50), lambda i: CASE WHEN o.pos <= i OR o.from_pos <= i THEN true ELSE a.bares[o.pos - i] <> b.bares[o.from_pos - i] END), true), 50) - 1 AS down
 FROM o JOIN q a ON o.doc_id IS NOT DISTINCT FROM a.doc_id AND o.text = a.text JOIN q b ON o.from_id IS NOT DISTINCT FROM b.doc_id AND o.from_text = b.text WHERE nth > 1),
g AS (SELECT DISTINCT doc_id, text, unnest(range(ls[pos - down], ls[upto + up] + 1)) AS line FROM e),
k AS (SELECT x.doc_id, x.text, string_agg(x.body, chr(10) ORDER BY x.line) FILTER (g.line IS NULL) AS kept, any_value(g.line) AS cut,
 count(*) FILTER (trim(x.body, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '') AS n_lines,
 count(*) FILTER (g.line IS NOT NULL AND trim(x.body, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '') AS n_removed,
 CAST(coalesce(sum(len(regexp_extract_all(x.body, '[^\x20\x09-\x0D]+'))), 0) AS BIGINT) AS words,
 CAST(coalesce(sum(len(regexp_extract_all(x.body, '[^\x20\x09-\x0D]+'))) FILTER (g.line IS NOT NULL), 0) AS BIGINT) AS words_removed
 FROM x LEFT JOIN g ON x.doc_id IS NOT DISTINCT FROM g.doc_id AND x.text = g.text AND x.line = g.line GROUP BY x.doc_id, x.text)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(words, 0) AS words, coalesce(words_removed, 0) AS words_removed,
 CASE WHEN cut IS NULL THEN d.text ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text"""


@query
def op7_winnowed_contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("k1", "k2")


ORACLES["op7_winnowed_contamination"] = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(list_slice(ws, s, s + least(len(ws), 13) - 1), ' ') AS win
 FROM b, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS t(s) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, s, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS win FROM w, lens, unnest(range(1, len(ws) - n + 2)) AS t(s)),
hit AS (SELECT r, s, dw.n, win, item_id FROM dw JOIN iw USING (n, win)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""


@query
def op10_risk_controlled_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and risk-controlled cutoffs per language for every document."""
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("k1", "k2")


@query
def op8_odd_sketch_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate documents, three-word shingles at 0.85."""
    return neardup.near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85).drop("k1", "k2", "first")


ORACLES["op8_odd_sketch_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + least(len(ws), 3) - 1), ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) USING (doc_id)"""


@query
def op2_chained_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Fuzzy passages of every document that an earlier document has."""
    return chains.fuzzy_passages(table(spark, folder, "documents"))


@query
def op12_block_table_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damage every conversation and repair its structure with the cheapest edits."""
    conversations = table(spark, folder, "conversations")
    return repair.digests(repair.repair(repair.damage(conversations)), conversations)


@query
def op13_bag_dedup_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op13_bag_dedup_search"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
a AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(a.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, a GROUP BY term),
q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(ts) AS term FROM b) GROUP BY i, term),
m AS (SELECT r, doc_id, 75 + (25 * len(ts) * a.n) // a.l AS m FROM d, a),
s AS (SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b USING (i) WHERE rank <= 20"""


@query
def op11_maxscore_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors of largest inner product for every fiftieth vector."""
    return maxscore.top_k(maxscore.whole_vectors(table(spark, folder, "embeddings")), F.col("vec_id") % 50 == 0)


ORACLES["op11_maxscore_top_k"] = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5"""

"""DuckDB SQL that gives the same rows as the queries beside it, for those that SQL can express."""

from quarry.functions import markup
from quarry.functions.text import STOP_WORDS
from quarry.operators import answer
from quarry.plans.queries import ONE_QUESTION

_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: NOT list_contains({_STOPS}, w))"


def _strip(x: str) -> str:
    for pattern, to in markup.INLINE:
        if r"\1" in pattern:  # DuckDB's patterns have no references to groups: each mark gets a branch of its own
            marks = pattern[1 : pattern.index(")")].split("|")
            pattern, to = "|".join(f"{m}(.*?){m}" for m in marks), "{1}{2}"
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('{', chr(92)).replace('}', '')}', 'g')"
    return rf"regexp_replace({x}, '^[\s\x0B\x{{0085}}\p{{Z}}]+|[\s\x0B\x{{0085}}\p{{Z}}]+$', '', 'g')"


def _snippet(x: str) -> str:
    clean = rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x0B\x{{0085}}\p{{Z}}]+', ' ', 'g'), ' ')"
    return f"CASE WHEN length({clean}) <= 240 THEN {clean} ELSE regexp_replace(substr({clean}, 1, 240), ' [^ ]*$', '') || ' ...' END"


CHUNKS = """chunks AS (
  SELECT doc_id AS vector_id, CAST(doc_id AS VARCHAR) AS chunk_id, source AS page_id, source AS title, lang AS section, lang || ' ' || source AS heading, 'Corpus > ' || source AS breadcrumb,
    source AS child_page, lang || ' team' AS owner, text, source || ' ' || lang || ' ' || lang || ' ' || source || ' Corpus > ' || source || CASE WHEN coalesce(text, '') <> '' THEN ' ' || text ELSE '' END AS page_text FROM documents
)"""
# The documents as they are after all changes: two in five renewed, two in five gone.
RENEWED = CHUNKS.replace("FROM documents", "FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 5 IN (1, 4) THEN 'renewed twice again ' || text ELSE text END AS text FROM documents WHERE doc_id % 5 NOT IN (2, 3))")
VECTORS = CHUNKS + ", vc AS (SELECT chunks.*, embedding FROM chunks LEFT JOIN embeddings ON vec_id = vector_id)"
QUESTIONS = "q AS (SELECT item_id AS qid, text AS question, text AS passage, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"
IP = "list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


def _bm25(source: str) -> str:
    """CTEs postings, corpus, terms over a source with vector_id and page_text."""
    return f"""toks AS (SELECT vector_id AS id, {_tok('page_text')} AS t FROM {source}),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
postings AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM postings, corpus GROUP BY term),
terms AS (SELECT term, df, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM raw) ELSE idf0 END AS idf FROM raw)"""


def _search(questions: str, k: int, name: str = "sparse") -> str:
    return f"""asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_tok('question')}) AS term FROM {questions}) GROUP BY ALL),
scored AS (SELECT qid, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM postings JOIN asked USING (term) JOIN terms USING (term), corpus GROUP BY qid, id),
{name} AS (SELECT * FROM (SELECT qid, id, bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) AS rank FROM scored WHERE bm25 > 0) WHERE rank <= {k})"""


def _dense(questions: str, source: str, key: str, k: int, name: str = "dense") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank
  FROM (SELECT qid, s.{key} AS id, {IP.format('s.embedding', 'x.embedding')} AS score FROM {questions} x, {source} s WHERE x.embedding IS NOT NULL AND s.embedding IS NOT NULL)) WHERE rank <= {k})"""


def _minmax(v: str, by: str) -> str:
    low, high = f"min({v}) OVER (PARTITION BY {by})", f"max({v}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {high} - {low} <= 1e-9 THEN CASE WHEN {v} > 0 THEN 1.0 ELSE 0.0 END ELSE ({v} - {low}) / ({high} - {low}) END"


FUSED = f"""nd AS (SELECT qid, id, score, rank, {_minmax('score', 'qid')} AS nv FROM dense), ns AS (SELECT qid, id, bm25, rank, {_minmax('bm25', 'qid')} AS nv FROM sparse),
fused0 AS (SELECT coalesce(nd.qid, ns.qid) AS qid, coalesce(nd.id, ns.id) AS id, coalesce(score, 0.0) AS cosine, coalesce(bm25, 0.0) AS bm25, nd.rank AS dr, ns.rank AS sr,
  0.5 * coalesce(nd.nv, 0.0) + 0.5 * coalesce(ns.nv, 0.0) AS hybrid FROM nd FULL JOIN ns ON nd.qid = ns.qid AND nd.id = ns.id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(hybrid, 9) DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM fused0) WHERE rank <= 60)"""
HYBRID = f"WITH {VECTORS}, {QUESTIONS}, {_bm25('vc')}, {_search('q', 60)}, {_dense('q', 'vc', 'vector_id', 60)}, {FUSED}"


def _match(x: str) -> str:
    return f"CASE WHEN len(w) > 0 THEN len(list_intersect(w, list_distinct({_tok(x)}))) / len(w) ELSE 0.0 END"


def _phrase(x: str) -> str:
    return f"CASE WHEN trim(question, ' ') <> '' AND contains(lower(coalesce({x}, '')), lower(trim(question, ' '))) THEN 1.0 ELSE 0.0 END"


RERANKED = f"""{HYBRID},
cand AS (SELECT f.qid, f.id, f.hybrid, f.cosine, f.bm25, f.rank AS rank0, v.*, q.question, list_distinct({_tok('q.question')}) AS w FROM fused f JOIN vc v ON v.vector_id = f.id JOIN q ON q.qid = f.qid),
parts AS (SELECT *, hybrid AS s_embedding, 0.15 * {_match('title')} AS s_title, 0.20 * {_match('section')} AS s_section, 0.25 * {_match('heading')} AS s_heading, 0.05 * {_match('breadcrumb')} AS s_breadcrumb,
  0.20 * len(list_filter(w, lambda t: contains(lower(coalesce(text, '')), t))) / greatest(len(w), 1) AS s_keyword, 0.35 * {_phrase('text')} AS s_exact_phrase, 0.20 * {_phrase('child_page')} AS s_child_page, 0.15 * {_match('owner')} AS s_owner FROM cand),
total AS (SELECT *, s_embedding + s_title + s_section + s_heading + s_breadcrumb + s_keyword + s_exact_phrase + s_child_page + s_owner AS score FROM parts),
reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank0) AS rank FROM total)"""
RETRIEVED = f"""{RERANKED},
found AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank) AS rank FROM reranked WHERE score >= 0.4)"""
EVAL = f"""WITH e AS (SELECT vec_id, embedding, label FROM embeddings), q AS (SELECT vec_id AS qid, embedding, label FROM e WHERE vec_id % 20 = 0), {_dense('q', 'e', 'vec_id', 40)},
first AS (SELECT qid, CAST(id % 100 AS VARCHAR) AS page_id, min(rank) AS f FROM dense WHERE id <> qid GROUP BY ALL),
pages AS (SELECT qid, page_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY f) AS INTEGER) AS rank FROM first),
relevant AS (SELECT DISTINCT qid, CAST(e.vec_id % 100 AS VARCHAR) AS page_id FROM e JOIN q ON e.label = q.label WHERE e.vec_id <> qid)"""


def _metrics(questions: str = "q") -> str:
    """CTE per: the metrics of each question from pages(qid, page_id, rank) and relevant(qid, page_id)."""
    at = ", ".join(
        f"coalesce(t{k} / least({k}, n), 0.0) AS precision_at_{k}, coalesce(t{k} / n_rel, 0.0) AS recall_at_{k}, CASE WHEN t{k} > 0 THEN 1.0 ELSE 0.0 END AS hit_at_{k}" for k in (1, 3, 5)
    )
    return f"""hits AS (SELECT p.qid, p.rank, r.qid IS NOT NULL AS hit FROM pages p LEFT JOIN relevant r ON r.qid = p.qid AND r.page_id = p.page_id),
run AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank) AS so_far FROM hits),
sums AS (SELECT qid, count(*) AS n, {', '.join(f'count(*) FILTER (hit AND rank <= {k}) AS t{k}' for k in (1, 3, 5))}, min(rank) FILTER (hit) AS f, sum(so_far / rank) FILTER (hit) AS ap FROM run GROUP BY qid),
per AS (SELECT {questions}.qid, {at}, coalesce(1 / f, 0.0) AS mrr, coalesce(ap / n_rel, 0.0) AS map FROM {questions} LEFT JOIN sums USING (qid) LEFT JOIN (SELECT qid, count(*) AS n_rel FROM relevant GROUP BY qid) USING (qid))"""


_NAMES = [f"{m}_at_{k}" for k in (1, 3, 5) for m in ("precision", "recall", "hit")] + ["mrr", "map"]


def _keywords(x: str, k: int = 4) -> str:
    good = f"list_filter(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOPS}, lower(t)))"
    return f"list_filter({good}, lambda t, i: list_position(list_transform({good}, lambda y: lower(y)), lower(t)) = i)[1:{k}]"


_SYNTH = "SELECT i, 900001 + i AS page FROM range(40) r(i)"

ORACLES = {
    "tokenize_stats": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)",
    "word_count": r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars FROM documents",
    "snippet": f"SELECT doc_id, {_snippet('text')} AS snippet FROM documents",
    "html_strip_sql": r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g'), '(?is)<meta\b[^>]*>', '', 'g') AS s FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(s, chr(13), ''), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS stripped FROM a""",
    "normalize_field_name": rf"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({_strip("'**' || p_name || '** - ' || p_type")}), '[\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_') AS field,
  trim(regexp_replace({_strip("replace(' `' || p_name || '`<br/>[x](y) [z]() ![i]() `` __' || p_type || '__  ' || p_brand, '<br/>', ' ')")}, '\s+', ' ', 'g'), ' ') AS cell FROM part""",
    "bm25_term_stats": f"WITH {CHUNKS}, {_bm25('chunks')} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "reindexed_terms": f"WITH {RENEWED}, {_bm25('chunks')} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "reindexed_search": f"WITH {RENEWED}, {QUESTIONS}, {_bm25('chunks')}, {_search('q', 30)} SELECT qid, round(bm25, 6) AS score, count(*) AS documents, compacted FROM sparse, (VALUES (false), (true)) v(compacted) GROUP BY ALL",
    "bm25_topk": f"WITH {CHUNKS}, q AS (SELECT 0 AS qid, '{ONE_QUESTION}' AS question), {_bm25('chunks')}, {_search('q', 20)} SELECT id, round(bm25, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sparse",
    "bm25_batch": f"WITH {CHUNKS}, {QUESTIONS}, {_bm25('chunks')}, {_search('q', 30)} SELECT qid, id, round(bm25, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sparse",
    "dense_topk": f"SELECT e.vec_id AS id, round({IP.format('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {IP.format('e.embedding', 'q.embedding')} DESC, id LIMIT 20",
    "dense_topk_batch": f"WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 20 = 0), {_dense('q', 'embeddings', 'vec_id', 20)} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM dense",
    "minmax_norm": f"SELECT l_orderkey, l_linenumber, round({_minmax('l_extendedprice', 'l_orderkey')}, 6) AS norm FROM lineitem",
    "hybrid_fusion": f"{HYBRID} SELECT qid, id, round(cosine, 6) AS cosine_score, round(bm25, 6) AS bm25_score, round(hybrid, 6) AS hybrid_score, CAST(rank AS INTEGER) AS rank FROM fused",
    "rerank_breakdown": f"{RERANKED} SELECT qid, id, {', '.join(f'round(s_{k}, 6) AS s_{k}' for k in ('embedding', 'title', 'section', 'heading', 'breadcrumb', 'keyword', 'exact_phrase', 'child_page', 'owner'))}, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM reranked",
    "retrieve_filtered": f"{RETRIEVED} SELECT qid, chunk_id, round(score, 6) AS score, round(cosine, 6) AS embedding_score, CAST(rank AS INTEGER) AS rank FROM found",
    "citations": f"{RETRIEVED} SELECT qid, CAST(rank AS INTEGER) AS \"index\", chunk_id, page_id, section, round(cosine, 4) AS similarity, round(score, 4) AS rerank_score, round(bm25, 4) AS bm25_score, round(hybrid, 4) AS hybrid_score, {_snippet('text')} AS snippet FROM found WHERE rank <= 5",
    "context_block": f"""{RETRIEVED}, ctx AS (SELECT qid, string_agg(chr(10) || 'SOURCE ' || rank || chr(10) || chr(10) || 'Title:' || chr(10) || title || chr(10) || chr(10) || 'Section:' || chr(10) || section || chr(10) || chr(10) || 'Chunk ID:' || chr(10) || chunk_id || chr(10) || chr(10) || 'Content:' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY rank) AS c FROM found WHERE rank <= 5 GROUP BY qid)
SELECT qid, md5(c) AS context_md5, CAST(length(c) AS INTEGER) AS chars FROM ctx""",
    "answer_metrics": f"""{RETRIEVED}, m AS (SELECT qid, count(*) AS chunks_retrieved, count(*) FILTER (rank <= 5) AS chunks_used, max(round(cosine, 4)) FILTER (rank <= 5) AS top_similarity, round(avg(round(cosine, 4)) FILTER (rank <= 5), 4) AS avg_similarity, count(DISTINCT page_id) FILTER (rank <= 5) AS unique_pages FROM found GROUP BY qid)
SELECT *, CASE WHEN top_similarity >= 0.55 THEN 'HIGH' WHEN top_similarity >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM m""",
    "confidence_bucket": "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 8 >= 0.55 THEN 'HIGH' WHEN l_discount * 8 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM lineitem",
    "score_summary": f"""{RETRIEVED} SELECT qid, round(max(score), 5) AS max_score, round(min(score), 5) AS min_score, round(avg(score), 5) AS avg_score, round(median(score), 5) AS median_score, round(coalesce(stddev_samp(score), 0.0), 5) AS stdev_score, count(DISTINCT page_id) AS unique_pages, CAST(1 AS BIGINT) AS unique_parents, count(DISTINCT child_page) AS unique_children,
  CASE WHEN max(score) >= 0.85 THEN 'HIGH' WHEN max(score) >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM found GROUP BY qid""",
    "diagnostics": f"{RETRIEVED} SELECT qid, count(*) AS chunks, count(DISTINCT page_id) AS pages, round(avg(cosine), 6) AS avg_similarity, round(min(cosine), 6) AS min_similarity, count(*) FILTER (bm25 > 0) AS bm25_matches FROM found GROUP BY qid",
    "dedup_pages": f"{EVAL} SELECT qid, page_id, rank FROM pages",
    "precision_recall_hit": f"{EVAL}, {_metrics()} SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES if '_at_' in c)} FROM per",
    "mrr_map": f"{EVAL}, {_metrics()} SELECT qid, round(mrr, 6) AS mrr, round(map, 6) AS map FROM per",
    "eval_aggregate": f"{EVAL}, {_metrics()} SELECT count(*) AS num_questions, {', '.join(f'round(avg({c}), 4) AS {c}' for c in _NAMES)} FROM per",
    "context_sufficiency": f"""{RETRIEVED}, kw AS (SELECT qid, {_keywords('question')} AS k FROM q), blob AS (SELECT qid, lower(string_agg(coalesce(text, ''), ' ' || chr(10) || ' ' ORDER BY rank)) AS b FROM found WHERE rank <= 5 GROUP BY qid)
SELECT kw.qid, round(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: contains(coalesce(b, ''), lower(x)))) / len(k) ELSE 0.0 END, 6) AS context_sufficiency FROM kw LEFT JOIN blob USING (qid)""",
    "compare_dense_hybrid": f"""{HYBRID}, relevant AS (SELECT q.qid, CAST(vector_id AS VARCHAR) AS page_id FROM vc JOIN q ON contains(vc.text, q.passage)),
d_agg AS (WITH pages AS (SELECT qid, CAST(id AS VARCHAR) AS page_id, rank FROM dense WHERE rank <= 20), {_metrics()} SELECT {', '.join(f'round(avg({c}), 4) AS {c}' for c in _NAMES)} FROM per),
h_agg AS (WITH pages AS (SELECT qid, CAST(id AS VARCHAR) AS page_id, rank FROM fused), {_metrics()} SELECT {', '.join(f'round(avg({c}), 4) AS {c}' for c in _NAMES)} FROM per),
d AS (UNPIVOT d_agg ON {', '.join(_NAMES)} INTO NAME metric VALUE v), h AS (UNPIVOT h_agg ON {', '.join(_NAMES)} INTO NAME metric VALUE v)
SELECT metric, d.v AS dense, h.v AS hybrid, round(h.v - d.v, 4) AS delta FROM d FULL JOIN h USING (metric)""",
    "auto_bootstrap": f"""
WITH {CHUNKS}, p AS (SELECT page_id, min(vector_id) AS f, arg_min(title, vector_id) AS title FROM chunks GROUP BY page_id),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY starts) AS n FROM (SELECT page_id, section, min(vector_id) AS starts FROM chunks WHERE lower(trim(section)) NOT IN ('', 'document', 'overview') GROUP BY ALL)),
u AS (SELECT page_id, f, 0 AS n, 'What information does the ''' || title || ''' page provide?' AS question, title AS k FROM p
  UNION ALL SELECT page_id, f, n, 'What does the ''' || section || ''' section of ''' || title || ''' cover?', section || ' ' || title FROM s JOIN p USING (page_id) WHERE n <= 2)
SELECT printf('auto%03d', row_number() OVER (ORDER BY f, n)) AS id, question, page_id AS pages, array_to_string({_keywords('k')}, ',') AS keywords, 'auto' AS tag FROM u""",
    "golden_merge": """
WITH t AS (SELECT conv_id, turn, lower(trim(text, ' ')) AS q, conv_id % 7 AS p FROM conversations WHERE role = 'user'),
n AS (SELECT *, row_number() OVER (PARTITION BY q, p ORDER BY conv_id, turn) AS k FROM t WHERE q <> '')
SELECT conv_id, turn FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id % 3 = 0 AND t.q = n.q AND t.p = n.p)""",
    "chunk_validation": r"""
WITH c AS (SELECT conv_id || '_' || (turn % 6) AS chunk_id, conv_id, role, text, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS w, turn + 1 AS chunk_number,
  CASE WHEN conv_id % 10 <> 0 THEN max(turn) OVER (PARTITION BY conv_id) + 1 END AS total_chunks FROM conversations),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY chunk_number) AS n, count(*) OVER (PARTITION BY conv_id) AS t FROM c),
o AS (SELECT count(*) AS chunks, count(DISTINCT conv_id) AS pages, round(avg(w), 2) AS avg_words, CAST(min(w) AS INTEGER) AS min_words, CAST(max(w) AS INTEGER) AS max_words,
  CAST(sum((chunk_id IS NULL)::INT + (conv_id IS NULL)::INT + 2 * (role IS NULL)::INT + (text IS NULL)::INT + (chunk_number IS NULL)::INT + (total_chunks IS NULL)::INT) AS BIGINT) AS missing_fields,
  count(*) FILTER (trim(coalesce(text, ''), ' ') = '') AS empty_texts, count(*) FILTER (chunk_number IS DISTINCT FROM n OR total_chunks IS DISTINCT FROM t) AS numbering_errors,
  (SELECT count(*) FROM (SELECT chunk_id FROM c GROUP BY chunk_id HAVING count(*) > 1)) AS duplicate_ids FROM x)
SELECT *, CASE WHEN missing_fields + empty_texts + numbering_errors + duplicate_ids = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM o""",
    "md_line_spans": """
WITH t AS (SELECT doc_id, string_split(coalesce('| a |' || chr(10) || replace(text, ', ', chr(10) || '- '), ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS s, unnest(range(len(ls))) AS line FROM t),
k AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM l WHERE regexp_matches(s, '^\\s*([-*+]|\\d+\\.)\\s+') OR (starts_with(trim(s, ' '), '|') AND ends_with(trim(s, ' '), '|')))
SELECT doc_id AS page_id, CAST(min(line) AS INTEGER) AS first_line, CAST(max(line) AS INTEGER) AS last_line FROM k GROUP BY doc_id, g""",
    "corpus_summary": f"WITH {CHUNKS} SELECT page_id, arg_min(title, vector_id) AS title, 'LIVE' AS status, arg_min(owner, vector_id) AS owner, count(*) AS chunks FROM chunks GROUP BY page_id",
    "corpus_counts": "SELECT count(*) AS chunks, count(DISTINCT source) AS pages, count(*) > 0 AS index_ready FROM documents",
    "page_tree": """
WITH RECURSIVE a(page_id, title, parent_id, ord) AS (SELECT 'root', 'World', NULL, 0 UNION ALL SELECT 'r' || r_regionkey, r_name, 'root', r_regionkey FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, n_nationkey FROM nation),
t AS (SELECT page_id, title, parent_id, 0 AS level, lpad(CAST(ord AS VARCHAR), 10, '0') AS path FROM a WHERE parent_id IS NULL
  UNION ALL SELECT a.page_id, a.title, a.parent_id, t.level + 1, t.path || '/' || lpad(CAST(a.ord AS VARCHAR), 10, '0') FROM t JOIN a ON a.parent_id = t.page_id)
SELECT page_id, title, parent_id, level, path FROM t""",
    "page_urls": "SELECT p_partkey, 'https://wiki.example/w/' || replace(p_name, ' ', '_') AS url, 'https://wiki.example/w/api.php?curid=' || p_partkey AS api_url FROM part",
    "embedding_texts": f"""WITH {CHUNKS} SELECT vector_id, md5(regexp_replace(array_to_string([
  'Parent Page:' || chr(10) || repeat(' ', 8) || 'Corpus', 'Child Page:' || chr(10) || repeat(' ', 8) || child_page, 'Title:' || chr(10) || repeat(' ', 8) || title, 'Breadcrumb:' || chr(10) || repeat(' ', 8) || breadcrumb,
  'Section:' || chr(10) || repeat(' ', 8) || section, 'Owner:' || chr(10) || repeat(' ', 8) || owner, 'Status:' || chr(10) || repeat(' ', 8) || 'LIVE', 'Audience:' || chr(10) || repeat(' ', 8),
  'Content:' || chr(10) || repeat(' ', 8) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')], chr(10) || chr(10) || repeat(' ', 8)), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM chunks""",
    "ask_history_top": "SELECT event_id AS ask_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "collection_listing": """
SELECT n_name AS name, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS has_index, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS has_golden FROM nation
UNION ALL SELECT r_name, false, false FROM region""",
    "api_metadata": """
SELECT p_partkey, p_brand || ' > ' || p_type || ' > ' || p_name AS breadcrumb, '1,2' AS ancestor_ids, p_name AS title, p_brand AS space_key, p_type AS space_name, CAST(p_size AS VARCHAR) AS version, '2026-01-01' AS updated_at, '2025-01-01' AS created_at,
  p_brand || CASE WHEN p_size % 3 <> 0 THEN ' 0' ELSE ' 1' END AS created_by, 'https://wiki.example/pages/viewpage.action?pageId=' || p_partkey AS source_url FROM part""",
    "vector_ids": "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS vector_id FROM documents",
    "candidate_keys": "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS key FROM documents",
    "inline_sources": f"""{RETRIEVED} SELECT qid, string_agg('[' || rank || '] ' || title || ' § ' || section || ' (sim=' || CAST(CAST(round(cosine, 4) AS DECIMAL(10, 4)) AS DECIMAL(10, 2)) || ')', chr(10) ORDER BY rank) AS sources FROM found WHERE rank <= 5 GROUP BY qid""",
    "golden_from_ask": f"""
WITH g AS (SELECT lower(trim(text, ' ')) AS q, CAST(conv_id % 7 AS VARCHAR) AS p FROM conversations WHERE role = 'assistant'),
a AS (SELECT conv_id, turn, text, lower(trim(text, ' ')) AS q, CAST(conv_id % 7 AS VARCHAR) AS p, row_number() OVER (PARTITION BY lower(trim(text, ' ')), conv_id % 7 ORDER BY conv_id, turn) AS n FROM conversations WHERE role = 'user' AND trim(text, ' ') <> ''),
k AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS i FROM a WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM g WHERE g.q = a.q AND g.p = a.p))
SELECT printf('ask%03d', i + (SELECT count(*) FROM conversations WHERE role = 'assistant')) AS id, text AS question, p AS pages, array_to_string({_keywords('text')}, ',') AS keywords, 'from_ask' AS tag FROM k""",
    "eval_by_k": f"{EVAL}, {_metrics()}, g AS (SELECT {', '.join(f'round(avg({c}), 4) AS {c}' for c in _NAMES)} FROM per) " + " UNION ALL ".join(f"SELECT {k} AS k, precision_at_{k} AS precision, recall_at_{k} AS recall, hit_at_{k} AS hit FROM g" for k in (1, 3, 5)),
    "registry_changes": """
SELECT n_name AS name, CASE WHEN n_name = 'CANADA' THEN 'again' ELSE lower(n_name) END AS title, 'mediawiki' AS source, CASE WHEN n_name = 'CANADA' THEN '9' ELSE CAST(n_regionkey AS VARCHAR) END AS page_limit, CAST(NULL AS VARCHAR) AS token_env FROM nation WHERE n_name <> 'BRAZIL'
UNION ALL SELECT 'NEW', 'new', 'confluence', NULL, 'T' UNION ALL SELECT 'CANADA', 'again', 'mediawiki', '9', NULL WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'CANADA')""",
    "raw_sink": "SELECT page_id, url, md5(html) AS html_md5 FROM pages",
    "history_sink": "SELECT conv_id * 1000 + turn AS ask_id, text AS question FROM conversations WHERE role = 'user' ORDER BY ask_id DESC LIMIT 200",
    "sidecar_sink": "SELECT CAST(page_id AS VARCHAR) AS page_id, url, 'T ' || page_id AS title, CAST(length(html) AS INTEGER) AS chars FROM pages",
}

_CONTEXT = ORACLES["context_block"].split("SELECT qid, md5(c)")[0]
_ENDS = [x.replace("'", "''") for x in (f"{answer.INSTRUCTIONS}\n{answer.RULE}\n\nQUESTION\n\n", f"\n\n{answer.RULE}\n\nDOCUMENTATION\n\n", f"\n\n{answer.RULE}\n\nProvide your response in this format:\n\nAnswer:\n\nSources Used:\n")]
ORACLES |= {
    "tree_lines": ORACLES["page_tree"].replace("SELECT page_id, title, parent_id, level, path FROM t", "SELECT path, repeat('    ', level) || '- ' || title AS line FROM t"),
    "prompts": f"{_CONTEXT} SELECT qid, md5('{_ENDS[0]}' || question || '{_ENDS[1]}' || c || '{_ENDS[2]}') AS prompt_md5 FROM ctx JOIN q USING (qid)",
    "index_sink": ORACLES["bm25_term_stats"],
    "golden_sink": ORACLES["auto_bootstrap"],
    "results_sink": ORACLES["eval_aggregate"],
}

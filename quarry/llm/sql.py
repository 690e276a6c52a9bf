"""DuckDB SQL that gives the same rows as the queries."""

from quarry.llm.url_filter import SOFT, STRICT

_SPACE = r"[\x20\x09-\x0D]+"
_terms = lambda xs: ", ".join(f"('{x}')" for x in xs)

URLS = rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), ruled AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM parts JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), strict(t) AS (VALUES {_terms(STRICT)}), soft(t) AS (VALUES {_terms(SOFT)}), hit AS (
  SELECT p.page_id,
    (SELECT count(*) FROM strict WHERE regexp_matches(lower(p.url), '(^|[^\p{{L}}\p{{N}}])' || t || '($|[^\p{{L}}\p{{N}}])')) AS n_strict,
    (SELECT count(*) FROM soft WHERE regexp_matches(lower(p.url), '(^|[^\p{{L}}\p{{N}}])' || t || '($|[^\p{{L}}\p{{N}}])')) AS n_soft
  FROM parts p
)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, r.rule,
  coalesce(r.verdict, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n_strict AS INTEGER) AS strict_hits, CAST(n_soft AS INTEGER) AS soft_terms
FROM parts p LEFT JOIN ruled r USING (page_id) JOIN hit USING (page_id)
"""

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 6, 1))) AS i, words FROM t),
key AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM key) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
line AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (
  SELECT t.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, length(text) AS chars, 1 + length(text) - length(replace(text, chr(10), '')) AS lines
  FROM t JOIN line USING (doc_id) LEFT JOIN cov USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > n_words * 25 OR word_chars < n_words * 2 OR n_symbols > n_words * 0.1
    OR length(regexp_replace(text, '\P{{L}}+', '', 'g')) < word_chars * 0.5
    OR length(regexp_replace(text, '[^0-9]+', '', 'g')) > chars * 0.3
    OR length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > chars * 0.5
    OR len(regexp_extract_all(text, '(?m)^[\t ]*[-*\x{{2022}}]')) > 0.9 * lines
    OR len(regexp_extract_all(text, '(?m)(\.\.\.|\x{{2026}})[\t ]*$')) > 0.3 * lines
    OR contains(lower(text), 'lorem ipsum')) AS kept
FROM b
"""

SUBSTRINGS = rf"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM t)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM bad, range(13) r(j)),
rest AS (
  SELECT w.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN w.word END, ' ' ORDER BY w.i) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM t) w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN rest USING (doc_id)
"""

_esc = lambda x: f"replace(replace(replace({x}, chr(92), chr(92) || chr(92)), '###', chr(92) || '###'), '</turn>', chr(92) || '</turn>')"

CHATS = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, role AS r0, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, text) AS nth FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || replace({_esc('role')}, ':', chr(92) || ':') || ': ' || {_esc('text')} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

FIM = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
k AS (SELECT *, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2, CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

_FAN_LEVELS = 12  # 8 ** 12 leaves of a group; each level is one more pair of CTEs
_field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
_leaf = lambda text: f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _grown(name: str, level: int) -> str:
    """CTEs of the next level of trees: pos of every node there, from nodes (tree, pos, h) below; a tree of one node is at its top."""
    return f"""{name}{level + 1} AS MATERIALIZED (
  SELECT tree, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{level} WHERE tree IN (SELECT tree FROM {name}{level} WHERE pos = 1) GROUP BY tree, pos // 8)"""


def _ways(name: str, leaves: str) -> str:
    """Siblings left and right of every leaf, level by level: one row for each leaf and level that its tree has."""
    parts = [
        f"""SELECT l.tree, l.pos, {k} AS level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < l.pos // {8**k}), '') AS lft, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > l.pos // {8**k}), '') AS rgt
  FROM {leaves} l JOIN {name}{k} n ON n.tree = l.tree AND n.pos // 8 = l.pos // {8 ** (k + 1)} WHERE l.tree IN (SELECT tree FROM {name}{k} WHERE pos = 1) GROUP BY l.tree, l.pos"""
        for k in range(_FAN_LEVELS)
    ]
    return "\n  UNION ALL ".join(parts)


_tops = lambda name: " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE tree NOT IN (SELECT tree FROM {name}{k} WHERE pos = 1)" for k in range(_FAN_LEVELS + 1))

MERKLE = f"""
WITH crc(t) AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, b)) AS t),
keyed AS (SELECT doc_id, lang, {_leaf('text')} AS leaf,
  CASE WHEN xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
    lambda c, x: xor(t[1 + CAST(xor(c, x) & 255 AS INTEGER)], c >> 8), 4294967295), 4294967295) % 3 = 0
  THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS other FROM documents, crc),
base AS (SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM keyed),
n0 AS MATERIALIZED (SELECT tree, pos, leaf AS h FROM base),
{", ".join(_grown("n", k) for k in range(_FAN_LEVELS))},
sub AS MATERIALIZED ({_tops("n")}),
u0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h FROM sub),
{", ".join(_grown("u", k) for k in range(_FAN_LEVELS))},
root AS ({_tops("u")}),
low AS ({_ways("n", "n0")}),
high AS ({_ways("u", "u0")}),
steps AS (SELECT tree, pos, level, lft, rgt FROM low UNION ALL SELECT b.tree, b.pos, 100 + g.level, g.lft, g.rgt FROM base b JOIN high g ON g.pos = b.tree - 1),
way AS (SELECT tree, pos, list([lft, rgt] ORDER BY level) AS w, string_agg(lft || rgt, '' ORDER BY level) AS siblings FROM steps GROUP BY tree, pos),
done AS (SELECT b.doc_id, b.leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, list_reduce(coalesce(w, []), lambda now, s: [sha256(s[1] || now[1] || s[2])], [b.other])[1] AS folded_root
  FROM base b JOIN sub ON sub.tree = b.tree CROSS JOIN root LEFT JOIN way ON way.tree = b.tree AND way.pos = b.pos)
SELECT *, folded_root = root AS verified FROM done
"""

ORACLES = {"op11_merkle_coordinate_proofs": MERKLE, "op12_reply_trees": CHATS, "op13_parallel_automaton": FIM, "op10_prefix_suffix_trees": SUBSTRINGS, "op6_url_vocabulary": URLS, "op7_quality_cascade": QUALITY}

"""SQL twins of text operators."""

from eventfold.llm.lines import ENDINGS, PHRASE_WORDS, PHRASES, SEPARATORS, SYMBOLS

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _any_end(word: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with({word}, '{m}')" for m in marks) + ")"


LINES_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), base AS (
  SELECT r, doc_id, text, {_WORDS.format("text")} AS words FROM docs
), split AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM base
), lines AS (
  SELECT r, no, line, {_WORDS.format("line")} AS w FROM split WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), judged AS (
  SELECT r, line, w, row_number() OVER (PARTITION BY r, line ORDER BY no) > 1 AS again, len(w) AS n,
         len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) AS seps,
         len(list_filter(w, lambda x: {_any_end("x", SYMBOLS)})) AS marks,
         len(list_filter(w, lambda x: {_any_end("x", ENDINGS)})) AS sentence_ends,
         ({" OR ".join(f"contains(lower(line), '{p}')" for p in PHRASES)}) AS phrase
  FROM lines
), ruled AS (
  SELECT *, CASE WHEN seps >= 2 AND 5 * seps >= n THEN 'navigation'
                 WHEN n <= {PHRASE_WORDS} AND phrase THEN 'boilerplate'
                 WHEN 10 * marks >= 3 * n OR sentence_ends = 0 THEN 'punctuation' END AS rule
  FROM judged
), by_doc AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines,
         count(*) FILTER (rule = 'punctuation') AS n_punctuation,
         count(*) FILTER (rule = 'navigation') AS n_navigation,
         count(*) FILTER (rule = 'boilerplate') AS n_boilerplate,
         coalesce(sum(length(array_to_string(w, ''))) FILTER (rule IS NOT NULL), 0)::BIGINT AS lost_chars
  FROM ruled GROUP BY r
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) >= 8)
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, range(8) AS s(k) GROUP BY r
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_punctuation, 0) AS n_punctuation,
         coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate,
         coalesce(lost_chars, 0) AS lost_chars
  FROM base LEFT JOIN by_doc USING (r) LEFT JOIN covered c USING (r)
)
SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
       NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND lost_chars * 100 <= word_chars * 30 AS kept
FROM counts
"""

DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), occurrences AS (
  SELECT r, lang, source, unnest(words) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON (c.lang = g.lang AND c.source = g.source AND c.term = k.term)
), shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 1)) // (sum(lang_n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS q
  FROM dense
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM groups a JOIN groups b ON (a.lang = b.lang AND a.source <> b.source)
  LEFT JOIN shares x ON (x.lang = a.lang AND x.source = a.source)
  LEFT JOIN shares y ON (y.lang = b.lang AND y.source = b.source AND y.term = x.term)
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

TOPK_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id,
       row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)::INTEGER AS rank,
       c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM vectors q JOIN vectors c ON q.r <> c.r WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
"""

INFILL_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
         ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4
  FROM docs
), formed AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
         greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS head,
         array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS tail
  FROM formed
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from marlspike.llm import licenses

HOST_RULES = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM base
), placed AS (
  SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM tokens WHERE len(words) >= 8
), windows AS (
  SELECT r, i, array_to_string(words[i : i + 7], chr(1)) AS w FROM placed
), twice AS (
  SELECT r, w FROM windows GROUP BY r, w HAVING count(*) > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest(range(0, 8)) AS p FROM windows SEMI JOIN twice USING (r, w)) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
  SELECT t.doc_id, t.source, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(l.lines, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM tokens t LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
), rules AS (
  SELECT source, unnest(['base', 'few_words', 'repeats', 'symbols', 'dup_lines', 'word_length']) AS rule,
    unnest([base_failed, n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS failed
  FROM judged
), hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM rules GROUP BY ALL
), prior AS (
  SELECT rule, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 AS between_hosts, (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS noise FROM hosts GROUP BY rule
), strength AS (
  SELECT rule, mean, CASE WHEN between_hosts > noise THEN least(greatest((mean * (1 - mean) - between_hosts) / (between_hosts - noise), 1.0), 1e6) ELSE 1e6 END AS s FROM prior
), rates AS (
  SELECT source, rule, n, s, mean, (k + mean * s) / (n + s) AS rate FROM hosts JOIN strength USING (rule)
), against AS (
  SELECT source, rule, rate - 2.326 * sqrt(rate * (1 - rate) / (n + s + 1)) > least(3 * mean, (1 + mean) / 2) AS speaks FROM rates
), verdicts AS (
  SELECT source, count(*) FILTER (WHERE speaks AND rule IN ('base', 'few_words', 'repeats')) > 0 OR count(*) FILTER (WHERE speaks AND rule IN ('symbols', 'dup_lines', 'word_length')) > 1 AS rejected FROM against GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept, n_lines
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""

# base32 of a SHA-1: five hex digits are four characters
WARC = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex) AS winner,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, (i // 4 * 5 + 1)::INTEGER, 5))::INTEGER >> (15 - i % 4 * 5)::INTEGER) % 32 + 1, 1)), '') AS payload_digest
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN winner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN winner <> page_id THEN winner END AS refers_to FROM named
"""



def _licenses() -> str:
    """Every template at every place of its key phrase, scored by the words that stand at their places there."""
    templates = ", ".join(f"({t}, '{label}', '{' '.join(words)}', {[' '.join(phrase) for _, phrase in keys]})" for t, (label, words, keys) in enumerate(licenses.INDEX))
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.PHRASES.items())
    return f"""
WITH documents_ AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), placed AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS at FROM documents_
), templates AS (SELECT t, label, string_split(wording, ' ') AS words, keys FROM (VALUES {templates}) x(t, label, wording, keys)
), posting AS (SELECT t, unnest(words) AS word, unnest(range(len(words))) AS place FROM templates
), idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / ((SELECT count(DISTINCT r) FROM placed p WHERE p.word = v.word) + 0.5)) AS idf FROM (SELECT DISTINCT word FROM posting) v
), totals AS (SELECT t, sum(idf) AS total FROM posting JOIN idf USING (word) GROUP BY t
), split AS (SELECT t, label, words, k, string_split(keys[k], ' ') AS phrase, len(keys) AS n FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS k FROM templates)
), first AS (SELECT t, label, k, n, phrase, list_filter(range(len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)[1] AS at FROM split
), keyed AS (SELECT p.r, f.t, f.label, p.at - f.at AS shift FROM placed p JOIN first f ON p.word = f.phrase[1] JOIN documents_ d ON d.r = p.r WHERE d.words[p.at + 1 : p.at + len(f.phrase)] = f.phrase GROUP BY ALL HAVING count(DISTINCT k) = any_value(n)
), shares AS (SELECT k.r, k.t, k.label, k.shift, sum(idf) / any_value(total) AS share FROM keyed k JOIN posting g USING (t) JOIN placed p ON p.r = k.r AND p.at = k.shift + g.place AND p.word = g.word JOIN idf ON idf.word = g.word JOIN totals ON totals.t = k.t GROUP BY ALL
), found AS (SELECT r, list(DISTINCT label) AS more, least(1.0, max(share)) AS share FROM shares WHERE least(1.0, share) >= {licenses.LEAST_SCORE} GROUP BY r
), phrases AS (SELECT string_split(phrase, ' ') AS phrase, label FROM (VALUES {phrases}) x(phrase, label)
), base AS (SELECT p.r, count(*) AS n, min(p.at) AS first_word, max(p.at) AS last_word, list(DISTINCT label) AS labels FROM placed p JOIN phrases ON p.word = phrase[1] JOIN documents_ d ON d.r = p.r WHERE d.words[p.at + 1 : p.at + len(phrase)] = phrase GROUP BY p.r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels, round(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END, 9)::DOUBLE AS score
FROM documents_ LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""


SUBSTRINGS = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS w FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM base WHERE len(words) >= 50)
), owners AS (
  SELECT w, min(doc_id) AS owner FROM windows GROUP BY w
), lost AS (
  SELECT r, list_distinct(flatten(list(range(i, i + 50)))) AS places FROM windows JOIN owners USING (w) WHERE doc_id > owner GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_select(words, list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)))) END, ' ')) AS kept_sha256
FROM base LEFT JOIN lost USING (r)
"""


# components are whole numbers in doubles, so that sums are exact
NEGATIVES = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (
  SELECT * FROM vectors WHERE vec_id % 100 = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score FROM anchors a, vectors v
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""


# crc32 bit by bit; a prefix is named by the digest of its turns' digests
PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), parts AS (
  SELECT c.conv_id, 0 AS part, k, turn, len FROM convs c JOIN own ON own.conv_id = c.base AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, turn, len FROM convs c JOIN own ON own.conv_id = c.conv_id AND k > h
), placed AS (
  SELECT conv_id, row_number() OVER w AS depth, len, md5(string_agg(turn, ',') OVER w) AS prefix, lag(1) OVER (PARTITION BY conv_id ORDER BY part DESC, k DESC) IS NULL AS is_last
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
), members AS (
  SELECT conv_id, depth, len, prefix, coalesce(lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent, is_last FROM placed
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL, NOT EXISTS (SELECT 1 FROM placed p WHERE p.conv_id = convs.conv_id) FROM convs
), nodes AS (
  SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(len) AS saved,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE is_last), '')) AS ends_sha256 FROM members GROUP BY prefix
), children AS (
  SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT top, count(*) FILTER (WHERE n IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT DISTINCT a.prefix AS top, b.prefix AS prefix FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth) JOIN nodes USING (prefix) LEFT JOIN children ON children.parent = nodes.prefix GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.top = n.prefix LEFT JOIN nodes p ON p.prefix = n.parent LEFT JOIN children c ON c.parent = n.prefix
"""


SQL: dict[str, str] = {"op4_warc": WARC, "op6_host_rules": HOST_RULES, "op8_licenses": _licenses(), "op11_substrings": SUBSTRINGS, "op12_negatives": NEGATIVES, "op13_prefix_trie": PREFIX_TRIE}

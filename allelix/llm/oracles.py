"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

# [\x20\x09-\x0D] as characters
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, {_WS}), {_UPPER}) AS key FROM l),
shared AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(k.doc_id <> s.keeper, false) AS gone FROM k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUALITY_RULES = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split(translate(coalesce(text, ''), {_WS}, '      '), ' '), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WS}) <> '') AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i,
             unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS win
      FROM w WHERE len(words) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM h, (VALUES (0), (1), (2)) o(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
         + 4 * (100 * n_symbols > 5 * word_chars)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
         + 16 * (word_chars < 2 * n_words OR word_chars > 30 * n_words)::BIGINT
         + 32 * (100 * n_upper > 60 * word_chars)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, f, substr(h, 2 * f + 1, 498) AS part  -- 200 starts each
      FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 200)) AS f FROM d)),
w AS (SELECT doc_id, f + s AS s, md5_number(substr(part, 2 * s + 1, 100)) AS k
      FROM (SELECT doc_id, f, part, unnest(range(length(part) // 2 - 49)) AS s FROM p)),
least AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT w.doc_id, w.s FROM w JOIN least ON w.k = least.k WHERE w.doc_id > least.m),
edges AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh
          FROM gone),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS z
         FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM edges) GROUP BY doc_id, g),
cut AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM runs
        UNION ALL SELECT d.doc_id, coalesce(max(r.z), 0), length(any_value(d.h)) // 2
        FROM d LEFT JOIN runs r ON d.doc_id = r.doc_id GROUP BY d.doc_id),
kept AS (SELECT cut.doc_id, string_agg(substr(d.h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS h
         FROM cut JOIN d ON cut.doc_id = d.doc_id GROUP BY cut.doc_id),
n AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n.removed, 0)::BIGINT AS n_removed,
       coalesce(n.spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

MINHASH_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(translate(translate(coalesce(text, ''), {_UPPER}), {_WS}, '      '), ' '),
                             lambda x: x <> '') AS words
  FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 1 THEN [words[1]] ELSE [words[i], words[i + 1]] END AS sh
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0)),
s AS (SELECT DISTINCT doc_id, sh FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh
      WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM b JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
      WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a
"""

# crc32 has no function: its table by rule, then a fold over a word's bytes (a hex digit pair each)
IMPORTANCE_RESAMPLE = f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
      FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS w FROM d),
s AS (SELECT w, count(*) AS n FROM f GROUP BY w),
t AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM q) GROUP BY w),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM s UNION SELECT w FROM t)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
               lambda i: (position(h[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(h[2 * i + 2] IN '0123456789ABCDEF') - 1)),
               lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, crc),
sb AS (SELECT bucket, sum(n) AS n FROM s JOIN b ON s.w = b.w GROUP BY bucket),
tb AS (SELECT bucket, sum(n) AS n FROM t JOIN b ON t.w = b.w GROUP BY bucket),
g AS (SELECT sb.bucket, floor(1000 * ln((coalesce(tb.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
             / ((sb.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM sb LEFT JOIN tb ON sb.bucket = tb.bucket),
m AS (SELECT doc_id, sum(gain) AS total, count(*) AS n FROM f JOIN b ON f.w = b.w JOIN g ON b.bucket = g.bucket GROUP BY doc_id),
h AS (SELECT d.doc_id, len(d.w) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20)
SELECT o.doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank
FROM o LEFT JOIN r ON o.doc_id = r.doc_id
"""

PHRASE_MINING = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split(translate(translate(coalesce(text, ''), {_UPPER}), ',;:!?' || chr(10) || chr(11) || chr(12) || chr(13),
                             '.........'), '.')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) o(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, phrase, a, words, i, array_to_string(words[:i], ' ') AS head, array_to_string(words[i + 1:], ' ') AS rest
        FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT cut.lang, phrase, a, i, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
      FROM cut JOIN (SELECT lang, phrase AS head, f FROM f) x ON cut.lang = x.lang AND cut.head = x.head
      JOIN (SELECT lang, phrase AS rest, f FROM f) y ON cut.lang = y.lang AND cut.rest = y.rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
sub AS (SELECT lang, part, max(a) AS a FROM (
          SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS part FROM c WHERE k = 3)
        GROUP BY lang, part),
kept AS (SELECT low.* FROM low LEFT JOIN sub ON low.lang = sub.lang AND low.phrase = sub.part
         WHERE sub.a IS NULL OR 100 * sub.a < 50 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a,
       l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n ON kept.lang = n.lang
QUALIFY rank <= 2000
"""

RELATIVE_PARSE = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), {_WS}, '      '), ' '), lambda x: x <> '') AS words
  FROM documents),
w AS (SELECT doc_id, i, md5_number(array_to_string(words[i:i + 12], ' ')) AS k
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT w.doc_id, w.i + j AS i FROM w JOIN least ON w.k = least.k, range(13) r(j) WHERE w.doc_id > least.m),
x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS text FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i
         GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n.removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

ORACLES = {
    "op3_suffix_dedup": SUFFIX_DEDUP,
    "op4_line_dedup": LINE_DEDUP,
    "op6_minhash_dedup": MINHASH_DEDUP,
    "op10_quality_rules": QUALITY_RULES,
    "op11_importance_resample": IMPORTANCE_RESAMPLE,
    "op12_phrase_mining": PHRASE_MINING,
    "op13_relative_parse": RELATIVE_PARSE,
}

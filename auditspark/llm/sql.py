"""DuckDB SQL of the queries that it can express."""

OP8 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM t),
s AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        md5(concat(coalesce(length(role)::VARCHAR, 'n'), ':', coalesce(role, ''), coalesce(length(text)::VARCHAR, 'n'), ':', coalesce(text, ''))) AS one,
        '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line FROM p),
x AS (SELECT conv_id, pos, n_turns, string_agg(one, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM s),
w AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM x WHERE pos = n_turns GROUP BY ALL),
k AS (SELECT conv_id, n_copies FROM w WHERE prefix NOT IN (SELECT prefix FROM x WHERE pos < n_turns))
SELECT s.conv_id, s.n_turns, k.n_copies, string_agg(s.line, '' ORDER BY s.pos) AS rendered, length(string_agg(s.line, '' ORDER BY s.pos)) AS n_chars
FROM s JOIN k ON s.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""

OP9 = r"""
WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM z),
c AS (SELECT *, [3.0, 1.0, 2.0][1 + (ord - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
        1.5::DOUBLE * sum(source_size) OVER () AS budget FROM o),
v AS (SELECT *, sum(w) OVER () AS all_w, sum(cap) OVER u AS cap_upto, sum(w) OVER u AS w_upto FROM c WINDOW u AS (ORDER BY cap / w, ord ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, max((budget - (cap_upto - cap)) / (all_w - (w_upto - w))) OVER () AS level FROM v),
t AS (SELECT source, source_size, least(cap, w * level) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(target - whole * source_size, 0.0) AS rest FROM f),
g AS (SELECT source, h, sum(size)::BIGINT AS s, count(*) AS alike FROM r GROUP BY source, h),
e AS (SELECT g.*, q.rest, sum(s) OVER (PARTITION BY g.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, max(h) AS threshold, arg_max(CASE WHEN upto < rest THEN alike ELSE floor((rest - (upto - s)) / (s / alike) + 0.5)::BIGINT END, h) AS fit
      FROM e WHERE rest > 0 AND upto - s < rest GROUP BY source),
n AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS nth FROM r)
SELECT n.doc_id, n.size, q.source_size, q.target, (q.whole + CASE WHEN n.h < b.threshold OR n.h = b.threshold AND n.nth <= b.fit THEN 1 ELSE 0 END) * n.size AS taken
FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON n.source IS NOT DISTINCT FROM b.source
"""

OP10 = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT row_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS s
      FROM (SELECT row_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
p AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.row_id != y.row_id GROUP BY ALL),
l AS (SELECT a, b, k = na.n AND k = nb.n AS same FROM p JOIN n na ON na.row_id = a JOIN n nb ON nb.row_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(w.doc_id, (SELECT min(o.doc_id) FROM reach JOIN w o ON o.row_id = reach.b WHERE reach.a = w.row_id)) AS component_id,
       least(w.doc_id, (SELECT min(o.doc_id) FROM l JOIN w o ON o.row_id = l.b WHERE l.a = w.row_id AND l.same)) AS class_id
FROM w LEFT JOIN n ON n.row_id = w.row_id
"""

OP11 = r"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT row_id, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
n AS (SELECT row_id, sum(tf)::BIGINT AS n FROM f GROUP BY row_id),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * c.n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, c.n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT q.item_id, f.row_id, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + (50 * n.n * c.n_docs) // c.n_terms))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN n ON n.row_id = f.row_id, c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT row_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
a AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT row_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM a) GROUP BY row_id),
l AS (SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
m AS (SELECT d.row_id, d.doc_id, d.lang, md5(d.text) AS key, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
        coalesce(l.n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
        length(regexp_replace(text, '[^!"''()+,\-./:;=?@\[\\\]^_`{}~]', '', 'g')) AS n_marks
      FROM d LEFT JOIN r USING (row_id) LEFT JOIN l USING (row_id)),
v AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % 5 AS fold, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        [least(1000, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0)), least(1000, coalesce(1000 * n_capitals // nullif(word_chars, 0), 0)),
         least(1000, coalesce(1000 * n_marks // nullif(word_chars, 0), 0)), least(1000, coalesce(1000 * n_digits // nullif(word_chars, 0), 0)),
         least(1000, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0)), least(1000, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)),
         least(1000, coalesce(10 * word_chars // nullif(n_words, 0), 0))]::BIGINT[] AS vs FROM m),
b AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
s AS (SELECT lang, key, fold, vs, min(b.quality) AS quality FROM v JOIN b USING (doc_id) WHERE NOT base_failed AND fold <> 0 GROUP BY ALL),
p AS (SELECT lang, vs, unnest(range(1, 8)) AS rule FROM s WHERE fold = 1 AND quality = 1),
h AS (SELECT lang, rule, vs[rule] AS x, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT lang, rule, x, sum(n) OVER (PARTITION BY lang, rule) AS total, sum(n) OVER (PARTITION BY lang, rule) - sum(n) OVER (PARTITION BY lang, rule ORDER BY x) AS above FROM h),
e AS (SELECT lang, level, rule, min(x) AS c FROM o, (SELECT unnest([0, 1, 2, 5, 10, 20, 50]) AS level) WHERE above * 1000 <= level * total GROUP BY ALL),
c0 AS (SELECT lang, level, list(c ORDER BY rule) AS cs FROM e GROUP BY ALL),
bad AS (SELECT s.lang, c0.level, list_sum(list_transform(range(1, 8), lambda i: CASE WHEN s.vs[i] > c0.cs[i] THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS mask
        FROM s JOIN c0 ON s.lang IS NOT DISTINCT FROM c0.lang WHERE s.fold = 1 AND s.quality = 0),
sets AS (SELECT lang, level, u.u AS used, count(*) FILTER (mask & u.u <> 0) AS caught FROM bad, range(128) u(u) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, level ORDER BY caught DESC, bit_count(used), used) AS i FROM sets),
c AS (SELECT c0.lang, c0.level, list_transform(range(1, 8), lambda i: CASE WHEN coalesce(b.used, 0) & (1 << (i - 1)) <> 0 THEN c0.cs[i] END) AS cs
      FROM c0 LEFT JOIN (SELECT * FROM best WHERE i = 1) b ON c0.lang IS NOT DISTINCT FROM b.lang AND c0.level = b.level),
t AS (SELECT s.lang, c.level, c.cs, s.fold, s.quality, len(list_filter(range(1, 8), lambda i: s.vs[i] > c.cs[i])) > 0 AS rejected FROM s JOIN c ON s.lang IS NOT DISTINCT FROM c.lang),
k AS (SELECT lang, level, cs, count(*) FILTER (quality = 1 AND fold <> 1) AS n, count(*) FILTER (quality = 1 AND fold <> 1 AND rejected) AS x, count(*) FILTER (quality = 0 AND fold = 1 AND rejected) AS gain FROM t GROUP BY ALL),
z AS (SELECT greatest(1, count(*)) AS n_strata FROM (SELECT DISTINCT lang FROM c)),
y AS (SELECT k.*, n > 0 AND (x >= n OR list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) <= 0.05 / z.n_strata) AND x < n AS ok FROM k, z),
f AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY level) AS so_far FROM y),
w AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, level) AS i FROM f WHERE so_far),
j AS (SELECT v.*, array_to_string(list_transform(list_filter(range(1, 8), lambda i: v.vs[i] > w.cs[i]), lambda i: ['symbols', 'capitals', 'marks', 'digits', 'dup_lines', 'repeats', 'word_length'][i]), ',') AS failed
      FROM v LEFT JOIN (SELECT * FROM w WHERE i = 1) w ON v.lang IS NOT DISTINCT FROM w.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(failed, '') = '' AS kept, coalesce(failed, '') AS failed_rules, fold = 0 AS held_out FROM j
"""

SQL = {"op8_chat_formatting": OP8, "op9_mixing": OP9, "op10_jaccard": OP10, "op11_lexical": OP11, "op12_quality_rules": OP12}

"""DuckDB twins of the training-data queries where SQL expresses them."""

from longfeat.llm import licenses

WHITE = r"[\x20\x09-\x0D]"

#: Conversations as lists of their turns, each turn the sorted list of its rows.
SNAPSHOTS = """
WITH turns AS (
  SELECT conv_id, turn, list_sort(list({'role': role, 'text': text})) AS said
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), whole AS (
  SELECT conv_id, list({'turn': turn, 'said': said} ORDER BY turn NULLS FIRST) AS all_turns FROM turns GROUP BY conv_id
), retained AS (
  SELECT conv_id FROM whole x WHERE NOT EXISTS (
    SELECT 1 FROM whole y
    WHERE y.all_turns[1] IS NOT DISTINCT FROM x.all_turns[1] AND y.conv_id <> x.conv_id
      AND y.all_turns[1:len(x.all_turns)] = x.all_turns
      AND (len(y.all_turns) > len(x.all_turns) OR y.conv_id < x.conv_id)
  )
)
SELECT conv_id, turn, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM conversations WHERE conv_id IN (SELECT conv_id FROM retained)
"""

LINES = rf"""
WITH rows AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT row, doc_id, place, line,
    translate(regexp_replace(regexp_replace(line, '^{WHITE}+', ''), '{WHITE}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM rows)
),
first AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key HAVING min(doc_id) < max(doc_id)
),
judged AS (SELECT l.*, coalesce(l.doc_id > f.first, false) AS gone FROM lines l LEFT JOIN first f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row
"""

#: The distinct strings of 50 words, and the words under those that start earlier too.
WORD_WINDOWS = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)
),
late AS (SELECT w.doc_id, w.i FROM windows w JOIN (SELECT k, min(doc_id) AS first FROM windows GROUP BY k) f USING (k) WHERE w.doc_id > f.first),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT x.doc_id, count(c.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL) AS text,
    count(*) FILTER (WHERE c.p IS NOT NULL AND b.p IS NULL) AS n_spans
  FROM words x LEFT JOIN covered c ON c.doc_id = x.doc_id AND c.p = x.p LEFT JOIN covered b ON b.doc_id = x.doc_id AND b.p = x.p - 1
  GROUP BY x.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256,
  coalesce(n_spans, 0) AS n_spans
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

SHINGLES = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m USING (doc_id)
"""

#: Every place of every template by joining all its words; base phrases need all of them.
_TEMPLATES = ", ".join(
    f"({k}, '{t.label}', {t.base}, {i}, '{w}', {i in t.mandatory()})"
    for k, t in enumerate([*licenses.BASE, *licenses.NOTICES])
    for i, w in enumerate(t.words)
)
LICENSES = rf"""
WITH templates(template, label, base, rank, word, must) AS (VALUES {_TEMPLATES}),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
words AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
weights AS (
  SELECT word, ln(1 + (SELECT count(*) FROM docs) / (1 + count(DISTINCT row))) + 1e-6 AS weight
  FROM (SELECT DISTINCT word FROM templates) LEFT JOIN words USING (word) GROUP BY word
),
totals AS (SELECT template, sum(weight) AS total, count(*) FILTER (WHERE must) AS needed FROM templates JOIN weights USING (word) GROUP BY template),
stands AS (
  SELECT row, template, any_value(label) AS label, any_value(base) AS base, i - rank AS start, sum(weight) / any_value(total) AS share
  FROM words JOIN templates USING (word) JOIN weights USING (word) JOIN totals USING (template)
  GROUP BY row, template, i - rank HAVING count(*) FILTER (WHERE must) = any_value(needed) AND sum(weight) / any_value(total) >= {licenses.SHARE}
),
found AS (
  SELECT row, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(share) AS score
  FROM stands GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(round(score, 6), 0) AS score
FROM docs LEFT JOIN found USING (row)
"""

MIDDLES = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
numbers AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn
),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
),
parts AS (
  SELECT *, '<P>' || substring(text, 1, a) AS prefix, '<M>' || substring(text, a + 1, b - a) AS middle, '<S>' || substring(text, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN prefix || suffix || middle ELSE suffix || prefix || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

#: Byte windows as pairs of hexadecimal digits; touching spans are one.
BYTE_WINDOWS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (
  SELECT doc_id, base, substring(h, 2 * base + 1, 698) AS part
  FROM docs, unnest(range(0, length(h) // 2, 300)) AS t(base) WHERE doc_id IS NOT NULL),
windows AS (
  SELECT doc_id, base + i AS a, hash(substring(part, 2 * i + 1, 100)) AS k1, md5_number_lower(substring(part, 2 * i + 1, 100)) AS k2
  FROM parts, unnest(range(0, least(300, greatest(length(part) // 2 - 49, 0)))) AS t(i)),
firsts AS (SELECT k1, k2, min(doc_id) AS first FROM windows GROUP BY k1, k2 HAVING min(doc_id) < max(doc_id)),
late AS (SELECT w.doc_id, w.a FROM windows w JOIN firsts f USING (k1, k2) WHERE w.doc_id > f.first),
marked AS (SELECT *, coalesce(a > lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 50, TRUE) AS new FROM late),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM marked),
spans AS (SELECT doc_id, run, min(a) AS a, max(a) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT s.doc_id, s.a, s.b, substring(h, 2 * coalesce(lag(s.b) OVER w, 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER w, 0))) AS passed
  FROM spans s JOIN docs USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.a)),
cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(passed, '' ORDER BY a) AS passed, max(b) AS stop
  FROM gaps GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(passed, '') || substring(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op2_relative_lempel_ziv": WORD_WINDOWS,
    "op4_snapshot_collapse": SNAPSHOTS,
    "op5_line_dedup": LINES,
    "op8_longest_previous_factor": BYTE_WINDOWS,
    "op10_parity_sketch_join": SHINGLES,
    "op11_rare_token_index": LICENSES,
    "op13_displacement_scatter": MIDDLES,
}

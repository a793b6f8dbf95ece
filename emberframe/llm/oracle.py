"""SQL equivalents of the text operators' queries, where SQL can express them."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_STOP = (
    "the of and to in a is that for on with as was be this are by or from at "
    "der die das und ist den von zu mit auf für im nicht ein eine dem des sich auch "
    "le la les de du et un une est en que dans pour par sur au qui plus pas "
    "el los las del y una es por con para se no al lo su")

OP5 = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM payloads)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM grouped
"""

OP8 = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
counts AS (
  SELECT doc_id, words, len(words) AS n_words, list_sum(list_transform(words, lambda w: length(w))) AS chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(words, lambda w: list_contains(string_split('{_STOP}', ' '), lower(w)))) AS n_stop
  FROM split),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM counts)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
judged AS (
  SELECT c.doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_lines, n_stop, coalesce(v.n, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(v.n, 0) > 50 * n_words AS base_failed
  FROM counts c LEFT JOIN covered v USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 20 AND n_symbols / greatest(n_words, 1) <= 0.1
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_stop / greatest(n_words, 1) >= 0.02 AS kept
FROM judged
"""

OP10 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * inter >= 80 * (p.n + q.n - inter)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.lowest AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS lowest FROM reach GROUP BY a) r USING (doc_id)
"""

OP11 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT doc_id, p, substring(x, 2 * p + 1, 1400) AS part FROM (SELECT *, unnest(range(0, len(x) // 2 - 199, 500)) AS p FROM texts)),
starts AS (SELECT *, unnest(range(0, least(500, len(part) // 2 - 199))) AS k FROM parts),
windows AS (SELECT doc_id, p + k AS i, md5(substring(part, 2 * k + 1, 400)) AS h FROM starts),
found AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT *, i - lag(i) OVER w > 200 AS gap FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY ALL),
edges AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM runs),
pieces AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
         string_agg(substring(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS kept
  FROM edges JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN pieces USING (doc_id)
"""

# crc32 as a fold: a byte is XOR-ed in, then eight shifts (-1) follow.
OP12 = """
WITH turns AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'digest': digest, 'size': size} ORDER BY turn NULLS FIRST, digest) AS seq FROM turns GROUP BY conv_id),
steps AS (
  SELECT *, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM own),
heads AS (
  SELECT conv_id, seq, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(s, lambda e: CAST(e AS BIGINT))),
         lambda crc, e: CASE WHEN e >= 0 THEN xor(crc, e) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) % 9 AS h FROM steps),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) AS seq
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
members AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS d, seq FROM rebuilt),
nodes AS (
  SELECT d, list_transform(seq[1:d], lambda t: t.digest) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(CASE WHEN d > 0 THEN seq[d].size ELSE 0 END) AS size,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY ALL),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT x.*, coalesce(c.n, 0) AS n_children FROM nodes x LEFT JOIN children c USING (path)),
below AS (SELECT path[1:k] AS path, n_children, (n_convs - 1) * size AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM below GROUP BY path)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM counted x JOIN sums s USING (path) LEFT JOIN nodes p ON x.d > 0 AND p.path = x.path[1:x.d - 1]
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13 = rf"""
WITH split AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT doc_id, len(terms) AS n, count(*) FILTER (len(terms) > 0) OVER () AS all_n, sum(len(terms)) OVER () AS all_l FROM split),
norms AS (SELECT doc_id, all_n, CAST(75 + (25 * n * all_n) // all_l AS BIGINT) AS m FROM sizes WHERE n > 0),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM split) GROUP BY ALL),
frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * all_n + 2) / (2 * df + 1))) AS BIGINT)
                                   * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN frequencies USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0) WHERE place <= 20
"""

ORACLES = {"op5_zstd_archives": OP5, "op8_quality_rules": OP8, "op10_ngram_jaccard": OP10, "op11_suffix_dedup": OP11, "op12_prefix_trie": OP12, "op13_lexical_search": OP13}

"""The SQL (DuckDB) for those queries of this package that SQL can express."""

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY norm)""",
    "op9_warc": """WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
best AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS top FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM best""",
    # The CRC goes bit by bit, lowest bit of each character first.
    "op11_prefix_trie": """WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(said ORDER BY place) AS said, CAST(conv_id AS VARCHAR) AS name FROM turns GROUP BY conv_id),
crc AS (
  SELECT *, xor(list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(range(1, length(name) + 1),
      lambda i: list_transform(range(0, 8), lambda b: CAST((ascii(substr(name, i, 1)) >> b) & 1 AS UBIGINT))))),
    lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 6 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (
  SELECT conv_id, depth, said[1:depth] AS prefix, len(said) = depth AS ends
  FROM (SELECT *, unnest(range(0, len(said) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM prefixes GROUP BY prefix, depth),
family AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children,
         (SELECT p.conv_id FROM nodes p WHERE p.depth = n.depth - 1 AND n.prefix[1:p.depth] = p.prefix) AS parent_conv_id
  FROM nodes n),
sums AS (
  SELECT above, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(prefix[depth].text) END) AS saved_tokens
  FROM (SELECT *, unnest(list_transform(range(0, depth + 1), lambda d: prefix[1:d])) AS above FROM family) GROUP BY above)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM family JOIN sums ON prefix = above""",
    # A repeat of more than 50 words is a window of 51 words found twice.
    "op12_quality": r"""WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split),
line_counts AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
  GROUP BY doc_id),
spots AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM split),
windows AS (
  SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, sha256(array_to_string(words[place:place + 7], ' '))) AS n
  FROM spots WHERE place + 7 <= len(words)),
inside AS (
  SELECT DISTINCT doc_id, unnest(range(place, place + 8)) AS place FROM windows WHERE n > 1),
covered AS (
  SELECT doc_id, count(*) AS n_repeat_words, sum(length(words[place])) AS covered_chars
  FROM inside JOIN split USING (doc_id) GROUP BY doc_id),
long_repeats AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, sha256(array_to_string(words[place:place + 50], ' ')) AS said
    FROM spots SEMI JOIN covered USING (doc_id) WHERE place + 50 <= len(words))
  GROUP BY doc_id, said HAVING count(*) > 1),
measured AS (
  SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(covered_chars, 0) AS BIGINT) AS covered_chars
  FROM split LEFT JOIN line_counts USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * covered_chars <= 25 * word_chars
       AND doc_id NOT IN (SELECT doc_id FROM long_repeats) AS kept
FROM measured""",
}

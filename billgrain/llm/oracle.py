"""The same results as SQL on the given tables, for the operators that SQL can express."""

from __future__ import annotations

from billgrain.llm.licenses import COPYRIGHT_LINE, KNOWN, SPELLINGS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    form = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    form = rf"(' ' || trim(regexp_replace({form}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"
    for other, usual in SPELLINGS:
        form = f"replace({form}, {_quoted(f' {other} ')}, {_quoted(f' {usual} ')})"
    return f"trim({form})"


OP9 = f"""
WITH known AS (
  SELECT DISTINCT license, md5({_canonical("notice")}) AS digest
  FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) AS t(license, notice)
), units AS (
  SELECT doc_id, 'document' AS scope, coalesce(text, '') AS unit FROM documents
  UNION ALL
  SELECT doc_id, 'line', unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
)
SELECT doc_id, license, scope, count(*) AS times
FROM units JOIN known ON md5({_canonical("unit")}) = digest
GROUP BY doc_id, license, scope
"""

_WATER = """
{name}_level AS (
  SELECT *, least(capacity, max(at_least) OVER (PARTITION BY {parents}) * weight) AS {name}_budget FROM (
    SELECT *, CASE WHEN sum(weight) OVER later > 0 THEN ({budget} - coalesce(sum(capacity) OVER earlier, 0)) / sum(weight) OVER later END AS at_least
    FROM {name}_nodes
    WINDOW earlier AS (PARTITION BY {parents} ORDER BY CASE WHEN weight > 0 THEN capacity / weight ELSE 'inf'::DOUBLE END, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           later AS (PARTITION BY {parents} ORDER BY CASE WHEN weight > 0 THEN capacity / weight ELSE 'inf'::DOUBLE END, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  )
)"""

OP3 = rf"""
WITH rows AS (
  SELECT doc_id, 'd' || (regexp_extract(source, '(\d+)$', 1)::INT % 4) AS domain, lang AS language, source AS origin,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM documents
), leaves AS (
  SELECT domain, language, origin, sum(tokens)::DOUBLE AS available, 2 * sum(tokens)::DOUBLE AS can FROM rows GROUP BY ALL
), root AS (SELECT least(sum(available) * 0.5, sum(can)) AS root_budget FROM leaves),
domain_nodes AS (
  SELECT domain, sum(can) AS capacity, any_value(root_budget) AS root_budget,
         CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 2.0 WHEN 'd2' THEN 1.0 ELSE 1.0 END::DOUBLE AS weight
  FROM leaves, root GROUP BY domain
), {_WATER.format(name="domain", parents="1", budget="root_budget")},
language_nodes AS (
  SELECT domain, language, sum(can) AS capacity, any_value(domain_budget) AS domain_budget,
         CASE language WHEN 'en' THEN 1.0 WHEN 'de' THEN 1.0 WHEN 'fr' THEN 1.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM leaves JOIN domain_level USING (domain) GROUP BY domain, language
), {_WATER.format(name="language", parents="domain", budget="domain_budget")},
origin_nodes AS (
  SELECT domain, language, origin, sum(can) AS capacity, any_value(language_budget) AS language_budget, 1.0::DOUBLE AS weight
  FROM leaves JOIN language_level USING (domain, language) GROUP BY domain, language, origin
), {_WATER.format(name="origin", parents="domain, language", budget="language_budget")},
budgets AS (
  SELECT domain, language, origin,
         CASE WHEN available > 0 THEN floor(floor(origin_budget + 1e-6) / available) ELSE 0 END::BIGINT AS whole,
         CASE WHEN available > 0 THEN floor(origin_budget + 1e-6) % available ELSE 0 END AS rest
  FROM origin_level JOIN leaves USING (domain, language, origin)
), taken AS (
  SELECT doc_id, domain, language, origin, tokens, whole, rest,
         sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('mix:' || whole || ':' || doc_id)) AS upto
  FROM rows JOIN budgets USING (domain, language, origin)
)
SELECT doc_id, domain, language, origin, tokens, unnest(range(whole + (upto <= rest)::INT))::INT AS epoch FROM taken
"""

OP2 = r"""
WITH occurrences AS (
  SELECT doc_id, (n - 1)::INT AS line_no, trim(lines[n], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(n)
), long_lines AS (SELECT *, length(line) AS size FROM occurrences WHERE length(line) >= 20),
distinct_lines AS (
  SELECT line, size, count(*) AS times, min({'d': doc_id, 'n': line_no}) AS place FROM long_lines GROUP BY line, size
), near AS (
  SELECT a.line AS x, b.line AS y FROM distinct_lines a JOIN distinct_lines b ON a.size = b.size AND a.line < b.line
  WHERE abs(strlen(a.line) - strlen(b.line)) <= 3
    AND len(list_filter(range(1, a.size + 1), lambda i: substring(a.line, i, 1) != substring(b.line, i, 1))) = 1
  UNION ALL
  SELECT a.line, b.line FROM distinct_lines a JOIN distinct_lines b ON a.size = b.size + 1
  WHERE (left(a.line, 6) = left(b.line, 6) OR right(a.line, 6) = right(b.line, 6))
    AND len(list_filter(range(1, a.size + 1), lambda i: left(a.line, i - 1) || substring(a.line, i + 1) = b.line)) > 0
), ends AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
linked AS (
  SELECT e.x AS line, count(*) AS links, bool_or(o.place < m.place) AS later
  FROM ends e JOIN distinct_lines m ON m.line = e.x JOIN distinct_lines o ON o.line = e.y GROUP BY e.x
)
SELECT l.doc_id, l.line_no, d.place.d AS first_id, d.place.n AS first_line, d.times, coalesce(k.links, 0) AS links,
       ({'d': l.doc_id, 'n': l.line_no} = d.place AND NOT coalesce(k.later, false)) AS kept
FROM long_lines l JOIN distinct_lines d USING (line) LEFT JOIN linked k USING (line)
"""

# CRC-32 of a text's bytes, a table step per byte; the table follows from the polynomial
_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x))"

OP10 = f"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE
    list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT) END AS b
  FROM documents
), sized AS (
  SELECT doc_id, text, octet_length(encode(text)) + 1 AS size, md5(text) AS digest,
    xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM bytes, crc_table
), placed AS (
  SELECT *, sum(size) OVER () AS all_bytes, sum(size) OVER (PARTITION BY digest) AS total,
    coalesce(sum(size) OVER (ORDER BY digest, md5(doc_id::VARCHAR)[1:2], doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin,
    row_number() OVER (ORDER BY digest, md5(doc_id::VARCHAR)[1:2], doc_id) - 1 AS place
  FROM sized
), cut AS (
  SELECT *, least(15, ((CASE WHEN total * 16 <= all_bytes * 0.01 THEN min(begin) OVER (PARTITION BY digest) ELSE begin END)::HUGEINT * 16 // all_bytes::HUGEINT))::INT AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""

OP11 = r"""
WITH rows AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), failing AS (
  SELECT doc_id, part, [
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM rows
), marks AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), sets AS (
  SELECT part, fails, count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(range(1, 6)) AS f), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, array_to_string(list_transform(o, lambda f: substring('ABCDE', f, 1)), '') AS filter_order, unnest(range(1, 6))::INT AS step FROM orders),
counted AS (
  SELECT part, filter_order, step, o[step] AS f,
    sum(n) FILTER (WHERE NOT early AND NOT own) AS kept,
    sum(n) FILTER (WHERE NOT early AND own) AS removed,
    sum(n) FILTER (WHERE early AND own) AS redundant,
    sum(n) FILTER (WHERE own AND alone) AS unique_fails,
    sum(good) FILTER (WHERE NOT early AND own) AS good_lost,
    sum(toxic) FILTER (WHERE NOT early AND own) AS toxic_lost
  FROM (
    SELECT *, fails[o[step]] AS own, len(list_filter(o[1:step - 1], lambda f: fails[f])) > 0 AS early, len(list_filter(fails, lambda x: x)) = 1 AS alone
    FROM sets, steps
  ) GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM counted
"""

_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH RECURSIVE rows AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM rows
), members AS (SELECT doc_id, len(s) AS n, unnest(s) AS m FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM members a JOIN members b ON a.m = b.m AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS u, doc_id AS v FROM sets
  UNION
  SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
), least AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON u = doc_id
"""

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"""

OP13 = rf"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
rows AS (
  SELECT doc_id, row_number() OVER () AS no, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), aim AS (SELECT regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
words AS (SELECT no, unnest(w) AS word FROM rows), aim_words AS (SELECT unnest(w) AS word FROM aim),
vocabulary AS (SELECT word, {_CRC.format(text="word")} % 10000 AS bucket FROM (SELECT word FROM words UNION SELECT word FROM aim_words), crc_table),
s AS (SELECT bucket, count(*) AS s FROM words JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim_words JOIN vocabulary USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), totals
), sums AS (SELECT no, sum(gain) AS gain FROM words JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY no),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(gain::DOUBLE / len(w))::BIGINT END AS weight,
    floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM rows LEFT JOIN sums USING (no)
), placed AS (
  SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= 20 AS able,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) FILTER (WHERE n_features >= 20) OVER () AS n_able
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n_able // 100 THEN place END AS rank FROM placed
"""

SQL = {"op2_line_edit_dedup": OP2, "op3_source_mix": OP3, "op9_license_scan": OP9, "op10_byte_shards": OP10, "op11_filter_audit": OP11, "op12_jaccard_tiles": OP12, "op13_importance_draw": OP13}

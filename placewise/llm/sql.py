"""DuckDB statements for the same rows as the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from placewise.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

QUALITY = rf"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
words AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM parts),
windows AS (
  SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS k
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, k, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows WHERE k IS NOT NULL) WHERE n > 1),
covered AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
counts AS (
  SELECT p.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣▪●]'))) AS n_list_lines, len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS n_trailing_lines
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id),
failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    list_filter([
      CASE WHEN n_words < 10 THEN 'few_words' END,
      CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeated_words' END,
      CASE WHEN (CASE WHEN n_words = 0 THEN 0 ELSE CAST(word_chars AS DOUBLE) / n_words END) < 2 THEN 'short_words' END,
      CASE WHEN n_words > 0 AND CAST(word_chars AS DOUBLE) / n_words > 15 THEN 'long_words' END,
      CASE WHEN n_words > 0 AND CAST(n_symbols AS DOUBLE) / n_words > 0.3 THEN 'symbols' END,
      CASE WHEN (CASE WHEN n_words = 0 THEN 0 ELSE CAST(n_stop_words + 1 AS DOUBLE) / n_words END) < 0.03 THEN 'few_stop_words' END,
      CASE WHEN n_lines > 0 AND CAST(n_dup_lines AS DOUBLE) / n_lines > 0.5 THEN 'repeated_lines' END,
      CASE WHEN n_lines > 0 AND CAST(n_list_lines AS DOUBLE) / n_lines > 0.9 THEN 'list_lines' END,
      CASE WHEN n_lines > 0 AND CAST(n_trailing_lines AS DOUBLE) / n_lines > 0.5 THEN 'trailing_lines' END
    ], lambda x: x IS NOT NULL) AS names
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, len(names) = 0 AS kept,
  array_to_string(names, ',') AS failed_rules
FROM failed"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.line, l.i, coalesce(l.doc_id <> h.keeper, false) AS dropped FROM keyed l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN g.m > p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.m > p.page_id THEN g.m END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html"""

#: crc32 isn't among the functions: its table of 256 follows from the polynomial, and distinct features run through it byte by byte.
RESAMPLING = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
worded AS (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
  SELECT side, doc_id, unnest(w) AS f FROM worded
  UNION ALL
  SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded),
seen AS (SELECT side, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM seen)),
buckets AS (
  SELECT f, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, crc),
held AS (SELECT side, doc_id, bucket, n FROM seen JOIN buckets USING (f)),
totals AS (SELECT CAST(coalesce(sum(n) FILTER (WHERE side = 0), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(n) FILTER (WHERE side = 1), 0) AS DOUBLE) AS t_all FROM held),
per AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE side = 1), 0) AS DOUBLE) AS t FROM held GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM per, totals),
sums AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, sum(n * g) AS g FROM held JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS BIGINT) AS weight
  FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id),
noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS able FROM noisy WHERE n_features >= 39)
SELECT noisy.doc_id, n_features, weight, score, CASE WHEN r <= 25 * able // 100 THEN r END AS rank
FROM noisy LEFT JOIN placed ON placed.doc_id = noisy.doc_id"""

#: The cheapest edits as a fold over a conversation's rows: of each grammar state (start, after system, user, assistant) the least (cost, labels).
REPAIR = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS d
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) AS k FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 256), md5(text), k) AS i FROM damaged),
judged AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
faults AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS r FROM judged),
folded AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS lines,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list(struct_pack(r := r, gone := fault IN ('b', 'd'), more := CASE WHEN fault = 't' THEN 1 ELSE 0 END, q := [struct_pack(c := CAST(0 AS BIGINT), s := '')]) ORDER BY i),
      lambda a, x: struct_pack(r := x.r, gone := x.gone, more := x.more, q := list_transform([list_transform([1, 2, 3, 4], lambda j: list_sort(list_concat(
        [struct_pack(c := a.q[j].c + 3, s := a.q[j].s || 'D')],
        CASE WHEN x.gone THEN [] WHEN j = 2 AND x.r = 's' THEN [struct_pack(c := a.q[1].c + x.more, s := a.q[1].s || 'K')]
          WHEN j = 3 THEN list_transform([1, 2, 4], lambda f: struct_pack(c := a.q[f].c + x.more + CASE WHEN x.r = 'u' THEN 0 ELSE 2 END, s := a.q[f].s || CASE WHEN x.r = 'u' THEN 'K' ELSE 'R' END))
          WHEN j = 4 THEN [struct_pack(c := a.q[3].c + x.more + CASE WHEN x.r = 'a' THEN 0 ELSE 2 END, s := a.q[3].s || CASE WHEN x.r = 'a' THEN 'K' ELSE 'R' END)] ELSE [] END
      ))[1])], lambda b: [b[1], b[2],
        list_sort([b[3]] || list_transform([1, 2, 4], lambda f: struct_pack(c := b[f].c + 2, s := b[f].s || 'I')))[1],
        list_sort([b[4], struct_pack(c := b[3].c + 2, s := b[3].s || 'I')] || list_transform([1, 2], lambda f: struct_pack(c := b[f].c + 4, s := b[f].s || 'II')))[1]])[1]),
      struct_pack(r := '', gone := false, more := 0, q := [struct_pack(c := CAST(0 AS BIGINT), s := ''), struct_pack(c := CAST(1000000000 AS BIGINT), s := ''), struct_pack(c := CAST(2 AS BIGINT), s := 'I'), struct_pack(c := CAST(4 AS BIGINT), s := 'II')])) AS f
  FROM faults GROUP BY conv_id),
chosen AS (SELECT *, list_sort([f.q[1], f.q[4]])[1] AS best FROM folded),
told AS (SELECT *, best.s AS audit, length(replace(best.s, 'D', '')) AS n FROM chosen),
mended AS (
  SELECT *, list_transform(list_filter(range(1, length(audit) + 1), lambda k: audit[k] <> 'D'), lambda k:
    CASE WHEN audit[k] = 'K' THEN lines[length(replace(left(audit, k), 'I', ''))].role WHEN (length(replace(left(audit, k), 'D', '')) % 2 = 1) = (n % 2 = 0) THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN audit[k] = 'I' THEN '' ELSE lines[length(replace(left(audit, k), 'I', ''))].text END) AS out
  FROM told)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": QUALITY, "op6_line_dedup": LINES, "op10_warc": WARC, "op12_importance_resampling": RESAMPLING, "op13_conversation_repair": REPAIR}

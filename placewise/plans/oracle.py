"""The same queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from placewise.plans import fixtures as X
from placewise.sources.schemas import ASPECT_NAMES, ASPECT_WEIGHTS, CATEGORY_ICONS, DEFAULT_ICON, EMOTIONS

_RAW = """raw AS (
  SELECT d.source AS place_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS pos, 'u' || (d.doc_id % 37) AS name,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 5.0 WHEN quality = 1 AND toxic = 1 THEN 2.0 WHEN quality = 0 AND toxic = 1 THEN 1.0 ELSE 3.0 END::DOUBLE AS stars,
    d.text, strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') AS dt, d.doc_id % 11 AS likes
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN orders o ON o.o_orderkey = d.doc_id)"""
_REV = (
    _RAW
    + r""",
rev AS (
  SELECT place_id, pos, name AS author, coalesce(stars, 3.0) AS rating, left(t, 800) AS text, dt AS date, likes
  FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM raw) WHERE length(t) > 0)"""
)
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
_KEPT = f"""sets AS (
  SELECT place_id, list([{{'pos': pos, 'w': w}}] ORDER BY pos) AS rows
  FROM (SELECT place_id, pos, list_distinct({_WORDS}) AS w FROM rev) GROUP BY place_id),
kept AS (
  SELECT place_id, unnest(list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
      CAST(len(list_intersect(k.w, x[1].w)) AS DOUBLE) / greatest(1, len(k.w) + len(x[1].w) - len(list_intersect(k.w, x[1].w))) > 0.70::DOUBLE)) > 0
    THEN acc ELSE list_concat(acc, x) END)).pos AS pos FROM sets)"""
_ORD = """ord AS (
  SELECT c_nationkey AS place_id, CAST(o_custkey AS VARCHAR) AS author, CAST(left(o_orderpriority, 1) AS DOUBLE) AS rating, strftime(o_orderdate, '%Y-%m-%d') AS date
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_ASPECT_LIST = "[" + ", ".join(f"'{a}'" for a in ASPECT_NAMES) + "]"
_ASP = f"""asp AS (
  SELECT l_suppkey AS place_id, l_orderkey AS batch, {_ASPECT_LIST}[l_linenumber] AS aspect, CASE WHEN l_quantity < 50 THEN l_quantity / 5 END AS score, l_partkey % 10 AS mentions,
    CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || ' ' || l_partkey END AS summary, 'r' || (l_orderkey % 50 + 1) AS id FROM lineitem)"""
_ASPM = (
    _ASP
    + f""",
found AS (
  SELECT place_id, aspect, (CAST(printf('%.2f', CAST(CAST(avg(score) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS score, CAST(sum(mentions) AS BIGINT) AS mentions,
    (min({{'batch': batch, 'm': mentions, 's': summary}}) FILTER (WHERE summary <> '')).s AS summary
  FROM asp WHERE score IS NOT NULL GROUP BY ALL),
cited AS (
  SELECT place_id, aspect, list(id ORDER BY seen) AS ids
  FROM (SELECT place_id, aspect, id, min(batch) AS seen FROM asp WHERE score IS NOT NULL GROUP BY ALL) GROUP BY ALL),
aspm AS (
  SELECT p.place_id, a.aspect, f.score, coalesce(f.mentions, 0) AS mentions, f.summary, coalesce(i.ids, []) AS ids
  FROM (SELECT DISTINCT place_id FROM asp) p CROSS JOIN (SELECT unnest({_ASPECT_LIST}) AS aspect) a LEFT JOIN found f ON f.place_id = p.place_id AND f.aspect = a.aspect
    LEFT JOIN cited i ON i.place_id = p.place_id AND i.aspect = a.aspect)"""
)
_WEIGHT = "CASE aspect " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in ASPECT_WEIGHTS.items()) + " END"
_ASPW = f"aspw AS (SELECT place_id, (CAST(printf('%.2f', CAST(CAST(sum(score * {_WEIGHT}) / sum({_WEIGHT}) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS aspect_comp FROM asp WHERE score IS NOT NULL GROUP BY 1)"
_EV = """ev AS (
  SELECT user_id AS place_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 15) AS INTEGER) AS batch,
    least(1.0::DOUBLE, greatest(-1.0::DOUBLE, value / 50 - 1)) AS score, event_type AS emotion FROM events)"""
_BATCHES = _EV + ",\nbatches AS (SELECT place_id, batch, (CAST(printf('%.3f', CAST(CAST(avg(score) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS s FROM ev GROUP BY ALL)"
_LABEL = "CASE WHEN s >= 0.4 THEN 'Positive' WHEN s <= -0.3 THEN 'Negative' WHEN s BETWEEN -0.15 AND 0.15 THEN 'Neutral' ELSE 'Mixed' END"
_MOOD = (
    _BATCHES
    + f""",
mood AS (
  SELECT place_id, n_batches, CASE WHEN n_batches = 1 THEN own ELSE s END AS sentiment_score, CASE WHEN n_batches = 1 THEN CASE WHEN own > 0 THEN 'Positive' ELSE 'Mixed' END ELSE {_LABEL} END AS overall_sentiment
  FROM (SELECT place_id, count(*) AS n_batches, (CAST(printf('%.3f', CAST(CAST(avg(s) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS s, any_value(s) AS own FROM batches GROUP BY 1))"""
)
_STEADY = """steady AS (
  SELECT place_id, CASE WHEN count(score) >= 3 THEN greatest(0.0, (CAST(printf('%.2f', CAST(CAST(10 - stddev_pop(score) * 5 AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0)) ELSE 5.0 END AS consistency_comp FROM ev GROUP BY 1)"""
_RECENT = """recent AS (
  SELECT place_id, trend, CASE trend WHEN 'Declining' THEN greatest(0.0, base - 1.5) WHEN 'Improving' THEN least(10.0, base + 1.0) ELSE base END AS recency_comp
  FROM (
    SELECT place_id, ['Declining', 'Improving', 'Stable'][place_id % 3 + 1] AS trend,
      (CAST(printf('%.2f', CAST(CAST((coalesce(CASE WHEN place_id % 7 <> 0 THEN arg_min(s, batch) END, (CAST(printf('%.3f', CAST(CAST(avg(s) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0)) + 1) / 2 * 10 AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS base
    FROM batches GROUP BY place_id))"""
_TRUST = """pv AS (
  SELECT place_id, i, ['PASS', 'CORRECTED', 'UNAVAILABLE', 'FAIL'][i % 4 + 1] AS status, CASE WHEN i % 5 = 0 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE + i * 0.01::DOUBLE END AS accuracy
  FROM (SELECT DISTINCT source AS place_id, CAST(substring(source, 4) AS BIGINT) AS i FROM documents)),
pt AS (
  SELECT source AS place_id, (CAST(printf('%.2f', CAST(CAST(avg((toxic = 0)::INT) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS trust, (CAST(printf('%.2f', CAST(CAST(avg((quality = 0)::INT) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS fake
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
trust AS (
  SELECT place_id, i, status, accuracy, trust, CASE WHEN status = 'UNAVAILABLE' THEN base ELSE greatest(0.0, least(10.0, (CAST(printf('%.2f', CAST(CAST(base * (coalesce(nullif(accuracy, 0), 1) * 0.5::DOUBLE + 0.5) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0))) END AS trust_comp
  FROM (SELECT pv.*, trust, greatest(0.0, least(10.0, (CAST(printf('%.2f', CAST(CAST((coalesce(trust, 0.7::DOUBLE) - coalesce(fake, 0.2::DOUBLE) * 0.5::DOUBLE) * 10 AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0))) AS base FROM pv LEFT JOIN pt ON pv.place_id = pt.place_id))"""
_CONCERNS = """concerns AS (
  SELECT d.doc_id, source, lang, CASE WHEN quality = 0 AND toxic = 1 THEN 'Major' WHEN quality = 0 THEN 'Moderate' WHEN toxic = 1 THEN 'Minor' END AS severity
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 0 OR toxic = 1)"""
_PENALTY = "CASE severity WHEN 'Major' THEN 1.5 WHEN 'Moderate' THEN 0.8 ELSE 0.2 END"
_FINAL = ",\n".join([_REV, _ORD, _ASP, _ASPW, _MOOD, _STEADY, _RECENT, _TRUST, _CONCERNS]) + f""",
risk AS (
  SELECT place_id, least(3.0, (CAST(printf('%.6f', CAST(CAST(sum(p) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0)) AS risk_penalty
  FROM (SELECT source AS place_id, {_PENALTY} AS p FROM concerns UNION ALL SELECT place_id, 0.3 FROM pv WHERE i % 3 = 0) GROUP BY 1),
parts AS (
  SELECT t.place_id, n, trust, status, accuracy, trust_comp, (CAST(printf('%.2f', CAST(CAST((coalesce(sentiment_score, 0) + 1) / 2 * 10 AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS sentiment_comp, coalesce(aspect_comp, 5.0) AS aspect_comp,
    (CAST(printf('%.2f', CAST(CAST(coalesce(g.r, scraped) * 2 AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS rating_comp, coalesce(consistency_comp, 5.0) AS consistency_comp,
    coalesce(recency_comp, (CAST(printf('%.2f', CAST(CAST((coalesce(sentiment_score, 0) + 1) / 2 * 10 AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0)) AS recency_comp, coalesce(risk_penalty, 0.0) AS risk_penalty
  FROM trust t JOIN (SELECT place_id, count(*) AS n, avg(rating) AS scraped FROM rev GROUP BY 1) s ON s.place_id = t.place_id LEFT JOIN risk ON risk.place_id = t.place_id
    LEFT JOIN (SELECT place_id, avg(rating) AS r FROM ord WHERE place_id % 2 = 0 GROUP BY 1) g ON g.place_id = t.i LEFT JOIN aspw ON aspw.place_id = t.i LEFT JOIN mood ON mood.place_id = t.i
    LEFT JOIN recent ON recent.place_id = t.i LEFT JOIN steady ON steady.place_id = t.i),
total AS (
  SELECT *, sentiment_comp * 0.30::DOUBLE + aspect_comp * 0.25::DOUBLE + rating_comp * 0.15::DOUBLE + trust_comp * 0.15::DOUBLE + consistency_comp * 0.10::DOUBLE + recency_comp * 0.05::DOUBLE AS composite FROM parts),
conf AS (
  SELECT *, (CAST(printf('%.2f', CAST(CAST(greatest(0.0, least(10.0, composite - risk_penalty)) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS final_score,
    least(1.0, least(1.0, least(1.0, n / 50) + CASE WHEN consistency_comp >= 7 THEN 0.15 ELSE 0 END) + CASE WHEN coalesce(trust, 0.7) >= 0.8 THEN 0.1 ELSE 0 END)::DOUBLE AS base FROM total),
final AS (
  SELECT place_id, CASE WHEN final_score >= 8 THEN 'HIGHLY RECOMMENDED' WHEN final_score >= 6.5 THEN 'RECOMMENDED' WHEN final_score >= 4.5 THEN 'VISIT WITH CAUTION' ELSE 'NOT RECOMMENDED' END AS verdict, final_score,
    (CAST(printf('%.3f', CAST(CAST(CASE status WHEN 'PASS' THEN least(1.0, least(1.0, base + 0.1) * (coalesce(nullif(accuracy, 0), 1) * 0.3 + 0.7)) WHEN 'UNAVAILABLE' THEN greatest(0.0, base - 0.1) WHEN 'CORRECTED' THEN greatest(0.0, base - 0.05) ELSE base END AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS confidence,
    sentiment_comp, aspect_comp, rating_comp, trust_comp, consistency_comp, recency_comp, risk_penalty, (CAST(printf('%.2f', CAST(CAST(composite AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS composite_raw
  FROM conf)"""

_PHRASES = f"""early AS (SELECT place_id, pos, {_WORDS} AS w FROM rev WHERE pos <= 30),
grams AS (SELECT place_id, pos, unnest(range(1, greatest(len(w) - 1, 1))) AS k, w FROM early WHERE len(w) >= 3),
grams2 AS (SELECT place_id, pos, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS phrase FROM grams),
ranked AS (
  SELECT place_id, phrase, count(*) AS cnt, row_number() OVER (PARTITION BY place_id ORDER BY count(*) DESC, min(pos * 100000 + k)) AS rank
  FROM grams2 WHERE length(phrase) > 8 GROUP BY place_id, phrase),
phrases AS (SELECT place_id, CAST(rank AS INTEGER) AS rank, phrase, cnt FROM ranked WHERE rank <= 5 AND cnt >= 4)"""
_PAIRS = f"""tok AS (SELECT place_id, pos, list_distinct({_WORDS}) AS w FROM rev WHERE pos <= 30),
pairs AS (
  SELECT p.place_id, count(b.place_id) AS n FROM (SELECT DISTINCT place_id FROM rev) p LEFT JOIN (
    SELECT a.place_id FROM tok a JOIN tok b ON a.place_id = b.place_id AND a.pos < b.pos
    WHERE CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.55::DOUBLE) b ON b.place_id = p.place_id GROUP BY 1)"""
_PCT = "CAST(CAST(round_even(CAST({} AS DECIMAL(18,9)) * 100, 0) AS INTEGER) AS VARCHAR) || '%'"


def _stats(rows: str, text: str) -> str:
    return f"""stats AS (
  SELECT place_id, count(*) AS n, avg(rating) AS avg_rating, count(*) FILTER (WHERE rating = 5) AS fives, count(*) FILTER (WHERE rating = 1) AS ones, count(DISTINCT rating) AS n_ratings,
    count(*) FILTER (WHERE rating = 5 AND length({text}) < 12) AS short_fives, avg(length({text})) AS avg_length, count(DISTINCT author) AS authors,
    count(nullif(left(date, 10), '')) AS n_dates, count(DISTINCT nullif(left(date, 10), '')) AS n_days FROM {rows} GROUP BY 1)"""


def _flags(pairs: str, phrases: str, joins: str) -> str:
    return f"""flagged AS (
  SELECT s.place_id, list_filter([
    CASE WHEN fives / n > 0.75 THEN 'Unusually high 5-star ratio (' || {_PCT.format("fives / n")} || ') — potential rating manipulation' END,
    CASE WHEN ones / n > 0.40 THEN 'High 1-star ratio (' || {_PCT.format("ones / n")} || ') — possible targeted negative campaign' END,
    CASE WHEN n_ratings = 1 THEN 'All reviews share the exact same star rating — highly suspicious uniformity' END,
    CASE WHEN short_fives / n > 0.30 THEN short_fives || ' very short 5-star reviews (< 12 chars) — likely filler boosts' END,
    CASE WHEN {pairs} >= 3 THEN {pairs} || ' near-duplicate review pairs (>55% word overlap)' END,
    CASE WHEN {phrases} IS NOT NULL THEN 'Repeated phrases across reviews: ' || {phrases} || ' — coordinated language' END,
    CASE WHEN authors / n < 0.7 AND n > 8 THEN 'Low author diversity (' || authors || ' unique / ' || n || ' reviews) — possible sock-puppets' END,
    CASE WHEN n < 6 THEN 'Too few reviews for high-confidence analysis — treat results with caution' END,
    CASE WHEN n_dates >= 5 AND n_days / n_dates < 0.25 THEN 'Many reviews share the same date — possible coordinated review-bombing' END
  ], lambda x: x IS NOT NULL) AS flags FROM stats s {joins})
SELECT place_id, unnest(range(1, len(flags) + 1))::INTEGER AS flag_no, unnest(flags) AS flag FROM flagged"""


_CORR = f"""corr AS (SELECT *, CASE WHEN ids = '' THEN [] ELSE string_split(ids, ',') END AS evidence FROM (VALUES {X.CORRECTIONS}) t(place_id, idx, field, original_claim, corrected_claim, ids)),
ver AS (
  SELECT place_id, coalesce(nullif(verification_status, ''), nullif(status, ''), 'PASS') AS status, CAST(coalesce(accuracy, 0.94) AS DOUBLE) AS accuracy, coalesce(hallucination_detected, false) AS hallucination
  FROM (VALUES {X.VERIFICATIONS}) t(place_id, verification_status, status, accuracy, hallucination_detected)),
todo AS (SELECT c.* FROM corr c JOIN ver v ON c.place_id = v.place_id AND v.status NOT IN ('PASS', 'UNAVAILABLE') WHERE len(evidence) > 0)"""
_POINTS = f"""points AS (SELECT *, CASE WHEN ids IS NULL THEN NULL WHEN ids = '' THEN [] ELSE string_split(ids, ',') END AS evidence FROM (VALUES {X.POINTS}) t(place_id, ord, polarity, claim, aspect, ids))"""
_PLACES = f"(VALUES {X.PLACES}) t(place_id, title, address, totalScore, reviewsCount, categoryName, description, price, phone, permanentlyClosed, temporarilyClosed)"
_FEATURES = """feat AS (
  SELECT r_name AS query, s_suppkey AS ord, 'Place ' || (s_suppkey % 9) AS name,
    coalesce(nullif(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE n_name END, ''), CASE WHEN s_suppkey % 8 = 0 THEN n_name END, CASE WHEN s_suppkey % 2 = 0 THEN 'County' END, '') AS city, r_name AS country, s_suppkey::DOUBLE AS lat, s_acctbal AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _icon(text: str, icons: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in icons.items()) + f" ELSE '{default}' END"


def _title(x: str) -> str:
    return f"list_aggregate(list_transform(string_split({x}, '_'), lambda w: upper(left(w, 1)) || substring(w, 2)), 'string_agg', ' ')"


def _pct1(x: str) -> str:
    return f"format('{{:.1f}}', (CAST(printf('%.1f', CAST(CAST({x} AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0))"


_FALLBACK = "SELECT place_id, CAST(k AS INTEGER) AS ord, '{}' AS aspect, left(text, 150) AS evidence, {}, 'r' || pos AS review_id FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY pos) AS k FROM rev WHERE {}) WHERE k <= {}"

ORACLE_SQL: dict[str, str] = {
    "final_score": f"WITH {_FINAL} SELECT * FROM final",
    "verdict_counts": f"WITH {_FINAL} SELECT verdict, count(*) AS n FROM final GROUP BY 1",
    "report_text": f"WITH {_FINAL} SELECT place_id, 'Place: ' || place_id || chr(10) || 'Verdict: ' || verdict || chr(10) || printf('Score: %.2f/10  Confidence: %.3f', final_score, confidence) AS report_text, CASE WHEN contains(verdict, 'HIGHLY') THEN 'highly' WHEN contains(verdict, 'NOT') THEN 'not' WHEN contains(verdict, 'CAUTION') THEN 'caution' ELSE 'recommended' END AS class FROM final",
    "score_unpivot": f"""WITH {_FINAL}, found AS (SELECT place_id, aspect, (CAST(printf('%.2f', CAST(CAST(avg(score) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS score FROM asp WHERE score IS NOT NULL AND aspect <> 'accessibility' GROUP BY ALL),
rows AS (
  SELECT place_id, 'Sentiment' AS metric, sentiment_comp AS score FROM final UNION ALL SELECT place_id, 'Google Rating', rating_comp FROM final UNION ALL SELECT place_id, 'Trust', trust_comp FROM final
  UNION ALL SELECT place_id, 'Consistency', consistency_comp FROM final UNION ALL SELECT 'src' || place_id, {_title("aspect")}, score FROM found)
SELECT place_id, metric, score, CASE WHEN score >= 7 THEN 'good' WHEN score >= 5 THEN 'fair' ELSE 'poor' END AS class, CAST(trunc(score * 10) AS INTEGER) AS width FROM rows""",
    "review_funnel": f"""WITH {_REV}, {_KEPT}
SELECT r.place_id, r.n AS raw_scraped, coalesce(u.n, 0) AS usable_text, coalesce(k.n, 0) AS cleaned, coalesce(k.n, 0) AS analyzed FROM (SELECT place_id, count(*) AS n FROM raw GROUP BY 1) r
LEFT JOIN (SELECT place_id, count(*) AS n FROM rev GROUP BY 1) u ON u.place_id = r.place_id LEFT JOIN (SELECT place_id, count(*) AS n FROM kept GROUP BY 1) k ON k.place_id = r.place_id""",
    "usable_reviews": f"WITH {_REV} SELECT place_id, CAST(pos AS INTEGER) AS pos, author, rating, CAST(length(text) AS INTEGER) AS n_chars, date, likes FROM rev",
    "best_place": f"""WITH {_ORD} SELECT n_regionkey, n_nationkey, n AS reviews FROM (
  SELECT n_regionkey, n_nationkey, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY coalesce(n, 0) DESC, n_nationkey) AS k
  FROM nation LEFT JOIN (SELECT place_id, count(*) AS n FROM ord GROUP BY 1) ON place_id = n_nationkey) WHERE k = 1""",
    "place_projection": f"""SELECT place_id, coalesce(nullif(title, ''), place_id) AS name, coalesce(address, '') AS address, CAST(coalesce(totalScore, 0) AS DOUBLE) AS google_score, CAST(coalesce(reviewsCount, 0) AS BIGINT) AS review_count,
  coalesce(categoryName, '') AS category, 0 AS n_subtypes, coalesce(price, '') AS price, coalesce(permanentlyClosed, false) AS permanently_closed, coalesce(temporarilyClosed, false) AS temporarily_closed FROM {_PLACES}""",
    "place_badges": f"""SELECT place_id, CASE WHEN permanentlyClosed THEN 'PERMANENTLY CLOSED' WHEN temporarilyClosed THEN 'TEMPORARILY CLOSED' ELSE '' END AS badge,
  concat_ws('  ', '💰 ' || nullif(price, ''), '📞 ' || nullif(phone, '')) AS meta, CASE WHEN length(coalesce(description, '')) > 20 THEN left(description, 20) || '…' ELSE coalesce(description, '') END AS description FROM {_PLACES}""",
    "rating_histogram": f"""WITH {_ORD} SELECT place_id, CAST(star AS VARCHAR) AS star, count(*) FILTER (WHERE greatest(1, least(5, trunc(rating))) = star) AS n FROM ord, range(1, 6) t(star) GROUP BY ALL""",
    "rating_integrity_flags": f"WITH {_ORD}, {_stats('ord', 'NULL::VARCHAR')}, {_flags('0', 'NULL::VARCHAR', '')}",
    "document_flags": f"""WITH {_REV}, {_PHRASES}, {_PAIRS}, {_stats("rev", "text")},
listed AS (SELECT place_id, '[' || string_agg('''' || phrase || '''', ', ' ORDER BY rank) || ']' AS p FROM phrases WHERE rank <= 3 GROUP BY 1),
{_flags("pairs.n2", "listed.p", "JOIN (SELECT place_id, n AS n2 FROM pairs) pairs ON pairs.place_id = s.place_id LEFT JOIN listed ON listed.place_id = s.place_id")}""",
    "short_top_rating_share": f"WITH {_REV}, {_stats('rev', 'text')} SELECT place_id, short_fives, (CAST(printf('%.6f', CAST(CAST(short_fives / n AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS share, short_fives / n > 0.30 AS flagged FROM stats",
    "near_duplicate_pairs": f"WITH {_REV}, {_PAIRS} SELECT place_id, n AS duplicate_pairs FROM pairs",
    "source_reviews": f"""WITH {_RAW}, newest AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY pos DESC) AS nth, count(*) OVER (PARTITION BY place_id) AS n FROM raw)
SELECT 'place_id: ' || place_id AS query, place_id, n AS reviews_count, CAST(nth AS INTEGER) AS nth, CAST(pos AS INTEGER) AS pos, name, stars, CAST(length(text) AS INTEGER) AS n_chars, dt AS date FROM newest WHERE nth <= 8""",
    "cached_reports": f"""WITH {_REV}, n AS (SELECT place_id, count(*) AS whole, count(*) FILTER (WHERE rating <= 2) AS critical FROM rev GROUP BY 1)
SELECT place_id, CASE WHEN critical > 0 THEN '2024-01-05' ELSE '2024-01-01' END AS generated, CASE WHEN critical > 0 THEN critical ELSE whole END AS n, critical > 0 AS fresh FROM n""",
    "kept_themes": """WITH t AS (
  SELECT p_brand || '/' || (p_size // 5) AS place_id, CASE WHEN length(p_brand || '/' || (p_size // 5)) % 2 = 0 THEN 0 ELSE p_partkey % 2 END AS batch, p_partkey AS ord,
    split_part(p_type, ' ', 1) AS name, p_size AS frequency, 'r' || (p_partkey % 5) AS id FROM part),
one AS (SELECT place_id FROM t GROUP BY 1 HAVING count(DISTINCT batch) = 1),
seen AS (SELECT place_id, name, id, min({'b': batch, 'o': ord}) AS pos FROM t WHERE place_id NOT IN (FROM one) GROUP BY ALL),
ids AS (SELECT place_id, name, string_agg(id, ',' ORDER BY pos) AS ids FROM seen GROUP BY ALL)
SELECT place_id, name, CAST(frequency AS BIGINT) AS frequency, id AS ids, ord AS first FROM t WHERE place_id IN (FROM one)
UNION ALL
SELECT t.place_id, t.name, CAST(sum(frequency) AS BIGINT), any_value(ids.ids), min({'b': batch, 'o': ord}).o FROM t JOIN ids ON ids.place_id = t.place_id AND ids.name = t.name GROUP BY ALL""",
    "batch_emotions": f"""WITH {_EV}, n AS (SELECT place_id, batch, CASE emotion WHEN 'signup' THEN 'Excited' WHEN 'purchase' THEN 'Happy' WHEN 'view' THEN 'Neutral' WHEN 'error' THEN 'Angry' ELSE emotion END AS e FROM ev),
one AS (SELECT place_id FROM n GROUP BY 1 HAVING count(DISTINCT batch) = 1)
SELECT place_id, e AS emotion, count(*) AS n FROM n WHERE place_id IN (FROM one) GROUP BY ALL
UNION ALL
SELECT place_id, emotion, count(*) FILTER (WHERE e = emotion) AS n FROM n, (SELECT unnest({list(EMOTIONS)}) AS emotion) WHERE place_id NOT IN (FROM one) GROUP BY ALL""",
    "given_facts": f"""WITH {_REV}, given AS (
  SELECT place_id, CAST(row_number() OVER (PARTITION BY place_id ORDER BY lang) AS INTEGER) AS fact_no, 'Reviews in ' || lang AS fact
  FROM (SELECT DISTINCT source AS place_id, lang FROM documents WHERE lang IS NOT NULL AND CAST(substring(source, 4) AS BIGINT) % 2 = 0))
FROM given
UNION ALL
SELECT place_id, CAST(1 AS INTEGER), 'Average rating of analyzed sample is ' || printf('%.1f', CAST(CAST(avg(rating) AS DECIMAL(18,9)) AS DOUBLE)) || '★ across ' || count(*) || ' reviews.' FROM rev WHERE place_id NOT IN (SELECT place_id FROM given) GROUP BY place_id""",
    "dangling_ids": f"""WITH {_REV} SELECT DISTINCT 'src' || (user_id % 20) AS place_id, 'r' || (event_id % 900) AS review_id FROM events
EXCEPT SELECT place_id, 'r' || pos FROM rev""",
    "exact_rounding": """SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_extendedprice * (1 - l_discount)) AS DOUBLE) AS net, CAST(printf('%.2f', l_extendedprice / 8) AS DOUBLE) AS eighth,
  CAST(printf('%.1f', l_extendedprice / 1000) AS DOUBLE) AS mill, CAST(printf('%.0f', l_quantity / 4) AS DOUBLE) AS half, CAST(printf('%.3f', -l_extendedprice / 200) AS DOUBLE) AS negative FROM lineitem""",
    "greedy_dedupe": f"WITH {_REV}, {_KEPT} SELECT place_id, CAST(pos AS INTEGER) AS pos FROM kept",
    "repeated_phrases": f"WITH {_REV}, {_PHRASES} SELECT * FROM phrases",
    "review_batches": f"WITH {_REV} SELECT place_id, 'r' || pos AS review_id, CAST((pos - 1) // 15 AS INTEGER) AS batch FROM rev",
    "batch_prompts": f"""WITH {_REV}, p AS (SELECT place_id, CAST((pos - 1) // 15 AS INTEGER) AS batch, string_agg('[r' || pos || '] ⭐' || CAST(rating AS INTEGER) || '/5  date:' || coalesce(left(date, 10), 'None') || chr(10) || left(text, 350), chr(10) || '---' || chr(10) ORDER BY pos) AS prompt FROM rev GROUP BY ALL)
SELECT place_id, batch, CAST(length(prompt) AS INTEGER) AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
    "verifier_sample": f"WITH {_REV} SELECT place_id, 'r' || pos AS id, rating, left(text, 150) AS text FROM rev WHERE pos <= 20",
    "guardrail_sample": f"WITH {_REV} SELECT place_id, 'r' || pos AS id, rating, left(text, 120) AS text FROM rev WHERE pos <= 18",
    "heuristic_stats": f"""WITH {_REV}, {_PHRASES}, {_PAIRS}, {_stats("rev", "text")}
SELECT s.place_id, s.n AS total_reviews, (CAST(printf('%.2f', CAST(CAST(avg_rating AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS avg_rating, (CAST(printf('%.2f', CAST(CAST(fives / s.n AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS five_star_pct, (CAST(printf('%.2f', CAST(CAST(ones / s.n AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS one_star_pct,
  (CAST(printf('%.0f', CAST(CAST(avg_length AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) AS avg_review_length, authors AS unique_authors, pairs.n AS duplicate_pairs, coalesce(p.p, '') AS repeated_phrases
FROM stats s JOIN pairs ON pairs.place_id = s.place_id LEFT JOIN (SELECT place_id, string_agg(phrase, ' | ' ORDER BY rank) AS p FROM phrases WHERE rank <= 3 GROUP BY 1) p ON p.place_id = s.place_id""",
    "aspect_merge": f"WITH {_ASPM} SELECT place_id, aspect, score, mentions AS reviews_mentioning, summary, CAST(len(ids) AS INTEGER) AS n_evidence, array_to_string(ids, ',') AS ids FROM aspm",
    "single_batch_aspects": f"""WITH own AS (
  SELECT p_partkey - CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END AS place_id, p_partkey AS batch, {_ASPECT_LIST}[p_size % 7 + 1] AS aspect, p_retailprice / 128 AS score, p_size AS mentions, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS summary, 'r' || p_size AS id FROM part),
n AS (SELECT place_id, count(*) AS n FROM own GROUP BY 1),
merged AS (
  SELECT o.place_id, aspect, CASE WHEN any_value(n) = 1 THEN any_value(score) ELSE (CAST(printf('%.2f', CAST(CAST(avg(score) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0) END AS score, CAST(sum(mentions) AS BIGINT) AS reviews_mentioning,
    CASE WHEN any_value(n) = 1 THEN any_value(summary) ELSE arg_min(summary, batch) FILTER (WHERE summary <> '') END AS summary, list(id ORDER BY batch) AS ids FROM own o JOIN n ON n.place_id = o.place_id GROUP BY ALL),
once AS (SELECT * REPLACE (CASE WHEN len(ids) = 2 AND ids[1] = ids[2] THEN ids[1:1] ELSE ids END AS ids) FROM merged)
SELECT p.place_id, a.aspect, score, coalesce(reviews_mentioning, 0) AS reviews_mentioning, summary, coalesce(array_to_string(ids, ','), '') AS ids
FROM n p CROSS JOIN (SELECT unnest({_ASPECT_LIST}) AS aspect) a LEFT JOIN once o ON o.place_id = p.place_id AND o.aspect = a.aspect""",
    "trimmed_aspects": f"WITH {_ASPM} SELECT place_id, aspect, score, array_to_string(ids[1:2], ',') AS ids FROM aspm WHERE score IS NOT NULL",
    "credibility_table": f"WITH {_ASPM} SELECT place_id, {_title('aspect')} AS aspect, CASE WHEN score >= 5 THEN '✅' ELSE '❌' END AS credible, {_PCT.format('coalesce(score / 10, 0)')} AS share FROM aspm WHERE aspect <> 'accessibility'",
    "aspect_observations": f"""WITH {_ASPM} SELECT place_id, CAST(row_number() OVER (PARTITION BY place_id ORDER BY list_position({_ASPECT_LIST}, aspect)) - 1 AS INTEGER) AS ord,
  {_title('aspect')} || ': score ' || score || '/10 confirmed across ' || mentions || ' review mention(s).' AS observation FROM aspm WHERE score IS NOT NULL AND list_position({_ASPECT_LIST}, aspect) <= 3""",
    "aspect_weighted_score": f"WITH {_ASP}, {_ASPW} SELECT * FROM aspw",
    "sentiment_merge_label": f"WITH {_MOOD} SELECT * FROM mood",
    "theme_classes": f"WITH {_MOOD} SELECT place_id, CASE WHEN contains(overall_sentiment, 'Pos') THEN 'positive' WHEN contains(overall_sentiment, 'Neg') THEN 'negative' ELSE 'neutral' END AS polarity, ['📉', '📈', '➡️'][place_id % 3 + 1] AS icon FROM mood",
    "emotion_distribution": f"""WITH {_EV}, n AS (SELECT place_id, CASE emotion WHEN 'signup' THEN 'Excited' WHEN 'purchase' THEN 'Happy' WHEN 'view' THEN 'Neutral' WHEN 'error' THEN 'Angry' END AS e FROM ev)
SELECT place_id, emotion, count(*) FILTER (WHERE e = emotion) AS n FROM n, (SELECT unnest({list(EMOTIONS)}) AS emotion) GROUP BY ALL""",
    "shown_emotions": f"""WITH {_EV} SELECT place_id, CASE emotion WHEN 'signup' THEN 'Excited' WHEN 'purchase' THEN 'Happy' WHEN 'view' THEN 'Neutral' WHEN 'error' THEN 'Angry' END AS emotion, count(*) AS n FROM ev WHERE emotion <> 'click' GROUP BY ALL""",
    "first_non_empty_quote": f"WITH {_REV} SELECT place_id, arg_min(left(text, 40), pos) FILTER (WHERE rating >= 5) AS positive_quote, arg_min(left(text, 40), pos) FILTER (WHERE rating <= 2) AS negative_quote FROM rev GROUP BY 1",
    "keyword_union": f"""WITH {_REV}, w AS (SELECT place_id, pos, unnest(range(1, 4)) AS k, {_WORDS} AS w FROM rev)
SELECT place_id, keyword, CAST(row_number() OVER (PARTITION BY place_id ORDER BY f) AS INTEGER) AS ord FROM (SELECT place_id, w[k] AS keyword, min(pos * 10 + k) AS f FROM w WHERE k <= len(w) GROUP BY ALL)""",
    "theme_merge": """WITH t AS (SELECT p_brand, p_type, 'r' || (p_partkey % 7) AS id, min(p_partkey) AS seen FROM part GROUP BY ALL)
SELECT p_brand AS place_id, p_type AS name, CAST(sum(p_size) AS BIGINT) AS frequency, arg_min(p_name, p_partkey) AS sentiment, 'Q' || arg_min(p_size, p_partkey) AS representative_quote, 'part ' || min(p_partkey) AS evidence,
  any_value(ids) AS ids FROM part JOIN (SELECT p_brand AS b, p_type AS y, string_agg(id, ',' ORDER BY seen) AS ids FROM t GROUP BY ALL) ON b = p_brand AND y = p_type GROUP BY 1, 2""",
    "consistency_component": f"WITH {_EV}, {_STEADY} SELECT * FROM steady",
    "risk_penalty": f"""WITH {_CONCERNS} SELECT place_id, least(3.0, (CAST(printf('%.6f', CAST(CAST(sum(p) AS DECIMAL(18,9)) AS DOUBLE)) AS DOUBLE) + 0)) AS risk_penalty FROM (
  SELECT lang || '-' || (doc_id % 97) AS place_id, {_PENALTY} AS p FROM concerns UNION ALL SELECT lang || '-' || (doc_id % 97), 0.3 FROM concerns WHERE doc_id % 2 = 0) GROUP BY 1""",
    "corrected_aspects": f"""WITH {_ASPM}, {_CORR}
SELECT CAST(a.place_id AS VARCHAR) AS place_id, a.aspect, CASE WHEN a.place_id = 1 AND a.aspect = 'service' AND (score IS NULL OR abs(2.5 - score) > 0.5) THEN 2.5 WHEN a.place_id = 1 AND a.aspect = 'service' AND abs(2.9 - score) > 0.5 THEN 2.9 ELSE score END AS score,
  CASE WHEN a.place_id = 1 AND a.aspect = 'service' AND (score IS NULL OR abs(2.5 - score) > 0.5) THEN 'service is 2.5 of 10' WHEN a.place_id = 1 AND a.aspect = 'service' AND abs(2.9 - score) > 0.5 THEN 'should be 2.9' ELSE 'merged' END AS summary FROM aspm a""",
    "corrected_sentiment": f"""WITH {_MOOD}, {_CORR},
fix AS (SELECT place_id, lower(corrected_claim) AS c FROM todo WHERE field IN ('sentiment', 'sentiment.overall'))
SELECT CAST(m.place_id AS VARCHAR) AS place_id, CASE WHEN contains(c, 'negative') THEN 'Negative' WHEN contains(c, 'positive') THEN 'Positive' WHEN contains(c, 'mixed') THEN 'Mixed' ELSE overall_sentiment END AS overall_sentiment,
  CASE WHEN contains(c, 'negative') THEN -abs(sentiment_score) WHEN contains(c, 'positive') THEN abs(sentiment_score) ELSE sentiment_score END AS sentiment_score FROM mood m LEFT JOIN fix ON fix.place_id = CAST(m.place_id AS VARCHAR)""",
    "corrected_keywords": f"""WITH {_CORR}, k AS (SELECT * FROM (VALUES {X.KEYWORDS}) t(place_id, polarity, ord, keyword))
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM todo t WHERE t.place_id = k.place_id AND t.field = 'keywords.' || k.polarity AND trim(lower(t.original_claim)) = lower(k.keyword) AND regexp_matches(lower(t.corrected_claim), 'not|unsupported|absent|incorrect'))""",
    "correction_concerns": f"""WITH {_CORR} SELECT place_id, CAST(row_number() OVER (PARTITION BY place_id ORDER BY idx) AS INTEGER) AS ord, field AS aspect, left(corrected_claim, 200) AS evidence, 'Moderate' AS severity, ids, 'Model B correction' AS source FROM todo WHERE starts_with(field, 'guardrail')""",
    "correction_badges": f"WITH {_CORR} SELECT place_id, idx, field, CASE WHEN len(evidence) > 0 THEN 'Applied' ELSE 'Skipped' END AS badge FROM corr",
    "trust_component": f"WITH {_TRUST} SELECT place_id, trust_comp FROM trust",
    "recency_component": f"WITH {_BATCHES}, {_RECENT} SELECT place_id, trend, recency_comp FROM recent",
    "guardrail_cards": f"WITH {_TRUST} SELECT place_id, {_PCT.format('trust')} AS trust, {_PCT.format('fake')} AS fake, CASE WHEN trust < 0.9 THEN {_pct1('trust * 5')} || '/5' ELSE '—' END AS adjusted FROM pt",
    "fallback_positives": f"WITH {_REV} " + _FALLBACK.format("Verified Customer Praise", "0.88::DOUBLE AS confidence", "rating >= 4", 4),
    "fallback_concerns": f"WITH {_REV} " + _FALLBACK.format("Reported Customer Concern", "CASE WHEN rating = 1 THEN 'Major' ELSE 'Moderate' END AS severity", "rating <= 3", 3),
    "enriched_concerns": f"""WITH {_REV}, kind AS (SELECT DISTINCT source AS place_id, CAST(substring(source, 4) AS BIGINT) % 3 AS k FROM documents)
SELECT place_id, 0 AS ord, 'Given' AS aspect, 'as stated' AS evidence, 'Minor' AS severity, 'r7' AS ids FROM kind WHERE k = 0
UNION ALL SELECT place_id, o, ['Food', 'Quiet'][o + 1], ['Food - cold', 'Quiet'][o + 1], ['Moderate', 'Minor'][o + 1], 'r' || (o + 1) FROM kind, (SELECT unnest([0, 1]) AS o) WHERE k = 1
UNION ALL SELECT r.place_id, CAST(n - 1 AS INTEGER), 'Reported Customer Concern', left(text, 150), CASE WHEN rating = 1 THEN 'Major' ELSE 'Moderate' END, 'r' || pos
FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY pos) AS n FROM rev WHERE rating <= 3) r JOIN kind ON kind.place_id = r.place_id WHERE k = 2 AND n <= 3""",
    "point_evidence": f"""WITH {_POINTS} SELECT place_id, ord, polarity, coalesce(nullif(aspect, ''), CASE WHEN contains(coalesce(claim, ''), ' - ') THEN split_part(claim, ' - ', 1) ELSE left(coalesce(claim, ''), 35) END) AS aspect, coalesce(claim, '') AS evidence,
  CASE WHEN polarity = 'positive' THEN CAST(round(0.92 - ord * 0.04, 2) AS DOUBLE) END AS confidence, CASE WHEN polarity = 'negative' THEN CASE WHEN ord = 0 THEN 'Moderate' ELSE 'Minor' END END AS severity,
  CASE WHEN len(coalesce(evidence, [])) > 0 THEN ids ELSE 'r' || (ord + 1) END AS ids FROM points""",
    "evidence_lines": f"WITH {_POINTS} SELECT place_id, ord, coalesce(claim, '') AS claim, array_to_string(coalesce(evidence, []), ', ') AS ids FROM points WHERE polarity = 'positive'",
    "pros_and_cons": f"""WITH {_POINTS}, l AS (SELECT place_id, list(claim ORDER BY ord) FILTER (WHERE polarity = 'positive') AS pros, list(claim ORDER BY ord) FILTER (WHERE polarity = 'negative') AS cons FROM points GROUP BY 1)
SELECT place_id, CAST(o AS INTEGER) AS ord, coalesce(pros[o + 1], '') AS pro, coalesce(cons[o + 1], '') AS con FROM l, range(0, 5) t(o) WHERE o < greatest(coalesce(len(pros), 0), coalesce(len(cons), 0))""",
    "verified_facts": f"""WITH {_REV}, w AS (SELECT place_id, pos, unnest(range(1, 4)) AS k, {_WORDS} AS w FROM rev),
kw AS (SELECT place_id, keyword, row_number() OVER (PARTITION BY place_id ORDER BY f) AS o FROM (SELECT place_id, w[k] AS keyword, min(pos * 10 + k) AS f FROM w WHERE k <= len(w) GROUP BY ALL)),
top AS (SELECT place_id, string_agg(keyword, ', ' ORDER BY o) AS t FROM kw WHERE o <= 4 GROUP BY 1)
SELECT place_id, 1 AS fact_no, 'Average rating of analyzed sample is ' || {_pct1("avg(rating)")} || '★ across ' || count(*) || ' reviews.' AS fact FROM rev GROUP BY 1 UNION ALL SELECT place_id, 2, 'Top verified positive customer descriptors: ' || t || '.' FROM top""",
    "verification_defaults": f"WITH {_CORR} SELECT place_id, status AS verification_status, accuracy, hallucination AS hallucination_detected FROM ver",
    "verification_banner": f"""SELECT place_id, coalesce(verification_status, 'PASS') AS status, CASE WHEN accuracy IS NULL THEN 'N/A' ELSE {_PCT.format("accuracy")} END AS accuracy, CASE WHEN hallucination_detected IS NULL THEN 'N/A' WHEN hallucination_detected THEN 'Yes' ELSE 'No' END AS hallucination
FROM (VALUES {X.VERIFICATIONS}) t(place_id, verification_status, status, accuracy, hallucination_detected)""",
    "verification_observations": f"""WITH {_REV}, {_TRUST}, s AS (SELECT place_id, count(*) AS n, avg(rating) AS r, count(*) FILTER (WHERE rating >= 4) AS p, count(*) FILTER (WHERE rating <= 2) AS c FROM rev GROUP BY 1),
o AS (SELECT s.place_id, unnest([
  {{'section': 'sentiment', 'ord': 0, 'observation': 'Review ratings average ' || {_pct1("r")} || '★ across ' || n || ' reviews (' || p || ' positive, ' || c || ' critical).'}},
  {{'section': 'sentiment', 'ord': 1, 'observation': 'Model 1 overall sentiment ''Mixed'' accurately aligns with reviewer sentiment distribution.'}},
  {{'section': 'aspects', 'ord': 0, 'observation': 'Food quality, service speed, and ambience dimensions match reviewer statements.'}},
  {{'section': 'keywords', 'ord': 0, 'observation': 'Frequent positive terms verified in reviews: clean, fast.'}},
  {{'section': 'guardrail', 'ord': 0, 'observation': 'Review authenticity trust score confirmed at ' || trust || '% (anomaly probability: ' || {_pct1("fake * 100")} || '%).'}},
  {{'section': 'guardrail', 'ord': 1, 'observation': 'Checked ' || n || ' reviews for repetitive templated phrasing; organic natural reviews confirmed.'}},
  {{'section': 'evidence', 'ord': 0, 'observation': 'Direct citations mapped to ' || least(n, 20) || ' review IDs with no hallucinated user claims.'}},
  {{'section': 'evidence', 'ord': 1, 'observation': 'All pros and cons are substantiated by verifiable reviewer quotes.'}}]) AS x FROM s JOIN pt ON pt.place_id = s.place_id)
SELECT place_id, x.section AS section, x.ord AS ord, x.observation AS observation FROM o""",
    "place_suggestions": f"""WITH {_FEATURES}, few AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS seq FROM feat),
named AS (SELECT *, concat_ws(', ', name, nullif(city, ''), country) AS display_name FROM few WHERE seq <= 14),
once AS (SELECT *, row_number() OVER (PARTITION BY query, display_name ORDER BY ord) AS seen FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY contains(lower(name || ' ' || city || '  ' || country), 'nation_1') DESC, ord) AS rank FROM once WHERE seen = 1)
SELECT query, 'nation_1' AS city, CAST(rank AS INTEGER) AS rank, display_name, display_name AS search_name, lat, lon, 'house' AS type, 'amenity' AS category FROM ranked WHERE rank <= 7""",
    "city_suggestions": """WITH f AS (SELECT r_name AS query, n_nationkey AS ord, n_name || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE ', ' || r_name END AS label, n_nationkey % 3 = 0 OR n_nationkey % 2 = 0 AS ok, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS seq FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY min(ord)) AS rank FROM f WHERE seq <= 18 AND ok GROUP BY query, label) SELECT query, CAST(rank AS INTEGER) AS rank, label FROM r WHERE rank <= 6""",
    "geocode_city": f"WITH {_FEATURES} SELECT query, arg_min(lat, ord) AS lat, arg_min(lon, ord) AS lon FROM feat GROUP BY 1",
    "category_icon": f"SELECT p_partkey, {_icon('''lower(p_type || ' ' || array_to_string(string_split(p_name, ' ')[1:3], ' '))''', {'widget': 'W', 'gear': 'G', 'ring': 'R', 'bolt': 'B', 'hot': 'H', 'red': 'D'}, '?')} AS icon FROM part",
    "category_icon_fixture": f"""WITH k AS (SELECT place_id, category, CASE WHEN types = '' THEN [] ELSE string_split(types, '|') END AS subtypes FROM (VALUES {X.CATEGORIES}) t(place_id, category, types))
SELECT place_id, {_icon("lower(category || ' ' || array_to_string(subtypes[1:3], ' '))", CATEGORY_ICONS, DEFAULT_ICON)} AS icon, array_to_string(list_filter(subtypes, lambda x: lower(x) <> lower(category))[1:6], '|') AS tags FROM k""",
    "subtype_tags": "SELECT p_partkey, array_to_string(list_filter(list_append(string_split(p_name, ' '), 'RED ' || p_type), lambda x: lower(x) <> 'red ' || lower(p_type))[1:6], '|') AS tags FROM part",
    "report_cache_fresh": """SELECT c_custkey, 'Café_' || c_custkey || '__Main-Street' AS slug, CAST(max(o_orderdate) AS DATE) AS day, max(o_orderdate) IS NOT NULL AS hit
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate > TIMESTAMP '2000-01-05 00:00:00' - INTERVAL 700 DAY GROUP BY 1""",
    "source_routing": f"""WITH q AS (SELECT query, lat, lon, CASE WHEN starts_with(query, 'http') THEN 'url' WHEN starts_with(lower(query), 'place_id:') THEN 'place_id' WHEN coalesce(lat, 0) <> 0 AND coalesce(lon, 0) <> 0 THEN 'map' ELSE 'search' END AS kind FROM (VALUES {X.REQUESTS}) t(query, city, lat, lon))
SELECT query, kind, CASE WHEN kind = 'map' THEN 'https://www.google.com/maps/search/' || replace(url_encode(query), '%2F', '/') || '/@' || CAST(lat AS DOUBLE) || ',' || CAST(lon AS DOUBLE) || ',17z' ELSE query END AS input,
  CASE WHEN kind IN ('url', 'place_id') THEN 1 WHEN kind = 'map' THEN 3 ELSE 5 END AS max_places, 'newest' AS reviews_sort, 'en' AS language FROM q""",
    "query_text": f"""SELECT query, city, CASE WHEN coalesce(city, '') = '' OR contains(lower(query), lower(city)) THEN query ELSE query || ', ' || city END AS full_query, query <> '' AND NOT starts_with(query, 'http') AS warn,
  CASE WHEN length(query) > 32 THEN left(query, 29) || '…' ELSE query END AS label FROM (VALUES {X.REQUESTS}) t(query, city, lat, lon)""",
    "json_repair": """SELECT CAST(id AS BIGINT) AS id, k, parsed FROM (VALUES (1, 'v', true), (2, 'v2', true), (3, 'v3', true), (4, 'v4', true), (5, 'v5', true), (6, NULL, false), (7, 'v7', true), (8, '{"m":"v8"}', true), (9, NULL, true), (10, NULL, false)) t(id, k, parsed)
UNION ALL SELECT event_id + 1000, json_extract_string(props, '$.k'), true FROM events""",
    "url_expansion": f"""WITH q AS (SELECT coalesce(nullif(e.full_url, ''), r.query) AS query, lat, lon FROM (VALUES {X.REQUESTS}) r(query, city, lat, lon) LEFT JOIN (VALUES {X.EXPANSIONS}) e(short, full_url) ON trim(r.query) = e.short),
k AS (SELECT query, CASE WHEN starts_with(query, 'http') THEN 'url' WHEN starts_with(lower(query), 'place_id:') THEN 'place_id' WHEN coalesce(lat, 0) <> 0 AND coalesce(lon, 0) <> 0 THEN 'map' ELSE 'search' END AS kind FROM q)
SELECT query, kind, CASE WHEN kind IN ('url', 'place_id') THEN 1 WHEN kind = 'map' THEN 3 ELSE 5 END AS max_places FROM k""",
    "sentiment_context": f"""WITH {_REV}, w AS (SELECT place_id, pos, unnest(range(1, 4)) AS k, {_WORDS} AS w FROM rev),
kw AS (SELECT place_id, keyword, row_number() OVER (PARTITION BY place_id ORDER BY f) AS o FROM (SELECT place_id, w[k] AS keyword, min(pos * 10 + k) AS f FROM w WHERE k <= len(w) GROUP BY ALL))
SELECT place_id, string_agg(keyword, '|' ORDER BY o) FILTER (WHERE o <= 10) AS positive_keywords, string_agg(keyword, '|' ORDER BY o) FILTER (WHERE o <= 8) AS negative_keywords, string_agg(keyword, '|' ORDER BY o) FILTER (WHERE o <= 5) AS themes FROM kw GROUP BY 1""",
    "trimmed_concerns": f"""WITH {_POINTS} SELECT place_id, ord, coalesce(nullif(aspect, ''), CASE WHEN contains(coalesce(claim, ''), ' - ') THEN split_part(claim, ' - ', 1) ELSE left(coalesce(claim, ''), 35) END) AS aspect,
  left(coalesce(claim, ''), 80) AS evidence, CASE WHEN ord = 0 THEN 'Moderate' ELSE 'Minor' END AS severity FROM points WHERE polarity = 'negative' AND ord < 4""",
    "evidence_listing": f"WITH {_POINTS} SELECT place_id, polarity, ord, claim AS evidence, CASE WHEN polarity = 'negative' THEN CASE WHEN ord = 0 THEN 'Moderate' ELSE 'Minor' END END AS severity FROM points WHERE coalesce(claim, '') <> ''",
    "batch_extras": f"""WITH {_BATCHES} SELECT place_id, CASE WHEN count(*) = 1 THEN 'tone ' || CASE WHEN any_value(s) > 0 THEN 'Positive' ELSE 'Mixed' END END AS emotional_tone FROM batches WHERE batch = 0 OR place_id % 2 = 0 GROUP BY 1""",
    "model_info": f"""WITH m AS (SELECT place_id, map_from_entries(list({{'k': key, 'v': value}})) AS i FROM (VALUES {X.MODELS}) t(place_id, key, value) GROUP BY 1)
SELECT place_id, coalesce(i['model_a'], i['sentiment_model'], '—') AS analyst, coalesce(i['model_b'], i['verifier_model'], '—') AS verifier, coalesce(i['verdict_model'], i['model_a'], '—') AS explainer FROM m""",
    "verification_summary": f"SELECT place_id, coalesce(verification_status, 'PASS') AS verification_status, CAST(coalesce(accuracy, 0.94) AS DOUBLE) AS accuracy FROM (VALUES {X.VERIFICATIONS}) t(place_id, verification_status, status, accuracy, hallucination_detected)",
}
ORACLE_SQL["suggestion_grid"] = (
    "SELECT query, CAST((rank - 1) // 2 AS INTEGER) AS row, (rank - 1) % 2 AS col, CASE WHEN length(display_name) > 34 THEN left(display_name, 31) || '…' ELSE display_name END AS label "
    f"FROM ({ORACLE_SQL['place_suggestions']}) WHERE rank <= 6"
)

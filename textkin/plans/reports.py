"""Profiles, statistics, reports, metrics and alerts."""

from __future__ import annotations

from .dialect import plan, quoted
from .search import hits, top


def results(d) -> str:
    """CTE r(qid, id, score, rank): the search results that reports are about."""
    return f"{hits(d)}, r AS ({top('tfidf_hits', 20, 'score > 0')})"


def profile(columns: tuple[str, ...], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {quoted(c)} AS column_name, count({c}) AS non_null, count(*) - count({c}) AS missing, round(100.0e0 * (count(*) - count({c})) / count(*), 4) AS missing_percent, count(DISTINCT {c}) AS n_distinct FROM {table}" for c in columns
    )


@plan("column_profile")
def _(d):
    return profile(("doc_id", "text", "lang", "source", "n_chars"), "documents")


@plan("top_values")
def _(d):
    one = lambda c: f"SELECT {quoted(c)} AS column_name, value, n, r FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS r FROM (SELECT CAST({c} AS {'STRING' if d.explode('x')[0] == 'e' else 'VARCHAR'}) AS value, count(*) AS n FROM part GROUP BY {c})) WHERE r <= 50"
    return " UNION ALL ".join(map(one, ("p_brand", "p_type", "p_size")))


@plan("profile_merge")
def _(d):
    # exact for any number of chunks: partial counts per chunk and value, then one merge
    return "SELECT sum(n) AS n_rows, count(DISTINCT value) AS n_distinct, max(most) AS most FROM (SELECT p_partkey % 4 AS chunk, p_name AS value, count(*) AS n, max(p_size) AS most FROM part GROUP BY 1, 2)"


@plan("column_stats")
def _(d):
    return "SELECT 'text' AS column_name, count(*) AS n, round(avg(length(text)), 6) AS mean, CAST(min(length(text)) AS DOUBLE) AS least, CAST(max(length(text)) AS DOUBLE) AS most, CAST(NULL AS DOUBLE) AS std FROM documents UNION ALL SELECT 'p_retailprice', count(*), round(avg(p_retailprice), 4), min(p_retailprice), max(p_retailprice), round(stddev_samp(p_retailprice), 4) FROM part"


@plan("category_distribution")
def _(d):
    return f"WITH c AS (SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type) SELECT count(*) AS n_categories, sum(n) AS n_items, max(n) AS most, min(n) AS least, {d.median('n')} AS median, {d.count_if('n = 1')} AS singles, {d.count_if('n >= 100')} AS large FROM c"


@plan("category_top")
def _(d):
    return "SELECT p_type, n, r FROM (SELECT p_type, n, row_number() OVER (ORDER BY n DESC, p_type) AS r FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)) WHERE r <= 10"


@plan("data_quality")
def _(d):
    return "SELECT p_name, count(*) AS n, count(DISTINCT p_type) AS n_categories FROM part GROUP BY p_name HAVING count(*) > 1"


@plan("exact_dups")
def _(d):
    return "SELECT text_md5, n, first_id, last_id FROM (SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY md5(text)) WHERE n > 1"


@plan("multikey_dups")
def _(d):
    return "SELECT p_name, p_brand, p_type, n, first_key FROM (SELECT p_name, p_brand, p_type, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY p_name, p_brand, p_type) WHERE n > 1"


@plan("dup_prefilter")
def _(d):
    return "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY length(text), lower(substr(text, 1, 3))) AS n FROM documents WHERE length(text) > 3) WHERE n > 1"


@plan("report_summary")
def _(d):
    return f"WITH {results(d)} SELECT count(*) AS n, round(avg(score), 5) AS mean, max(score) AS most, min(score) AS least, {d.count_if('score >= 0.8e0')} AS high, {d.count_if('score >= 0.5e0 AND score < 0.8e0')} AS medium, {d.count_if('score < 0.5e0')} AS low FROM r"


@plan("report_stats")
def _(d):
    return f"WITH {results(d)} SELECT round(avg(score), 5) AS mean, round({d.median('score')}, 5) AS median, round(stddev_samp(score), 5) AS std, round({d.quantile('score', 0.25)}, 5) AS q25, round({d.quantile('score', 0.75)}, 5) AS q75 FROM r"


@plan("report_quality")
def _(d):
    return f"WITH {results(d)} SELECT rank, count(*) AS n, round(avg(score), 5) AS mean FROM r GROUP BY rank"


@plan("report_detail")
def _(d):
    return f"WITH {results(d)} SELECT qid, id, rank, score, CASE WHEN score >= 0.8e0 THEN 'excellent' WHEN score >= 0.6e0 THEN 'good' WHEN score >= 0.4e0 THEN 'fair' ELSE 'poor' END AS label FROM r"


@plan("comparison_table")
def _(d):
    return f"WITH {results(d)} SELECT qid, count(*) AS n, max(score) AS best, max(CASE WHEN rank = 1 THEN id END) AS best_id FROM r GROUP BY qid"


LADDERS = {
    "standard": ((0.95, "дубль"), (0.8, "точный аналог"), (0.6, "близкий аналог"), (0.4, "возможный аналог")),
    "jaccard": ((0.9, "дубль"), (0.7, "аналог"), (0.5, "близкий аналог"), (0.3, "возможный аналог")),
}


def ladder(x: str, name: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {t}e0 THEN {quoted(label)}" for t, label in LADDERS[name]) + " ELSE 'нет аналогов' END"


@plan("relation_type")
def _(d):
    return f"WITH {results(d)} SELECT qid, id, {ladder('score', 'standard')} AS standard, {ladder('score', 'jaccard')} AS jaccard FROM r"


@plan("relation_counts")
def _(d):
    return f"WITH {results(d)} SELECT {ladder('score', 'standard')} AS relation, count(*) AS n FROM r GROUP BY 1"


@plan("relation_share")
def _(d):
    return f"WITH {results(d)}, c AS (SELECT {ladder('score', 'jaccard')} AS relation, count(*) AS n FROM r GROUP BY 1) SELECT relation, n, round(100.0e0 * n / sum(n) OVER (), 4) AS percent FROM c"


@plan("enrich_results")
def _(d):
    return f"WITH {results(d)} SELECT qid, id, score, lang, source, length(text) AS n FROM r JOIN documents ON doc_id = id"


@plan("category_filter")
def _(d):
    # candidates are filtered before the best are cut
    return f"WITH {hits(d)}, c AS (SELECT qid, id, score FROM tfidf_hits JOIN documents ON doc_id = id WHERE lang = 'en') {top('c', 20, 'score > 0')}"


@plan("adaptive_threshold")
def _(d):
    return "SELECT n, CASE WHEN n < 30 THEN 85 WHEN n < 60 THEN 70 ELSE 50 END AS threshold FROM (SELECT round(avg(length(p_name)), 6) AS n FROM part)"


def last_1000() -> str:
    return "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL) WHERE r <= 1000"


@plan("metric_stats")
def _(d):
    rank = lambda p: f"max(CASE WHEN i = least(CAST(floor(n * {p}e0) AS BIGINT), n - 1) THEN value END)"
    return f"""WITH v AS ({last_1000()}), s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM v)
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, {rank(0.5)} AS median, {rank(0.95)} AS p95, {rank(0.99)} AS p99 FROM s GROUP BY event_type"""


@plan("nearest_rank")
def _(d):
    return f"SELECT event_type, value AS p90 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ({last_1000()})) WHERE i = least(CAST(floor(n * 0.9e0) AS BIGINT), n - 1)"


@plan("retention")
def _(d):
    return "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL '24' HOUR FROM events) GROUP BY event_type"


def hourly() -> str:
    return "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, avg(value) AS mean FROM events GROUP BY event_type, date_trunc('hour', ts)"


@plan("alerts")
def _(d):
    # rules: (metric, condition, threshold, level); an alert is raised when its rule begins to hold, resolved when it ceases
    rules = "('n', 'gt', 4.0, 'warning'), ('n', 'eq', 3.0, 'info'), ('mean', 'gt', 60.0, 'error'), ('mean', 'lt', 40.0, 'info')"
    return f"""WITH h AS ({hourly()}), m AS (SELECT event_type, hour, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM h UNION ALL SELECT event_type, hour, 'mean', mean FROM h),
a AS (SELECT event_type, hour, m.metric, cond, threshold, level, coalesce(CASE cond WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold ELSE abs(value - threshold) < 0.001e0 END, FALSE) AS active FROM m JOIN {d.values(rows=rules, columns="rule_metric, cond, threshold, level")} ON rule_metric = m.metric),
b AS (SELECT *, lag(active, 1, FALSE) OVER (PARTITION BY event_type, metric, cond ORDER BY hour) AS before FROM a)
SELECT event_type, hour, metric, cond, level, CASE WHEN active THEN 'raised' ELSE 'resolved' END AS change FROM b WHERE active <> before"""


@plan("health")
def _(d):
    return f"WITH h AS ({hourly()}) SELECT hour, CASE WHEN max(CASE WHEN event_type = 'error' AND n >= 4 THEN 1 ELSE 0 END) = 1 THEN 'unhealthy' WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'degraded' ELSE 'healthy' END AS health FROM h GROUP BY hour"


@plan("event_codec")
def _(d):
    return f"SELECT event_id, event_type, user_id, {d.json_int('props', 'k')} AS k FROM events"


@plan("event_metrics")
def _(d):
    return "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"


@plan("event_windows")
def _(d):
    return "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@plan("session_events")
def _(d):
    us = d.epoch("ts")
    return f"""WITH e AS (SELECT user_id, {us} AS t, CASE WHEN {us} - lag({us}) OVER (PARTITION BY user_id ORDER BY {us}, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(t) - min(t) AS micros FROM s GROUP BY user_id, session"""


@plan("stale_sessions")
def _(d):
    us = d.epoch("ts")
    return f"SELECT user_id, n FROM (SELECT user_id, sum(CASE WHEN gap > 60000000 THEN 1 ELSE 0 END) AS n FROM (SELECT user_id, {us} - lag({us}) OVER (PARTITION BY user_id ORDER BY {us}) AS gap FROM events) GROUP BY user_id)"


@plan("subscription_match")
def _(d):
    rows = "('a', 'click'), ('a', 'purchase'), ('b', 'error'), ('c', NULL)"
    return f"SELECT client, event_id FROM events JOIN {d.values(rows, 'client, wanted')} ON wanted IS NULL OR wanted = event_type"


@plan("doc_upsert")
def _(d):
    return "SELECT doc_id, h, version FROM (SELECT doc_id, h, version, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS r FROM (SELECT doc_id, md5(text) AS h, 1 AS version FROM documents UNION ALL SELECT doc_id, md5(lower(text)), 2 FROM documents WHERE lang = 'de')) WHERE r = 1"


@plan("incremental_skip")
def _(d):
    return "WITH new AS (SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN text || '.' ELSE text END) AS h FROM documents), known AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT doc_id FROM new WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.doc_id = new.doc_id AND known.h = new.h)"


@plan("incremental_index")
def _(d):
    return f"WITH new AS (SELECT doc_id, text FROM documents WHERE lang = 'fr') SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, {d.explode(d.words('text'))} AS term FROM new) GROUP BY term"


@plan("scan_catalog")
def _(d):
    return "SELECT p_partkey, trim(p_name) AS name, p_brand, p_type, p_retailprice FROM part"


@plan("stratified_sample")
def _(d):
    return "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR(20)) || '42'), doc_id) AS r FROM documents) WHERE r <= 20"


@plan("processing_stats")
def _(d):
    return "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, sum(n_chars) AS chars FROM documents GROUP BY lang"


@plan("index_stats")
def _(d):
    return f"SELECT count(*) AS postings, count(DISTINCT term) AS terms, count(DISTINCT id) AS items FROM (SELECT DISTINCT doc_id AS id, {d.explode(d.words('text'))} AS term FROM documents)"


@plan("evaluation")
def _(d):
    # of all hits; hits without a label count as not relevant, and how many have one is told
    return f"WITH {results(d)} SELECT qid, count(*) AS n, count(quality) AS labelled, round(avg(CASE WHEN quality = 1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS precision_at_k FROM r LEFT JOIN labels ON doc_id = id GROUP BY qid"


@plan("export_stats")
def _(d):
    return f"WITH {results(d)}, q AS (SELECT qid, count(*) AS n, avg(score) AS mean FROM r GROUP BY qid) SELECT count(*) AS queries, sum(n) AS results, round(avg(n), 5) AS per_query, round(avg(mean), 5) AS mean_score FROM q"


@plan("search_db_stats")
def _(d):
    return "SELECT count(*) AS n_items, count(DISTINCT p_name) AS n_names, count(DISTINCT p_brand) AS n_brands, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_with_rows FROM part"


@plan("processing_summary")
def _(d):
    w = d.size(d.words("text"))
    return f"SELECT lang, count(*) AS n, round(avg(length(text)), 5) AS mean_chars, round(avg({w}), 5) AS mean_words, round(avg(length({d.join(d.words('text'))}) / greatest(length(text), 1.0e0)), 5) AS kept_share FROM documents GROUP BY lang"


@plan("integration_report")
def _(d):
    # a score of the catalog: names that stand once, categories that are filled, names of one category alone; and what to do about each
    return """WITH n AS (SELECT p_name, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY p_name), s AS (SELECT round(100.0e0 * avg(CASE WHEN n = 1 THEN 1.0e0 ELSE 0.0e0 END), 4) AS unique_names, round(100.0e0 * avg(CASE WHEN types = 1 THEN 1.0e0 ELSE 0.0e0 END), 4) AS one_category FROM n),
f AS (SELECT round(100.0e0 * avg(CASE WHEN p_type IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END), 4) AS filled FROM part)
SELECT unique_names, one_category, filled, round((unique_names + one_category + filled) / 3, 4) AS score, CASE WHEN unique_names < 90 THEN 'merge duplicates' ELSE 'none' END AS about_names, CASE WHEN one_category < 90 THEN 'settle categories' ELSE 'none' END AS about_categories FROM s CROSS JOIN f"""


@plan("conversation_turns")
def _(d):
    return "SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY role"

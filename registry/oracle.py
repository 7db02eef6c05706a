"""SQL for DuckDB that gives the same rows as ``registry.queries``."""

from __future__ import annotations

from hitlens.operators.parse import FIELDS, LINE, REQUEST_KEY
from hitlens.plans.site import EXTRACT_COLUMNS
from registry.access_log import HARD_URI, SITES

ORACLE: dict[str, str] = {}

_names = "[" + ", ".join(f"'{name}'" for name in FIELDS) + "]"
_pattern = LINE.replace("'", "''")
_present = " AND ".join(
    f"trim({c}) <> '' AND lower(trim({c})) <> 'nan'"
    for c in REQUEST_KEY
    if c not in ("status", "body_bytes_sent")
)
_PAIR = "'(?s)^[^=]*=.+'"
_KEYS = "list_transform(clean_query_list, lambda x: split_part(x, '=', 1))"
_SPLIT = "concat_ws('|', '123', " + ", ".join(f"{c}::varchar" for c in REQUEST_KEY) + ")"


def _unplus(text: str) -> str:
    return f"url_decode(replace({text}, '+', ' '))"


CTES = f"""
WITH base AS (
  SELECT event_id AS eid, concat(
    '10.', cast(user_id % 256 AS varchar), '.', cast(event_id % 256 AS varchar), '.7 - - [',
    strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' +0000] "',
    CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT'
                    WHEN 'error' THEN 'HEAD' ELSE 'GET' END, ' ',
    regexp_replace(url, '^[a-z]+://[^/]+', ''),
    CASE WHEN event_id % 5 = 0 THEN '%20x%C3%B1' ELSE '' END, ' HTTP/1.1" ',
    CASE WHEN event_type = 'error' THEN '500' WHEN event_id % 17 = 0 THEN '404' ELSE '200' END,
    ' ', cast(cast(round(value * 100) AS int) AS varchar), ' "',
    CASE WHEN event_id % 11 = 0 THEN '-' ELSE url END,
    '" "Mozilla/5.0 (u', cast(user_id % 9 AS varchar), ')"') AS value
  FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)
), lines AS (
  SELECT value FROM base
  UNION ALL SELECT value FROM base WHERE eid % 13 = 0
  UNION ALL SELECT concat(value, ' 5') FROM base WHERE eid % 26 = 0
  UNION ALL SELECT replace(value, '"', '') FROM base WHERE eid % 19 = 0
  UNION ALL SELECT regexp_replace(value, '\\[[^\\]]*\\]', '[31/Feb/2024:10:00:00 +0000]') FROM base WHERE eid % 23 = 0
  UNION ALL SELECT regexp_replace(value, '"Mozilla[^"]*"', '"NaN"') FROM base WHERE eid % 29 = 0
  UNION ALL SELECT regexp_replace(value, '^[0-9.]+', '2001:db8::1') FROM base WHERE eid % 31 = 0
  UNION ALL SELECT replace(value, ' HTTP/1.1', '{HARD_URI} HTTP/1.1') FROM base WHERE eid % 37 = 0
  UNION ALL SELECT replace(value, '+0000]', '-0230]') FROM base WHERE eid % 41 = 0
  UNION ALL SELECT regexp_replace(value, '"[^"]*" "Mozilla', '"" "Mozilla') FROM base WHERE eid % 43 = 0
), matched AS MATERIALIZED (
  SELECT regexp_extract(value, '{_pattern}', {_names}) AS f
  FROM lines WHERE regexp_matches(value, '{_pattern}')
), parsed AS MATERIALIZED (
  SELECT f.remote_addr, f.remote_usr, f.date_time,
    substr(f.date_time, 1, 11) AS date, substr(f.date_time, 13, 8) AS time,
    f.method, f.req_uri, f.http_ver, try_cast(f.status AS integer) AS status,
    try_cast(f.body_bytes_sent AS integer) AS body_bytes_sent, f.http_referer, f.user_agent
  FROM matched
), decoded AS (
  SELECT DISTINCT *, url_decode(req_uri) AS dec_req_uri FROM parsed
  WHERE {_present} AND status IS NOT NULL AND body_bytes_sent IS NOT NULL
    AND try_strptime(left(date_time, 20), '%d/%b/%Y:%H:%M:%S') IS NOT NULL
), pieces AS (
  SELECT *,
    regexp_replace(regexp_extract(dec_req_uri, '^([^?#]*)', 1), ';[^/]*$', '') AS clean_path,
    list_filter(string_split(regexp_extract(dec_req_uri, '^[^?#]*\\?([^#]*)', 1), '&'),
                lambda x: regexp_matches(x, {_PAIR})) AS raw_pairs,
    coalesce(nullif(nullif(regexp_extract(http_referer,
      '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), ''), '-'), 'Unknown') AS domain,
    strptime(left(date_time, 20), '%d/%b/%Y:%H:%M:%S')
      - to_minutes(cast(date_time[22:24] AS integer) * 60 + cast(date_time[22] || date_time[25:26] AS integer))
      AS fdate_time
  FROM decoded
), requests AS MATERIALIZED (
  SELECT * EXCLUDE (raw_pairs),
    list_transform(raw_pairs, lambda x: {_unplus("split_part(x, '=', 1)")} || '=' ||
      {_unplus("substr(x, instr(x, '=') + 1)")}) AS clean_query_list,
    cast(epoch(fdate_time) AS bigint) AS dateunixtimest,
    hour(fdate_time) + minute(fdate_time) / 60.0::double AS fabstime,
    cast(dayofweek(fdate_time) + 1 AS integer) AS day_of_week,
    strftime(fdate_time, '%Y-%m-%dT%H:%M:%S.%g+0000') AS es_time
  FROM pieces
), sites AS (
  SELECT domain AS site, cast(row_number() OVER (ORDER BY n DESC, domain) - 1 AS integer) AS idx
  FROM (SELECT domain, count(*) AS n FROM requests WHERE domain <> 'Unknown' GROUP BY domain)
  ORDER BY idx LIMIT {SITES}
), extract AS (
  SELECT requests.*, coalesce(site, 'other') AS domain_category
  FROM requests LEFT JOIN sites ON domain = site
), keyed AS (
  SELECT *, ('0x' || substr(md5({_SPLIT}), 1, 8))::bigint % 10 < 8 AS training,
    concat_ws('|', clean_path, coalesce(array_to_string({_KEYS}, '&'), '')) AS page FROM extract
), tally AS (
  SELECT page, idx, count(*) AS n
  FROM keyed JOIN sites ON domain_category = site WHERE training GROUP BY ALL
), shares AS (
  SELECT page, idx, n / sum(n) OVER (PARTITION BY page) AS p FROM tally
), best AS (
  SELECT page, p, cast(idx AS double) AS prediction, site AS guess FROM (
    SELECT *, row_number() OVER (PARTITION BY page ORDER BY p DESC, idx) AS place FROM shares
  ) JOIN sites USING (idx) WHERE place = 1
), voted AS (
  SELECT keyed.*, coalesce(prediction, 0.0) AS prediction,
    CASE WHEN p > 0.70 THEN guess ELSE 'other' END AS prediction_domain
  FROM keyed LEFT JOIN best USING (page)
), tested AS (
  SELECT idx AS domain_index, cast(prediction AS integer) AS prediction
  FROM voted JOIN sites ON domain_category = site WHERE NOT training
), cells AS (
  SELECT domain_index, prediction, count(*) AS requests FROM tested GROUP BY ALL
), scored AS (
  SELECT *, body_bytes_sent::double / (body_bytes_sent::double + 1000) AS outlierScore FROM extract
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY domain_category ORDER BY outlierScore) AS place,
    count(*) OVER (PARTITION BY domain_category) AS n FROM scored
), limits AS (
  SELECT domain_category, min(outlierScore) AS threshold FROM ranked
  WHERE place >= ceil((1.0::double - 0.05::double) * n) GROUP BY domain_category
), labelled AS (
  SELECT scored.*, outlierScore >= threshold AS anomaly_bool
  FROM scored JOIN limits USING (domain_category)
)
"""


def _list(expression: str) -> str:
    return f"array_to_string({expression}, ' | ')"


_TOKENS = f"list_concat(string_split(clean_path, '/'), {_KEYS})"
_CLASSES = (
    f"list_transform({_TOKENS}, lambda x: CASE WHEN regexp_matches(x, '^[a-fA-F0-9]{{24}}$') THEN "
    "'MONGOID' WHEN regexp_matches(x, '^[0-9]+$') THEN 'DIGIT' ELSE x END)"
)
_GRAMS = (
    "list_transform(range(1, greatest(length(clean_path) - 7, 1)), "
    "lambda i: array_to_string(string_split(substr(clean_path, i, 9), ''), ' '))"
)
_EXTRACT = ", ".join(
    f"{_list(c)} AS {c}" if c == "clean_query_list" else c
    for c in EXTRACT_COLUMNS
    if c != "fdate_time"
)
_GAPS = """
  SELECT * REPLACE (
    CASE WHEN body_bytes_sent % 7 = 0 OR user_agent = 'NaN' THEN NULL ELSE user_agent END AS user_agent,
    CASE WHEN body_bytes_sent % 11 = 0 THEN NULL ELSE nullif(http_referer, '') END AS http_referer,
    CASE WHEN body_bytes_sent % 13 = 0 THEN NULL ELSE remote_usr END AS remote_usr)
  FROM parsed"""
_WORDS = "SELECT unnest(string_split(clean_path, '/')) AS word FROM requests"
_SIZES = """SELECT min(s)::integer AS min_array_length, max(s)::integer AS max_array_length,
  round(avg(s), 6) AS avg_array_length, round(stddev_samp(s), 6) AS stddev_array_length"""


def oracle(name: str, select: str) -> None:
    ORACLE[name] = CTES + select


oracle("log_raw", "SELECT value FROM lines")
oracle("log_parse", "SELECT * FROM parsed")
oracle("log_dedup", "SELECT DISTINCT * FROM parsed")
oracle("blank_to_null", _GAPS)
oracle(
    "drop_incomplete",
    f"SELECT * FROM ({_GAPS}) WHERE user_agent IS NOT NULL AND http_referer IS NOT NULL "
    "AND remote_usr IS NOT NULL",
)
oracle("uri_decode", "SELECT req_uri, dec_req_uri, count(*) AS requests FROM requests GROUP BY ALL")
oracle("uri_path", "SELECT date_time, remote_addr, dec_req_uri, clean_path FROM requests")
oracle(
    "uri_query",
    f"SELECT date_time, remote_addr, len(clean_query_list)::integer AS pairs, "
    f"{_list('clean_query_list')} AS clean_query_list FROM requests",
)
oracle(
    "referer_domain",
    """SELECT http_referer, coalesce(nullif(regexp_extract(http_referer,
         '^[a-z]+://([^/?#]*)', 1), ''), 'Unknown') AS domain, count(*) AS lines
       FROM parsed GROUP BY ALL""",
)
oracle(
    "log_time",
    "SELECT date_time, date, time, dateunixtimest, fabstime, day_of_week, es_time FROM requests",
)
oracle("log_features", f"SELECT {_EXTRACT}, domain_category FROM extract")
oracle("path_tokens", f"SELECT date_time, remote_addr, {_list(_TOKENS)} AS url_features FROM requests")
oracle(
    "agent_tokens",
    f"""SELECT user_agent, len(string_split(user_agent, ' '))::integer AS words,
        {_list("string_split(user_agent, ' ')")} AS agent FROM requests""",
)
oracle("query_keys", f"SELECT date_time, remote_addr, {_list(_KEYS)} AS keys FROM requests")
oracle(
    "query_values",
    f"""SELECT date_time, remote_addr,
      {_list("list_transform(clean_query_list, lambda x: substr(x, instr(x, '=') + 1))")} AS values,
      {_list("list_transform(clean_query_list, lambda x: split_part(x, '=', 2))")} AS cut_values
    FROM requests""",
)
oracle(
    "query_pairs",
    """SELECT split_part(p, '=', 1) AS query_key, substr(p, instr(p, '=') + 1) AS query_value,
         count(*) AS requests
       FROM (SELECT unnest(clean_query_list) AS p FROM requests) GROUP BY ALL""",
)
oracle("path_normalise", f"SELECT clean_path, {_list(_CLASSES)} AS url_features_regex FROM requests")
oracle(
    "path_document",
    f"SELECT array_to_string({_CLASSES}, ' ') AS document, count(*) AS requests "
    "FROM requests GROUP BY ALL",
)
oracle(
    "path_ngrams",
    f"""SELECT date_time, remote_addr, clean_path,
         greatest(length(clean_path) - 8, 0)::integer AS grams,
         coalesce({_list(_GRAMS)}, '') AS path_ngrams FROM requests""",
)
oracle("token_counts", f"SELECT word, count(*) AS tokens FROM ({_WORDS}) GROUP BY word")
oracle("domain_category", "SELECT date_time, remote_addr, domain, domain_category FROM extract")
oracle(
    "path_contains",
    """SELECT domain, count(*) AS pairs FROM
         (SELECT domain, clean_path, unnest(clean_query_list) AS query_param FROM requests)
       WHERE contains(clean_path, '/en/') AND domain <> 'Unknown' GROUP BY domain""",
)
oracle(
    "row_slice",
    """SELECT date_time, remote_addr, req_uri, status FROM requests
       ORDER BY date_time, remote_addr, req_uri LIMIT 20 OFFSET 100""",
)
oracle(
    "union_sparse",
    """SELECT date_time, remote_addr, status::varchar AS error, NULL::varchar AS clean_path FROM requests
         WHERE status >= 500
       UNION ALL SELECT date_time, remote_addr, NULL::varchar, clean_path FROM requests
         WHERE status = 404""",
)
oracle("volume_by_date", "SELECT date, count(*) AS requests FROM requests GROUP BY date")
oracle("volume_by_domain", "SELECT domain, count(*) AS requests FROM requests GROUP BY domain")
oracle(
    "volume_by_date_domain",
    "SELECT date, domain, count(*) AS requests FROM requests GROUP BY date, domain",
)
oracle(
    "token_profile",
    f"""SELECT count(DISTINCT word) AS unique_words,
         min(length(word))::integer AS min_word_length, max(length(word))::integer AS max_word_length,
         round(avg(length(word)), 6) AS avg_word_length,
         round(stddev_samp(length(word)), 6) AS stddev_word_length FROM ({_WORDS})""",
)
oracle(
    "token_profile_merged",
    f"""SELECT true AS unique_words_near,
         min(length(word))::integer AS min_word_length, max(length(word))::integer AS max_word_length,
         round(avg(length(word)), 6) AS avg_word_length,
         round(stddev_samp(length(word)), 6) AS stddev_word_length FROM ({_WORDS})""",
)
oracle(
    "token_profile_weighted",
    f"""{_SIZES} FROM (SELECT len(w) AS s, unnest(w) FROM
         (SELECT string_split(clean_path, '/') AS w FROM requests))""",
)
oracle(
    "path_size_profile",
    f"{_SIZES} FROM (SELECT len(string_split(clean_path, '/')) AS s FROM requests)",
)
oracle(
    "job_log",
    """SELECT unnest(['Volume', 'Errors', 'Unknown']) AS Metric, unnest([concat(count(*), ', 20'),
         concat(count(*) FILTER (status >= 500)), concat(count(*) FILTER (domain = 'Unknown'))])
       AS Value FROM requests""",
)
oracle(
    "partition_scan",
    """SELECT date_time, remote_addr, method, dec_req_uri, domain_category FROM extract
       WHERE domain_category = (SELECT site FROM sites WHERE idx = 0)""",
)
oracle("partitioned_roundtrip", f"SELECT {_EXTRACT}, domain_category FROM extract")
oracle("append_again", f"SELECT {_EXTRACT}, domain_category FROM extract")
oracle(
    "csv_roundtrip",
    "SELECT date, domain_category, count(*) AS requests FROM extract GROUP BY ALL",
)
oracle(
    "anomaly_label",
    """SELECT date_time, remote_addr, domain_category, outlierScore,
         anomaly_bool::integer AS anomaly, anomaly_bool FROM labelled""",
)
oracle(
    "anomaly_top",
    """SELECT * FROM (
         SELECT domain_category, outlierScore, es_time, method, status, body_bytes_sent, http_referer,
           user_agent, dec_req_uri, row_number() OVER (PARTITION BY domain_category
             ORDER BY outlierScore DESC, es_time, method, status, body_bytes_sent, http_referer, user_agent,
               dec_req_uri)::integer AS place
         FROM labelled WHERE anomaly_bool
       ) WHERE place <= 10""",
)
oracle(
    "publish_rows",
    """SELECT method, status, body_bytes_sent, http_referer, user_agent, dec_req_uri, fabstime,
         day_of_week, es_time, outlierScore, anomaly_bool, domain_category FROM labelled""",
)
oracle(
    "detect_features",
    f"""SELECT date_time, remote_addr, es_time, fabstime, status, body_bytes_sent,
         (length(dec_req_uri) - length(clean_path))::integer AS query_len,
         {_list(_CLASSES)} AS url_features FROM requests""",
)
oracle(
    "category_index",
    """SELECT domain AS label, n AS requests, row_number() OVER (ORDER BY n DESC, domain) - 1
         AS domain_index
       FROM (SELECT domain, count(*) AS n FROM requests GROUP BY domain)""",
)
oracle(
    "category_index_skip",
    """SELECT date_time, remote_addr, method, method_index FROM extract JOIN (
         SELECT method, cast(row_number() OVER (ORDER BY n DESC, method) - 1 AS double)
           AS method_index
         FROM (SELECT method, count(*) AS n FROM extract
               WHERE domain_category <> 'other' AND method <> 'POST' GROUP BY method)
       ) USING (method) WHERE domain_category = 'other'""",
)
oracle(
    "method_onehot",
    """SELECT method, cast(i AS double) AS method_index, requests,
         CASE WHEN i = m THEN repeat('0', m) ELSE
           concat(repeat('0', i), '1', repeat('0', m - i - 1)) END AS method_onehot
       FROM (SELECT method, n AS requests, row_number() OVER (ORDER BY n DESC, method) - 1 AS i,
               count(*) OVER () - 1 AS m
             FROM (SELECT method, count(*) AS n FROM extract GROUP BY method))""",
)
oracle(
    "holdout_split",
    f"""SELECT date_time, remote_addr, req_uri,
         ('0x' || substr(md5({_SPLIT}), 1, 8))::bigint % 10 < 8 AS training FROM extract""",
)
oracle(
    "predict_threshold",
    """SELECT date_time, remote_addr, clean_path, prediction, prediction_domain FROM voted
       WHERE domain_category = 'other'""",
)
oracle(
    "ground_truth",
    f"""SELECT {_EXTRACT}, domain_category FROM voted WHERE domain_category <> 'other'
        UNION ALL SELECT {_EXTRACT}, prediction_domain FROM voted WHERE domain_category = 'other'""",
)
oracle(
    "confusion_matrix",
    """SELECT domain_index, prediction, requests,
         requests / sum(requests) OVER () AS percentage FROM cells""",
)
oracle(
    "confusion_pivot",
    "SELECT domain_index, "
    + ", ".join(
        f"coalesce(sum(requests) FILTER (prediction = {c}), 0)::bigint AS class_{c}"
        for c in range(SITES)
    )
    + " FROM cells GROUP BY domain_index",
)
oracle(
    "classifier_metrics",
    """, per AS (
      SELECT c.idx,
        (SELECT coalesce(sum(requests), 0) FROM cells WHERE domain_index = c.idx) AS actual,
        (SELECT coalesce(sum(requests), 0) FROM cells WHERE prediction = c.idx) AS predicted,
        (SELECT coalesce(sum(requests), 0) FROM cells
         WHERE domain_index = c.idx AND prediction = c.idx) AS hits
      FROM sites c
    ), rates AS (
      SELECT actual, hits, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p,
        hits / actual AS r FROM per WHERE actual > 0
    )
    SELECT round(sum(hits) / sum(actual), 9) AS accuracy,
      round(sum(p * actual) / sum(actual), 9) AS weighted_precision,
      round(sum(r * actual) / sum(actual), 9) AS weighted_recall,
      round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * actual) / sum(actual), 9)
        AS weighted_f1
    FROM rates""",
)
oracle(
    "line_outcomes",
    f"""SELECT outcome, count(*) AS lines FROM (
         SELECT 'rejected' AS outcome FROM lines WHERE NOT regexp_matches(value, '{_pattern}')
         UNION ALL SELECT CASE
           WHEN NOT ({_present} AND status IS NOT NULL AND body_bytes_sent IS NOT NULL) THEN 'incomplete'
           WHEN try_strptime(left(date_time, 20), '%d/%b/%Y:%H:%M:%S') IS NULL THEN 'bad date'
           ELSE 'accepted' END FROM parsed) GROUP BY outcome""",
)
oracle(
    "confusion_share_pivot",
    "SELECT domain_index, "
    + ", ".join(
        f"round(coalesce(sum(requests) FILTER (prediction = {c}), 0) / any_value(total), 9) AS class_{c}"
        for c in range(SITES)
    )
    + " FROM (SELECT *, sum(requests) OVER () AS total FROM cells) GROUP BY domain_index",
)

# Models: what holds for them whatever the hashes and random trees are.

_METHODS = """methods AS (
  SELECT method, row_number() OVER (ORDER BY n DESC, method) AS place, count(*) OVER () AS kinds
  FROM (SELECT method, count(*) AS n FROM extract GROUP BY method))"""
oracle(
    "hashed_terms",
    f"""SELECT date_time, remote_addr, len({_TOKENS})::double AS url_features_2040,
         len({_TOKENS})::double AS url_features_512,
         len(string_split(user_agent, ' '))::double AS agent_32,
         greatest(len(string_split(user_agent, ' ')) - 6, 0)::double AS agent_ngrams_32
       FROM requests""",
)
oracle(
    "domain_features",
    f""", {_METHODS}
       SELECT date_time, remote_addr, (16384 + 3 + kinds - 1)::integer AS width,
         round(fabstime + day_of_week + body_bytes_sent + CASE WHEN place < kinds THEN 1 ELSE 0 END
           + greatest(length(clean_path) - 8, 0) + len(clean_query_list), 6) AS total
       FROM extract JOIN methods USING (method) WHERE domain_category <> 'other'""",
)
oracle(
    "detect_vector",
    f"""SELECT date_time, remote_addr, 516 AS width, round(fabstime + status + body_bytes_sent
         + length(dec_req_uri) - length(clean_path) + len({_TOKENS}), 6) AS total FROM requests""",
)
oracle(
    "forest_fit",
    """SELECT domain_category AS forest_group, 100::bigint AS trees,
         least(256, count(*))::integer AS least_sample, least(256, count(*))::integer AS most_sample,
         100 * least(256, count(*))::bigint AS leaf_rows FROM extract GROUP BY domain_category""",
)
_LABELS = "TRUE AS scores_fit, TRUE AS labels_fit FROM extract GROUP BY domain_category"
for _name in ("forest_score", "forest_by_domain", "forest_one_feature", "forest_embedding"):
    oracle(_name, f"SELECT domain_category, count(*) AS requests, {_LABELS}")
oracle(
    "path_minhash",
    """SELECT clean_path, count(*) AS requests, 1::bigint AS signatures, length(clean_path) < 9 AS missing
       FROM requests GROUP BY clean_path""",
)
_SIMILAR = """, sets AS (
  SELECT clean_path, count(*) AS requests, list_sort(list_distinct(
    list_transform(range(1, length(clean_path) - 1), lambda i: substr(clean_path, i, 3)))) AS terms
  FROM requests GROUP BY clean_path
), classes AS (
  SELECT min(clean_path) AS least, terms FROM sets WHERE len(terms) > 0 GROUP BY terms
), pairs AS (
  SELECT x.least AS a, y.least AS b, len(list_intersect(x.terms, y.terms))::bigint AS shared,
    len(x.terms) + len(y.terms) - shared AS total
  FROM classes x JOIN classes y ON x.least < y.least
), links AS (
  SELECT * FROM pairs WHERE 100 * shared >= 75 * total
)
"""
oracle("similar_paths", _SIMILAR + "SELECT * FROM links")
oracle(
    "similar_path_members",
    _SIMILAR
    + """SELECT clean_path, requests, coalesce(c.least, clean_path) AS least,
           (SELECT count(*) FROM links WHERE a = c.least OR b = c.least) AS n_links
         FROM sets LEFT JOIN classes c USING (terms)""",
)
oracle(
    "path_embedding",
    f""", worded AS (
         SELECT date_time, remote_addr, req_uri, clean_path, {_CLASSES} AS words FROM requests
       ), frequent AS (
         SELECT word FROM (SELECT unnest(words) AS word FROM worded) GROUP BY word HAVING count(*) >= 5
       ), common AS (
         SELECT list(word) AS words FROM frequent
       )
       SELECT date_time, remote_addr, clean_path, 100 AS width,
         NOT list_has_any(w.words, coalesce(c.words, [])) AS is_zero FROM worded w, common c""",
)
oracle(
    "train_domain",
    """SELECT count(*) AS tested, TRUE AS metrics_fit FROM keyed
       WHERE domain_category <> 'other' AND NOT training""",
)
for _query in ("predict_domain", "predict_stored"):
    oracle(
        _query,
        """SELECT method, count(*) AS requests, true AS classes_fit, true AS chances_fit, true AS most_likely,
         true AS labels_fit, count(DISTINCT (clean_path, clean_query_list)) > 1 AS tells_apart
       FROM extract WHERE domain_category = 'other' GROUP BY method""",
    )

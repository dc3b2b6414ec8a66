"""Independent SQL for the queries, over the same tables."""

from __future__ import annotations

from ..functions.labels import NEUTRAL_ATTRIBUTE
from ..functions.text import NEGATIVE_WORDS, POSITIVE_WORDS
from ..functions.values import (
    EMERGING,
    FALLING,
    FLAT,
    INSUFFICIENT,
    MEDIUM,
    MOSTLY_NEGATIVE,
    MOSTLY_POSITIVE,
    NEGATIVE,
    NEUTRAL,
    POLARITY_LABELS,
    POSITIVE,
    RISING,
    STRONG,
    UNKNOWN,
    WEAK,
)


def R(x: str, n: int = 2) -> str:
    return f"CAST(round(CAST(({x}) AS DECIMAL(38,12)), {n}) AS DOUBLE)"


def PCT(a: str, b: str) -> str:
    return f"coalesce({R(f'CAST({a} AS DOUBLE) * 100e0 / nullif(CAST({b} AS DOUBLE), 0)')}, 0e0)"


def DAY(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def HOUR(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:00')"


def B(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


_LABEL = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in POLARITY_LABELS.items()) + " END"

_POSTS_O = """
SELECT o_orderkey AS post_id, CAST(o_custkey AS VARCHAR) AS user_id, c_name AS username,
  o_orderpriority || ' ' || o_orderstatus AS content, o_orderdate AS publish_time,
  o_orderkey % 7 AS repost_count, o_orderkey % 5 AS comment_count, o_orderkey % 11 AS like_count,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 1000 END AS followers_count, o_orderkey % 5 AS n_images,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS sentiment_polarity,
  o_orderkey % 29 <> 0 AS has_attribute, substr(o_orderpriority, 3) AS attr1, o_orderstatus AS attr2,
  o_orderkey % 12 <> 4 AS has_belief, CAST(o_orderkey % 4 AS INTEGER) AS n_subs, 'C_' || o_orderstatus AS bcat,
  ['S_' || substr(o_orderpriority, 1, 1), 'M_' || month(o_orderdate), 'Q_' || quarter(o_orderdate)] AS subs,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS publisher_decision,
  CASE WHEN o_orderkey % 41 <> 0 THEN c_mktsegment END AS publisher,
  CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 53 <> 0 THEN n_name END AS location
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
"""
_POSTS_E = """
SELECT event_id AS post_id, CAST(user_id AS VARCHAR) AS user_id, ts AS publish_time, event_type AS publisher,
  CAST(least(5, 1 + floor(value / 100)) AS INTEGER) AS sentiment_polarity, CAST(floor(value) AS BIGINT) AS like_count
FROM events
"""
_POSTS_D = """
SELECT doc_id AS post_id, lang AS location, source AS publisher, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS publish_time
FROM documents
"""
_SPACE = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EMOJI = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2700}-\x{27BF}]+"
)


def CLEAN(x: str) -> str:
    out = f"regexp_replace({x}, '(?i)(https?://[^{_SPACE}]+|www\\.[^{_SPACE}]+)', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    out = f"regexp_replace({out}, '{_EMOJI}', ' ', 'g')"
    out = f"replace({out}, chr(8203), ' ')"
    return f"trim(regexp_replace({out}, '[{_SPACE}]+', ' ', 'g'))"


_TOKENS = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"


def _focus(posts: str, days: int = 14) -> dict[str, str]:
    return {
        "daily": f"SELECT CAST(publish_time AS DATE) AS d, count(*) AS n FROM {posts} GROUP BY 1",
        "calendar": "SELECT CAST(unnest(generate_series((SELECT min(d) FROM daily), (SELECT max(d) FROM daily), "
        "INTERVAL 1 DAY)) AS DATE) AS d",
        "rolled": "SELECT calendar.d, sum(coalesce(n, 0)) OVER (ORDER BY calendar.d ROWS BETWEEN "
        f"{days - 1} PRECEDING AND CURRENT ROW) AS total FROM calendar LEFT JOIN daily ON calendar.d = daily.d",
        "focus": f"SELECT d - {days - 1} AS s, d AS e, CAST(total AS BIGINT) AS posts FROM rolled "
        "ORDER BY total DESC, d LIMIT 1",
    }


_CTES = {
    "posts_o": _POSTS_O,
    "posts_e": _POSTS_E,
    "posts_d": _POSTS_D,
    "mentions": "SELECT l_orderkey AS post_id, l_linenumber AS position, p_brand AS parent_topic, p_type AS sub_topic "
    "FROM lineitem JOIN part ON l_partkey = p_partkey",
    "m": "SELECT mentions.*, publish_time, location, publisher FROM mentions JOIN posts_o USING (post_id)",
    "first_topic": "SELECT post_id, parent_topic, sub_topic FROM (SELECT *, row_number() OVER (PARTITION BY post_id "
    "ORDER BY position, parent_topic, sub_topic) AS rn FROM mentions) WHERE rn = 1",
    "total_o": "SELECT count(*) AS total FROM orders",
    "series": f"SELECT {HOUR('publish_time')} AS time, count(*) AS count, {R('avg(sentiment_polarity)')} AS avg_polarity, "
    f"{PCT('count(*) FILTER (WHERE sentiment_polarity >= 4)', 'count(*)')} AS positive_ratio, "
    f"{PCT('count(*) FILTER (WHERE sentiment_polarity <= 2)', 'count(*)')} AS negative_ratio "
    "FROM posts_e GROUP BY 1",
    "smooth": "SELECT *, avg(avg_polarity) OVER (ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sm FROM series",
    "diffs": f"SELECT *, {R('sm - lag(sm) OVER (ORDER BY time)', 9)} AS curr FROM smooth",
    "diffs2": "SELECT *, lag(curr) OVER (ORDER BY time) AS prev FROM diffs",
    "turns": f"SELECT time, {R('avg_polarity')} AS avg_polarity, CASE WHEN prev > 0 THEN 'up_to_down' ELSE 'down_to_up' "
    f"END AS direction, {R('curr - prev', 3)} AS delta FROM diffs2 "
    f"WHERE sign(prev) <> sign(curr) AND {R('abs(curr - prev)', 9)} >= 0.05",
    "spikes": f"SELECT time, count, {R('z', 2)} AS zscore FROM (SELECT time, count, "
    f"{R('(count - avg(count) OVER ()) / nullif(stddev_pop(count) OVER (), 0)', 9)} AS z FROM series) WHERE z >= 2",
    "toks": f"SELECT post_id, publish_time, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT post_id, "
    f"publish_time, regexp_extract_all({CLEAN('content')}, '{_TOKENS}') AS t FROM posts_d)",
    "tf": "SELECT post_id, publish_time, tok, count(*) AS n, min(pos) AS pos FROM toks GROUP BY ALL",
    "tfrank": "SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, pos) AS rank FROM tf",
    "words": "SELECT post_id, publish_time, lower(w) AS word FROM (SELECT post_id, publish_time, unnest("
    r"regexp_extract_all(content, '[A-Za-z]{3,}|[\x{4e00}-\x{9fff}]{2,}')) AS w FROM posts_d) "
    "WHERE NOT (lower(w) LIKE 'http%' OR lower(w) LIKE 'www%')",
    "located": "SELECT location, count(*) AS count FROM posts_o WHERE trim(location) <> '' GROUP BY 1",
    "rated": f"SELECT location, count(*) AS post_count, avg(sentiment_polarity) AS mean, "
    f"{R('avg(sentiment_polarity)')} AS avg_polarity, "
    f"{PCT('count(*) FILTER (WHERE sentiment_polarity >= 4)', 'count(*)')} AS positive_ratio, "
    f"{PCT('count(*) FILTER (WHERE sentiment_polarity <= 2)', 'count(*)')} AS negative_ratio "
    "FROM posts_o WHERE trim(location) <> '' AND sentiment_polarity IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "pub": f"SELECT coalesce(publisher, '{UNKNOWN}') AS publisher, count(*) AS count, "
    f"{R('avg(repost_count)')} AS avg_reposts, {R('avg(comment_count)')} AS avg_comments, "
    f"{R('avg(like_count)')} AS avg_likes, {R('avg(sentiment_polarity)')} AS avg_sentiment, "
    f"{B('sum(repost_count + comment_count + like_count)')} AS total_engagement, "
    f"{PCT('count(*)', '(SELECT total FROM total_o)')} AS percentage FROM posts_o GROUP BY 1",
    "parents": "SELECT DISTINCT post_id, parent_topic FROM mentions",
    "pairs": "SELECT a.parent_topic AS a, b.parent_topic AS b, count(*) AS count FROM parents a JOIN parents b "
    "ON a.post_id = b.post_id AND a.parent_topic < b.parent_topic GROUP BY 1, 2",
    "net": "SELECT * FROM pairs WHERE count >= 3 ORDER BY count DESC, a, b LIMIT 20",
    "signals": "SELECT post_id, unnest(CASE WHEN n_subs > 0 THEN subs[1:n_subs] ELSE [bcat] END) AS signal, "
    "CASE WHEN n_subs > 0 THEN n_subs ELSE 1 END AS k, bcat AS category, "
    "ln(1 + 5e0 * repost_count + 3 * comment_count + like_count) AS w FROM posts_o WHERE has_belief",
    "edges": f"SELECT source, target, {R('sum(w)', 6)} AS weight, CASE WHEN source = target THEN 'Loop' ELSE 'Regular' "
    "END AS type FROM (SELECT a.signal AS source, b.signal AS target, a.w FROM signals a JOIN signals b "
    "ON a.post_id = b.post_id AND (a.signal < b.signal OR a.k = 1)) GROUP BY 1, 2",
    "nodes": f"SELECT signal, arg_min(category, post_id) AS category, {R('sum(w * (k - 1))', 6)} AS co_occurrence_weight "
    "FROM signals GROUP BY 1",
    "kw30": "SELECT tok AS keyword, count(*) AS count FROM tfrank WHERE rank <= 30 GROUP BY 1",
    "ents": "SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY k, pos) - 1 AS pos, entity FROM ("
    "SELECT post_id, entity, min(k) AS k, arg_min(pos, (k, pos)) AS pos FROM ("
    "SELECT post_id, 0 AS k, unnest(t) AS entity, generate_subscripts(t, 1) AS pos FROM (SELECT post_id, "
    f"regexp_extract_all({CLEAN('content')}, '#([^#{_SPACE}]{{2,30}})#', 1) AS t FROM posts_d) UNION ALL "
    "SELECT post_id, 1 AS k, unnest(t) AS entity, generate_subscripts(t, 1) AS pos FROM (SELECT post_id, "
    rf"regexp_extract_all({CLEAN('content')}, '@([A-Za-z0-9_\-\x{{4e00}}-\x{{9fff}}]{{2,30}})', 1) AS t FROM posts_d)"
    ") GROUP BY 1, 2)",
    "enttop": "SELECT entity, count(*) AS count FROM ents GROUP BY 1 ORDER BY count DESC, entity LIMIT 15",
    "lex": "SELECT posts_d.post_id, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative FROM posts_d LEFT JOIN ("
    "SELECT post_id, count(*) FILTER (WHERE tok IN ("
    + ", ".join(f"'{w}'" for w in POSITIVE_WORDS)
    + ")) AS p, count(*) FILTER (WHERE tok IN ("
    + ", ".join(f"'{w}'" for w in NEGATIVE_WORDS)
    + ")) AS n FROM toks GROUP BY 1) x ON x.post_id = posts_d.post_id",
    "search": "SELECT page_id AS row_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS query, "
    "trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title, "
    "substr(regexp_extract(html, '<title>(.*?)</title>', 1), 1, 20) AS head, "
    r"regexp_replace(url, '[?#].*$', '') AS url, regexp_extract(url, '^https?://([^/]+)/', 1) AS source FROM pages",
    "docs": "SELECT row_id, 0 AS pos, query, title, trim(url) AS url, trim(head) AS snippet, source FROM search UNION ALL "
    "SELECT row_id, 1 AS pos, query, title, '' AS url, trim(source) AS snippet, source FROM search",
    "runs": "SELECT s_suppkey AS no, 'e_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, "
    "CASE s_suppkey % 5 WHEN 0 THEN 'sentiment_trend_tion' WHEN 1 THEN 'geographic_the_chart' WHEN 2 THEN "
    "'keyword_wordcloud' WHEN 3 THEN 'belief_and_network' ELSE 'participant_zzz' END AS tool_name, "
    "CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE '图表' END AS category, "
    "CASE WHEN s_suppkey % 7 = 0 THEN 'failed' ELSE 'success' END AS status, s_name AS summary, "
    "CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey % 3 END AS charts, "
    "CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey % 2 END AS data, s_suppkey % 7 = 0 AS error, "
    "s_suppkey % 5 <> 2 AS generates_chart FROM supplier",
    "insights": "SELECT 'insight_' || item_id AS insight_id, lower(CASE item_id % 4 WHEN 0 THEN text || "
    "' supplier#' || lpad(CAST(item_id % 90 AS VARCHAR), 9, '0') ELSE text END) AS text FROM benchmark",
    "hits": "SELECT insight_id, id, status, category FROM insights, runs WHERE contains(text, tool_name) "
    "OR contains(text, lower(summary)) OR len(list_filter(string_split(tool_name, '_'), "
    "lambda p: length(p) > 2 AND contains(text, p))) > 0",
    "log": "SELECT 'run_' || event_type AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY "
    "event_id - event_id % 2, tstext, event, branch_id, stage, node, status) AS seq, tstext AS ts, event, stage, node, "
    "branch_id, status FROM (SELECT *, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS tstext, "
    "CASE WHEN event_id % 3 = 0 THEN 'exit' ELSE 'enter' END AS event, 'stage' || (user_id % 3) AS stage, "
    "'node' || (user_id % 10) AS node, CASE WHEN user_id % 4 <> 0 THEN 'b' || (user_id % 20) ELSE 'main' END AS branch_id, "
    "CASE WHEN event_id % 3 = 0 THEN CASE WHEN value > 200 THEN 'failed' ELSE 'completed' END ELSE '' END AS status "
    "FROM events)",
    "last_event": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, branch_id ORDER BY seq DESC) AS rn "
    "FROM log) WHERE rn = 1",
    **_focus("posts_o"),
    "bagged": "SELECT post_id, lower(tok) AS tok, count(*) AS n FROM toks GROUP BY 1, 2",
    "keyed": "SELECT post_id, string_agg(tok || ':' || n, ' ' ORDER BY tok) AS key FROM bagged GROUP BY 1",
    "reps": "SELECT key, min(post_id) AS rep, count(*) AS copies FROM keyed GROUP BY 1",
    "repbag": "SELECT rep, copies, tok, n FROM reps JOIN bagged ON rep = post_id",
    "tokdf": "SELECT tok, sum(copies) AS df FROM repbag GROUP BY 1",
    "weights": "SELECT rep, tok, n * (ln((1e0 + (SELECT count(*) FROM posts_d)) / (1 + df)) + 1) AS w "
    "FROM repbag JOIN tokdf USING (tok)",
    "norms": "SELECT rep, sqrt(sum(w * w)) AS norm FROM weights GROUP BY 1",
    "dots": "SELECT a.rep AS a, b.rep AS b, sum(a.w * b.w) AS dot FROM weights a JOIN weights b ON a.tok = b.tok "
    "AND a.rep < b.rep GROUP BY 1, 2",
    "alike": f"SELECT a, b, {R('dot / (x.norm * y.norm)', 9)} AS similarity FROM dots JOIN norms x ON x.rep = a "
    f"JOIN norms y ON y.rep = b WHERE {R('dot / (x.norm * y.norm)', 9)} >= 0.85",
    "links": "SELECT a AS x, b AS y FROM alike UNION ALL SELECT b, a FROM alike",
    "reach": "SELECT rep AS node, rep AS seen FROM reps UNION SELECT y, seen FROM reach JOIN links ON x = node",
    "component": "SELECT node, min(seen) AS leader FROM reach GROUP BY 1",
    "member": "SELECT posts_d.post_id, coalesce(leader, posts_d.post_id) AS leader FROM posts_d LEFT JOIN keyed "
    "USING (post_id) LEFT JOIN reps USING (key) LEFT JOIN component ON node = rep",
    "clustered": "SELECT post_id, CAST(CASE WHEN count(*) OVER (PARTITION BY leader) >= 2 THEN dense_rank() OVER "
    "(ORDER BY leader) - 1 ELSE -1 END AS BIGINT) AS text_similarity_group FROM member",
}
_SIMILAR = "posts_d toks bagged keyed reps repbag tokdf weights norms dots alike"


def q(names: str, body: str, **more: str) -> str:
    """``body`` with the named common tables, in order."""
    parts = {n: _CTES[n] for n in names.split()} | more
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in parts.items()) + "\n" + body


_FOCUS = "daily calendar rolled focus"
_IN_FOCUS = "publish_time >= (SELECT s FROM focus) AND publish_time < (SELECT e + 1 FROM focus)"
_BUCKETS = (
    "count(*) FILTER (WHERE sentiment_polarity <= 2) AS negative, count(*) FILTER (WHERE sentiment_polarity = 3) AS "
    "neutral, count(*) FILTER (WHERE sentiment_polarity >= 4) AS positive, "
    "count(*) FILTER (WHERE sentiment_polarity IS NULL) AS unknown"
)
_TOTAL = "(SELECT total FROM total_o)"


def _top(source: str, key: str, k: int, where: str = "true", n: str = "count(*)") -> str:
    return (
        f"SELECT {key}, CAST({n} AS BIGINT) AS total FROM {source} WHERE {where} GROUP BY 1 ORDER BY total DESC, {key} LIMIT {k}"
    )


def _grid(source: str, rows: str, row: str, key: str, name: str) -> str:
    """Zero-filled counts of ``source(row, key)`` over rows × top keys."""
    return (
        f"SELECT r.{row}, t.{key}, coalesce(n, 0) AS {name} FROM {rows} r CROSS JOIN top t LEFT JOIN "
        f"(SELECT {row}, {key}, count(*) AS n FROM {source} GROUP BY 1, 2) c ON c.{row} = r.{row} AND c.{key} = t.{key}"
    )


_SENT = f"CASE WHEN sentiment_polarity <= 2 THEN '{NEGATIVE}' WHEN sentiment_polarity >= 4 THEN '{POSITIVE}' WHEN sentiment_polarity = 3 THEN '{NEUTRAL}' ELSE '{UNKNOWN}' END"
_GEO_CLASS = f"CASE WHEN {{0}} >= 3.5 THEN '{MOSTLY_POSITIVE}' WHEN {{0}} <= 2.5 THEN '{MOSTLY_NEGATIVE}' ELSE '{NEUTRAL}' END"
_ENGAGE = "repost_count + comment_count + like_count"
_SCORE = "repost_count * 3 + comment_count * 2 + like_count"
_KNOWN_PUB = f"coalesce(publisher, '{UNKNOWN}')"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

_NORMAL = q(
    "posts_o",
    f"""SELECT post_id, username, CASE WHEN post_id % 23 <> 0 THEN {_TS.format('publish_time')} END AS publish_time,
    coalesce(trim(location), '') AS location, CASE WHEN post_id % 19 = 0 THEN 0 ELSE repost_count END AS repost_count,
    CAST(0 AS BIGINT) AS comment_count, CASE WHEN post_id % 17 = 0 THEN 0 ELSE like_count END AS like_count,
    CASE WHEN post_id % 13 <> 0 THEN sentiment_polarity END AS sentiment_polarity FROM posts_o""",
)
_FEATURE_ROWS = """SELECT CAST(sentiment_polarity AS DOUBLE) AS sentiment_polarity, CAST(repost_count AS DOUBLE) AS repost_count,
  CAST(comment_count AS DOUBLE) AS comment_count, CAST(like_count AS DOUBLE) AS like_count,
  CAST(length(content) AS DOUBLE) AS content_length, CAST(n_images AS DOUBLE) AS image_count,
  CAST(coalesce(tc, 0) AS DOUBLE) AS topic_count FROM posts_o LEFT JOIN (SELECT post_id, count(*) AS tc FROM mentions
  GROUP BY 1) USING (post_id) WHERE sentiment_polarity IS NOT NULL"""
_FEATURES = (
    "sentiment_polarity", "repost_count", "comment_count", "like_count", "content_length", "image_count", "topic_count"
)
_CORR = "\nUNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, "
    + ("1e0" if a == b else f"coalesce({R(f'corr({a}, {b})', 3)}, 0e0)")
    + " AS correlation, count(*) AS sample_size FROM f"
    for a in _FEATURES
    for b in _FEATURES
)


_SETS = {
    "tokset": "SELECT DISTINCT post_id, tok FROM toks",
    "setkey": "SELECT post_id, string_agg(tok, ' ' ORDER BY tok) AS key, count(*) AS size FROM tokset GROUP BY 1",
    "sets": "SELECT key, min(post_id) AS rep, count(*) AS copies, max(size) AS size FROM setkey GROUP BY 1",
    "bag": "SELECT rep, tok FROM sets JOIN tokset ON rep = post_id",
}
_JACCARD = "CAST(inter AS DOUBLE) / (x.size + y.size - inter)"


def _cross(v1: str, v2: str, source: str, ctes: str) -> str:
    return q(
        ctes,
        f"""SELECT a.v1 AS value1, b.v2 AS value2, coalesce(n, 0) AS count, a.total AS row_total, b.total AS col_total,
        {PCT('coalesce(n, 0)', 'a.total')} AS row_percentage, {PCT('coalesce(n, 0)', 'b.total')} AS col_percentage
        FROM t1 a CROSS JOIN t2 b LEFT JOIN (SELECT v1, v2, count(*) AS n FROM x GROUP BY 1, 2) c
        ON c.v1 = a.v1 AND c.v2 = b.v2""",
        x=f"SELECT {v1} AS v1, {v2} AS v2 FROM {source}",
        t1=_top("x", "v1", 10),
        t2=_top("x", "v2", 10),
    )


def _participants(label: str) -> str:
    return q(
        "posts_e",
        """SELECT time, active_posts, active_users, new_users, new_user_posts,
        CAST(sum(new_users) OVER (ORDER BY time) AS BIGINT) AS cumulative_users FROM (
          SELECT x.time, count(*) AS active_posts, count(DISTINCT x.user_id) AS active_users,
          count(DISTINCT x.user_id) FILTER (WHERE x.time = f.time) AS new_users,
          count(*) FILTER (WHERE x.time = f.time) AS new_user_posts
          FROM x JOIN f USING (user_id) GROUP BY 1)""",
        x=f"SELECT {label} AS time, user_id FROM posts_e",
        f="SELECT user_id, min(time) AS time FROM x GROUP BY 1",
    )


ORACLES: dict[str, str] = {
    "read_posts": _NORMAL,
    "read_posts_array": _NORMAL,
    "normalize_posts": _NORMAL,
    "read_enriched": q(
        "posts_o mentions total_o",
        f"""SELECT count(*) AS total_count, count(*) FILTER (WHERE ok) AS valid_count,
        {PCT('count(*) FILTER (WHERE ok)', 'count(*)')} AS enhancement_rate FROM (SELECT sentiment_polarity IS NOT NULL
        AND has_attribute AND publisher IS NOT NULL AND post_id IN (SELECT post_id FROM mentions) AS ok FROM posts_o)""",
    ),
    "read_vocab": "SELECT DISTINCT p_brand AS parent_topic, p_type AS sub_topic FROM part",
    "resume_enrichment": q(
        "posts_o",
        """SELECT p.post_id, o.publisher_decision, o.publisher_decision IS NOT NULL AS resumed FROM posts_o p LEFT JOIN (
        SELECT content, publish_time, user_id, username, arg_min(publisher_decision, post_id) AS publisher_decision
        FROM posts_o WHERE publisher_decision IS NOT NULL GROUP BY ALL) o USING (content, publish_time, user_id, username)""",
    ),
    "remaining_posts": q(
        "posts_o",
        """SELECT post_id FROM posts_o p WHERE NOT EXISTS (SELECT 1 FROM posts_o o WHERE o.publisher_decision IS NOT NULL
        AND o.content = p.content AND o.publish_time = p.publish_time AND o.user_id = p.user_id
        AND o.username = p.username)""",
    ),
    "head_sample": q(
        "posts_o",
        f"""SELECT count(*) AS posts, count(*) FILTER (WHERE n_images > 0) AS posts_with_images,
        {B('sum(n_images)')} AS total_images FROM (SELECT * FROM posts_o ORDER BY post_id LIMIT 20)""",
    ),
    "cap_images": q(
        "posts_o",
        f"""SELECT count(*) AS total_posts, count(*) FILTER (WHERE n_images > 0) AS posts_with_images,
        count(*) FILTER (WHERE n_images > 3) AS posts_with_too_many_images,
        {B('sum(greatest(n_images - 3, 0))')} AS total_images_removed,
        count(*) FILTER (WHERE n_images > 3) AS posts_modified FROM posts_o""",
    ),
    "sentiment_bucket": q("posts_o", f"SELECT {_SENT} AS bucket, count(*) AS count FROM posts_o GROUP BY 1"),
    "time_key": q("posts_e", f"SELECT {HOUR('publish_time')} AS time, count(*) AS count FROM posts_e GROUP BY 1"),
    "explode_topics": q("mentions", "SELECT post_id, parent_topic, sub_topic FROM mentions"),
    "explode_attributes": q(
        "posts_o",
        """SELECT attribute, count(*) AS count FROM (SELECT attr1 AS attribute FROM posts_o WHERE has_attribute
        UNION ALL SELECT attr2 FROM posts_o WHERE has_attribute) GROUP BY 1""",
    ),
    "dim_value": q(
        "posts_o mentions first_topic",
        f"""SELECT dimension, value, count(*) AS count FROM (
        SELECT 'publisher' AS dimension, {_KNOWN_PUB} AS value FROM posts_o UNION ALL
        SELECT 'location', coalesce(nullif(location, ''), '{UNKNOWN}') FROM posts_o UNION ALL
        SELECT 'sentiment_polarity', coalesce({_LABEL.format('sentiment_polarity')}, '{UNKNOWN}') FROM posts_o UNION ALL
        SELECT 'topic', coalesce(parent_topic, '{UNKNOWN}') FROM posts_o LEFT JOIN first_topic USING (post_id))
        GROUP BY 1, 2""",
    ),
    "focus_filter": q(
        f"posts_o {_FOCUS}",
        f"SELECT post_id, {_TS.format('publish_time')} AS publish_time FROM posts_o WHERE {_IN_FOCUS}",
    ),
    "content_preview": """SELECT doc_id AS post_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...'
        ELSE text END AS preview FROM documents""",
    "clean_text": f"""SELECT 'document' AS kind, doc_id AS id, md5({CLEAN('text')}) AS digest,
        CAST(length({CLEAN('text')}) AS INTEGER) AS size FROM documents UNION ALL SELECT 'page', page_id,
        md5({CLEAN('html')}), CAST(length({CLEAN('html')}) AS INTEGER) FROM pages UNION ALL SELECT 'turn',
        conv_id * 100000 + turn, md5({CLEAN('text')}), CAST(length({CLEAN('text')}) AS INTEGER) FROM conversations""",
    "tokenize": f"""SELECT doc_id AS post_id, CAST(len(t) AS INTEGER) AS tokens, md5(coalesce(array_to_string(t, ' '), '')) AS digest
        FROM (SELECT doc_id, regexp_extract_all({CLEAN('text')}, '{_TOKENS}') AS t FROM documents)""",
    "content_words": q("posts_d words", "SELECT post_id, word, count(*) AS n FROM words GROUP BY 1, 2"),
    "keywords_topn": q(
        "posts_d toks tf tfrank", "SELECT post_id, rank, tok AS keyword, n FROM tfrank WHERE rank <= 10"
    ),
    "keywords_tfidf": q(
        "posts_d toks tf",
        """SELECT post_id, rank, tok AS keyword, score FROM (SELECT *, row_number() OVER (PARTITION BY post_id
        ORDER BY score DESC, pos) AS rank FROM scored) WHERE rank <= 10""",
        df="SELECT tok, count(*) AS df FROM tf GROUP BY 1",
        scored=f"""SELECT post_id, tok, pos, {R('n * (ln((1e0 + (SELECT count(*) FROM posts_d)) / (1 + df)) + 1)', 6)}
        AS score FROM tf JOIN df USING (tok)""",
    ),
    "entities": q("posts_d ents", "SELECT post_id, CAST(pos AS INTEGER) AS pos, entity FROM ents"),
    "lexicon_sentiment": q(
        "posts_d toks lex",
        """SELECT post_id, CASE WHEN positive > negative THEN 'positive' WHEN positive < negative THEN 'negative'
        ELSE 'neutral' END AS label, CAST(positive - negative AS INTEGER) AS score, CAST(positive AS INTEGER) AS positive,
        CAST(negative AS INTEGER) AS negative FROM lex""",
    ),
    "nlp_enrich": q(
        "posts_d toks tf tfrank ents lex",
        """SELECT l.post_id, coalesce(k.keywords, '') AS keywords, CAST(coalesce(e.n, 0) AS INTEGER) AS entities,
        CASE WHEN positive > negative THEN 'positive' WHEN positive < negative THEN 'negative' ELSE 'neutral' END AS label
        FROM lex l LEFT JOIN (SELECT post_id, string_agg(tok, ' ' ORDER BY rank) AS keywords FROM tfrank WHERE rank <= 8
        GROUP BY 1) k USING (post_id) LEFT JOIN (SELECT post_id, count(*) AS n FROM ents GROUP BY 1) e USING (post_id)""",
    ),
    "repair_mojibake": "SELECT doc_id AS post_id, md5(text) AS digest FROM documents",
    "similar_pairs": q(
        _SIMILAR,
        f"""SELECT a, b, {R('similarity', 6)} AS similarity, x.copies AS copies_a, y.copies AS copies_b FROM alike
        JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b UNION ALL
        SELECT rep, rep, 1e0, copies, copies FROM reps WHERE copies > 1""",
    ),
    "similar_pairs_jaccard": q(
        "posts_d toks",
        f"""SELECT a, b, {R(f'{_JACCARD}', 6)} AS similarity, x.copies AS copies_a, y.copies AS copies_b FROM (
        SELECT p.rep AS a, r.rep AS b, count(*) AS inter FROM bag p JOIN bag r ON p.tok = r.tok AND p.rep < r.rep GROUP BY 1, 2)
        JOIN sets x ON x.rep = a JOIN sets y ON y.rep = b WHERE {R(f'{_JACCARD}', 9)} >= 0.6 UNION ALL
        SELECT rep, rep, 1e0, copies, copies FROM sets WHERE copies > 1""",
        **_SETS,
    ),
    "text_copies": q(
        "posts_d toks bagged keyed reps", "SELECT post_id, rep FROM keyed JOIN reps USING (key)"
    ),
    "text_clusters": q(f"{_SIMILAR} links reach component member clustered", "SELECT * FROM clustered"),
    "text_cluster_sizes": q(
        f"{_SIMILAR} links reach component member clustered",
        "SELECT text_similarity_group, count(*) AS count FROM clustered WHERE text_similarity_group >= 0 GROUP BY 1",
    ),
    "parse_polarity": """SELECT o_orderkey AS post_id, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 3
        ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS polarity FROM orders""",
    "parse_attributes": f"""SELECT o_orderkey AS post_id, CASE o_orderkey % 7 WHEN 0 THEN '{NEUTRAL_ATTRIBUTE}'
        WHEN 1 THEN '' ELSE concat_ws(',', CASE WHEN substr(o_orderpriority, 3) IN ('URGENT', 'HIGH', 'MEDIUM')
        THEN substr(o_orderpriority, 3) END, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END) END
        AS attributes FROM orders""",
    "parse_topics": """SELECT p_partkey AS post_id, CASE WHEN p_partkey % 9 <> 0 AND (p_brand, p_type) IN (SELECT
        (p_brand, p_type) FROM part WHERE p_size <= 25) THEN p_brand || '>' || p_type ELSE '' END AS topics FROM part""",
    "parse_publisher": """SELECT c_custkey AS post_id, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'MACHINERY'
        ELSE c_mktsegment END AS publisher FROM customer""",
    "parse_beliefs": """SELECT p_partkey AS post_id, CASE WHEN p_partkey % 4 = 2 OR p_brand NOT IN (SELECT p_brand FROM
        part WHERE p_size > 10) THEN '' ELSE p_brand || ':' || CASE WHEN (p_brand, p_type) IN (SELECT (p_brand, p_type)
        FROM part WHERE p_size > 10) THEN p_type ELSE '' END END AS beliefs FROM part""",
    "parse_decision": """SELECT o_orderkey AS post_id, CASE WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'MEDIUM'
        WHEN o_orderpriority LIKE '%HIGH%' THEN 'HIGH' WHEN o_orderpriority LIKE '%URGENT%' THEN 'URGENT'
        ELSE 'MEDIUM' END AS decision FROM orders""",
    "apply_labels": q(
        "posts_o",
        """SELECT post_id, coalesce(sentiment_polarity, 4) AS sentiment_polarity,
        coalesce(publisher_decision, 'F') AS publisher_decision FROM posts_o""",
    ),
    "label_posts": q(
        "posts_o",
        """SELECT post_id, coalesce(sentiment_polarity, CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS sentiment_polarity,
        coalesce(publisher_decision, CASE WHEN substr(o_orderpriority, 3, 1) = 'U' THEN 'U' ELSE 'H' END)
        AS publisher_decision FROM posts_o JOIN orders ON o_orderkey = post_id""",
    ),
    "overview_totals": q(
        "posts_o",
        f"""SELECT count(*) AS total_posts, count(*) FILTER (WHERE sentiment_polarity IS NOT NULL OR has_attribute OR
        publisher IS NOT NULL) AS processed_posts, {B('sum(repost_count)')} AS total_reposts,
        {B('sum(comment_count)')} AS total_comments, {B('sum(like_count)')} AS total_likes,
        {R('avg(repost_count)', 6)} AS avg_reposts, {R('avg(comment_count)', 6)} AS avg_comments,
        {R('avg(like_count)', 6)} AS avg_likes, count(DISTINCT user_id) AS unique_users,
        {B('sum(n_images)')} AS total_images, count(*) FILTER (WHERE n_images > 0) AS posts_with_images,
        {R('avg(length(content))', 6)} AS avg_content_length FROM posts_o""",
    ),
    "overview_empty_fields": q(
        "posts_o mentions",
        """SELECT count(*) FILTER (WHERE sentiment_polarity IS NULL) AS sentiment_polarity_empty,
        count(*) FILTER (WHERE NOT has_attribute) AS sentiment_attribute_empty,
        count(*) FILTER (WHERE post_id NOT IN (SELECT post_id FROM mentions)) AS topics_empty,
        count(*) FILTER (WHERE publisher IS NULL) AS publisher_empty,
        count(*) FILTER (WHERE NOT has_belief) AS belief_system_empty,
        count(*) FILTER (WHERE publisher_decision IS NULL) AS publisher_decision_empty FROM posts_o""",
    ),
    "overview_top_users": q(
        "posts_o",
        f"""SELECT user_id, arg_min(username, post_id) AS username, {B(f'sum({_ENGAGE})')} AS total_engagement
        FROM posts_o GROUP BY 1 ORDER BY total_engagement DESC, user_id LIMIT 10""",
    ),
    "overview_hours": q(
        "posts_e", "SELECT strftime(publish_time, '%H:00') AS hour, count(*) AS count FROM posts_e GROUP BY 1"
    ),
    "overview_geo": q("posts_o", "SELECT location, count(*) AS count FROM posts_o WHERE location <> '' GROUP BY 1"),
    "overview_publishers": q(
        "posts_o", "SELECT publisher, count(*) AS count FROM posts_o WHERE publisher <> '' GROUP BY 1"
    ),
    "data_summary": q(
        "posts_e",
        f"""SELECT count(*) AS total_posts,
        rtrim(rtrim(strftime(min(publish_time), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS start,
        rtrim(rtrim(strftime(max(publish_time), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS "end",
        {R("floor(epoch(max(publish_time) - min(publish_time))) / 3600e0", 1)} AS span_hours,
        CAST(0 AS BIGINT) AS total_reposts, CAST(0 AS BIGINT) AS total_comments, {B('sum(like_count)')} AS total_likes
        FROM posts_e""",
    ),
    "data_summary_counts": q(
        "posts_o mentions",
        """SELECT 'sentiment' AS dimension, CAST(sentiment_polarity AS VARCHAR) AS value, count(*) AS count FROM posts_o
        WHERE sentiment_polarity IS NOT NULL GROUP BY 2 UNION ALL
        SELECT 'publisher', publisher, count(*) FROM posts_o WHERE publisher <> '' GROUP BY 2 UNION ALL
        SELECT * FROM (SELECT 'location', location, count(*) FROM posts_o WHERE location <> '' GROUP BY 2
          ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL
        SELECT * FROM (SELECT 'topic', parent_topic, count(*) FROM mentions GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
    ),
    "sample_posts_random": q(
        "posts_o",
        "SELECT post_id, sentiment_polarity FROM posts_o ORDER BY md5(CAST(post_id AS VARCHAR)), post_id LIMIT 10",
    ),
    "sample_for_report": q(
        "posts_o",
        "SELECT post_id, sentiment_polarity FROM posts_o ORDER BY md5(CAST(post_id AS VARCHAR)), post_id LIMIT 10",
    ),
    "sample_posts_influential": q(
        "posts_o", f"SELECT post_id, sentiment_polarity FROM posts_o ORDER BY {_ENGAGE} DESC, post_id LIMIT 10"
    ),
    "sample_posts_diverse": q(
        "posts_o",
        """SELECT post_id, sentiment_polarity FROM r WHERE rn <= 2 UNION ALL SELECT * FROM (SELECT post_id,
        sentiment_polarity FROM r WHERE rn > 2 ORDER BY h, post_id LIMIT 2)""",
        r="""SELECT post_id, sentiment_polarity, md5(CAST(post_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY
        coalesce(sentiment_polarity, 3) ORDER BY md5(CAST(post_id AS VARCHAR)), post_id) AS rn FROM posts_o""",
    ),
    "focus_window": q(
        f"posts_o {_FOCUS}", f"""SELECT {DAY('s')} AS start, {DAY('e')} AS "end", posts FROM focus"""
    ),
    "turning_points": q("posts_e series smooth diffs diffs2 turns", "SELECT * FROM turns"),
    "growth_rate": q(
        "posts_e series",
        f"""SELECT time, count, {R('(count - lag(count) OVER (ORDER BY time)) / CAST(lag(count) OVER (ORDER BY time) AS DOUBLE)')}
        AS growth_rate_vs_prev FROM series""",
    ),
    "volume_spikes": q("posts_e series spikes", "SELECT * FROM spikes"),
    "sentiment_distribution": q(
        "posts_o total_o",
        f"""SELECT v AS polarity_value, {_LABEL.format('v')} AS label, coalesce(n, 0) AS count,
        {PCT('coalesce(n, 0)', _TOTAL)} AS percentage, {_TOTAL} AS total_count,
        (SELECT count(sentiment_polarity) FROM posts_o) AS valid_count,
        (SELECT {R('avg(sentiment_polarity)')} FROM posts_o) AS avg_polarity,
        (SELECT {_LABEL.format('sentiment_polarity')} FROM c ORDER BY n DESC, sentiment_polarity LIMIT 1) AS dominant_polarity
        FROM (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS v) LEFT JOIN c ON c.sentiment_polarity = v""",
        c="SELECT sentiment_polarity, count(*) AS n FROM posts_o WHERE sentiment_polarity IS NOT NULL GROUP BY 1",
    ),
    "sentiment_share": q(
        "posts_o total_o",
        f"""SELECT sentiment_polarity AS polarity_value, {_LABEL.format('sentiment_polarity')} AS label, count(*) AS count,
        {PCT('count(*)', _TOTAL)} AS percentage FROM posts_o WHERE sentiment_polarity IS NOT NULL GROUP BY 1""",
    ),
    "sentiment_time_series": q("posts_e series", "SELECT * FROM series"),
    "sentiment_time_series_day": q(
        "posts_o",
        f"""SELECT {DAY('publish_time')} AS time, count(*) AS count, {R('avg(sentiment_polarity)')} AS avg_polarity,
        {PCT('count(*) FILTER (WHERE sentiment_polarity >= 4)', 'count(*)')} AS positive_ratio,
        {PCT('count(*) FILTER (WHERE sentiment_polarity <= 2)', 'count(*)')} AS negative_ratio FROM posts_o GROUP BY 1""",
    ),
    "sentiment_bucket_trend": q("posts_o", f"SELECT {DAY('publish_time')} AS time, {_BUCKETS} FROM posts_o GROUP BY 1"),
    "sentiment_focus_buckets": q(
        f"posts_o {_FOCUS}", f"SELECT {DAY('publish_time')} AS time, {_BUCKETS} FROM posts_o WHERE {_IN_FOCUS} GROUP BY 1"
    ),
    "sentiment_focus_daily": q(
        f"posts_o {_FOCUS}",
        f"""SELECT {DAY('publish_time')} AS time, {R('avg(sentiment_polarity)')} AS avg_polarity,
        count(sentiment_polarity) AS count FROM posts_o WHERE {_IN_FOCUS} GROUP BY 1""",
    ),
    "sentiment_focus_publisher": q(
        f"posts_o {_FOCUS}",
        f"""SELECT {DAY('publish_time')} AS time, {_KNOWN_PUB} AS publisher, {R('avg(sentiment_polarity)')} AS mean,
        {R('median(sentiment_polarity)')} AS median, count(sentiment_polarity) AS count FROM posts_o WHERE {_IN_FOCUS}
        GROUP BY 1, 2""",
    ),
    "sentiment_focus_publisher_top": q(
        f"posts_o {_FOCUS}",
        f"""SELECT {DAY('publish_time')} AS time, publisher, {R('avg(sentiment_polarity)')} AS mean,
        {R('median(sentiment_polarity)')} AS median, count(sentiment_polarity) AS count FROM x
        WHERE publisher IN (SELECT publisher FROM top) GROUP BY 1, 2""",
        x=f"SELECT publish_time, {_KNOWN_PUB} AS publisher, sentiment_polarity FROM posts_o WHERE {_IN_FOCUS}",
        top=_top("x", "publisher", 3),
    ),
    "attribute_trend": q(
        "posts_o",
        _grid("y", "times", "time", "attribute", "n"),
        x=f"""SELECT {DAY('publish_time')} AS time, attr1 AS attribute FROM posts_o WHERE has_attribute UNION ALL
        SELECT {DAY('publish_time')}, attr2 FROM posts_o WHERE has_attribute""",
        top=_top("x", "attribute", 6),
        y="SELECT * FROM x WHERE attribute IN (SELECT attribute FROM top)",
        times="SELECT DISTINCT time FROM y",
    ),
    "attribute_turning_points": q(
        "posts_o",
        """SELECT attribute, time, change FROM (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY abs(change) DESC,
        time) AS rn FROM steps WHERE change IS NOT NULL) WHERE rn = 1 AND abs(change) >= 1
        ORDER BY abs(change) DESC, attribute LIMIT 5""",
        x=f"""SELECT {DAY('publish_time')} AS time, attr1 AS attribute FROM posts_o WHERE has_attribute UNION ALL
        SELECT {DAY('publish_time')}, attr2 FROM posts_o WHERE has_attribute""",
        top=_top("x", "attribute", 10),
        y="SELECT * FROM x WHERE attribute IN (SELECT attribute FROM top)",
        times="SELECT DISTINCT time FROM y",
        grid=_grid("y", "times", "time", "attribute", "n"),
        steps="SELECT attribute, time, n - lag(n) OVER (PARTITION BY attribute ORDER BY time) AS change FROM grid",
    ),
    "sentiment_trend_label": q(
        "posts_e series",
        f"""SELECT min(time) AS start, max(time) AS "end", count(*) AS points, CASE WHEN count(*) < 2 THEN '{INSUFFICIENT}'
        WHEN arg_max(avg_polarity, time) > arg_min(avg_polarity, time) THEN '{RISING}'
        WHEN arg_max(avg_polarity, time) < arg_min(avg_polarity, time) THEN '{FALLING}' ELSE '{FLAT}' END AS trend FROM series""",
    ),
    "peak_periods": q("posts_e series", "SELECT * FROM series ORDER BY count DESC, time LIMIT 3"),
    "hourly_distribution": q(
        "posts_e", "SELECT CAST(hour(publish_time) AS INTEGER) AS hour, count(*) AS count FROM posts_e GROUP BY 1"
    ),
    "peak_hours": q(
        "posts_e",
        "SELECT CAST(hour(publish_time) AS INTEGER) AS hour, count(*) AS count FROM posts_e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    ),
    "sentiment_trend_series": q(
        "posts_e series smooth diffs diffs2 turns spikes",
        f"""SELECT time, count, avg_polarity, positive_ratio, {R('100e0 - positive_ratio - negative_ratio')} AS neutral_ratio,
        negative_ratio, time IN (SELECT time FROM turns) AS is_turning_point, time IN (SELECT time FROM spikes) AS is_spike
        FROM series""",
    ),
    "sentiment_anomalies": q(
        "posts_e series",
        f"""SELECT time, avg_polarity, count, CASE WHEN zp > 2 THEN {R('zp', 1)} END AS polarity_zscore,
        CASE WHEN zc > 2 THEN {R('zc', 1)} END AS count_zscore, {R('mp')} AS mean_polarity, {R('sp')} AS std_polarity,
        {R('mc')} AS mean_count, {R('sc')} AS std_count FROM z WHERE zp > 2 OR zc > 2""",
        b="""SELECT avg(avg_polarity) AS mp, stddev_pop(avg_polarity) AS sp, avg(count) AS mc, stddev_pop(count) AS sc
        FROM series""",
        z=f"""SELECT *, {R('abs(avg_polarity - mp) / nullif(sp, 0)', 9)} AS zp,
        {R('abs(count - mc) / nullif(sc, 0)', 9)} AS zc FROM series, b""",
    ),
    "topic_frequency": q(
        "mentions total_o",
        f"""SELECT level, topic, count(*) AS count, {PCT('count(*)', _TOTAL)} AS percentage FROM (
        SELECT 'parent' AS level, parent_topic AS topic FROM mentions UNION ALL SELECT 'sub', sub_topic FROM mentions)
        GROUP BY 1, 2""",
    ),
    "topic_pairs_top": q(
        "mentions total_o",
        f"""SELECT parent_topic || ' > ' || sub_topic AS topic, count(*) AS count, {PCT('count(*)', _TOTAL)} AS percentage
        FROM mentions GROUP BY 1 ORDER BY count DESC, topic LIMIT 10""",
    ),
    "topic_coverage": q(
        "mentions total_o",
        f"""SELECT count(DISTINCT post_id) AS posts_with_topics, {_TOTAL} AS total_posts,
        {PCT('count(DISTINCT post_id)', _TOTAL)} AS percentage FROM mentions""",
    ),
    "topic_time_evolution": q(
        "posts_o mentions m",
        f"""SELECT {DAY('publish_time')} AS time, parent_topic, count(*) AS count FROM m
        WHERE parent_topic IN (SELECT parent_topic FROM top) GROUP BY 1, 2""",
        top=_top("m", "parent_topic", 5),
    ),
    "topic_trends": q(
        "posts_o mentions m",
        f"""SELECT parent_topic, {R('f')} AS first_period_avg, {R('l')} AS last_period_avg,
        coalesce({R('(l - f) * 100e0 / nullif(f, 0)')}, 0e0) AS change_percentage, CASE WHEN f = 0 AND l > 0 THEN '{EMERGING}'
        WHEN {R('(l - f) * 100e0 / nullif(f, 0)', 9)} > 10 THEN '{RISING}'
        WHEN {R('(l - f) * 100e0 / nullif(f, 0)', 9)} < -10 THEN '{FALLING}' ELSE '{FLAT}' END AS trend FROM s""",
        top=_top("m", "parent_topic", 5),
        y=f"SELECT {DAY('publish_time')} AS time, parent_topic FROM m WHERE parent_topic IN (SELECT parent_topic FROM top)",
        times="SELECT DISTINCT time FROM y",
        grid=_grid("y", "times", "time", "parent_topic", "n"),
        placed="SELECT *, dense_rank() OVER (ORDER BY time) AS place, (SELECT count(*) FROM times) AS k FROM grid",
        s="""SELECT parent_topic, sum(n) FILTER (WHERE place <= k // 3) / CAST(max(k // 3) AS DOUBLE) AS f,
        sum(n) FILTER (WHERE place > k - ceil(k / 3e0)) / max(ceil(k / 3e0)) AS l FROM placed GROUP BY 1""",
    ),
    "topic_focus_trend": q(
        f"posts_o mentions m {_FOCUS}",
        """SELECT time, CAST(rank AS INTEGER) AS rank, parent_topic, count FROM (SELECT *, row_number() OVER (PARTITION BY
        time ORDER BY count DESC, parent_topic) AS rank FROM c) WHERE rank <= 5""",
        c=f"""SELECT {DAY('publish_time')} AS time, parent_topic, count(*) AS count FROM m WHERE {_IN_FOCUS}
        GROUP BY 1, 2""",
    ),
    "topic_focus_distribution": q(
        f"posts_o mentions m {_FOCUS}",
        _grid("y", "times", "time", "parent_topic", "count"),
        y=f"SELECT {DAY('publish_time')} AS time, parent_topic FROM m WHERE {_IN_FOCUS}",
        top=_top("y", "parent_topic", 5),
        times=f"SELECT DISTINCT {DAY('publish_time')} AS time FROM posts_o WHERE {_IN_FOCUS}",
    ),
    "topic_keyword_trend": q(
        "posts_d words",
        _grid("y", "times", "time", "word", "count"),
        y=f"SELECT {DAY('publish_time')} AS time, word FROM words",
        top=_top("y", "word", 8),
        times="SELECT DISTINCT time FROM y",
    ),
    "topic_focus_keywords": q(
        "posts_d words",
        _grid("y", "times", "time", "word", "count"),
        **_focus("posts_d"),
        y=f"SELECT {DAY('publish_time')} AS time, word FROM words WHERE {_IN_FOCUS}",
        top=_top("y", "word", 12),
        times=f"SELECT {DAY('d')} AS time FROM (SELECT unnest(generate_series((SELECT s FROM focus), (SELECT e FROM focus), "
        "INTERVAL 1 DAY)) AS d)",
    ),
    "topic_cooccurrence": q(
        "mentions total_o parents pairs",
        f"""SELECT a AS topic_a, b AS topic_b, count, {PCT('count', _TOTAL)} AS support,
        (SELECT count(*) FROM pairs) AS total_pairs_analyzed FROM pairs WHERE count >= 2
        ORDER BY count DESC, a, b LIMIT 20""",
    ),
    "topic_association_matrix": q(
        "mentions parents pairs",
        """SELECT x.t AS topic1, y.t AS topic2, coalesce(count, 0) AS count FROM k x JOIN k y ON x.t <> y.t
        LEFT JOIN pairs ON a = least(x.t, y.t) AND b = greatest(x.t, y.t)""",
        k="SELECT a AS t FROM pairs WHERE count >= 2 UNION SELECT b FROM pairs WHERE count >= 2",
    ),
    "topic_ranking": q(
        "mentions total_o",
        f"""SELECT parent_topic, count(*) AS count, {PCT('count(*)', _TOTAL)} AS percentage FROM mentions GROUP BY 1
        ORDER BY count DESC, parent_topic LIMIT 10""",
    ),
    "topic_evolution_dense": q(
        "posts_o mentions m",
        _grid("y", "times", "time", "parent_topic", "count"),
        top=_top("m", "parent_topic", 5),
        y=f"SELECT {DAY('publish_time')} AS time, parent_topic FROM m WHERE parent_topic IN (SELECT parent_topic FROM top)",
        times="SELECT DISTINCT time FROM y",
    ),
    "topic_focus_evolution": q(
        f"posts_o mentions m {_FOCUS}",
        f"SELECT *, time BETWEEN (SELECT {DAY('s')} FROM focus) AND (SELECT {DAY('e')} FROM focus) AS in_focus FROM grid",
        top=_top("m", "parent_topic", 5),
        y=f"SELECT {DAY('publish_time')} AS time, parent_topic FROM m WHERE parent_topic IN (SELECT parent_topic FROM top)",
        times="SELECT DISTINCT time FROM y",
        grid=_grid("y", "times", "time", "parent_topic", "count"),
    ),
    "topic_network": q(
        "mentions parents pairs net",
        f"""SELECT a AS topic_a, b AS topic_b, count, {R('count / CAST(max(count) OVER () AS DOUBLE)', 4)} AS relative_weight
        FROM net""",
    ),
    "topic_network_nodes": q(
        "mentions parents pairs net",
        """SELECT parent_topic AS topic, count(*) AS count FROM mentions WHERE parent_topic IN (SELECT a FROM net UNION
        SELECT b FROM net) GROUP BY 1""",
    ),
    "geo_distribution": q(
        "posts_o total_o located", f"SELECT location, count, {PCT('count', _TOTAL)} AS percentage FROM located"
    ),
    "geo_top": q(
        "posts_o total_o located",
        f"SELECT location, count, {PCT('count', _TOTAL)} AS percentage FROM located ORDER BY count DESC, location LIMIT 10",
    ),
    "geo_coverage": q(
        "posts_o total_o located",
        f"""SELECT {_TOTAL} AS total_posts, {B('sum(count)')} AS posts_with_location, count(*) AS unique_locations,
        {PCT('sum(count)', _TOTAL)} AS coverage_percentage FROM located""",
    ),
    "geo_hotspots": q(
        "posts_o total_o located",
        f"""SELECT location, count, {PCT('count', _TOTAL)} AS percentage, {R('t')} AS threshold,
        {PCT('sum(count) OVER ()', '(SELECT sum(count) FROM located)')} AS hotspot_concentration
        FROM located, (SELECT quantile_cont(count, 0.9) AS t FROM located) WHERE count >= t""",
    ),
    "geo_sentiment": q(
        "posts_o rated",
        f"""SELECT location, post_count, avg_polarity, positive_ratio, negative_ratio,
        {_GEO_CLASS.format(R('mean', 9))} AS sentiment_label,
        location = (SELECT location FROM rated ORDER BY avg_polarity DESC, location LIMIT 1) AS most_positive,
        location = (SELECT location FROM rated ORDER BY avg_polarity, location DESC LIMIT 1) AS most_negative FROM rated""",
    ),
    "geo_metric_matrix": q(
        "posts_o rated",
        f"""SELECT location, metric, value, {R('CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.5e0 END', 4)} AS scaled
        FROM (SELECT *, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM l)""",
        best="SELECT * FROM rated ORDER BY post_count DESC, location LIMIT 15",
        l=" UNION ALL ".join(
            f"SELECT location, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM best"
            for m in ("avg_polarity", "positive_ratio", "negative_ratio", "post_count")
        ),
    ),
    "geo_ranking": q(
        "posts_o total_o located rated",
        f"""SELECT location, count, {PCT('count', _TOTAL)} AS percentage, CASE WHEN post_count IS NULL THEN '{UNKNOWN}' ELSE
        {_GEO_CLASS.format('avg_polarity')} END AS sentiment_label FROM located LEFT JOIN rated USING (location)
        ORDER BY count DESC, location LIMIT 15""",
    ),
    "geo_sentiment_compare": q(
        "posts_o rated",
        """SELECT location, post_count, positive_ratio, negative_ratio, avg_polarity FROM rated
        ORDER BY post_count DESC, location LIMIT 12""",
    ),
    "geo_topic_matrix": q(
        "posts_o mentions m",
        _grid("y", "regions", "location", "parent_topic", "count"),
        regions=_top("m", "location", 10, "trim(location) <> ''"),
        y="SELECT location, parent_topic FROM m WHERE location IN (SELECT location FROM regions)",
        top=_top("y", "parent_topic", 8),
    ),
    "geo_time_matrix": q(
        "posts_o",
        _grid("y", "times", "time", "location", "count"),
        y=f"SELECT {DAY('publish_time')} AS time, location FROM posts_o WHERE location IS NOT NULL",
        top=_top("y", "location", 8),
        times="SELECT DISTINCT time FROM y",
    ),
    "publisher_distribution": q("posts_o total_o pub", "SELECT * FROM pub"),
    "top_publishers": q("posts_o total_o pub", "SELECT * FROM pub ORDER BY count DESC, publisher LIMIT 5"),
    "publisher_bar": q(
        "posts_o total_o pub",
        f"""SELECT publisher, count, avg_sentiment, CASE WHEN avg_sentiment IS NULL THEN '{UNKNOWN}' WHEN avg_sentiment >= 3.5
        THEN '{POSITIVE}' WHEN avg_sentiment <= 2.5 THEN '{NEGATIVE}' ELSE '{NEUTRAL}' END AS sentiment_class FROM pub""",
    ),
    "top_accounts": q(
        "posts_o",
        f"""SELECT username, coalesce(publisher, '{UNKNOWN}') AS publisher, e AS engagement, followers_count FROM (
        SELECT *, {_ENGAGE} AS e, row_number() OVER (PARTITION BY username ORDER BY {_ENGAGE} DESC, post_id) AS rn
        FROM posts_o) WHERE rn = 1 ORDER BY e DESC, username LIMIT 20""",
    ),
    "representative_posts": q(
        "posts_o",
        f"""SELECT post_id, username, {_KNOWN_PUB} AS publisher, {_TS.format('publish_time')} AS publish_time,
        {_ENGAGE} AS engagement, content FROM posts_o ORDER BY {_ENGAGE} DESC, post_id LIMIT 50""",
    ),
    "cross_matrix": _cross(
        _KNOWN_PUB, f"coalesce({_LABEL.format('sentiment_polarity')}, '{UNKNOWN}')", "posts_o", "posts_o"
    ),
    "cross_matrix_topic": _cross(
        f"coalesce(nullif(location, ''), '{UNKNOWN}')",
        f"coalesce(parent_topic, '{UNKNOWN}')",
        "posts_o LEFT JOIN first_topic USING (post_id)",
        "posts_o mentions first_topic",
    ),
    "influence_top": q(
        "posts_o",
        f"""SELECT post_id, username, content AS content_preview, {_TS.format('publish_time')} AS publish_time, repost_count,
        comment_count, like_count, {_SCORE} AS influence_score, sentiment_polarity, {_KNOWN_PUB} AS publisher FROM posts_o
        ORDER BY {_SCORE} DESC, post_id LIMIT 20""",
    ),
    "influence_summary": q(
        "posts_o",
        f"""SELECT count(*) AS total_posts, {B('sum(s)')} AS total_engagement, {R('sum(s) / CAST(count(*) AS DOUBLE)')}
        AS avg_influence_score, {PCT('sum(s) FILTER (WHERE rn <= 20)', 'sum(s)')} AS influence_concentration FROM (
        SELECT {_SCORE} AS s, row_number() OVER (ORDER BY {_SCORE} DESC, post_id) AS rn FROM posts_o)""",
    ),
    "publisher_influence": q(
        "posts_o",
        f"""SELECT {_KNOWN_PUB} AS publisher, {B(f'sum({_SCORE})')} AS total_influence FROM posts_o GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 10""",
    ),
    "correlation_matrix": q("posts_o mentions", _CORR, f=_FEATURE_ROWS),
    "correlation_significant": q(
        "posts_o mentions",
        f"""SELECT feature1, feature2, correlation, CASE WHEN abs(correlation) >= 0.7 THEN '{STRONG}' WHEN
        abs(correlation) >= 0.5 THEN '{MEDIUM}' ELSE '{WEAK}' END AS strength FROM c WHERE feature1 < feature2
        AND abs(correlation) >= 0.3""",
        f=_FEATURE_ROWS,
        c=_CORR,
    ),
    "publisher_buckets": q(
        "posts_o",
        f"""SELECT {_KNOWN_PUB} AS publisher, count(*) AS count, {_BUCKETS} FROM posts_o GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 10""",
    ),
    "publisher_focus": q(
        f"posts_o {_FOCUS}",
        _grid("y", "times", "time", "publisher", "count"),
        x=f"SELECT {DAY('publish_time')} AS time, {_KNOWN_PUB} AS publisher FROM posts_o WHERE {_IN_FOCUS}",
        top=_top("x", "publisher", 5),
        y="SELECT * FROM x WHERE publisher IN (SELECT publisher FROM top)",
        times="SELECT DISTINCT time FROM y",
    ),
    "publisher_topics": q(
        "posts_o mentions m",
        _grid("y", "pubs", "publisher", "parent_topic", "count"),
        x=f"SELECT {_KNOWN_PUB} AS publisher, parent_topic FROM m",
        pubs=_top("x", "publisher", 8),
        y="SELECT * FROM x WHERE publisher IN (SELECT publisher FROM pubs)",
        top=_top("y", "parent_topic", 8),
    ),
    "participant_trend": _participants(DAY("publish_time")),
    "participant_trend_hour": _participants(HOUR("publish_time")),
    "belief_signals_flat": q("posts_o signals", "SELECT post_id, signal, category FROM signals"),
    "belief_edges": q("posts_o signals edges", "SELECT * FROM edges"),
    "belief_nodes": q("posts_o signals nodes", "SELECT * FROM nodes"),
    "belief_network": q(
        "posts_o signals edges nodes",
        f"""SELECT signal, category, co_occurrence_weight, self_weight, {R('co_occurrence_weight + self_weight', 6)} AS
        total_weight, {R('CASE WHEN co_occurrence_weight + self_weight > 0 THEN sqrt(self_weight / (co_occurrence_weight + self_weight)) ELSE 0 END', 4)}
        AS inner_ratio FROM (SELECT nodes.*, coalesce(weight, 0e0) AS self_weight FROM nodes LEFT JOIN
        (SELECT source, weight FROM edges WHERE type = 'Loop') ON source = signal)""",
    ),
    "belief_network_edges": q(
        "posts_o signals edges",
        f"""SELECT source, target, weight, CASE WHEN weight <= {R('c[1]', 6)} THEN 1 WHEN weight <= {R('c[2]', 6)} THEN 2
        WHEN weight <= {R('c[3]', 6)} THEN 3 WHEN weight <= {R('c[4]', 6)} THEN 4 ELSE 5 END AS strength FROM edges,
        (SELECT quantile_cont(weight, [0.2, 0.4, 0.6, 0.8]) AS c FROM edges WHERE type = 'Regular') WHERE type = 'Regular'""",
    ),
    "keyword_frequency": q(
        "posts_d toks tf tfrank kw30", "SELECT * FROM kw30 ORDER BY count DESC, keyword LIMIT 30"
    ),
    "keyword_time_matrix": q(
        "posts_d toks tf tfrank",
        _grid("y", "times", "time", "keyword", "count"),
        x=f"SELECT {DAY('publish_time')} AS time, tok AS keyword FROM tfrank WHERE rank <= 10",
        top=_top("x", "keyword", 10),
        y="SELECT * FROM x WHERE keyword IN (SELECT keyword FROM top)",
        times="SELECT DISTINCT time FROM y",
    ),
    "entity_nodes": q("posts_d ents enttop", "SELECT * FROM enttop"),
    "entity_cooccurrence": q(
        "posts_d",
        """SELECT a.entity AS source, b.entity AS target, count(*) AS weight FROM ents_t a JOIN ents_t b ON a.post_id = b.post_id
        AND a.entity < b.entity WHERE a.entity IN (SELECT entity FROM enttop_t) AND b.entity IN (SELECT entity FROM enttop_t)
        GROUP BY 1, 2""",
        posts_t="SELECT post_id, publish_time, content || ' #' || lang || '# @' || source || ' #' || source || '#' AS content "
        "FROM posts_d JOIN documents ON doc_id = post_id",
        ents_t=_CTES["ents"].replace("posts_d", "posts_t"),
        enttop_t=_CTES["enttop"].replace("ents", "ents_t"),
    ),
    "lexicon_distribution": q(
        "posts_d toks lex",
        """SELECT CASE WHEN positive > negative THEN 'positive' WHEN positive < negative THEN 'negative' ELSE 'neutral' END
        AS label, count(*) AS count FROM lex GROUP BY 1""",
    ),
    "normalize_queries": """SELECT b.item_id, coalesce(s.queries, '') AS queries FROM benchmark b LEFT JOIN (
        SELECT item_id, string_agg(w, '|' ORDER BY p) AS queries FROM (SELECT *, row_number() OVER (PARTITION BY item_id
        ORDER BY p) AS rn FROM (SELECT item_id, trim(w) AS w, min(pos) AS p FROM (SELECT item_id,
        unnest(string_split(text, '.')) AS w, generate_subscripts(string_split(text, '.'), 1) AS pos FROM benchmark)
        GROUP BY 1, 2 HAVING trim(w) <> '')) WHERE rn <= 5 GROUP BY 1) s USING (item_id)""",
    "flatten_documents": q("search docs", "SELECT row_id, pos, query, title, url, snippet, source FROM docs"),
    "dedup_documents": q(
        "search docs",
        """SELECT row_id, pos, query, title, url, snippet, source FROM (SELECT *, row_number() OVER (PARTITION BY
        CASE WHEN url <> '' THEN url ELSE title || '|' || snippet END ORDER BY row_id, pos) AS rn FROM docs) WHERE rn = 1""",
    ),
    "search_totals": q(
        "search docs", "SELECT query, count(*) AS results FROM docs GROUP BY ROLLUP (query)"
    ),
    "search_sufficiency": q(
        "search docs",
        """SELECT CASE query WHEN 'en' THEN 2 WHEN 'de' THEN 1 ELSE 0 END AS round, count(*) AS documents_count,
        count(*) >= 4 OR CASE query WHEN 'en' THEN 2 WHEN 'de' THEN 1 ELSE 0 END >= 2 AS is_sufficient
        FROM (SELECT CASE WHEN query IN ('en', 'de') THEN query ELSE '' END AS query FROM docs) GROUP BY query""",
    ),
    "merge_branches": q(
        "runs",
        f"""SELECT 'chart' AS kind, tool_name AS source_tool, {B('sum(charts)')} AS outputs FROM runs GROUP BY 2
        HAVING sum(charts) > 0 UNION ALL SELECT 'table', tool_name, count(*) FROM runs WHERE data > 0 GROUP BY 2""",
    ),
    "merge_totals": q(
        "runs",
        f"""SELECT {B('sum(charts)')} AS total_charts, count(*) FILTER (WHERE data > 0) AS total_tables,
        (SELECT max(turn) FROM conversations) AS forum_rounds FROM runs""",
    ),
    "latest_conclusions": """SELECT conv_id AS discussion, turn AS round, md5(trim(text)) AS digest FROM (SELECT *,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1
        AND trim(text) <> ''""",
    "dimension_coverage": q(
        "runs",
        f"""SELECT d AS dimension, {B('coalesce(n, 0)')} AS charts, coalesce(n, 0) > 0 AS covered, coalesce(n, 0) < 20 AS
        below_minimum, {R("(count(*) FILTER (WHERE n > 0) OVER ()) / 5e0", 3)} AS coverage_ratio FROM (SELECT unnest(['sentiment',
        'topic', 'geographic', 'interaction', 'nlp']) AS d) LEFT JOIN (SELECT CASE tool_name WHEN 'sentiment_trend_tion'
        THEN 'sentiment' WHEN 'geographic_the_chart' THEN 'geographic' WHEN 'keyword_wordcloud' THEN 'nlp' WHEN
        'belief_and_network' THEN 'topic' ELSE 'interaction' END AS d, sum(charts) AS n FROM runs GROUP BY 1) USING (d)""",
    ),
    "tool_run_stats": q(
        "runs",
        """SELECT tool_name, runs, charts, data, error OR (generates_chart AND NOT error AND charts = 0) AS error,
        generates_chart AND NOT error AND charts = 0 AS empty_chart FROM (SELECT *, count(*) OVER (PARTITION BY tool_name)
        AS runs, row_number() OVER (PARTITION BY tool_name ORDER BY no DESC) AS rn FROM runs) WHERE rn = 1""",
    ),
    "insight_evidence": q(
        "runs insights hits",
        """SELECT insight_id, id, status, true AS matched FROM hits UNION ALL SELECT insight_id, id, status, false FROM
        insights, (SELECT id, status FROM runs WHERE status = 'success' ORDER BY no DESC LIMIT 2)
        WHERE insight_id NOT IN (SELECT insight_id FROM hits)""",
    ),
    "evidence_confidence": q(
        "runs insights hits",
        """SELECT insight_id, n AS evidence, CASE WHEN n >= 2 THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT i.insight_id, CASE WHEN count(h.id) > 0 THEN count(h.id) ELSE (SELECT least(2, count(*)) FROM runs
        WHERE status = 'success') END AS n FROM insights i LEFT JOIN hits h ON h.insight_id = i.insight_id GROUP BY 1)""",
    ),
    "event_log_normalize": q("log", "SELECT run_id, seq, ts, event, stage, node, branch_id, status FROM log"),
    "current_location": q(
        "log last_event",
        """SELECT run_id, coalesce(arg_max(stage, seq) FILTER (WHERE event = 'enter'), '') AS current_stage,
        coalesce(arg_max(node, seq) FILTER (WHERE event = 'enter'), '') AS current_node,
        count(*) FILTER (WHERE event = 'enter') AS open_branches FROM last_event GROUP BY 1""",
    ),
    "failed_exits": q(
        "log",
        """SELECT run_id, seq, event, node, branch_id, status FROM log WHERE event = 'exit' AND status = 'failed'
        ORDER BY seq DESC, run_id DESC LIMIT 20""",
    ),
    "recent_events": q(
        "log", "SELECT run_id, seq, event, node, branch_id, status FROM log ORDER BY seq DESC, run_id DESC LIMIT 50"
    ),
}

# Written and read back, or run as a stream: the same results as above.
ORACLES["write_results"] = ORACLES["geo_sentiment"]
# Sketches of so few users are exact.
ORACLES["participant_trend_approx"] = (
    f"SELECT time, active_posts, active_users, new_users, cumulative_users FROM ({ORACLES['participant_trend']})"
)
ORACLES["participant_ranges"] = q(
    "posts_e",
    """SELECT range_id, count(DISTINCT user_id) AS users FROM (SELECT unnest(range(1, 11)) AS range_id) r LEFT JOIN posts_e
    ON publish_time >= TIMESTAMP '2024-01-01' AND publish_time < TIMESTAMP '2024-01-01' + to_days(CAST(range_id AS INTEGER))
    GROUP BY 1""",
)
ORACLES["incremental_groups"] = q(
    "posts_d toks",
    f"SELECT * FROM ({_CTES['clustered']})",
    **_SETS,
    alike=f"""SELECT a, b FROM (SELECT p.rep AS a, r.rep AS b, count(*) AS inter FROM bag p JOIN bag r ON p.tok = r.tok
        AND p.rep < r.rep GROUP BY 1, 2) JOIN sets x ON x.rep = a JOIN sets y ON y.rep = b WHERE {R(f'{_JACCARD}', 9)} >= 0.6""",
    links=_CTES["links"],
    reach="SELECT rep AS node, rep AS seen FROM sets UNION SELECT y, seen FROM reach JOIN links ON x = node",
    component=_CTES["component"],
    member="""SELECT posts_d.post_id, coalesce(leader, posts_d.post_id) AS leader FROM posts_d LEFT JOIN setkey USING (post_id)
        LEFT JOIN sets USING (key) LEFT JOIN component ON node = rep""",
)
ORACLES["nlp_enrich_groups"] = (
    f"SELECT e.*, g.text_similarity_group FROM ({ORACLES['nlp_enrich']}) e JOIN ({ORACLES['text_clusters']}) g USING (post_id)"
)
# What stands between spaces, in place of word runs.
for _name in (
    "tokenize keywords_topn keywords_tfidf lexicon_sentiment nlp_enrich similar_pairs similar_pairs_jaccard text_clusters "
    "text_cluster_sizes"
).split():
    ORACLES[f"{_name}_spaces"] = ORACLES[_name]
    for _column in ("content", "text"):
        ORACLES[f"{_name}_spaces"] = ORACLES[f"{_name}_spaces"].replace(
            f"regexp_extract_all({CLEAN(_column)}, '{_TOKENS}')",
            f"list_filter(string_split({CLEAN(_column)}, ' '), lambda x: x <> '')",
        )
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CHINESE = "".join(chr(0x4E00 + k) for k in range(26))
# The best cost of each suffix is put in front of those of the shorter ones; then the words are read off from the front.
ORACLES["tokenize_dictionary"] = f"""
WITH RECURSIVE known AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z]+')) AS w FROM benchmark)
  GROUP BY 1
), whole AS (SELECT sum(n) AS t FROM known),
costs AS (SELECT w, length(w) AS l, CAST(round(1000000 * (ln(t) - ln(n))) AS BIGINT) AS c FROM known, whole),
toks AS (
  SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(
    regexp_replace(translate({CLEAN('text')}, '{_UPPER}', '{_LOWER}'), '([a-z]+) ([a-z]+) ([a-z]+)', '\\1\\2\\3', 'g'),
    '[0-9_]+|[a-z]+') AS t FROM documents)
), runs AS (SELECT DISTINCT tok AS r FROM toks WHERE tok >= 'a'),
starts AS (SELECT r, unnest(range(0, length(r))) AS i FROM runs),
found AS (
  SELECT s.r, s.i, list({{'c': k.c, 'l': k.l}}) AS cs
  FROM (SELECT r, i, l, substr(r, i + 1, l) AS w FROM starts, (SELECT DISTINCT l FROM costs) WHERE i + l <= length(r)) s
  JOIN costs k ON k.w = s.w GROUP BY ALL
), lists AS (
  SELECT s.r, list(coalesce(f.cs, [{{'c': CAST(round(1000000 * ln(t)) AS BIGINT), 'l': 1}}]) ORDER BY s.i) AS css
  FROM starts s LEFT JOIN found f ON f.r = s.r AND f.i = s.i CROSS JOIN whole GROUP BY s.r
), paths AS (
  SELECT r, css, length(r) AS i, [CAST(0 AS BIGINT)] AS best, CAST([] AS BIGINT[]) AS lens FROM lists
  UNION ALL
  SELECT r, css, i - 1, list_prepend(b.c, best), list_prepend(-b.m, lens) FROM (
    SELECT *, list_sort(list_transform(css[i], lambda x: {{'c': x.c + best[x.l], 'm': -x.l}}))[1] AS b FROM paths WHERE i > 0)
), walks AS (
  SELECT r, lens, CAST(1 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS words FROM paths WHERE i = 0
  UNION ALL
  SELECT r, lens, place + lens[place], list_append(words, substr(r, place, lens[place])) FROM walks
  WHERE place <= length(r)
), done AS (SELECT r, words FROM walks WHERE place > length(r)),
flat AS (
  SELECT doc_id, pos, CASE WHEN words IS NULL THEN tok ELSE translate(array_to_string(words, ' '), '{_LOWER}', '{_CHINESE}') END AS tok,
    coalesce(len(words), 1) AS n FROM toks LEFT JOIN done ON r = tok
)
SELECT doc_id AS post_id, CAST(coalesce(sum(n), 0) AS INTEGER) AS tokens, md5(coalesce(string_agg(flat.tok, ' ' ORDER BY pos), '')) AS digest
FROM documents LEFT JOIN flat USING (doc_id) GROUP BY doc_id"""
ORACLES["read_results"] = " UNION ALL ".join(
    f"SELECT '{operator}' AS operator, '{frame}' AS frame, {name} AS name, {n} AS n FROM ({ORACLES[operator]})"
    for operator, frame, name, n in (
        ("geo_sentiment", "locations", "location", "post_count"),
        ("sentiment_distribution", "levels", "label", "count"),
        ("publisher_distribution", "publishers", "publisher", "count"),
    )
)
ORACLES["write_graph"] = q(
    "posts_o signals edges nodes",
    "SELECT * FROM edges UNION ALL SELECT signal, category, co_occurrence_weight, 'node' FROM nodes",
)
ORACLES["incremental_enrich"] = ORACLES["nlp_enrich"]
ORACLES["write_enriched"] = q(
    "posts_e",
    f"""SELECT {DAY('publish_time')} AS publish_date, count(*) AS posts, count(sentiment_polarity) AS rated FROM posts_e
    GROUP BY 1""",
)
# The order in which a stream reads its events breaks ties of the raw sequence numbers.
ORACLES["stream_current_location"] = q(
    "",
    """SELECT run_id, coalesce(max(o).stage, '') AS current_stage, coalesce(max(o).node, '') AS current_node,
    count(o) AS open_branches FROM (SELECT run_id, CASE WHEN l.event = 'enter' THEN
    {'seq': l.seq, 'stage': l.stage, 'node': l.node} END AS o FROM last) GROUP BY 1""",
    raw="""SELECT 'run_' || event_type AS run_id, event_id - event_id % 2 AS seq, CASE WHEN event_id % 3 = 0 THEN 'exit'
    ELSE 'enter' END AS event, 'stage' || (user_id % 3) AS stage, 'node' || (user_id % 10) AS node,
    CASE WHEN user_id % 4 <> 0 THEN 'b' || (user_id % 20) ELSE 'main' END AS branch_id FROM events""",
    last="""SELECT run_id, branch_id, max({'seq': seq, 'event': event, 'stage': stage, 'node': node}) AS l FROM raw
    GROUP BY 1, 2""",
)
ORACLES["stream_sentiment_series"] = q("posts_e series", "SELECT * FROM series")
ORACLES["stream_participants"] = q(
    "posts_e",
    f"SELECT {HOUR('publish_time')} AS time, count(DISTINCT user_id) AS active_users FROM posts_e GROUP BY 1",
)

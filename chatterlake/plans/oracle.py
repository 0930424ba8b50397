"""SQL statements (DuckDB dialect) that must give the same rows as the queries."""

from ..functions.fixed_values import LANGUAGE_NAMES, STOP_WORDS, TOURISM_PHRASES
from .queries import CUSTOM_WORDS, KEYWORDS, SAMPLE_ROWS

W = r"\p{L}\p{N}_"
S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


def _any_of(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


LANGUAGES = f"names(code, name) AS (VALUES {_values(LANGUAGE_NAMES.items())})"
STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"

VALID = f"coalesce(regexp_matches(text, '(?s)[^{S}].+[^{S}]'), false)"
KEYWORD = _any_of("t", KEYWORDS)
LETTERS = "len(list_filter(range(1, len(c) - 2), lambda i: c[i] = c[i+1] AND c[i] = c[i+2] AND c[i] = c[i+3] AND c[i] <> chr(10))) > 0"
WORDS = (
    f"len(list_filter(range(1, len(k) - 1), lambda i: k[i] = k[i+2] AND regexp_matches(k[i], '^[{W}]') "
    f"AND regexp_matches(k[i+1], '^[{S}]'))) > 0"
)

# Documents with lower-cased text t, its characters c and its word/space/other runs k.
BASE = rf"""base AS (
  SELECT *, string_split(t, '') AS c, regexp_extract_all(t, '[{W}]+|[{S}]+|[^{W}{S}]+') AS k
  FROM (SELECT *, lower(text) AS t FROM documents))"""

# Dots with the character before, and the place q of the first visible character after a
# run of whitespace; a passage that starts at q and ends at a later dot must also end at p.
SENTENCES = rf"""
dots AS (
  SELECT doc_id, p, c[p-1] AS prev, p + 1 + length(regexp_extract(substr(t, p + 1), '^[{S}]+')) AS q
  FROM (SELECT doc_id, t, c, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] = '.')) AS p FROM base)),
pairs AS (
  SELECT a.doc_id, a.p, CASE WHEN b.p = a.q THEN a.q - 1 ELSE a.q END AS q, b.p AS d
  FROM dots a JOIN dots b ON a.doc_id = b.doc_id AND a.prev = b.prev AND b.p >= a.q AND b.p - a.q < a.p
  WHERE a.q > a.p + 1 AND (b.p > a.q OR a.q > a.p + 2)),
sentences AS (
  SELECT DISTINCT doc_id FROM pairs JOIN base USING (doc_id)
  WHERE substr(t, q, d - q) = substr(t, p - (d - q), d - q) AND d - q < p AND NOT contains(substr(t, q, d - q), chr(10)))"""

SPAM = f"""{BASE}, {SENTENCES},
flags AS (
  SELECT doc_id, text, lang, source, t, {VALID} AS is_valid, {KEYWORD} AS has_keyword, {LETTERS} AS letters, {WORDS} AS words,
         doc_id IN (SELECT doc_id FROM sentences) AS sentences
  FROM base),
clean AS (SELECT doc_id, lang, source, t AS cleaned_text FROM flags
          WHERE is_valid AND NOT has_keyword AND NOT letters AND NOT words AND NOT sentences)"""

CONFIDENCE = "round(('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT::DOUBLE / 16777216, 6)"


def _tokens(source, text, keep="", min_length=3):
    keep = keep + ", " if keep else ""
    return f"SELECT {keep}unnest(regexp_extract_all(lower({text}), '[{W}]{{{min_length},}}')) AS topic FROM {source}"


def _topics(source, text, language, n_languages, n_topics):
    """CTEs ending in `found(language, language_name, rank, topic, count)`."""
    return f"""{LANGUAGES},
frequent AS (SELECT {language} AS language FROM {source} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {n_languages}),
counted AS (
  SELECT language, topic, count(*) AS count
  FROM ({_tokens(source, text, f"{language} AS language")})
  WHERE topic NOT IN {STOPS} AND language IN (SELECT language FROM frequent) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY count DESC, topic) AS rank FROM counted),
found AS (
  SELECT language, coalesce(name, language) AS language_name, rank::INTEGER AS rank, topic, count
  FROM ranked LEFT JOIN names ON code = language WHERE rank <= {n_topics})"""


def _bayes(name, labelled, scored, features):
    """CTEs ending in `<name>(key, label, score, k)`: naive Bayes fitted on `labelled(label, text)`.

    `features(text)` gives the list of features of a text; `scored(key, text)` are the texts.
    """
    return f"""
{name}_train AS (SELECT label, unnest({features('text')}) AS f FROM ({labelled})),
{name}_model AS (SELECT f, label, count(*) AS n FROM {name}_train GROUP BY ALL),
{name}_classes AS (
  SELECT label, ln(d / sum(d) OVER ()) AS prior, ln(n + (SELECT count(DISTINCT f) FROM {name}_model)) AS denominator
  FROM (SELECT label, count(*) AS d FROM ({labelled}) GROUP BY 1)
  JOIN (SELECT label, sum(n)::DOUBLE AS n FROM {name}_model GROUP BY 1) USING (label)),
{name}_texts AS (SELECT key, {features('text')} AS fs FROM ({scored})),
{name}_weighted AS (
  SELECT key, label, sum(times * ln(1 + n)) AS s
  FROM (SELECT key, f, count(*) AS times FROM (SELECT key, unnest(fs) AS f FROM {name}_texts) GROUP BY ALL)
  JOIN {name}_model USING (f) GROUP BY ALL),
{name}_lp AS (
  SELECT t.key, c.label, len(fs) AS k, prior - len(fs) * denominator + coalesce(s, 0) AS lp
  FROM {name}_texts t CROSS JOIN {name}_classes c LEFT JOIN {name}_weighted w ON w.key = t.key AND w.label = c.label),
{name}_best AS (SELECT *, max(lp) OVER (PARTITION BY key) AS best FROM {name}_lp),
{name} AS (SELECT key, min(label) FILTER (lp = best) AS label, 1 / sum(exp(lp - best)) AS score, any_value(k) AS k FROM {name}_best GROUP BY key)"""


def _gram_list(text):
    """3-grams of a text; the characters are split once, as a lambda parameter."""
    return (
        f"flatten(list_transform([string_split(lower({text}), '')], "
        "lambda c: list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i+1] || c[i+2])))"
    )


def _word_list(text):
    return f"regexp_extract_all(lower({text}), '[{W}]+')"


LONG_ENOUGH = f"coalesce(regexp_matches(text, '(?s)[^{S}].{{3,}}[^{S}]'), false)"
FILLED = "CASE WHEN regexp_matches(text, '[^" + S + "]') THEN text ELSE 'empty' END"
LANG_TRAIN = "SELECT lang AS label, text FROM documents"
MOOD_TRAIN = "SELECT CASE WHEN toxic = 1 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS label, text FROM documents JOIN labels USING (doc_id)"
LANG = _bayes("lang_score", LANG_TRAIN, f"SELECT doc_id AS key, text FROM documents WHERE {LONG_ENOUGH}", _gram_list)
TURN_LANG = _bayes(
    "lang_score", LANG_TRAIN, f"SELECT conv_id || ':' || turn AS key, text FROM conversations WHERE {LONG_ENOUGH}", _gram_list
)
MOOD = _bayes("mood", MOOD_TRAIN, f"SELECT doc_id AS key, {FILLED} AS text FROM documents", _word_list)
CUT = "CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END"
CUT_MOOD = _bayes("mood", MOOD_TRAIN, f"SELECT doc_id AS key, {CUT} AS text FROM documents", _word_list)

TOURISM = f"{_any_of('lower(text)', TOURISM_PHRASES)}::INTEGER"

EVENTS = """dirty AS (
  SELECT event_id, event_type, user_id, value, ts,
    CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN 'no' WHEN 'error' THEN 'maybe' WHEN 'purchase' THEN '1' END AS is_reply
  FROM events)"""
FLAG = "CASE event_type WHEN 'click' THEN true WHEN 'purchase' THEN true WHEN 'view' THEN false END"

ALTERED = """altered AS (
  SELECT * REPLACE ((CASE WHEN p_brand = 'Brand#2' THEN p_size + 1 ELSE p_size END)::INTEGER AS p_size)
  FROM part WHERE p_type <> 'SMALL'),
only_left AS (SELECT * FROM part EXCEPT ALL SELECT * FROM altered),
only_right AS (SELECT * FROM altered EXCEPT ALL SELECT * FROM part)"""

DATED = f"""dated AS (
  SELECT year(o_orderdate)::INTEGER AS year, {TOURISM} AS tourism_related
  FROM documents JOIN orders ON doc_id = o_orderkey)"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

PART_TYPES = ["bigint", "string", "string", "string", "int", "double"]
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _share(part, whole, digits):
    return f"round(100.0 * {part} / nullif({whole}, 0), {digits})"


def _per_day(source):
    return f"""WITH d AS (SELECT day, count(*) AS n FROM ({source}) WHERE day IS NOT NULL GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d)
SELECT spine.day::VARCHAR AS day, coalesce(n, 0)::BIGINT AS count FROM spine LEFT JOIN d ON d.day = spine.day"""


def _distribution(source, label, digits):
    return f"""SELECT {label}, count(*) AS count, {_share('count(*)', 'sum(count(*)) OVER ()', digits)} AS share
FROM {source} GROUP BY {label}"""


def _profile_column(name):
    return (
        f"SELECT '{name}' AS \"column\", count(*) AS row_count, count(*) - count({name}) AS null_count, "
        f"min({name})::VARCHAR AS min_value, max({name})::VARCHAR AS max_value FROM part"
    )


def statements():
    """Statement per query name; queries without one are those SQL cannot state."""
    sql = {}
    sql["text_valid"] = f"SELECT doc_id, {VALID} AS is_valid FROM documents"
    sql["strip_length"] = (
        f"SELECT conv_id, turn, length(regexp_extract(text, '(?s)[^{S}](?:.*[^{S}])?'))::INTEGER AS stripped_length FROM conversations"
    )
    sql["spam_keywords"] = f"SELECT doc_id, {_any_of('lower(text)', KEYWORDS)} AS is_spam FROM documents"
    # The keyword file's lines are stripped, so `los ` is read as `los`.
    sql["spam_keyword_file"] = (
        f"SELECT doc_id FROM documents WHERE {_any_of('lower(text)', [k.strip() for k in KEYWORDS])}"
    )
    sql["spam_keyword_table"] = f"""WITH w AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{W}]{{12,}}')) AS keyword FROM benchmark)
SELECT DISTINCT doc_id FROM documents JOIN w ON contains(lower(text), keyword)"""
    sql["spam_repeat_letters"] = f"WITH {BASE} SELECT doc_id, {LETTERS} AS is_spam FROM base"
    sql["spam_repeat_words"] = f"WITH {BASE} SELECT doc_id, {WORDS} AS is_spam FROM base"
    sql["spam_repeat_sentences"] = (
        f"WITH {BASE}, {SENTENCES} SELECT doc_id, doc_id IN (SELECT doc_id FROM sentences) AS is_spam FROM base"
    )
    sql["spam_reasons"] = f"""WITH {SPAM} SELECT doc_id, CASE WHEN NOT is_valid THEN 'too_short' WHEN has_keyword THEN 'keyword'
  WHEN letters THEN 'repeated_letters' WHEN words THEN 'repeated_words' WHEN sentences THEN 'repeated_sentences' END AS spam_reason
FROM flags"""
    sql["clean_comments"] = f"WITH {SPAM} SELECT doc_id, cleaned_text FROM clean"
    sql["drop_missing"] = sql["clean_comments"]
    sql["clean_column"] = f"WITH {SPAM} SELECT doc_id, cleaned_text FROM documents LEFT JOIN clean USING (doc_id)"
    sql["removal_stats"] = f"""WITH {SPAM}, n AS (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM clean) AS b)
SELECT a AS original_count, b AS kept_count, a - b AS removed_count, {_share('(a - b)', 'a', 2)} AS removal_rate FROM n"""
    sql["filter_english"] = f"WITH {SPAM} SELECT doc_id, cleaned_text FROM clean WHERE lang = 'en'"
    sql["language_filter"] = f"""SELECT * FROM (SELECT doc_id, lang AS language, {CONFIDENCE} AS language_confidence FROM documents)
WHERE language IN ('en', 'fr') AND language_confidence >= 0.8"""
    sql["english_only"] = "SELECT doc_id, lang AS language FROM documents WHERE lang = 'en'"
    sql["unsupported_languages"] = f"""WITH {LANGUAGES}
SELECT language, count(*) AS count
FROM (SELECT CASE WHEN source = 'src0' THEN lang || '-x' ELSE lang END AS language FROM documents)
WHERE language NOT IN (SELECT code FROM names) GROUP BY 1"""
    sql["supported_languages"] = f"""WITH {LANGUAGES}
SELECT code AS language, name AS language_name, count(doc_id) AS count FROM names LEFT JOIN documents ON lang = code GROUP BY ALL"""
    sql["truncate_text"] = f"SELECT doc_id, {CUT} AS truncated FROM documents"
    sql["fill_missing"] = "SELECT doc_id, CASE WHEN source <> 'src1' THEN text ELSE '' END AS filled FROM documents"
    sql["fill_blank"] = f"""SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'empty' ELSE {FILLED} END AS filled FROM documents"""
    sql["tokens"] = f"SELECT * FROM ({_tokens('conversations', 'text', 'conv_id, turn')}) WHERE topic NOT IN {STOPS}"
    sql["word_counts"] = f"""SELECT topic, count(*) AS count FROM ({_tokens('documents', 'text')})
WHERE topic NOT IN {STOPS} GROUP BY 1"""
    sql["top_words"] = sql["word_counts"] + " ORDER BY count DESC, topic LIMIT 10"
    sql["topics_by_language"] = f"WITH {_topics('documents', 'text', 'lang', 5, 10)} SELECT * RENAME (language AS lang) FROM found"
    sql["clean_topics"] = f"WITH {SPAM}, {_topics('clean', 'cleaned_text', 'lang', 5, 10)} SELECT * FROM found"
    sql["topics_chart"] = f"WITH {_topics('documents', 'text', 'lang', 3, 15)} SELECT * RENAME (language AS lang) FROM found"
    sql["word_cloud"] = f"""WITH {_topics('documents', 'text', 'lang', 5, 100)}
SELECT * RENAME (language AS lang), round(count / max(count) OVER (PARTITION BY language), 6) AS weight FROM found"""
    sql["topics_overall"] = f"""SELECT row_number() OVER (ORDER BY count DESC, topic)::INTEGER AS rank, topic, count
FROM (SELECT topic, count(*) AS count FROM ({_tokens('conversations', 'text')}) WHERE topic NOT IN {STOPS}
      GROUP BY 1 ORDER BY count DESC, topic LIMIT 10)"""
    sql["topic_metadata"] = f"WITH {_topics('documents', 'text', 'lang', 5, 10)} SELECT * FROM found"
    sql["label_tourism"] = f"SELECT doc_id, {TOURISM} AS tourism_related FROM documents"
    sql["label_summary"] = f"""WITH n AS (SELECT count(*) AS total, sum({TOURISM})::BIGINT AS matches FROM documents)
SELECT total, matches, total - matches AS non_matches, {_share('matches', 'total', 2)} AS match_share,
  {_share('(total - matches)', 'total', 2)} AS non_match_share FROM n"""
    sql["label_custom"] = (
        f"SELECT conv_id, turn, {_any_of('lower(text)', CUSTOM_WORDS)}::INTEGER AS dialogue_related FROM conversations"
    )
    sql["language_distribution"] = f"""WITH {LANGUAGES}
SELECT lang, coalesce(name, lang) AS language_name, count, share
FROM ({_distribution('documents', 'lang', 1)}) LEFT JOIN names ON code = lang"""
    sql["top_groups"] = "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, user_id LIMIT 5"
    sql["distinct_languages"] = """SELECT count(*) AS language_count
FROM (SELECT DISTINCT CASE WHEN lang <> 'es' THEN lang END AS language FROM documents)"""
    sql["union_parts"] = """SELECT text AS comment, lang, NULL AS role FROM documents
UNION ALL SELECT text, NULL, role FROM conversations"""
    sql["row_count"] = " UNION ALL ".join(f"SELECT count(*) AS row_count, '{t}' AS table_name FROM {t}" for t in TABLES)
    sql["sample_exact"] = f"SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id) LIMIT {SAMPLE_ROWS}"
    sql["sample_ranges"] = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
ORDER BY md5('42:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber) LIMIT 20000"""
    # The same key for many rows: the row as JSON decides.
    sql["sample_ties"] = """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem
ORDER BY md5('42:' || l_returnflag), md5('42:{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}') LIMIT 12000"""
    sql["daily_epoch"] = _per_day("SELECT CASE WHEN event_type <> 'error' THEN ts::DATE END AS day FROM events")
    sql["daily_counts"] = _per_day("SELECT o_orderdate::DATE AS day FROM orders")
    sql["daily_events"] = _per_day("SELECT CASE WHEN event_type <> 'error' THEN ts::DATE END AS day FROM events")
    sql["parse_timestamps"] = """SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts)::VARCHAR END AS micros,
  event_type = 'error' AS is_unreadable FROM events"""
    sql["coerce_boolean"] = f"SELECT event_id, ({FLAG})::VARCHAR AS is_reply, 'boolean' AS type FROM events"
    sql["coerce_epoch"] = """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE floor(epoch(ts)) END AS timestamp FROM events"""
    sql["coerce_count"] = """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE user_id END AS like_count FROM events"""
    sql["coerce_fractional"] = """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS view_count FROM events"""
    sql["coerce_safe"] = f"""WITH {EVENTS} SELECT event_id, is_reply,
  CASE WHEN event_type = 'error' THEN 'abc' WHEN event_type <> 'view' THEN user_id::VARCHAR END AS like_count,
  CASE WHEN event_type = 'error' THEN 'abc' WHEN event_type <> 'view' THEN value::VARCHAR END AS view_count,
  CASE WHEN event_type = 'error' THEN '2024-01-01' ELSE floor(epoch(ts))::BIGINT::VARCHAR END AS timestamp,
  event_type AS country FROM dirty"""
    sql["csv_roundtrip"] = "SELECT doc_id, text, lang FROM documents"
    sql["csv_edges"] = """SELECT event_id, concat(event_type, chr(13), chr(10), '"', user_id, '"') AS note, user_id, true AS empty FROM events"""
    sql["csv_bad_lines"] = """SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN user_id::VARCHAR END AS user_id,
  NULL::VARCHAR AS note FROM events WHERE event_type <> 'error'"""
    sql["csv_quotes"] = """SELECT event_id, CASE WHEN event_type = 'view' THEN 'first "line"' || chr(10) || 'second, line' ELSE '6" wide' END AS size,
  user_id::VARCHAR AS user_id FROM events WHERE event_type <> 'error'"""
    sql["json_list"] = """SELECT conv_id AS id, count(*)::INTEGER AS turns, max(turn) AS last_turn FROM conversations GROUP BY 1
UNION ALL SELECT -count(*), -1, NULL FROM conversations"""
    sql["json_comments"] = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN role END AS role, text, length(text) AS size, role AS author_role FROM conversations"""
    sql["json_to_csv"] = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN role END AS role, text,
  '{"role":"' || role || '","size":' || length(text) || '}' AS author FROM conversations"""
    sql["parquet_verify"] = " UNION ALL ".join(
        f"SELECT '{codec}' AS codec, true AS written, false AS written_again, true AS verified, count(*) AS row_count, "
        "sum(p_size)::BIGINT AS size_sum FROM part"
        for codec in ("snappy", "gzip", "zstd", "none")
    )
    sql["find_csv_files"] = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, true AS is_filled, count(*) AS row_count FROM {t}" for t in ("nation", "part", "orders")
    )
    sql["split_by_year"] = "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS row_count FROM orders GROUP BY 1"
    sql["yearly_trends"] = f"""WITH {DATED} SELECT year, count(*) AS row_count, sum(tourism_related)::BIGINT AS matches,
  {_share('sum(tourism_related)', 'count(*)', 2)} AS match_share FROM dated GROUP BY 1"""
    sql["label_results"] = f"""SELECT source AS file, count(*) AS row_count, sum({TOURISM})::BIGINT AS matches,
  {_share(f'sum({TOURISM})', 'count(*)', 2)} AS match_share FROM documents GROUP BY 1"""
    sql["compare_tables"] = f"""WITH {ALTERED}
SELECT (SELECT count(*) FROM part) AS left_rows, (SELECT count(*) FROM altered) AS right_rows,
  (SELECT count(*) FROM only_left) AS only_left, (SELECT count(*) FROM only_right) AS only_right,
  '' AS columns_only_left, '' AS columns_only_right,
  (SELECT count(*) FROM only_left) + (SELECT count(*) FROM only_right) = 0 AS equal"""
    differences = f"""WITH {ALTERED}
SELECT 'left' AS side, count(*) AS copies, p_partkey, p_size FROM only_left GROUP BY ALL
UNION ALL SELECT 'right', count(*), p_partkey, p_size FROM only_right GROUP BY ALL"""
    sql["table_differences"] = differences
    sql["sample_differences"] = f"SELECT * FROM ({differences}) ORDER BY p_partkey, p_size, side LIMIT 3"
    sql["profile_table"] = " UNION ALL ".join(_profile_column(c) for c in PART_COLUMNS)
    def part(name, table, value, plain=True):
        least, most = (f"min({value})::VARCHAR", f"max({value})::VARCHAR") if plain else ("NULL::VARCHAR", "NULL::VARCHAR")
        return f"""SELECT '{name}' AS "column", count(*) AS row_count, count(*) - count({value}) AS null_count, {least} AS min_value, {most} AS max_value FROM {table}"""

    sql["profile_nested"] = """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN role END AS role, length(text)::INTEGER AS size FROM conversations WHERE conv_id % 7 <> 3 OR turn > 0),
        c AS (SELECT conv_id, max(size) AS longest, count(*) AS n FROM t GROUP BY conv_id), u AS (SELECT t.* FROM t JOIN c USING (conv_id) WHERE n > 2),
        e AS (SELECT size AS v FROM u UNION ALL SELECT NULL FROM u) """ + " UNION ALL ".join([
            part("conv_id", "c", "conv_id"), part("turns", "c", "CASE WHEN n > 2 THEN 1 END", False), part("turns[]", "u", "1", False), part("turns[].turn", "u", "turn"),
            part("turns[].role", "u", "role"), part("turns[].sizes", "u", "1", False), part("turns[].sizes[]", "e", "v"), part("sizes", "c", "1", False),
            part("sizes{keys}", "c", "concat('k', n)"), part("sizes{values}", "c", "longest"), part("info", "c", "CASE WHEN n > 1 THEN 1 END", False),
            part("info.n", "c", "CASE WHEN n > 1 THEN n END"), part("info.deep", "c", "CASE WHEN n > 1 THEN 1 END", False),
            part("info.deep.longest", "c", "CASE WHEN n > 1 THEN longest END")])
    sql["profile_distinct"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS exact_distinct, true AS is_close FROM events"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    )
    sql["examine_parquet"] = " UNION ALL ".join(
        f"SELECT p.*, {i}::INTEGER AS position, '{t}' AS type, 7::BIGINT AS samples FROM ({_profile_column(c)}) AS p"
        for i, (c, t) in enumerate(zip(PART_COLUMNS, PART_TYPES))
    )
    sql["table_schema"] = " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS position, '{c}' AS \"column\", '{t}' AS type, (SELECT count(*) FROM part) AS row_count"
        for i, (c, t) in enumerate(zip(PART_COLUMNS, PART_TYPES))
    )
    sql["language_model"] = f"""SELECT f AS feature, count(*) FILTER (label = 'de') AS n_de, count(*) FILTER (label = 'en') AS n_en,
  count(*) FILTER (label = 'es') AS n_es, count(*) FILTER (label = 'fr') AS n_fr
FROM (SELECT label, unnest({_gram_list('text')}) AS f FROM ({LANG_TRAIN})) GROUP BY 1"""
    language = "coalesce(label, 'und') AS language, round(coalesce(score, 0), 6) AS language_confidence"
    sql["language_scores"] = f"WITH {LANG} SELECT doc_id, {language} FROM documents LEFT JOIN lang_score ON key = doc_id"
    sql["language_scores_shuffled"] = f"""WITH {TURN_LANG} SELECT conv_id || ':' || turn AS turn_id, {language}
FROM conversations LEFT JOIN lang_score ON key = conv_id || ':' || turn"""
    sql["sentiment_scores"] = f"WITH {MOOD} SELECT key AS doc_id, label AS sentiment_label, round(score, 6) AS sentiment_score FROM mood"
    sql["sentiment_distribution"] = f"WITH {MOOD} {_distribution('(SELECT label AS sentiment_label FROM mood)', 'sentiment_label', 2)}"
    sql["english_sentiment"] = f"""WITH {MOOD}
{_distribution("(SELECT label AS sentiment FROM mood JOIN documents ON doc_id = key WHERE lang = 'en')", 'sentiment', 1)}"""
    sql["no_language_model"] = "SELECT doc_id, NULL::VARCHAR AS language, 0.0::DOUBLE AS language_confidence FROM documents"
    sql["sentiment_fallback"] = "SELECT doc_id, 'NEUTRAL' AS sentiment_label, 0.5::DOUBLE AS sentiment_score FROM documents"
    sql["score_hook"] = """SELECT doc_id, CASE WHEN length(text) > 400 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
  (CASE WHEN length(text) > 400 THEN 0.75 ELSE 0.25 END)::DOUBLE AS score FROM documents"""
    file_spam = SPAM.replace(KEYWORD, _any_of("t", [k.strip() for k in KEYWORDS]))
    sql["job_analyze"] = f"""WITH {file_spam}, {LANG}, {MOOD}
SELECT c.doc_id, l.label AS language, round(l.score, 6) AS language_confidence, c.cleaned_text,
  CASE WHEN l.label = 'en' THEN m.label END AS sentiment, CASE WHEN l.label = 'en' THEN round(m.score, 6) END AS sentiment_score
FROM clean c JOIN lang_score l ON l.key = c.doc_id JOIN mood m ON m.key = c.doc_id
WHERE l.label IN ('en', 'fr') AND l.score >= 0.8"""
    sql["job_label"] = sql["label_summary"]
    sql["job_sentiment"] = f"WITH {CUT_MOOD} {_distribution('(SELECT label AS sentiment_label FROM mood)', 'sentiment_label', 2)}"
    sql["job_filter"] = f"""WITH {file_spam}, {LANG}
SELECT doc_id, label AS language FROM clean JOIN lang_score ON key = doc_id WHERE label = 'en' AND score >= 0.8"""
    sql["job_convert"] = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, true AS converted, count(*) > 0 AS has_files FROM {t}" for t in ("nation", "part", "orders")
    )
    sql["job_convert_rows"] = "SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part"
    sql["convert_folder"] = "SELECT * FROM orders"
    sql["conversion_summary"] = "SELECT true AS some, 0::BIGINT AS failed, 0::BIGINT AS succeeded_again, true AS all_left, count(*) AS rows FROM nation"
    sql["compare_folders"] = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS left_rows, count(*) AS right_rows, 0::BIGINT AS only_left, 0::BIGINT AS only_right, "
        f"true AS equal FROM {t}"
        for t in ("nation", "part", "orders")
    )
    # Each field as text, a comma or line end after it; timestamps are written with 23 characters.
    fields = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "part": PART_COLUMNS,
              "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]}
    sizes = " UNION ALL ".join(
        "SELECT sum(" + " + ".join(f"length({c}::VARCHAR) + 1" for c in columns) + (" + 24" if t == "orders" else "") + f") AS n FROM {t}"
        for t, columns in fields.items()
    )
    sql["size_report"] = f"SELECT sum(n)::BIGINT AS data_bytes, true AS is_converted, true AS is_consistent FROM ({sizes})"
    return sql

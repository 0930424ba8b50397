"""End-to-end jobs: they own reads, writes and actions."""

import warnings
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.fixed_values import CODECS, DEFAULT_TOPICS, LANGUAGE_CONFIDENCE, SENTIMENT_BATCH
from ..functions.text import fill_missing, truncate_text
from ..operators.classify import (
    distinct_texts,
    score_languages,
    score_sentiment,
    with_neutral_sentiment,
)
from ..operators.cleaning import drop_missing_cleaned, keyword_hits, removal_stats, with_cleaned_text
from ..operators.coerce import apply_plan, plan_csv_types, rename_text_column, require_column
from ..operators.labels import summary_of_counts, with_label
from ..operators.language import keep_languages, unsupported_targets
from ..operators.stats import (
    daily_counts,
    english_sentiment_distribution,
    language_distribution,
    parse_timestamp,
    sample_exact,
    sentiment_distribution,
)
from ..operators.topics import (
    frequent_languages,
    language_word_counts,
    overall_topic_metadata,
    rank_topics,
    ranked_topics,
    topic_metadata,
    with_weights,
)
from ..operators.validate import compare_tables, profile_table, sample_differences, sample_rows, table_differences, table_schema
from ..operators.yearly import label_results as results_per_file
from ..operators.yearly import rows_per_year, write_by_year
from ..operators.yearly import yearly_trends as trends_per_year
from ..sources.csv import find_csv, output_path, read_comments, read_csv, write_csv
from ..sources.json import read_json_comments
from ..sources.keywords import keyword_list, read_keywords
from ..sources.parquet import verify_parquet, write_parquet
from ..sources.storage import list_files, metadata_path, path_exists, reader_path, relative_path, spread, staged, total_size, write_table
from .trees import convert_files, same_files

# Differing pairs of two trees are independent Spark jobs; this many are submitted at a time.
CONCURRENT_FILES = 8


def clean_with(df, text_col, keywords, stack=None):
    """`with_cleaned_text` for a keyword frame of any length.

    Lists too long for a pattern are looked up once per distinct text that the other rules
    keep. The hits are written first, so that both sides of the join back are plain shuffles,
    which adaptive execution can split; rows that are spam already get keys of their own.
    """
    listed = keyword_list(keywords)
    if listed is not None:
        return with_cleaned_text(df, text_col, listed)
    cleaned = with_cleaned_text(df, text_col)
    hits = keyword_hits(distinct_texts(drop_missing_cleaned(cleaned), text_col), "_text_key", text_col, keywords)
    hits = stack.enter_context(staged(hits, "hits")) if stack else write_table(hits, "hits")[0]
    own = F.concat(F.lit("-"), F.monotonically_increasing_id())
    keyed = cleaned.withColumn("_text_key", F.when(F.col("cleaned_text").isNull(), own).otherwise(F.sha2(F.col(text_col), 256)))
    found = keyed.join(hits.withColumn("_hit", F.lit(True)), "_text_key", "left")
    return found.withColumn("cleaned_text", F.when(F.col("_hit").isNull(), F.col("cleaned_text"))).drop("_text_key", "_hit")


def with_row_number(stack, df, name):
    """`df` as a staged table with `_row`, a number per row that stays, since it is written."""
    return stack.enter_context(staged(df.withColumn("_row", F.monotonically_increasing_id()), name))


def score_cleaned(stack, kept, language_model=None, sentiment_model=None, languages=None,
                  confidence=LANGUAGE_CONFIDENCE, key_col="_row"):
    """Language, language filter and English sentiment for cleaned rows of a table with a unique `key_col`.

    Models are fitted ones or loaders for `classify.score_with`. Without a language model
    the rows stay as they are. Scores are small tables (key and numbers, no text), which
    `stack` removes when it closes; texts move once, when they meet their scores. Sentiment
    is scored for English texts only and missing elsewhere.
    """
    if language_model is None:
        return kept
    texts = kept.select(key_col, "cleaned_text")
    wanted = keep_languages(score_languages(texts, key_col, "cleaned_text", language_model), languages, confidence)
    scores = stack.enter_context(staged(wanted, "languages"))
    if sentiment_model is not None:
        english = texts.join(scores.filter("language = 'en'"), key_col, "left_semi")
        sentiment = score_sentiment(english, key_col, "cleaned_text", sentiment_model, "sentiment", "sentiment_score")
        scores = stack.enter_context(staged(scores.join(sentiment, key_col, "left"), "scores"))
    return kept.join(scores, key_col)


def analyze_comments(spark, input_path, output, comment_col="comment", keywords_path=None, languages=None,
                     confidence=LANGUAGE_CONFIDENCE, language_model=None, sentiment_model=None,
                     n_topics=DEFAULT_TOPICS, topics=True, charts=False):
    """Clean, filter and score comments; write the rows, topics and chart tables.

    The input is parsed once; rows that are no spam are staged with a number each, by which
    scores find them again, and all rows are counted on the way. The scored rows are staged as
    well, and all reports read just their columns from there. Target languages that are not in the dictionary are named in a warning. Writes `output` (CSV), `<output stem>_metadata.json` and, with `charts`,
    tables below `<output stem>_charts`. Returns {name: DataFrame} of the small reports.
    """
    raw = rename_text_column(spread(read_comments(spark, input_path)), comment_col)
    keywords = read_keywords(spark, keywords_path)
    unknown = [row["language"] for row in unsupported_targets(spark, languages).collect()]
    if unknown:
        warnings.warn(f"Not in the language dictionary: {', '.join(sorted(unknown))}", stacklevel=2)
    reports = {}

    with ExitStack() as stack:
        seen = Observation()
        cleaned = clean_with(raw, "comment", keywords, stack).observe(seen, F.count("*").alias("rows"))
        kept = with_row_number(stack, drop_missing_cleaned(cleaned), "cleaned")
        scored = score_cleaned(stack, kept, language_model, sentiment_model, languages, confidence)
        rows = stack.enter_context(staged(scored.drop("_row"), "scored"))
        write_csv(rows, output)
        kept_count, languages = _rows_and_languages(rows)
        reports["removal_stats"] = _removal_report(spark, seen.get["rows"], kept_count)

        if kept_count and languages and (topics or charts):
            # Words are counted once; topics, bar chart and word cloud rank the same counts.
            counts = language_word_counts(rows, frequent_languages(rows, 5))
            counts = stack.enter_context(staged(counts, "words"))
        if topics and kept_count:
            if languages > 1:
                found = _keep(rank_topics(counts, n_topics))
                document = topic_metadata(found)
            else:
                found = _keep(ranked_topics(rows, n_topics))
                document = overall_topic_metadata(found)
            document.coalesce(1).write.mode("overwrite").json(output_path(output, "_metadata.json"))
            reports["topics"] = found
        if languages > 1:
            reports["language_distribution"] = _keep(language_distribution(rows))
        if charts and kept_count:
            folder = output_path(output, "_charts")
            tables = chart_tables(rows, counts if languages else None)
            with ThreadPoolExecutor(len(tables) or 1) as pool:
                list(pool.map(lambda t: t[1].write.mode("overwrite").parquet(f"{folder}/{t[0]}"), tables.items()))
    return reports


def _rows_and_languages(rows):
    """Row count and number of languages (a missing one counts) of the scored rows."""
    if "language" not in rows.columns:
        return rows.count(), 0
    missing = F.max(F.col("language").isNull().cast("int"))
    found = rows.agg(F.count("*"), F.count_distinct("language") + F.coalesce(missing, F.lit(0))).first()
    return found[0], found[1]


def _removal_report(spark, total, kept):
    rate = round(100.0 * (total - kept) / total, 2) if total else None
    return spark.createDataFrame(
        [(total, kept, total - kept, rate)],
        "original_count bigint, kept_count bigint, removed_count bigint, removal_rate double",
    )


def _keep(report):
    """A report as a frame of its own, apart from the staged files.

    Only for reports bounded by construction (languages, topics).
    """
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def chart_tables(rows, counts=None):
    """The tables behind the charts, for the columns that are there; `counts` are word counts per language."""
    tables = {}
    if "sentiment" in rows.columns:
        tables["sentiment_distribution"] = english_sentiment_distribution(rows)
    if counts is not None:
        top_three = F.broadcast(frequent_languages(rows, 3))
        tables["language_distribution"] = language_distribution(rows)
        tables["word_cloud"] = with_weights(rank_topics(counts, 100))
        tables["topics"] = rank_topics(counts.join(top_three, "language", "left_semi"), 15)
    if "timestamp" in rows.columns:
        tables["daily_counts"] = daily_counts(parse_timestamp(rows, "timestamp"), "timestamp")
    return tables


def label_comments(spark, input_path, output=None, label_type="tourism", sample=None, key=None):
    """Label comments by a keyword set, write CSV, return the summary."""
    comments = require_column(spread(read_comments(spark, input_path)), "comment")
    labelled = with_label(sample_exact(comments, sample, key), label_type)
    if output is None:
        folder, _, name = input_path.rstrip("/").rpartition("/")
        output = f"{folder}/labeled_{name}" if folder else f"labeled_{name}"
    label, seen = f"{label_type}_related", Observation()
    write_csv(labelled.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(label), F.lit(0)).alias("matches")), output)
    return summary_of_counts(spark.createDataFrame([(seen.get["rows"], seen.get["matches"])], "total bigint, matches bigint"))


def score_comment_sentiment(df, text_col, model, key_col="_row"):
    """Sentiment per `key_col`: missing text is empty, long text is cut, blank text is a fixed word.

    The cut is this command's rule for what it scores; the row keeps its whole text.
    """
    prepared = df.withColumn("_scored_text", truncate_text(fill_missing(text_col)))
    return score_sentiment(prepared, key_col, "_scored_text", model, batch_size=SENTIMENT_BATCH)


def analyze_sentiment(spark, input_path, output=None, comment_col="comment", model=None):
    """Score the sentiment of every comment, write CSV, return the distribution.

    The input is parsed once into a staged table; the distribution comes from the scores alone.
    """
    comments = require_column(spread(read_comments(spark, input_path)), comment_col)
    output = output or output_path(input_path, "_with_sentiment.csv")
    with ExitStack() as stack:
        if model is None:
            seen = Observation()
            scored = with_neutral_sentiment(comments).observe(seen, F.count("*").alias("rows"))
            write_csv(scored, output)
            return _keep(sentiment_distribution(with_neutral_sentiment(spark.range(seen.get["rows"]))))
        rows = with_row_number(stack, comments, "comments")
        scores = stack.enter_context(staged(score_comment_sentiment(rows, comment_col, model), "scores"))
        write_csv(rows.join(scores, "_row").drop("_row"), output)
        return _keep(sentiment_distribution(scores))


def convert_csv(spark, csv_path, parquet_path, delimiter=",", compression="snappy", overwrite=False, mode="compat"):
    """Convert one CSV file or single-schema folder to Parquet; True when written and not empty."""
    if not overwrite and path_exists(spark, parquet_path):
        return False
    table = read_csv(spark, csv_path, delimiter)
    typed = apply_plan(table, plan_csv_types(table, mode))
    return write_parquet(typed, parquet_path, compression, overwrite) and verify_parquet(spark, parquet_path)


def convert_tree(spark, input_dir, output_dir=None, delimiter=",", compression="snappy", overwrite=False,
                 extension=".csv", mode="compat"):
    """Convert every CSV file of a folder tree, keeping relative paths.

    Files may differ in columns and are typed one by one, yet files alike in header and types are
    read and written together (`trees`), so the jobs do not grow with the files. The listing
    and a row of counts per file, not the data, are on the driver. Returns a frame: file, target,
    converted, message.
    """
    if compression not in CODECS:
        raise ValueError(f"Unknown compression {compression!r}; known: {', '.join(CODECS)}")
    root = input_dir.rstrip("/")
    target_root = (output_dir or input_dir).rstrip("/")
    files = {}
    for row in find_csv(spark, root, extension).select("path").collect():
        relative = relative_path(spark, row["path"], root)
        files[relative] = (row["path"], f"{target_root}/{relative[: -len(extension)]}.parquet")
    left = {r: f for r, f in files.items() if overwrite or not path_exists(spark, f[1])}
    if len(delimiter) == 1:
        found = convert_files(spark, {metadata_path(spark, path): target for path, target in left.values()}, delimiter, compression, mode)
        messages = {r: found[metadata_path(spark, path)] for r, (path, _) in left.items()}
    else:
        messages = {}
        for relative, (path, target) in left.items():
            try:
                done = convert_csv(spark, path, target, delimiter, compression, overwrite, mode)
                messages[relative] = None if done else "the file has no rows"
            except Exception as error:
                messages[relative] = str(error).split("\n")[0]
    rows = [(r, t, r in left and messages[r] is None, messages.get(r) if r in left else "the target exists") for r, (_, t) in sorted(files.items())]
    return spark.createDataFrame(rows, "file string, target string, converted boolean, message string")


def conversion_summary(report):
    """Files converted and not converted; a skipped file counts as not converted."""
    return report.agg(
        F.count_if("converted").alias("succeeded"), F.count_if(~F.col("converted")).alias("failed")
    )


def size_report(spark, csv_dir, parquet_dir):
    """Bytes before and after, and the percentage saved."""
    before = total_size(spark, csv_dir, ".csv").first()["bytes"]
    after = total_size(spark, parquet_dir, ".parquet").first()["bytes"]
    saved = round((1 - after / before) * 100, 1) if before else None
    return spark.createDataFrame([(before, after, saved)], "bytes_before bigint, bytes_after bigint, saved_percent double")


def json_to_csv(spark, input_path, output=None):
    """Convert comment JSON to CSV; returns records and fields."""
    comments, seen = read_json_comments(spark, input_path), Observation()
    output = output or output_path(input_path, ".csv")
    write_csv(spread(comments).observe(seen, F.count("*").alias("records")), output)
    return spark.createDataFrame([(seen.get["records"], len(comments.columns))], "records bigint, fields int")


def filter_comments(spark, input_path, output="filtered_comments.csv", comment_col="comment", keywords_path=None,
                    language_model=None, confidence=LANGUAGE_CONFIDENCE):
    """Drop spam and, given a language model, comments that are not English; write CSV."""
    raw = rename_text_column(spread(read_comments(spark, input_path)), comment_col)
    with ExitStack() as stack:
        kept = drop_missing_cleaned(clean_with(raw, "comment", read_keywords(spark, keywords_path), stack))
        if language_model is not None:
            kept = with_row_number(stack, kept, "cleaned")
        write_csv(score_cleaned(stack, kept, language_model, None, ["en"], confidence).drop("_row"), output)
    return output


def compare_csv_parquet(spark, csv_path, parquet_path, mode="compat", samples=0):
    """Compare a CSV file with its Parquet form under the same typing rules.

    With `samples`, the report's `differing` lists the first so many rows that one side lacks,
    as JSON with the side that has them and the number of copies.
    """
    table = read_csv(spark, csv_path)
    left, right = apply_plan(table, plan_csv_types(table, mode)), spark.read.parquet(parquet_path)
    report = compare_tables(left, right)
    if not samples:
        return report
    chosen = sample_differences(table_differences(left, right), samples)
    rows = chosen.agg(F.collect_list(F.to_json(F.struct("*"))).alias("differing"))
    return report.withColumn("differing", rows.scalar())


def compare_folders(spark, csv_dir, parquet_dir, output=None, mode="compat", samples=0):
    """Compare two folder trees pair by pair, matched by relative path without extension.

    A Parquet table may be a file or a folder with that extension. Pairs alike in header and types
    are compared together by fingerprints (`trees`); only those that differ are compared by their
    rows, several at a time. A file without a partner is reported with NULL counts, one that
    cannot be read with its error in `message`; neither stops the others. With `samples`,
    `differing` lists rows that the other side lacks. Writes JSON when `output` is given.
    """
    csv_files = _tables(spark, csv_dir, ".csv")
    parquet_files = _tables(spark, parquet_dir, ".parquet", folders=True)
    both = {csv_files[stem]: parquet_files[stem] for stem in csv_files.keys() & parquet_files.keys()}
    same, failed = same_files(spark, both, _root_of(parquet_files), mode=mode) if both else ({}, {})

    def compare(stem):
        if stem not in csv_files or stem not in parquet_files:
            return (stem, *[None] * 6, False, None, "no partner")
        path, table = csv_files[stem], parquet_files[stem]
        if path in failed:
            return (stem, *[None] * 6, False, None, failed[path])
        if same.get(path):
            rows, left_only, right_only = same[path]
            return (stem, rows, rows, 0, 0, left_only, right_only, not left_only and not right_only, [] if samples else None, None)
        try:
            report = compare_csv_parquet(spark, reader_path(path), reader_path(table), mode, samples).first()
            return (stem, *report[:7], report["differing"] if samples else None, None)
        except Exception as error:
            return (stem, *[None] * 6, False, None, str(error).split("\n")[0])

    with ThreadPoolExecutor(CONCURRENT_FILES) as pool:
        rows = list(pool.map(compare, sorted(csv_files.keys() | parquet_files.keys())))
    result = spark.createDataFrame(
        rows,
        "file string, left_rows bigint, right_rows bigint, only_left bigint, only_right bigint, "
        "columns_only_left string, columns_only_right string, equal boolean, differing array<string>, message string",
    )
    if output:
        result.write.mode("overwrite").json(output)
    return result


def _tables(spark, folder, extension, folders=False):
    """Tables below a folder: relative path without its last extension -> path as the metadata column spells it.

    With `folders`, a folder with the extension is one table, whatever files it holds.
    """
    root, found = folder.rstrip("/"), {}
    for row in list_files(spark, folder, extension).select("path").collect():
        path, relative = row["path"], relative_path(spark, row["path"], root)
        if folders:
            parts = relative.split("/")
            at = next(i for i, part in enumerate(parts) if part.lower().endswith(extension))
            path, relative = path[: len(path) - len("".join("/" + p for p in parts[at + 1 :]))], "/".join(parts[: at + 1])
        found[relative[: -len(extension)]] = metadata_path(spark, path)
    return found


def _root_of(tables):
    """The folder that the tables of a tree are below, spelled as they are."""
    stem, path = next(iter(tables.items()))
    return "/".join(path.split("/")[: -1 - stem.count("/")])


def examine_parquet(spark, path, samples=10):
    """Schema, column profile and some rows of a Parquet table."""
    table = spark.read.parquet(path)
    return {"schema": table_schema(table), "profile": profile_table(table), "samples": sample_rows(table, samples)}


def split_by_year(spark, input_path, date_col, output_dir="yearly_data", date_format=None, file_format="parquet"):
    """Split a comment CSV into one folder per year; returns rows per year as written."""
    comments = require_column(read_comments(spark, input_path), date_col)
    write_by_year(comments, date_col, output_dir, date_format, file_format=file_format)
    return rows_per_year(read_yearly(spark, output_dir, file_format))


def read_yearly(spark, folder, file_format="parquet"):
    """A folder written by year, with its `year` column."""
    if file_format == "csv":
        return read_csv(spark, folder, file_name_col="_file").withColumn(
            "year", F.regexp_extract("_file", r"year=(\d+)", 1).try_cast("int")
        ).drop("_file")
    return spark.read.format(file_format).load(folder)


def label_results(spark, path, label_col="tourism_related"):
    """Matches per labelled CSV file, for one file or a folder of them."""
    labelled = require_column(read_csv(spark, path, file_name_col="file"), label_col)
    return results_per_file(labelled, label_col)


def yearly_trends(spark, folder, label_col="tourism_related", output=None, file_format="parquet"):
    """Matches per year of a labelled yearly folder; written as a table when `output` is given."""
    trends = trends_per_year(require_column(read_yearly(spark, folder, file_format), label_col), label_col)
    if output:
        trends.write.mode("overwrite").parquet(output)
    return trends


def cleaned_removal_stats(df, text_col="comment", keywords=()):
    """Removal statistics of cleaning alone."""
    cleaned = with_cleaned_text(df, text_col, keywords)
    return removal_stats(cleaned, F.col("cleaned_text").isNotNull())

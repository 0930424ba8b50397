"""Registered queries of the operators, each over its whole table, and their SQL."""

from pyspark.sql import functions as F

from . import collocations, decontaminate, language_id, licenses, lm, matched_packing, ngram_join, packing, quality, repetition, suffix_dedup, token_output, vector_codes
from .common import bucket_of


def _documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_license_scan(spark, folder):
    return licenses.license_scan(_documents(spark, folder)).drop("spans")


def op2_ngram_join(spark, folder):
    return ngram_join.ngram_components(_documents(spark, folder))


def op3_token_matrices(spark, folder):
    return token_output.packed_matrices(_documents(spark, folder))


def op4_language_id(spark, folder):
    docs = _documents(spark, folder)
    held_out = bucket_of("doc_id", 3) == 1
    model = language_id.fit(docs.filter(F.coalesce(~held_out, F.lit(True))))
    predicted = language_id.predict_language(docs, model)
    return predicted.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark, folder):
    return decontaminate.find_contained(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op6_packing(spark, folder):
    return packing.pack_documents(_documents(spark, folder))


def op7_lm_scoring(spark, folder):
    docs = _documents(spark, folder).select("doc_id", "text", F.coalesce(bucket_of("doc_id", 5) == 1, F.lit(False)).alias("held_out"))
    model = lm.fit(docs.filter(~F.col("held_out")))
    scored = lm.score_texts(docs, model, keep=("held_out",))
    model.close()
    return scored


def op8_quality(spark, folder):
    docs = _documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    learned = labels.filter(~held_out & F.col("label").isNotNull())
    model = quality.fit(docs.select("doc_id", "text").join(quality.choose(learned), "doc_id"))
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_repetition_rules(spark, folder):
    return repetition.repetition_rules(_documents(spark, folder))


def op10_suffix_dedup(spark, folder):
    # The remaining text has the name of the text it is taken from.
    return suffix_dedup.remove_repeats_and_passages(_documents(spark, folder)).withColumnRenamed("kept", "text")


def op11_vector_codes(spark, folder):
    coded, books = vector_codes.compress_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_matched_packing(spark, folder):
    return matched_packing.pack_matched(_documents(spark, folder))


def op13_collocations(spark, folder):
    return collocations.collocations(_documents(spark, folder))


QUERIES = [op1_license_scan, op2_ngram_join, op3_token_matrices, op4_language_id, op5_decontamination, op6_packing, op7_lm_scoring, op8_quality, op9_repetition_rules, op10_suffix_dedup,
           op11_vector_codes, op12_matched_packing, op13_collocations]


def registered():
    return {q.__name__: q for q in QUERIES}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _pattern(markup):
    """A template as a regular expression over words that each follow one space."""
    out = ""
    for part in licenses._MARK.split(markup):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<</optional>>":
            out += ")?"
        elif part.startswith("<<words"):
            least, most = part[2:-2].split()[2:]
            out += f"(?: [^ ]+){{{least},{most}}}"
        else:
            out += "".join(f" {w.decode()}" for w in licenses.words_of(part))
    return out + "(?: |$)"


def _license_sql():
    places = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM t, unnest(range(len(w))) AS r(i) WHERE "
        + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES.items())
    templates = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM t WHERE regexp_matches(s, '{_pattern(markup)}')" for label, markup in licenses.TEMPLATES.items())
    return f"""
        WITH t AS MATERIALIZED (SELECT doc_id, w, concat(' ', array_to_string(w, ' ')) AS s FROM (
                 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents)),
             p AS ({places}),
             b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
             m AS ({templates}),
             a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT * FROM m) GROUP BY doc_id)
        SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN t.doc_id IN (SELECT doc_id FROM m) THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
        FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


def _contained_sql():
    # An item of fewer than five words is one shingle of all its words.
    def words(table, key):
        return f"SELECT {key}, regexp_extract_all(lower(text), '{_ALNUM}') AS w FROM {table}"

    def grams(key, source):
        return f"SELECT DISTINCT {key}, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM {source}, unnest(range(1, len(w) - n + 2)) AS r(i)"

    return f"""
        WITH i AS MATERIALIZED (SELECT item_id, w, least(5, len(w)) AS n FROM ({words('benchmark', 'item_id')}) WHERE len(w) > 0),
             b AS MATERIALIZED ({grams('item_id', 'i')}),
             d AS ({grams('doc_id', f"({words('documents', 'doc_id')}), (SELECT DISTINCT n FROM i)")}),
             c AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item::DOUBLE AS containment
        FROM d JOIN b USING (n, g) JOIN c USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item)"""


def _repetition_sql():
    parts, joins, columns = [], "", []
    for n, limit in repetition.GRAM_SHARES.items():
        parts.append(f"""g{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, g) AS c
                         FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM t, unnest(range(1, len(w) - {n - 2})) AS r(i))),
                     c{n} AS (SELECT doc_id, sum(length(w[i])) AS chars FROM (SELECT DISTINCT doc_id, i + j AS i FROM g{n}, unnest(range({n})) AS r(j) WHERE k > 1) JOIN t USING (doc_id) GROUP BY doc_id)""")
        joins += f" LEFT JOIN c{n} USING (doc_id)"
        columns.append((f"dup_{n}gram_chars", f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1)::DOUBLE", limit))
    shares = ", ".join(f"{value} AS {name}" for name, value, _ in columns)
    good = " AND ".join(f"{name} <= {limit}" for name, _, limit in columns)
    return f"""
        WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
             {", ".join(parts)},
             r5 AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + j AS i FROM g5, unnest(range(5)) AS r(j) WHERE c > 1) GROUP BY doc_id),
             l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k
                   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_SPACED}')),
             ls AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(length(line)) FILTER (k > 1), 0) / sum(length(line))::DOUBLE AS dup_line_chars FROM l GROUP BY doc_id),
             m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                          len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM t),
             a AS (SELECT m.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                          coalesce(dup_line_chars, 0.0) AS dup_line_chars, {shares} FROM m LEFT JOIN ls USING (doc_id) LEFT JOIN r5 USING (doc_id){joins}),
             f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
        SELECT *, NOT base_failed AND dup_line_chars <= {repetition.LINE_CHARS_SHARE} AND {good} AS kept FROM f"""


def _codes_sql():
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES

    def nearest(k):
        return f"""SELECT vec_id, rid, label, part, v, z.d AS d, z.entry AS entry FROM (
                 SELECT vec_id, rid, label, part, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, entry := entry)) AS z
                 FROM p JOIN b{k} USING (part) GROUP BY vec_id, rid, label, part, v)"""

    steps = []
    for k in range(vector_codes.ROUNDS):
        steps.append(f"""a{k} AS MATERIALIZED ({nearest(k)}),
            m{k} AS MATERIALIZED (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM
                 (SELECT part, entry, i, count(*) AS n, sum(v[i])::BIGINT AS s FROM a{k}, unnest(range(1, len(v) + 1)) AS r(i) GROUP BY part, entry, i) GROUP BY part, entry),
            b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN m{k} USING (part, entry))""")
    last = vector_codes.ROUNDS
    return f"""
        WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
                 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS MATERIALIZED (SELECT vec_id, rid, label, part, w[part * len(w) // {parts} + 1:(part + 1) * len(w) // {parts}] AS v FROM k, unnest(range({parts})) AS r(part)),
             b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v AS e FROM p WHERE rid <= {entries}),
             {", ".join(steps)},
             z AS ({nearest(last)}),
             c AS (SELECT vec_id, rid, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY vec_id, rid),
             h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, h"""


def _collocation_sql():
    c = collocations
    score = "{scale} * a::HUGEINT * a // (l::HUGEINT * r)".format(scale=c.SCALE)
    return f"""
        WITH s AS MATERIALIZED (SELECT row_number() OVER () AS i, lang, words FROM (
                 SELECT coalesce(lang, '{c.NO_LANGUAGE}') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents)),
             w AS MATERIALIZED (SELECT lang, words, k, words[k] AS w1, words[k + 1] AS w2, words[k + 2] AS w3 FROM s, unnest(range(1, len(words) + 1)) AS r(k)),
             f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM w GROUP BY lang, w1),
             f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM w WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= {c.LEAST}),
             f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM w WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= {c.LEAST}),
             n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
             inside AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, w1, w2),
             cuts AS (SELECT lang, concat_ws(' ', w1, w2) AS phrase, 1 AS k, f2.f AS a, x.f AS l, y.f AS r FROM f2 JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM f1) y USING (lang, w2) LEFT JOIN inside USING (lang, w1, w2)
                      WHERE longer IS NULL OR 100 * longer < {c.INSIDE_PERCENT} * f2.f
                      UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), 1, f3.f, x.f, y.f FROM f3 JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM f2) y USING (lang, w2, w3)
                      UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), 2, f3.f, x.f, y.f FROM f3 JOIN f2 x USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w3, f FROM f1) y USING (lang, w3)),
             scored AS (SELECT lang, phrase, unnest(min(struct_pack(score := ({score})::BIGINT, k := k, a := a, l := l, r := r))) FROM cuts GROUP BY lang, phrase)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM scored JOIN n USING (lang)
        QUALIFY rank <= {c.TOP}"""


def statements():
    return {"op11_vector_codes": _codes_sql(), "op13_collocations": _collocation_sql(), "op1_license_scan": _license_sql(), "op5_decontamination": _contained_sql(), "op9_repetition_rules": _repetition_sql()}

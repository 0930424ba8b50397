"""Quality rules on repetition: characters inside repeated word runs and lines.

Every run of 5 to 10 words gets a rolling hash; runs that stood in the text before mark the
words they cover. A text is rejected if the marked share of its characters is above the
limit of that length, or if lines that stood before hold too much of it. One pass, no shuffle.
"""

import numpy as np

from .common import (
    SPACED, Hasher, arrow_schema, chunks, column_of, gram_hashes, in_row, record, repeated,
    row_bounds, rows_of, seen_before, sums, text_bytes, word_spans,
)

# The published limits of repetition rules for web text.
GRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHARS_SHARE = 0.20

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars double, " + ", ".join(f"dup_{n}gram_chars double" for n in GRAM_SHARES) + ", base_failed boolean, kept boolean"
)


def _covered(at, marked, n, size):
    """Words inside marked runs of `n` words."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, at[marked], 1)
    np.add.at(steps, at[marked] + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(data, offsets):
    """All measures of one run of texts, as arrays with a value per text."""
    starts, ends = word_spans(data, offsets)
    bounds = row_bounds(starts, offsets)
    hasher = Hasher(data)
    hashes, rows = hasher(starts, ends), rows_of(bounds)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    out = {"n_words": np.diff(bounds), "word_chars": sums(chars, bounds), "n_symbols": sums(SYMBOLS[data].astype(np.int64), offsets)}
    all_chars = np.maximum(out["word_chars"], 1)

    # Lines end at a line feed or at the end of their text.
    breaks = data == 10
    line_starts = np.union1d(offsets[:-1], np.flatnonzero(breaks) + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_ends = line_ends - ((line_ends > line_starts) & breaks[line_ends - 1]) if len(line_starts) else line_ends[:0]
    words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[words > 0], line_ends[words > 0]
    line_bounds = row_bounds(line_starts, offsets)
    again = seen_before(in_row(hasher(line_starts, line_ends), rows_of(line_bounds)))
    line_chars = points[line_ends] - points[line_starts]
    out["n_lines"], out["n_dup_lines"] = np.diff(line_bounds), sums(again.astype(np.int64), line_bounds)
    out["dup_line_chars"] = sums(line_chars * again, line_bounds) / np.maximum(sums(line_chars, line_bounds), 1)

    kept = out["dup_line_chars"] <= LINE_CHARS_SHARE
    for n, limit in GRAM_SHARES.items():
        at, values = gram_hashes(hashes, bounds, n)
        keys = in_row(values, rows[at])
        if n == 5:
            found = _covered(at, repeated(keys), n, len(starts))
            out["n_repeat_words"] = sums(found.astype(np.int64), bounds)
        again = _covered(at, seen_before(keys), n, len(starts))
        share = sums(chars * again, bounds) / all_chars
        out[f"dup_{n}gram_chars"] = share
        kept &= share <= limit
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["kept"] = kept & ~out["base_failed"]
    return out


def repetition_rules(docs, id_col="doc_id", text_col="text"):
    """Repetition measures and the verdict `kept` for every row.

    A missing or empty text has no words and is not kept; a short one (under 10 words)
    is not kept either. Repeated rows are judged each; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = arrow_schema(_COLUMNS)

    def run(batches):
        for batch in chunks(batches, text_col):
            rows = record(schema, **measure(*text_bytes(column_of(batch, text_col))))
            yield type(rows).from_arrays([column_of(batch, id_col), *rows.columns], names=[id_col, *schema.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_COLUMNS}")

"""Statistics of a text that quality rules and classifiers read, in one pass over it.

Words are runs of other than ``[\\x20\\x09-\\x0D]``. Null is an empty text. All counts are exact, over the whole text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pointweave.llm.common import slices

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
MARKS = b"!?"

#: n_chars code points; n_words; word_chars code points in words; n_symbols of SYMBOLS; n_lines with a word;
#: n_dup_lines equal to an earlier line; n_distinct words; n_repeat_words in 3-word windows found twice or more;
#: n_same words equal to the word before; n_top copies of the commonest word; bytes of upper case, letters, digits, marks.
COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words", "n_same", "n_top", "n_upper", "n_letters", "n_digits", "n_marks")
COUNT_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1].astype(np.int64)
        key = pairs[:-1] << 32 | ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.isin(key, twice)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(found)] |= found
    return int(covered.sum())


def without(raw: bytes, these: bytes) -> int:
    """How many of these bytes there are."""
    return len(raw) - len(raw.translate(None, these))


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.array([number[w] for w in words], np.int64)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    each = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    return (
        len(text), len(words), len(text) - sum(map(text.count, BLANK)), without(raw, SYMBOLS), len(lines), len(lines) - len(set(lines)),
        len(number), repeated_words(ids, len(number)), int((ids[1:] == ids[:-1]).sum()), int(each.max()),
        without(raw, UPPER), without(raw, LETTERS), without(raw, DIGITS), without(raw, MARKS),
    )


def count_column(text: Column) -> Column:
    """A struct of COUNTS. Not moved or repeated by the optimizer."""

    @F.arrow_udf(COUNT_TYPE)
    def text_counts(texts: pa.Array) -> pa.Array:
        rows = [counts(t) for part in slices(texts) for t in part]
        columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(COUNTS))

    return text_counts.asNondeterministic()(text.cast("string"))


#: Ratios that rules and classifiers see, each a numerator and a denominator of COUNTS (at least 1). None tells the
#: document's number, language or source, and none changes with the mere length of a clean text, as the share of distinct
#: words does.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "same_words": ("n_same", "n_words"),
    "top_word": ("n_top", "n_words"),
    "upper": ("n_upper", "n_letters"),
    "letters_per_char": ("n_letters", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}


def ratio_columns(counted: str) -> dict[str, Column]:
    """The ratios as columns over the struct column ``counted``."""
    out = {}
    for name, (top, bottom) in RATIOS.items():
        over = F.greatest(F.col(f"{counted}.{bottom}"), F.lit(1)).cast("double")
        out[name] = F.col(f"{counted}.{top}").cast("double") / over
    return out


def ratio_rows(rows: np.ndarray) -> np.ndarray:
    """The ratios of rows of COUNTS, with the same arithmetic as the columns."""
    at = {c: k for k, c in enumerate(COUNTS)}
    return np.stack([rows[:, at[t]].astype(float) / np.maximum(rows[:, at[b]], 1).astype(float) for t, b in RATIOS.values()], axis=1)

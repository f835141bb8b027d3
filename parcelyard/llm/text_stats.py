"""Document statistics from one vectorised pass over whole texts.

Words are maximal runs of characters other than space and the controls 9 to 13.
Null and empty texts have zeros everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Fixed set of symbols that mark debris rather than prose.
SYMBOLS = b"#*$%&|<>"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_upper", "n_lower", "n_digits", "n_punct", "n_exclaim", "n_long_words", "n_distinct_words", "n_wide")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars)] = 1
    return out


_IS = {
    "n_symbols": _flags(SYMBOLS),
    "n_upper": _flags(bytes(range(65, 91))),
    "n_lower": _flags(bytes(range(97, 123))),
    "n_digits": _flags(bytes(range(48, 58))),
    "n_punct": _flags(b".,;:'\"()-?"),
    "n_exclaim": _flags(b"!"),
    "n_wide": _flags(bytes(range(192, 256))),
    "n_chars_all": _flags(bytes([*range(128), *range(192, 256)])),
}
_CHAR = _IS["n_chars_all"].astype(bool)


def _repeats(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each item, how many equal ones its row has."""
    order = np.lexsort((h, row))
    a, b = h[order], row[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(a), np.int64)
    out[order] = np.bincount(group)[group] if len(a) else 0
    return out


def _earlier(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which items equal an earlier one of their row."""
    order = np.lexsort((np.arange(len(h)), h, row))
    a, b = h[order], row[order]
    out = np.zeros(len(h), bool)
    out[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return out


def batch_stats(col: pa.Array) -> dict[str, np.ndarray]:
    """All of COLUMNS for the rows of a string column."""
    data, off = common.text_bytes(col)
    out = {}
    for name, flag in _IS.items():
        out[name] = common.ranges_sum(flag[data], off)
    start, end, first = common.words(data, off)
    row = common.row_of(first)
    out["n_words"] = np.diff(first)
    pre = common.Prefix(data)
    h = pre.hash(start, end)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CHAR[data], out=chars[1:])
    size = chars[end] - chars[start]
    out["word_chars"] = common.ranges_sum(size, first)
    out["n_long_words"] = common.ranges_sum(size > 12, first)
    out["n_distinct_words"] = common.ranges_sum(~_earlier(h, row), first)
    # windows of five words that occur twice or more cover words
    at = common.whole_windows(first, 5)
    if len(at):
        w = common.windows(h, 5)[at]
        again = at[_repeats(w, row[at]) > 1]
        out["n_repeat_words"] = common.ranges_sum(common.covered(again, again + 5, len(h)), first)
    else:
        out["n_repeat_words"] = np.zeros(len(col), np.int64)
    # lines: between newlines and row edges
    brk = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate([off[:-1], brk + 1]), kind="stable")
    lrow = np.searchsorted(off[1:], ls, "right")
    # a break that ends a row starts an empty line of that row, not a line of the next
    ends = np.sort(np.concatenate([off[1:], brk]), kind="stable")
    has = np.searchsorted(start, ends, "left") > np.searchsorted(start, ls, "left")
    ls, le, lrow = ls[has], ends[has], lrow[has]
    edges = np.searchsorted(lrow, np.arange(len(col) + 1))
    out["n_lines"] = np.diff(edges)
    out["n_dup_lines"] = common.ranges_sum(_earlier(pre.hash(ls, le), lrow), edges)
    return out


def with_stats(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the columns s_<name> of COLUMNS; the text itself only where asked for. No shuffle."""
    names = docs.columns
    kept = [c for c in names if keep_text or c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(f"s_{c}", T.LongType()) for c in COLUMNS]])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text_col):
                s = batch_stats(part.column(at))
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in kept], *[pa.array(s[c], pa.int64()) for c in COLUMNS]], [*kept, *[f"s_{c}" for c in COLUMNS]])

    return docs.mapInArrow(common.tidy(run), schema)


def ratios(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Size-free statistics, each defined (0) for empty texts."""
    f = {k: np.asarray(v, float) for k, v in s.items()}
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    return {
        "symbols": over(f["n_symbols"], f["word_chars"]),
        "dup_lines": over(f["n_dup_lines"], f["n_lines"]),
        "repeats": over(f["n_repeat_words"], f["n_words"]),
        "upper": over(f["n_upper"], f["n_upper"] + f["n_lower"]),
        "digits": over(f["n_digits"], f["word_chars"]),
        "exclaim": over(f["n_exclaim"], f["n_words"]),
        "long_words": over(f["n_long_words"], f["n_words"]),
        "word_size": over(f["word_chars"], f["n_words"]),
        "punct": over(f["n_punct"], f["n_words"]),
        "distinct": over(f["n_distinct_words"], f["n_words"]),
        "wide": over(f["n_wide"], f["word_chars"]),
        "line_words": over(f["n_words"], f["n_lines"]),
        "size": np.log1p(f["n_words"]),
    }

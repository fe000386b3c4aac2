"""Lines of a file and line-range slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def universal_newlines(c) -> Column:
    """Text as read in text mode: CRLF and CR become LF."""
    return F.regexp_replace(_c(c), r"\r\n?", "\n")


def split_lines(c) -> Column:
    """Lines with their newline kept; '' -> [], a final newline adds no empty line."""
    return F.filter(F.split(_c(c), r"(?<=\n)", -1), lambda x: x != "")


#: Noncharacters: the first escapes itself (with the second) and U+FFFD (with the third).
_ESC, _SELF, _MARK = "\ufdd0", "\ufdd1", "\ufdd2"


def decode_utf8_lenient(c) -> Column:
    """Bytes -> text, invalid UTF-8 sequences dropped.

    The decoder marks what it cannot read with U+FFFD.  A U+FFFD that is in the
    bytes themselves is escaped before and put back after, so it stays.
    """
    def swap(text, old: str, new: str):
        return F.replace(text, F.lit(old), F.lit(new))

    own = swap(swap(_c(c).cast("string"), _ESC, _ESC + _SELF), "\ufffd", _ESC + _MARK)
    read = swap(F.make_valid_utf8(own), "\ufffd", "")
    return swap(swap(read, _ESC + _MARK, "\ufffd"), _ESC + _SELF, _ESC)


def file_path(folder, file, base: str | None = None) -> Column:
    """P10: ``base/folder/file`` (no base: ``folder/file``)."""
    parts = ([F.lit(base)] if base else []) + [_c(folder), _c(file)]
    return F.concat_ws("/", *parts)


def _digits(c) -> Column:
    """The cell without single underscores between its digits (Python reads ``1_2`` as 12)."""
    text = _c(c).cast("string")
    return F.when(text.rlike(r"^\s*[+-]?\d+(?:_\d+)+\s*$"), F.replace(text, F.lit("_"), F.lit(""))).otherwise(text)


def parse_int_lenient(c) -> Column:
    """T16 lenient: NULL when the cell is not an integer."""
    return _digits(c).try_cast("int")


def parse_int(c) -> Column:
    """T16 strict: a cell that is not an integer raises."""
    return _digits(c).cast("int")


def slice_strict(lines, begin, end) -> Column:
    """0-based half-open ``[begin, end)``; '' when begin < 0, end < begin or
    end > number of lines; a bound that is not an integer counts as (0, 0)."""
    ls = _c(lines)
    b, e = parse_int_lenient(begin), parse_int_lenient(end)
    bad_parse = b.isNull() | e.isNull()
    b = F.when(bad_parse, F.lit(0)).otherwise(b)
    e = F.when(bad_parse, F.lit(0)).otherwise(e)
    n = F.coalesce(F.size(ls), F.lit(0))
    ok = (b >= 0) & (e >= b) & (e <= n)
    piece = F.slice(F.coalesce(ls, F.array().cast("array<string>")), F.greatest(b + 1, F.lit(1)),
                    F.greatest(e - b, F.lit(0)))
    return F.when(ok, F.array_join(piece, "")).otherwise(F.lit(""))


def _clamp(i: Column, n: Column) -> Column:
    return F.when(i < 0, F.greatest(i + n, F.lit(0))).otherwise(F.least(i, n))


def slice_lenient(lines, begin, end) -> Column:
    """Python slice ``lines[begin:end]`` (negative = from the end, clamped);
    a bound that is not an integer raises, as ``int()`` does."""
    ls = F.coalesce(_c(lines), F.array().cast("array<string>"))
    n = F.size(ls)
    b, e = _clamp(parse_int(begin), n), _clamp(parse_int(end), n)
    return F.array_join(F.slice(ls, b + 1, F.greatest(e - b, F.lit(0))), "")

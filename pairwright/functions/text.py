"""Source-text normalisation as Column expressions.

Everything here is built from Spark SQL functions (``regexp_replace``,
``split``, ``zip_with`` ...), so it runs inside whole-stage code generation
with no Python in the executors.  The composite normaliser that also
renames identifiers (T7/T8) lives in ``operators.normalize`` because renaming
is a DataFrame job over a token table.

Regex notes (Java engine): ``(?U)`` makes ``\\s``, ``\\d`` and ``\\b`` Unicode
aware like Python's ``re``; ``(?d)`` makes ``.`` and ``$`` treat only
``\\n`` as a line end; literal patterns use possessive quantifiers, which
match the same strings without the deep backtracking that overflows the
executor stack on long literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# These values must equal the reference behaviour for equal results.
# Python's str.isspace() set = Unicode White_Space plus \x1c-\x1f.
WS_CLASS = r"\s\x1c-\x1f"
# Block and line comments (block: lazy, across lines; line: to end of line).
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"(?dm)//.*?$"
# String and char literals, escapes honoured, may span lines.
STRING_LITERAL = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
# Numeric literals: hex int/float, binary, octal 0o, decimal; underscores, exponents, suffixes.
NUMBER_LITERAL = (r"(?U)\b("
                  r"0[xX](?:[0-9A-Fa-f_]+(?:\.[0-9A-Fa-f_]+)?)(?:[pP][+\-]?\d[\d_]*)?[fFdD]?[lL]?"
                  r"|0[bB][01_]+[lL]?"
                  r"|0[oO][0-7_]+[lL]?"
                  r"|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+\-]?\d[\d_]*)?[fFdD]?[lL]?"
                  r")\b")
STR_MASK = "<STR>"
NUM_MASK = "<NUM>"
# Type name (last dotted part, array brackets stripped) -> rename bucket; anything else "obj".
TYPE_PREFIX = {
    "byte": "num", "short": "num", "int": "num", "long": "num",
    "float": "num", "double": "num", "boolean": "bool", "char": "chr",
    "String": "str", "CharSequence": "str",
}
ARRAY_SUFFIX = "_arr"
OTHER_PREFIX = "obj"
TAB_SPACES = "    "
# ------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(c) -> Column:
    """CRLF/CR -> LF, tab -> 4 spaces, right-strip lines, 3+ newlines -> 2,
    strip, one final newline unless the result is empty."""
    t = F.regexp_replace(_c(c), r"\r\n?", "\n")
    t = F.replace(t, F.lit("\t"), F.lit(TAB_SPACES))
    # a match starts at a run's first character only, so long runs cost linear time
    t = F.regexp_replace(t, rf"(?U)(?<![{WS_CLASS}&&[^\n]])[{WS_CLASS}&&[^\n]]++(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, rf"(?U)\A[{WS_CLASS}]++|(?<![{WS_CLASS}])[{WS_CLASS}]++\z", "")
    return F.regexp_replace(t, r"(?s)(?<=.)\z", "\n")  # each input is mentioned once


def blank_block_comments(c) -> Column:
    """Every ``/* ... */`` becomes as many spaces as it had characters."""
    def blank(t: Column) -> Column:
        pieces = F.split(t, BLOCK_COMMENT, -1)
        blanks = F.transform(F.regexp_extract_all(t, F.lit(BLOCK_COMMENT), 0),
                             lambda m: F.repeat(F.lit(" "), F.length(m)))
        return F.array_join(F.zip_with(pieces, F.concat(blanks, F.array(F.lit(""))), lambda p, b: F.concat(p, b)), "")

    # the one-element array names the input, which is then computed once
    return F.transform(F.array(_c(c)), blank)[0]


def remove_line_comments(c) -> Column:
    """``//`` to end of line, regardless of string literals."""
    return F.regexp_replace(_c(c), LINE_COMMENT, "")


def remove_comments(c) -> Column:
    """T2 then T3, the reference order."""
    return remove_line_comments(blank_block_comments(c))


def mask_strings(c) -> Column:
    """T4: string and char literals -> ``<STR>``."""
    return F.regexp_replace(_c(c), STRING_LITERAL, STR_MASK)


def mask_numbers(c) -> Column:
    """T5: numeric literals -> ``<NUM>``."""
    return F.regexp_replace(_c(c), NUMBER_LITERAL, NUM_MASK)


def mask_literals(c, strings: bool = True, numbers: bool = True) -> Column:
    t = _c(c)
    if strings:
        t = mask_strings(t)
    if numbers:
        t = mask_numbers(t)
    return t


def type_bucket(c) -> Column:
    """``num``/``bool``/``chr``/``str``/``obj`` by the last dotted part of the
    type, ``_arr`` appended for array types."""
    t = _c(c)
    base = F.element_at(F.split(F.regexp_replace(t, r"[\[\]]+\z", ""), r"\.", -1), -1)
    prefix = F.lit(OTHER_PREFIX)
    for name, p in reversed(list(TYPE_PREFIX.items())):
        prefix = F.when(base == name, F.lit(p)).otherwise(prefix)
    return F.concat(prefix, F.when(t.endswith("[]"), F.lit(ARRAY_SUFFIX)).otherwise(F.lit("")))


def bucket_of(t: str) -> str:
    """T6 of one text, for code that holds the type names itself."""
    base = t.rstrip("[]").rsplit(".", 1)[-1]
    return TYPE_PREFIX.get(base, OTHER_PREFIX) + (ARRAY_SUFFIX if t.endswith("[]") else "")


def normalize_no_rename(c, strip_comments: bool = True, strings: bool = True,
                        numbers: bool = True) -> Column:
    """T7 with renaming off: whitespace -> comments -> masks -> whitespace."""
    t = normalize_whitespace(c)
    if strip_comments:
        t = remove_comments(t)
    if strings or numbers:
        t = mask_literals(t, strings, numbers)
    return normalize_whitespace(t)

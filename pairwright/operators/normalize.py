"""The composite normaliser with renaming.

Order as in the reference: whitespace -> comments -> rename -> literal
masks -> whitespace.  Renaming is a DataFrame job (``operators.rename``), so
the normaliser works on a DataFrame of snippets, not on one string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions import text as T
from pairwright.operators.rename import deal_snippets, rename_identifiers


def normalize_code(df: DataFrame, sid: str = "snippet_id", code: str = "code", strip_comments: bool = True,
                   mask_strings: bool = True, mask_numbers: bool = True, rename: bool = True) -> DataFrame:
    """T7 over a snippet table; empty snippets stay empty."""
    if rename:
        df = deal_snippets(df, sid, code)  # before the rules, which then run once, in all of the parts
    out = df.withColumn("_orig_empty", F.col(code) == "")
    out = out.withColumn(code, T.normalize_whitespace(code))
    if strip_comments:
        out = out.withColumn(code, T.remove_comments(code))
    if rename:
        out = rename_identifiers(out, sid, code, dealt=True).drop("renamed")
    if mask_strings or mask_numbers:
        out = out.withColumn(code, T.mask_literals(code, mask_strings, mask_numbers))
    out = out.withColumn(code, T.normalize_whitespace(code))
    return out.withColumn(code, F.when(F.col("_orig_empty"), F.lit("")).otherwise(F.col(code))).drop("_orig_empty")

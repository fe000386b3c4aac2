"""Pair tables in CSV files: readers, layout checks, writers.

Layouts
-------
``pair9``  folder1, file1, begin1, end1, folder2, file2, begin2, end2, label
``pair8``  the same without label (one file per class, S4)
``fused8`` label digit glued to folder1 in the first cell (S3)

The header convention is an explicit argument: the reference's tools drop
the first row, its training reader and its split writer do not.

Row positions
-------------
``row_pos`` is the 0-based data-row number inside its file.  The scan
numbers rows inside each file split (``monotonically_increasing_id`` is
dense within a task, which reads its splits in order); a small table of
split sizes (one row per file block) gives each split's offset in its file.
The partition number alone is never taken as file order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.schema import PAIR8, PAIR_COLS
from pairwright.sources.files import derived_path

LAYOUTS = {"pair9": PAIR_COLS, "pair8": PAIR8, "fused8": ("fused0",) + PAIR8[1:]}
CORRUPT = "_corrupt_record"


def _schema(cols: Sequence[str], corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), True) for c in cols]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    return T.StructType(fields)


def csv_row_positions(df: DataFrame, out: str = "row_pos") -> DataFrame:
    """Add the 0-based row position within its file, and ``src`` = file path."""
    s = (df.withColumn("src", F.col("_metadata.file_path"))
         .withColumn("_blk", F.col("_metadata.file_block_start"))
         .withColumn("_id", F.monotonically_increasing_id()))
    blocks = s.groupBy("src", "_blk").agg(F.min("_id").alias("_id0"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("src").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("src", "_blk", "_id0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (s.join(offsets, ["src", "_blk"])
            .withColumn(out, F.col("_id") - F.col("_id0") + F.col("_off"))
            .drop("_blk", "_id", "_id0", "_off"))


def read_pairs(spark: SparkSession, paths: str | Sequence[str], header: bool = True,
               layout: str = "pair9", multiline: bool = False, positions: bool = True) -> DataFrame:
    """Read one or many pair files with a fixed all-string schema.

    Rows whose field count differs from the layout keep their raw text in
    ``_corrupt_record`` (short rows are padded with NULLs, long rows cut), so
    the strict check (P1) and the lenient use (P2) can both be applied.
    """
    cols = LAYOUTS[layout]
    df = (spark.read.schema(_schema(cols))
          .option("header", header).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT)
          .options(**CSV_OPTIONS).option("multiLine", multiline)
          .csv(list(paths) if not isinstance(paths, str) else paths))
    # Every cell of a well-formed row is a string value, "" included (Spark
    # reads an empty unquoted cell as NULL); NULL stays only for cells a
    # ragged row does not have.
    ok = F.col(CORRUPT).isNull()
    df = df.select(*[F.when(ok, F.coalesce(F.col(c), F.lit(""))).otherwise(F.col(c)).alias(c) for c in cols], CORRUPT,
                   "_metadata")
    if layout == "fused8":
        df = unfuse(df)
    return csv_row_positions(df) if positions else df.withColumn("src", F.col("_metadata.file_path"))


def layout_errors(df: DataFrame) -> DataFrame:
    """P1 on a CSV read: rows whose width differs from the layout, with their raw text.

    Spark rejects a query on a CSV scan that references only the corrupt
    record column, so the filter names a data column as well.
    """
    first = [c for c in df.columns if c not in (CORRUPT, "src", "row_pos")][0]
    bad = F.col(CORRUPT).isNotNull() & (F.col(first).isNull() | F.col(first).isNotNull())
    return df.filter(bad)


def lenient_rows(df: DataFrame, width: int = 9) -> DataFrame:
    """P2 on a CSV read: skip rows with fewer than ``width`` cells, keep longer
    ones (their extra cells are cut by the fixed schema)."""
    raw = F.col(CORRUPT)
    first = [c for c in df.columns if c not in (CORRUPT, "src", "row_pos")][0]
    keep = raw.isNull() | (F.size(csv_cells(raw)) >= width)
    if "label" in df.columns:  # the last cell of a longer row, as in parse_lenient
        df = df.withColumn("label", F.when(raw.isNull(), F.col("label")).otherwise(F.try_element_at(csv_cells(raw), F.lit(-1))))
    return df.filter(keep & (F.col(first).isNull() | F.col(first).isNotNull()))


def unfuse(df: DataFrame, col: str = "fused0") -> DataFrame:
    """S3: label = first character of the first cell, folder1 = the rest."""
    cols = [c for c in df.columns if c != col]
    c0 = F.col(col)
    return df.select(c0.substr(1, 1).alias("label"), c0.substr(F.lit(2), F.length(c0)).alias("folder1"), *cols)


def read_unlabeled(spark: SparkSession, clone_paths, nonclone_paths, header: bool = True) -> DataFrame:
    """One all-clone and one all-non-clone input; the first 8 cells are the pair."""
    c = read_pairs(spark, clone_paths, header, "pair8").withColumn("label", F.lit("1"))
    n = read_pairs(spark, nonclone_paths, header, "pair8").withColumn("label", F.lit("0"))
    return c.unionByName(n)


# ------------------------------------------------------------------ line-level parsing
# Reading and writing alike: "" is a quote inside quotes, blanks at a cell's ends are part of it.
CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}
# A mark after a line's last cell, so that empty cells at its end are told from absent ones.
_END = "\u0002"
# Columns given to the parser: enough for most lines, and for all that are wider.
_SPARE, _MOST = 24, 400


def csv_cells(line: Column | str) -> Column:
    """Cells of one CSV text line as an array of strings, by Spark's CSV parser; '' has none, NULL gives NULL.

    ``from_csv`` has spare string columns, so any width up to 400 cells comes
    back as it is (of a wider line the first 400).  A quote that does not
    close takes the rest of the line; of a cell whose quotes close early what
    follows them is kept (``"a"b`` is ``ab``), as in Python's ``csv.reader``;
    only blanks right after a closing quote go, where that reader keeps them.
    """
    line = F.col(line) if isinstance(line, str) else line

    def parsed(width: int) -> Column:
        cells = [f"c{i}" for i in range(width + 1)]
        row = F.from_csv(F.concat(line, F.lit("," + _END)), ", ".join(f"{c} string" for c in cells), CSV_OPTIONS)
        return F.transform(F.array(row), lambda r: F.array(*[r[c] for c in cells]))[0]

    def unmarked(found: Column) -> Column:
        """The cells before the mark, which stands alone or ends a cell whose quote did not close; NULL without it."""
        last = F.array_max(F.transform(found, lambda x, i: F.when(x.isNotNull(), i)))
        end = F.get(found, last)
        return F.when(end == _END, F.slice(found, F.lit(1), last)).when(
            end.endswith(_END), F.concat(F.slice(found, F.lit(1), last), F.array(end.substr(F.lit(1), F.length(end) - 2))))

    def value(x: Column) -> Column:
        """The parser leaves a cell whose quotes close early as it stands; a well-formed one
        that begins with a quote is in the line in its quoted form."""
        rx = r'(?s)\A"((?:[^"]|"")*+)"?(.*)\z'
        odd = x.startswith('"') & ~F.contains(line, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""'))))
        return F.when(odd, F.concat(F.replace(F.regexp_extract(x, rx, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, rx, 2))) \
            .otherwise(F.coalesce(x, F.lit("")))

    def cells(width: int) -> Column:
        return F.transform(F.array(parsed(width)), unmarked)[0]

    found = F.coalesce(cells(_SPARE), cells(_MOST), F.slice(parsed(_MOST), 1, _MOST))
    return F.when(line == "", F.array().cast("array<string>")).when(line.isNotNull(), F.transform(found, value))


def layout_report(lines: DataFrame, line: str = "line", expected: int = 9,
                  keep: Sequence[str] = ("src", "row_pos")) -> DataFrame:
    """P1 strict check: non-empty rows whose field count is not ``expected``.

    The reference raises on the first such row; the report lists all of them
    (path, position, count, text) and ``assert_layout`` raises on any.
    """
    n = F.size(csv_cells(line))
    return (lines.filter(F.col(line) != "").select(*keep, n.alias("n_fields"), F.col(line))
            .filter(F.col("n_fields") != expected))


def assert_layout(lines: DataFrame, line: str = "line", expected: int = 9) -> DataFrame:
    """The lines unchanged, but evaluation fails on a row of the wrong width."""
    n = F.size(csv_cells(line))
    bad = F.concat(F.lit(f"expected {expected} columns, got "), n.cast("string"), F.lit(": "), F.col(line))
    return lines.withColumn(line, F.when((F.col(line) != "") & (n != expected), F.raise_error(bad))
                            .otherwise(F.col(line)))


def parse_lenient(lines: DataFrame, line: str = "line", keep: Sequence[str] = ("src", "row_pos")) -> DataFrame:
    """P2 (+ P4's "last field is the label"): rows with at least 9 fields; the
    first 8 name the functions, the last one is the label.  Shorter rows are
    skipped, longer ones kept."""
    return (lines.filter(F.col(line) != "").withColumn("_f", csv_cells(line)).filter(F.size("_f") >= 9)
            .select(*keep, *[F.element_at("_f", i + 1).alias(c) for i, c in enumerate(PAIR8)],
                    F.element_at("_f", -1).alias("label")))


def parse_positional(lines: DataFrame, line: str = "line", layout: str = "pair9",
                     keep: Sequence[str] = ("src", "row_pos")) -> DataFrame:
    """S1/S2 on text lines: cells by position; a cell that is there but empty is "", one that a short row lacks is NULL."""
    cols = LAYOUTS[layout]
    out = lines.filter(F.col(line) != "").select(*keep, csv_cells(line).alias("_f")).select(
        *keep, *[F.get("_f", F.lit(i)).alias(c) for i, c in enumerate(cols)])
    return unfuse(out) if layout == "fused8" else out


def rows_of(lines: DataFrame, line: str = "line", keep: Sequence[str] = ("src", "row_pos")) -> DataFrame:
    """P3, as de-duplication and the duplicate report see it: every line is a row, a blank one an empty row.

    Nine cells by position (NULL where there is none) and, of rows of another
    width, blank ones among them, the whole text in ``_corrupt_record``.
    """
    return lines.select(*keep, line, csv_cells(line).alias("_f")).select(
        *keep, *[F.get("_f", F.lit(i)).alias(c) for i, c in enumerate(PAIR_COLS)],
        F.when(F.size("_f") != len(PAIR_COLS), F.col(line)).alias(CORRUPT))


def read_rows(spark: SparkSession, paths: str | Sequence[str], header: bool = True) -> DataFrame:
    """Pair files with their blank rows: ``rows_of`` over text lines, ``row_pos`` counting all of them.

    A line is a row, so cells must not hold line ends (``read_pairs`` with ``multiline`` reads those).
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths).select(F.col("value").alias("line"), "_metadata")
    lines = csv_row_positions(lines)
    if header:
        lines = lines.filter("row_pos > 0").withColumn("row_pos", F.col("row_pos") - 1)
    return rows_of(lines)


def head_rows(df: DataFrame, max_rows: int | None, pos: str = "row_pos") -> DataFrame:
    """P5: the first ``max_rows`` rows in file order (None = all, 0 = none).

    A position filter, not ``limit``: it is order-safe and pushed to the scan.
    """
    return df if max_rows is None else df.filter(F.col(pos) < max_rows)


# ------------------------------------------------------------------ sinks
def write_pairs(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite",
                by: str | None = None) -> None:
    """Nine columns in position order, optionally one folder per input.

    Rows are range partitioned on (input, position), so a large input is
    written by many tasks as ordered part files instead of by one task.
    """
    order = ([by] if by else []) + ["row_pos"]
    out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    w = out.select(*order[:-1], *PAIR_COLS).write.mode(mode)
    if by:
        w = w.partitionBy(by)
    w.options(**CSV_OPTIONS).option("header", header).csv(path)


def write_derived(df: DataFrame, suffix: str, out_dir: str | None = None, header: bool = True, src: str = "src") -> dict[str, str]:
    """One table per input, named ``<stem><suffix>`` beside the input or in ``out_dir``; returns input -> table.

    All inputs are written by one job, as numbered folders that then get their
    names (one rename an input, which replaces what an earlier run left there).
    """
    spark = df.sparkSession
    sources = [r[0] for r in df.select(src).distinct().orderBy(src).collect()]  # one row an input file
    targets = {s: derived_path(s, suffix, out_dir) for s in sources}
    if len(set(targets.values())) < len(targets):
        raise ValueError("inputs of the same name need folders of their own")
    if not sources:
        return targets
    names = spark.createDataFrame(list(enumerate(sources)), "_n int, _src string")
    tmp = f"{os.path.dirname(targets[sources[0]])}/_derived-{uuid.uuid4().hex}"
    rows = df.join(names, F.col(src) == F.col("_src")).repartitionByRange("_n", "row_pos").sortWithinPartitions("_n", "row_pos")
    rows.select("_n", *PAIR_COLS).write.partitionBy("_n").options(**CSV_OPTIONS).option("header", header).csv(tmp)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(tmp).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, s in enumerate(sources):
        fs.delete(path(targets[s]), True)
        if not fs.rename(path(f"{tmp}/_n={i}"), path(targets[s])):
            raise OSError(f"{targets[s]} cannot be written")
    fs.delete(path(tmp), True)
    return targets


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One headerless table per split (``split=<name>`` folders); the part
    files of a split, in name order, hold its rows in ``out_pos`` order."""
    (df.repartitionByRange("split", "out_pos").sortWithinPartitions("split", "out_pos")
     .select("split", *PAIR_COLS).write.mode(mode).partitionBy("split").options(**CSV_OPTIONS)
     .option("header", False).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", header: bool = True) -> None:
    """Metric log as CSV, metric report as JSON (or any format)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", header)
    w.format(fmt).save(path)

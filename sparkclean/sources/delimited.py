"""Delimited text -> records -> cells, for files of any size.

A line is not a record: a quoted cell may hold line breaks, and whether a line starts
inside a quoted cell depends on every line before it. The steps are

1. each line gets its place (file, split, number in split) from the scan itself;
2. a line is a function on the state {outside, inside a quoted cell}; almost all lines
   leave it as it is. The others ("turns") are narrow rows; windows over one split's turns
   and then over the splits of one file give the state in front of every line;
3. files without a turn are done: line = record, no shuffle. In the other files lines are
   numbered per split, and only lines that belong to a record of several lines are grouped.

Window groups are one input split or one small row per split, whatever the data looks
like. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID
from sparkclean.operators.identity import file_row_id
from sparkclean.session import bytes_within

# Stands for a doubled quote while a piece is examined; not a character (Unicode reserves
# it for internal use), so it does not occur in text.
_PAIR = "﷐"
# A record longer than this is not assembled: an unclosed quote would otherwise pull the
# rest of the file into one row. Its lines go to quarantine one by one, in full.
MAX_RECORD_CHARS = 64 * 1024 * 1024
SPLIT_ROW_BYTES = 400
BROADCAST_BYTES = 256 * 1024 * 1024

_PLACE = ["_file", "_split", "_line"]


def _leaves_open(piece: Column) -> Column:
    """Does a quoted cell go on after this piece (text behind the opening quote)?"""
    return ~F.contains(F.replace(piece, F.lit('""'), F.lit("")), F.lit('"'))


def _end_state(line: Column, start: int, sep: str) -> Column:
    """State after the line when it starts outside (0) or inside (1)."""

    def step(state: Column, piece: Column) -> Column:
        inside = F.when(_leaves_open(piece), 1).otherwise(0)
        opening = F.when(_leaves_open(F.substring(piece, 2, 2**31 - 1)), 1).otherwise(0)
        return F.when(state == 1, inside).when(piece.startswith('"'), opening).otherwise(0)

    return F.aggregate(F.split(line, _regex_literal(sep)), F.lit(start), step)


def _regex_literal(sep: str) -> str:
    return "\\" + sep if not sep.isalnum() else sep


def split_cells(record: Column, sep: str = ",") -> Column:
    """Cells of one record. Quotes inside an unquoted cell are plain text; text behind a
    closing quote is kept; doubled quotes are one quote.

    The pieces between separators are walked once to find where each cell begins and ends; its text is then put
    together in one go, so a quoted cell with many separators costs time in proportion to its length.
    """
    span = "struct<begin:int,end:int>"
    start = F.struct(
        F.lit(False).alias("open"), F.lit(0).alias("begin"), F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("cells")
    )

    def step(acc: Column, piece: Column) -> Column:
        quoted = acc["open"] | piece.startswith('"')
        goes_on = quoted & _leaves_open(F.when(acc["open"], piece).otherwise(F.substring(piece, 2, 2**31 - 1)))
        begin = F.when(acc["open"], acc["begin"]).otherwise(acc["at"])
        cell = F.struct(begin.alias("begin"), acc["at"].alias("end"))
        return F.struct(
            goes_on.alias("open"), begin.alias("begin"), (acc["at"] + 1).alias("at"),
            F.when(goes_on, acc["cells"]).otherwise(F.concat(acc["cells"], F.array(cell))).alias("cells"),
        )

    def finish(acc: Column) -> Column:
        # an unclosed cell at the end of the file keeps what it has
        rest = F.struct(acc["begin"].alias("begin"), (acc["at"] - 1).alias("end"))
        return F.when(acc["open"], F.concat(acc["cells"], F.array(rest))).otherwise(acc["cells"])

    def text(cell: Column) -> Column:
        whole = F.array_join(F.slice(pieces, cell["begin"] + 1, cell["end"] - cell["begin"] + 1), sep)
        marked = F.replace(F.substring(whole, 2, 2**31 - 1), F.lit('""'), F.lit(_PAIR))
        head = F.substring_index(marked, '"', 1)
        tail = F.substring(marked, F.length(head) + 2, 2**31 - 1)
        resolved = F.concat(F.replace(head, F.lit(_PAIR), F.lit('"')), F.replace(tail, F.lit(_PAIR), F.lit('""')))
        return F.when(whole.startswith('"'), resolved).otherwise(whole)

    pieces = F.split(record, _regex_literal(sep))
    cells = F.transform(F.aggregate(pieces, start, step, finish), text)
    return F.when(F.contains(record, F.lit('"')), cells).when(record == "", F.array().cast("array<string>")).otherwise(pieces)


def read_lines(spark: SparkSession, path: str | list[str], sep: str = ",", line_sep: str = "\n") -> DataFrame:
    """(_file, _split, _line, text, f0, f1): every line with its place and its two end states."""
    raw = spark.read.option("lineSep", line_sep).text(path if isinstance(path, list) else [path])
    text = F.make_valid_utf8(F.col("value"))  # undecodable bytes -> U+FFFD
    lines = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"),
        text.alias("text"),
    )
    quoted = F.contains(F.col("text"), F.lit('"'))
    bare = F.regexp_replace("text", "\r$", "")
    return lines.withColumn("f0", F.when(quoted, _end_state(bare, 0, sep)).otherwise(0)).withColumn(
        "f1", F.when(quoted, _end_state(bare, 1, sep)).otherwise(1)
    )


def _effects(df: DataFrame, w) -> DataFrame:
    """Running composition of the line functions in window ``w``: ``_c`` is the state a line
    forces (or NULL), ``_n`` the number of lines so far that flip the state."""
    const = F.when(F.col("f0") == F.col("f1"), F.col("f0"))
    flip = F.when((F.col("f0") == 1) & (F.col("f1") == 0), 1).otherwise(0)
    return df.withColumn("_c", const).withColumn("_n", F.sum(flip).over(w))


def split_offsets(lines: DataFrame) -> DataFrame:
    """One row per input split: first line, lines before it in the file, state in front of
    it and whether its file has any turn."""
    place = Window.partitionBy("_file", "_split").orderBy("_line")
    turns = lines.where((F.col("f0") != 0) | (F.col("f1") != 1)).select(*_PLACE, "f0", "f1")
    run = _effects(turns, place)
    run = run.withColumn("_nc", F.when(F.col("_c").isNotNull(), F.col("_n")))
    # per split: the last constant state, and the parity of flips after it
    effect = run.groupBy("_file", "_split").agg(
        F.max_by(F.struct("_c", "_nc"), F.when(F.col("_c").isNotNull(), F.col("_line"))).alias("k"),
        F.max("_n").alias("n"),
    ).select(
        "_file", "_split",
        F.col("k._c").alias("sc"),
        ((F.col("n") - F.coalesce(F.col("k._nc"), F.lit(0))) % 2).alias("sp"),
    )
    sizes = lines.groupBy("_file", "_split").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_count"))
    per_split = sizes.join(effect, ["_file", "_split"], "left").withColumn("sp", F.coalesce("sp", F.lit(0)))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    # state after the splits before this one, by the same rule one level up
    upto = Window.partitionBy("_file").orderBy("_split")
    flips_after = F.sum("sp").over(upto)
    step = per_split.withColumn("_f", flips_after).withColumn(
        "_fc", F.when(F.col("sc").isNotNull(), F.struct("sc", (F.col("_f") - F.col("sp")).alias("base")))
    )
    last_const = F.last("_fc", ignorenulls=True).over(before)
    flips_before = F.coalesce(F.sum("sp").over(before), F.lit(0))
    # everything from here on handles one small row per input split, no data
    return step.select(
        "_file", "_split", "_first",
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_lines_before"),
        (
            (F.coalesce(last_const["sc"], F.lit(0)) + flips_before - F.coalesce(last_const["base"], F.lit(0))) % 2
        ).cast("int").alias("_state"),
        F.max((F.col("sc").isNotNull() | (F.col("sp") > 0)).cast("int")).over(
            Window.partitionBy("_file")
        ).alias("_turning"),
        (F.dense_rank().over(Window.orderBy("_file")) - 1).cast("long").alias("_file_no"),
    )


def read_records(
    spark: SparkSession,
    path: str | list[str],
    work_dir: str,
    sep: str = ",",
    line_sep: str = "\n",
    max_record_chars: int = MAX_RECORD_CHARS,
) -> DataFrame:
    """(_rid, _file, record_no, record, oversize): records in file order, header included.

    ``record_no`` counts from 0 within the file, ``_rid`` orders all of them. The offsets
    are written to ``work_dir`` first, because the second scan must agree with them; a
    scan that was split differently stops with an error instead of losing lines.
    """
    lines = read_lines(spark, path, sep, line_sep)
    offsets_path = f"{work_dir}/splits"
    split_offsets(lines).write.parquet(offsets_path)
    offsets = spark.read.parquet(offsets_path)
    # one small row per input split; sent whole only when that is proven to be small
    small = bytes_within(offsets, BROADCAST_BYTES, SPLIT_ROW_BYTES)
    side = F.broadcast(offsets) if small else offsets
    placed = lines.join(side, ["_file", "_split"], "left").withColumn(
        "_no",
        F.when(F.col("_first").isNull(), F.raise_error(F.lit("input was split differently on the second scan")).cast("long"))
        .otherwise(F.col("_lines_before") + F.col("_line") - F.col("_first")),
    )
    turning = offsets.agg(F.coalesce(F.max("_turning"), F.lit(0))).first()[0]
    bom = F.when(F.col("record_no") == 0, F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record"))

    def finish(df: DataFrame) -> DataFrame:
        return df.withColumn("record", F.regexp_replace("record", "\r$", "")).select(
            file_row_id(F.col("_file_no"), F.col("record_no")).alias(ROW_ID),
            "_file", "record_no", bom.alias("record"), "oversize",
        )

    simple = placed.where("_turning = 0").select(
        "_file", "_file_no", F.col("_no").alias("record_no"), F.col("text").alias("record"), F.lit(False).alias("oversize")
    )
    if not turning:
        return finish(simple)
    return finish(simple.unionByName(_grouped_records(placed.where("_turning = 1"), work_dir, max_record_chars)))


def _grouped_records(placed: DataFrame, work_dir: str, max_record_chars: int) -> DataFrame:
    """Records of files that have cells with line breaks."""
    spark = placed.sparkSession
    w = Window.partitionBy("_file", "_split").orderBy("_line")
    run = _effects(placed, w)
    run = run.withColumn("_k", F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("c"), F.col("_n").alias("n"))))
    k = F.last("_k", ignorenulls=True).over(w)
    after = (
        F.when(k.isNotNull(), k["c"] + F.col("_n") - k["n"]).otherwise(F.col("_state") + F.col("_n")) % 2
    ).cast("int")
    run = run.withColumn("_after", after)
    run = run.withColumn("_inside", F.coalesce(F.lag("_after").over(w), F.col("_state")))
    starts = run.withColumn("_start", 1 - F.col("_inside")).withColumn("_s", F.sum("_start").over(w))
    # the first line of the next record shows that this one is complete; the last line of
    # a split cannot know and goes through the grouping
    starts = starts.withColumn("_next", F.lead("_start").over(w)).select(
        "_file", "_file_no", "_split", "_line", "_no", "text", "_start", "_s", "_next"
    )
    staged = f"{work_dir}/lines"
    starts.write.parquet(staged)  # read several times below
    starts = spark.read.parquet(staged)
    per_split = starts.groupBy("_file", "_split").agg(F.sum("_start").alias("_n_starts"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_split.select(
        F.col("_file").alias("_bf"), F.col("_split").alias("_bs"),
        F.coalesce(F.sum("_n_starts").over(before), F.lit(0)).alias("_base"),
    )
    bases_path = f"{work_dir}/records"
    bases.write.parquet(bases_path)
    bases = spark.read.parquet(bases_path)
    if bytes_within(bases, BROADCAST_BYTES, SPLIT_ROW_BYTES):
        bases = F.broadcast(bases)
    numbered = starts.join(
        bases, (F.col("_file") == F.col("_bf")) & (F.col("_split") == F.col("_bs"))
    ).withColumn("record_no", F.col("_base") + F.col("_s") - 1)
    whole = (F.col("_start") == 1) & (F.coalesce(F.col("_next"), F.lit(0)) == 1)
    single = numbered.where(whole).select(
        "_file", "_file_no", "record_no", F.col("text").alias("record"), F.lit(False).alias("oversize")
    )
    parts = numbered.where(~whole)
    size = F.sum(F.length("text").cast("long") + 1)
    # at most one row per max_record_chars characters of input
    huge = parts.groupBy("_file", "record_no").agg(size.alias("_chars")).where(F.col("_chars") > max_record_chars).select(
        F.col("_file").alias("_hf"), F.col("record_no").alias("_hr")
    )
    same = (F.col("_file") == F.col("_hf")) & (F.col("record_no") == F.col("_hr"))
    fits = parts.join(huge, same, "left_anti").groupBy("_file", "_file_no", "record_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_no", "text"))), lambda x: x["text"]), "\n").alias("record")
    ).select("_file", "_file_no", "record_no", "record", F.lit(False).alias("oversize"))
    loose = parts.join(huge, same, "left_semi").select(
        "_file", "_file_no", "record_no", F.col("text").alias("record"), F.lit(True).alias("oversize")
    )
    return single.unionByName(fits).unionByName(loose)

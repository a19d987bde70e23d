"""Files in: many sheets with provenance, JSON records, and text that may not parse."""

from __future__ import annotations

import os
import re
from collections import Counter
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voucherflow.functions.literals import fixed_table

FILE_ROW = "__row"
FILE_ROWS = 1 << 36        # `ord` leaves room for so many rows in a file
FORMATS = ("csv", "json", "parquet")


def _with_file_rows(df: DataFrame) -> DataFrame:
    """Zero-based row number inside each file of a text format.

    Spark numbers rows by partition; what is taken off is the number of a file's first row in each split, plus the rows of the
    splits before it. That table has one row for each split of a file, and it alone is grouped and ordered.
    """
    place = df.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__file"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__id", F.monotonically_increasing_id())
    splits = place.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("__file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return place.join(splits, ["__file", "__block"]).withColumn(FILE_ROW, F.col("__id") + F.col("__shift")).drop("__block", "__id", "__shift")


# ---- CSV in splits ---------------------------------------------------------

# What closes an open quoted value, and a line's fields from its start or from where such a value closed: a quote opens a value only at the start of a field.
_CLOSING = re.compile(r'(?:[^"]|"")*+"[^,]*(?:,|$)')
_FIELDS = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*|[^",][^,]*|(?=,))(?:,|$))*')


def ends_open(line: str, open_: bool) -> bool:
    """Whether a quoted value is open at the line's end, if it was at its start (`open_`)."""
    at = 0
    if open_:
        closing = _CLOSING.match(line)
        if closing is None:
            return True
        at = closing.end()
    return line.startswith('"', _FIELDS.match(line, at).end())


def _states(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether a value is open before each line, for a block that starts closed and one that starts open; one more place for the end."""
    quoted = np.flatnonzero(pc.fill_null(pc.match_substring(lines, '"'), False).to_numpy(zero_copy_only=False))
    text = lines.take(pa.array(quoted)).to_pylist()
    out = []
    for now in (False, True):
        state = np.full(len(lines) + 1, now)
        for n, line in zip(quoted.tolist(), text, strict=True):     # lines without a quote leave the state as it is
            new = ends_open(line, now)
            if new != now:
                state[n + 1:], now = new, new
        out.append(state)
    return tuple(out)


def _blocks(batches):
    """(file, block, lines) of each block of a task, in order; a block is as large as a split."""
    held, key = [], None
    for batch in batches:
        files, blocks = batch.column("__file"), batch.column("__block").to_numpy()
        change = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]] | np.r_[True, pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)]) if len(blocks) else []
        for a, b in zip(change, [*change[1:], len(blocks)], strict=True):
            new = (files[int(a)].as_py(), int(blocks[a]))
            if new != key and held:
                yield *key, pa.concat_arrays(held)
                held = []
            key = new
            held.append(batch.column("value").slice(int(a), int(b - a)))
    if held:
        yield *key, pa.concat_arrays(held)


def _starts(lines: pa.Array, state: np.ndarray) -> np.ndarray:
    """Which lines start a record: no value is open before them, and they are not blank."""
    return ~state[:-1] & (pc.utf8_length(pc.utf8_rtrim(lines, "\r")).to_numpy(zero_copy_only=False) > 0)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(__file, record, text): every record of CSV files with line breaks inside quotes, numbered in its file from zero (the header), read in splits.

    One pass finds for each split what it leaves open and how many records start in it, for either state at its start; the splits of a file are then put in a
    row, a list as long as that of the splits themselves. A second pass cuts the records. Only those that lie across splits are put together by a shuffle."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))

    def measure(batches):
        for file, block, text in _blocks(batches):
            states = _states(text)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([[bool(x[-1]) for x in states]]), pa.array([[int(_starts(text, x).sum()) for x in states]])],
                                             ["__file", "__block", "open", "starts"])
    known, before = {}, {}
    for r in sorted(lines.mapInArrow(measure, "__file string, __block long, open array<boolean>, starts array<long>").collect(), key=lambda r: (r["__file"], r["__block"])):
        state, number = before.get(r["__file"], (False, 0))
        known[r["__file"], r["__block"]] = (state, number)
        before[r["__file"]] = (r["open"][state], number + r["starts"][state])
    shared = spark.sparkContext.broadcast(known)

    def cut(batches):
        for file, block, text in _blocks(batches):
            open_, number = shared.value[file, block]
            state = _states(text)[open_]
            starts = _starts(text, state)
            # Lines of one record stand together; a blank line outside quotes belongs to none.
            inside = starts | state[:-1]
            record = (number - 1 + np.cumsum(starts))[inside]
            rows = text.filter(pa.array(inside))
            first = np.flatnonzero(np.r_[True, record[1:] != record[:-1]])[:len(record)]
            size = np.diff(np.r_[first, len(record)])
            single = np.flatnonzero(size == 1)
            whole = rows.take(pa.array(first)).to_pylist() if len(single) < len(size) else rows
            if len(single) < len(size):
                for n in np.flatnonzero(size > 1).tolist():
                    whole[n] = "\n".join(x.removesuffix("\r") for x in rows.slice(int(first[n]), int(size[n])).to_pylist())
                whole = pa.array(whole, pa.string())
            edge = np.zeros(len(first), bool)
            if len(first):
                edge[0], edge[-1] = open_, edge[-1] or state[-1]        # it came from the split before, or goes on in the next
                if open_ and len(first) == 1:
                    edge[0] = True
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(first), pa.string()), pa.array(np.full(len(first), block)), pa.array(record[first]), pa.array(edge), pc.utf8_rtrim(whole, "\r")],
                                             ["__file", "__block", "record", "edge", "text"])
    rows = lines.mapInArrow(cut, "__file string, __block long, record long, edge boolean, text string")
    joined = rows.where("edge").groupBy("__file", "record").agg(F.array_sort(F.collect_list(F.struct("__block", "text"))).alias("parts"))
    joined = joined.select("__file", "record", F.array_join(F.col("parts.text"), "\n").alias("text"))
    return rows.where("NOT edge").select("__file", "record", "text").unionByName(joined)


def _read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows with their file and zero-based row number, and the files. As in Spark's own reader, the first file's header names the columns."""
    records = csv_records(spark, path)
    files = [re.sub("^file:/+", "file:/", f) for f in spark.read.text(path).inputFiles()]
    heads = records.where("record = 0").select("__file", "text").orderBy("__file").limit(1).collect()
    names = _header(heads[0]["text"]) if heads else []
    if not names:
        return records.where("record > 0").select("__file", (F.col("record") - 1).alias(FILE_ROW)), files
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = records.where("record > 0").select("__file", (F.col("record") - 1).alias(FILE_ROW), F.from_csv("text", schema, {"escape": '"', "multiLine": "true"}).alias("__csv"))
    return parsed.select("__csv.*", "__file", FILE_ROW), files


def _header(text: str) -> list[str]:
    """Column names of a header record; empty ones and repeats are told apart as Spark's reader does it."""
    import csv
    names = next(csv.reader([text.removeprefix("\ufeff")]))
    counts = Counter(n.lower() for n in names)
    return [f"_c{k}" if not n else f"{n}{k}" if counts[n.lower()] > 1 else n for k, n in enumerate(names)]


def _load(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":        # without line breaks inside quotes
        return spark.read.option("header", True).option("escape", '"').csv(path)
    if fmt == "json":
        return spark.read.json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt}; use csv, json or parquet")


def _names(files: list[str]) -> dict[str, str]:
    """A short unique name for each file: its path below the folder all have in common, without the format's ending where that stays unique."""
    folder = os.path.commonpath([os.path.dirname(f) for f in files]) if files else ""
    inner = {f: unquote(f[len(folder):].lstrip("/")) for f in files}
    bare = {f: re.sub(r"\.(csv|json|parquet)$", "", name) for f, name in inner.items()}
    counts = Counter(bare.values())
    return {f: bare[f] if counts[bare[f]] == 1 else inner[f] for f in files}


def read_sheet(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = True) -> DataFrame:
    """One sheet: a file or a folder of files of one format, with references that are unique in it."""
    return read_sheets(spark, [(path, fmt)], multiline)


def read_sheets(spark: SparkSession, sheets: list[tuple[str, str]], multiline: bool = True) -> DataFrame:
    """Several (path, format) sheets as one table; columns a sheet lacks become null.

    A reference is '<file>!R<row>', the header counting as row 1, with the file's path below the folder that all files have in
    common; a single CSV file is just 'csv'. `ord` grows by file, then by row, over all sheets. A file that is named twice is read once for each sheet under one reference, so name each once.
    CSV files are read in splits either way; `multiline=False` saves a pass for data without line breaks inside quotes.
    """
    if not sheets:
        raise ValueError("no sheets given")
    loaded, files = [], set()
    for path, fmt in sheets:
        if fmt == "csv" and multiline:
            df, own = _read_csv(spark, path)
        else:
            df = _load(spark, path, fmt)
            own = [re.sub("^file:/+", "file:/", f) for f in df.inputFiles()]
            df = df.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__file"), F.col("_metadata.row_index").alias(FILE_ROW)) if fmt == "parquet" else _with_file_rows(df)
        loaded.append(df)
        files |= set(own)
    files = sorted(files)
    names = {files[0]: "csv"} if len(files) == 1 and sheets[0][1] == "csv" else _names(files)
    table = spark.createDataFrame([(f, names[f], n) for n, f in enumerate(files)] or [("", "", 0)], "__file string, source_sheet string, __number long")
    out = None
    for rows in loaded:
        # One row for each input file, a list that the reader holds on the driver in any case.
        rows = rows.join(F.broadcast(table), "__file").withColumns({
            "source_row": (F.col(FILE_ROW) + 2).cast("bigint"), "source_ref": F.concat("source_sheet", F.lit("!R"), (F.col(FILE_ROW) + 2).cast("string")),
            "ord": (F.col("__number") * FILE_ROWS + F.col(FILE_ROW)).cast("bigint")}).drop("__file", "__number", FILE_ROW)
        rows = rows.select(*[c for c in rows.columns if c not in PLACE], *PLACE)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


PLACE = ("source_sheet", "source_row", "source_ref", "ord")


def sheet_warnings(spark: SparkSession, sheets: list[tuple[str, str]]) -> DataFrame:
    """Per sheet: dropped label columns, unknown headers, empty or headerless content."""
    from voucherflow.operators import normalize as N
    notes = []
    for path, fmt in sheets:
        df = read_sheet(spark, path, fmt)
        names = [c for c in df.columns if c not in N.PROVENANCE]
        if not names or all(n.lower().startswith(("unnamed:", "_c")) for n in names):
            notes.append((path, "has no header row and was skipped"))
            continue
        if not N.rename_plan(names):
            notes.append((path, "no recognised GST/accounting columns; rows are still classified"))
        dropped = N.dropped_columns(names)
        if dropped:
            notes.append((path, "ignored label/output columns " + ", ".join(dropped)))
        if df.isEmpty():
            notes.append((path, "is empty and was skipped"))
    return fixed_table(spark, "sheet warning", notes or [("", "none")])


def json_records(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row per record of a JSON text holding a list, or an object with a `records` list.

    Text that is neither stays as one row with `error` set and no record.
    """
    as_list = F.from_json(column, "array<map<string,string>>")
    wrapped = F.from_json(column, "struct<records:array<map<string,string>>>")["records"]
    text = F.trim(F.col(column))
    records = F.when(text.startswith("["), as_list).when(text.startswith("{"), wrapped)
    good = F.when(records.isNotNull(), records)
    rows = df.select(key, good.alias("records"))
    return rows.select(key, F.col("records").isNull().alias("error"), F.posexplode_outer("records").alias("pos", "record")) \
        .withColumn("source_ref", F.when(F.col("pos").isNotNull(), F.concat(F.lit("records["), F.col("pos").cast("string"), F.lit("]"))))


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """First rows of a sheet by position; the row count is a separate aggregate."""
    return df.orderBy("ord").limit(rows)

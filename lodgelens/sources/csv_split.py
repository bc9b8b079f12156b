"""Multi-line CSV exports read by many tasks.

Whether a line break lies inside a quoted field depends on all quotes before it. Every block of a
file counts its quotes; a running sum over the blocks tells which of them start inside a field. With
that, each task finds the records of its own blocks. Records that run over the end of a block leave a
piece in each, and the pieces, two rows a block at most, are put together in order.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodgelens.bounds import MAX_BROADCAST_BYTES, fits_broadcast
from lodgelens.session import materialise
from lodgelens.sources.csv_files import scan_csv

_PARTS = "file long, start long, place int, text string"
#: A row of a block: what comes before its first record, its records, and the open one at its end.
_HEAD, _RECORD, _TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order within each block, with the block they start in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """``(file, start, inside)``: whether a block starts inside a quoted field."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    counted = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).cast("int").alias("odd"))
    # A window over a file's blocks: one small row per block.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Block:
    """The records of one block, as its lines come in batches: rows (place, header, text)."""

    def __init__(self, start: int, inside: bool):
        self.start, self.odd = start, inside
        self.open: list[str] = []  # lines of the record that is not known to be complete
        self.found = False  # whether a record starts in this block
        self.header = start == 0

    def take(self, lines: list[str], quotes: np.ndarray) -> list[tuple]:
        """What these lines complete."""
        odd = (np.cumsum(quotes) + self.odd) % 2
        begins = np.flatnonzero(np.append(self.odd, odd[:-1]) == 0)
        self.odd = bool(odd[-1])
        edges = [*begins.tolist(), len(lines)]
        self.open.extend(lines[: edges[0]])
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out.extend(self.close())
            self.found, self.open = True, lines[a:b]
        return out

    def close(self, last: bool = False) -> list[tuple]:
        """The record up to here, or the end of one that another block began."""
        if not self.open:
            return []
        text = "\n".join(self.open)
        self.open = []
        if not self.found:
            return [(_HEAD, False, text)]
        header, self.header = self.header, False
        return [(_TAIL if last and self.odd else _RECORD, header, text)]


def _check_header(text: str, names: list[str]) -> None:
    read = next(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")), [])
    if [c.strip() for c in read] != names:
        raise ValueError(f"CSV header {read} is not {names}")


def _parts(lines: DataFrame, blocks: DataFrame, names: list[str]) -> DataFrame:
    """Records and pieces of records of all blocks."""
    if not fits_broadcast(blocks):
        raise ValueError(f"more blocks than {MAX_BROADCAST_BYTES} bytes of block numbers; read fewer files at a time")
    # A broadcast join keeps the lines of a block in order, as a shuffle would not.
    marked = lines.join(F.broadcast(blocks), ["file", "start"], "left").select("file", "start", "inside", "line")

    def run(batches):
        key, block = None, None

        def rows(found):
            for place, header, text in found:
                if not header:
                    yield (*key, place, text)
                elif place == _TAIL:
                    raise ValueError("the header does not end in the first block of its file")
                else:
                    _check_header(text, names)

        def batch(found):
            columns = list(zip(*found, strict=True))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string())
            labels = ("file", "start", "place", "text")
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=labels)

        for part in batches:
            if not part.num_rows:
                continue
            if part["inside"].null_count:
                raise ValueError("the files or their blocks changed while they were read")
            found = []
            at = [part[c].to_numpy(zero_copy_only=False) for c in ("file", "start")]
            quotes = pc.count_substring(part["line"], '"').to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(at[0]) != 0) | (np.diff(at[1]) != 0)) + 1).tolist(), part.num_rows]
            text, inside = part["line"].to_pylist(), part["inside"]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if key != (here := (int(at[0][a]), int(at[1][a]))):
                    if block:
                        found.extend(rows(block.close(last=True)))
                    key, block = here, _Block(here[1], inside[a].as_py())
                found.extend(rows(block.take(text[a:b], quotes[a:b])))
            if found:
                yield batch(found)
        if block and (found := list(rows(block.close(last=True)))):
            yield batch(found)

    return marked.mapInArrow(run, _PARTS)


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records out of a tail and the heads after it; ``pieces`` has two rows a block at most."""
    running = Window.partitionBy("file").orderBy("start", "place")
    numbered = pieces.withColumn("record", F.count_if(F.col("place") == _TAIL).over(running))
    ordered = F.array_sort(F.collect_list(F.struct("start", "place", "text")))
    joined = F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")
    return numbered.groupBy("file", "record").agg(joined.alias("text")).select("text")


def scan_csv_split(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as ``scan_csv`` reads them, but with large files split over tasks.

    The files are read twice when this is called, once for the quotes and once for the records, which
    are stored in the scratch folder. They must follow the quoting rule of CSV: a field with a quote,
    a comma or a line break is quoted, and quotes in it are doubled. (``scan_csv`` also takes stray
    quotes inside bare fields.) Every file starts with the same header, else an error is raised. A
    gzip file is one block, so one task reads it. Empty lines are no rows. Rows come in no order.
    """
    names = scan_csv(spark, path).columns
    lines = _lines(spark, path)
    parts = materialise(_parts(lines, materialise(_blocks(lines), "csv-blocks"), names), "csv-records")
    cut = parts.filter(F.col("place") != _RECORD)
    records = parts.filter(F.col("place") == _RECORD).select("text").unionByName(_stitched(cut))
    records = records.select(F.regexp_replace("text", "\r$", "").alias("text")).filter("text <> ''")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return records.select(F.from_csv("text", schema, options).alias("row")).select("row.*")

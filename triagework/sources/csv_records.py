"""CSV with line breaks inside quoted cells, read in as many splits as the files' size asks for.

Files are read as lines, in splits. A first pass counts the quotes of every split; added up in the order of the splits,
they tell whether a split begins inside a quoted cell. A second pass goes through each split with that knowledge and puts
lines together to records. Only the pieces of records that cross a border, at most two per split, are shuffled.

A quote inside a cell must be doubled, as in files that spreadsheets write; lines end with a line feed, or a carriage
return and a line feed. The header is the first record of the first file and is left out wherever a file repeats it.
Blank lines between records are passed over. Cells that a record lacks are null, further ones are dropped.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagework.session import settle, store

PIECES = "file string, block long, place long, ends boolean, record string"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block`` (where the split begins) and ``line``, in file order within a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )


def split_parities(lines: DataFrame) -> DataFrame:
    """One row per split: whether it begins inside a quoted cell (``inside``)."""
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    counts = settle(lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def pieces_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a split, and the pieces of those that began before it or end behind it.

    A piece has ``place`` 0 if it goes on from the split before, and else its number; ``ends`` tells whether the record
    ends in it.
    """
    at, held, number, goes_on = None, [], 0, False
    for batch in batches:
        file, block, line, inside = (batch.column(i).to_pylist() for i in range(4))
        out: list[tuple] = []
        for f, b, text, began in zip(file, block, line, inside, strict=True):
            if (f, b) != at:
                if held:
                    out.append((*at, number, False, "\n".join(held)))
                at, held, number, goes_on = (f, b), [], 0 if began else 1, began
            held.append(text)
            goes_on ^= text.count('"') % 2 == 1
            if not goes_on:
                out.append((*at, number, True, "\n".join(held)))
                held, number = [], max(1, number + 1)
        yield as_batch(out)
    if held:
        yield as_batch([(*at, number, False, "\n".join(held))])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "place", "ends", "record"]
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``place`` and ``record`` of all records, header lines too."""
    lines = lines_of(spark, path)
    known = F.broadcast(split_parities(lines))
    marked = lines.join(known, ["file", "block"]).select("file", "block", "line", "inside")
    pieces = store(marked.mapInArrow(pieces_of, PIECES), "csv-pieces")
    whole = pieces.where("ends and place > 0").drop("ends")
    # A piece that goes on belongs to the last record that began, and did not end, before it.
    parts = pieces.where("not ends or place = 0")
    so_far = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    began = F.struct("block", "place")
    owned = parts.withColumn("owner", F.max(F.when(F.col("place") > 0, began)).over(so_far))
    in_order = F.array_sort(F.collect_list(F.struct("block", "place", "record")))
    crossing = (
        owned.groupBy("file", "owner")
        .agg(in_order.alias("parts"))
        .select(
            "file", F.col("owner.block").alias("block"), F.col("owner.place").alias("place"),
            F.array_join("parts.record", "\n").alias("record"),
        )
    )
    # The carriage return before a line's end is no part of a cell.
    joined = whole.unionByName(crossing).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return joined.where("record <> ''")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, under the names of the header."""
    found = store(records(spark, path), "csv-records")
    first = found.orderBy("file", "block", "place").select("record").first()
    if first is None:
        return spark.createDataFrame([], T.StructType([]))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "maxColumns": "20480"}
    width = first["record"].count(",") + 1
    places = ", ".join(f"c{i} string" for i in range(width))
    header = spark.range(1).select(F.from_csv(F.lit(first["record"]), places, options).alias("r")).select("r.*").first()
    names = [n for n in header if n is not None]
    plain = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = found.where(F.col("record") != F.lit(first["record"])).select(F.from_csv("record", plain, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])

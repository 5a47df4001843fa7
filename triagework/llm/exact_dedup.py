"""Exact deduplication by Grace hashing.

Each map task first folds the equal texts it sees in an open-addressing table, so a text that holds a third of all rows
leaves a task a few times only. The folded records are shuffled by content hash. A task that receives more distinct
text than its budget deals the records to spill files by further hash bits, and again, until a file fits a table. Tables
compare complete contents; hashes only tell where to look.

Texts are equal when they are identical after lowering A-Z; a null text is empty. The row with the largest id stays, a
null id is smaller than all others, and of rows with equal ids one stays. No rows give no rows. Other columns travel
unread and may have any name.
"""

import hashlib
import itertools
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from triagework.llm.common import LOWER, read_table, releasing, scratch, text_batches

#: Distinct text that a task keeps in memory, and rows that share a table in a map task.
TABLE_BYTES = 64 << 20
TABLE_ROWS = 200_000
FAN_OUT_BITS = 4
MISSING_ID = -(1 << 63)

FOLDED = pa.schema(
    [
        ("__hash", pa.int64()),
        ("__text", pa.binary()),
        ("__reps", pa.list_(pa.int64())),
        ("__size", pa.int64()),
        ("__id", pa.int64()),
        ("__row", pa.int64()),
    ]
)
FOLDED_DDL = "__hash long, __text binary, __reps array<long>, __size long, __id long, __row long"


def normal(text: bytes | None) -> bytes:
    return b"" if text is None else text.translate(LOWER)


def equal(a: bytes | None, b: bytes | None) -> bool:
    return a == b or normal(a) == normal(b)


class ContentTable:
    """Open addressing with linear probing; an entry is found by its hash and its complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def place(self, hashed: int, text: bytes | None) -> tuple[int, bool]:
        """Number of the entry with this content, and whether it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        at = (hashed ^ (hashed >> 32)) & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == hashed and equal(self.texts[entry], text):
                return entry, False
            at = (at + 1) & mask
        slots[at] = entry = len(self.texts)
        self.hashes.append(hashed)
        self.texts.append(text)
        self.bytes += len(text or b"") + 200
        if 2 * len(self.texts) > len(slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        slots = [-1] * (4 * len(self.slots))
        mask = len(slots) - 1
        for entry, hashed in enumerate(self.hashes):
            at = (hashed ^ (hashed >> 32)) & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry
        self.slots = slots


class Groups(ContentTable):
    """Table whose entries carry the rows they stand for: representatives, size, and the row that stays."""

    def __init__(self) -> None:
        super().__init__()
        self.reps: list[list[int]] = []
        self.sizes: list[int] = []
        self.best: list[tuple[int, int]] = []
        self.carried: list[object] = []

    def add(self, hashed: int, text: bytes | None, reps: list[int], size: int, best: tuple[int, int], carried: object) -> int:
        entry, new = self.place(hashed, text)
        if new:
            self.reps.append(list(reps))
            self.sizes.append(size)
            self.best.append(best)
            self.carried.append(carried)
            return entry
        self.reps[entry] += reps
        self.bytes += 8 * len(reps)
        self.sizes[entry] += size
        if best > self.best[entry]:
            self.best[entry], self.carried[entry], self.texts[entry] = best, carried, text
        return entry

    def records(self, carried: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.texts), 2_000):
            part = slice(at, at + 2_000)
            columns = [
                pa.array(self.hashes[part], pa.int64()),
                pa.array(self.texts[part], pa.binary()),
                pa.array(self.reps[part], pa.list_(pa.int64())),
                pa.array(self.sizes[part], pa.int64()),
                pa.array([b[0] for b in self.best[part]], pa.int64()),
                pa.array([b[1] for b in self.best[part]], pa.int64()),
            ]
            schema = FOLDED
            if carried is not None:
                columns.append(pa.array(self.carried[part], carried))
                schema = schema.append(pa.field("__carried", carried))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def content_hash(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(normal(text)) - (1 << 63)


def grouped(batches: Iterable[pa.RecordBatch], carried: pa.DataType | None, budget: int, level: int = 0) -> Iterator[Groups]:
    """Tables that together hold every record; records of equal content meet in one table.

    Past the budget the table and all further records go to spill files by the next hash bits, file by file.
    """
    table, source = Groups(), iter(batches)
    for batch in source:
        for record in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            table.add(record[0], record[1], record[2], record[3], (record[4], record[5]), record[6] if carried else None)
        if table.bytes > budget and (level + 1) * FAN_OUT_BITS < 64:
            break
    else:
        yield table
        return
    schema = FOLDED if carried is None else FOLDED.append(pa.field("__carried", carried))
    with SpillFiles(1 << FAN_OUT_BITS) as files:
        writers = [pa.ipc.new_stream(f, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) for f in files]
        spilled = table.records(carried)
        for batch in itertools.chain(spilled, source):
            bits = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(level * FAN_OUT_BITS)
            part = bits & np.uint64((1 << FAN_OUT_BITS) - 1)
            for p in np.unique(part):
                writers[int(p)].write_batch(batch.take(pa.array(np.flatnonzero(part == p))))
        del table, spilled
        for writer, file in zip(writers, files, strict=True):
            writer.close()
            file.seek(0)
            yield from grouped(pa.ipc.open_stream(file), carried, budget, level + 1)


class SpillFiles:
    """Nameless spill files of one task, on the disk Spark itself spills to; the system drops them when they close."""

    def __init__(self, n: int) -> None:
        folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.access(d, os.W_OK)]
        self.files = [tempfile.TemporaryFile(dir=folders[i % len(folders)] if folders else None) for i in range(n)]

    def __enter__(self) -> list:
        return self.files

    def __exit__(self, *_: object) -> None:
        for file in self.files:
            file.close()


def folds(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[tuple[Groups, list[int], list[int], list[int]]]:
    """Tables of a map task's rows, each with the entry, row number and id of every row it took in.

    Columns of ``batches``: id, text as binary, and what travels along, if anything.
    """
    base, n = TaskContext.get().partitionId() << 40, 0
    table, entries, rows, ids = Groups(), [], [], []
    for batch in text_batches(batches):
        columns = [c.to_pylist() for c in batch.columns]
        for i, (id_, text) in enumerate(zip(columns[0], columns[1], strict=True)):
            row, id_ = base + n, MISSING_ID if id_ is None else id_
            n += 1
            carried = columns[2][i] if len(columns) > 2 else None
            entries.append(table.add(content_hash(text), text, [row], 1, (id_, row), carried))
            rows.append(row)
            ids.append(id_)
        if table.bytes > budget or len(rows) > TABLE_ROWS:
            yield table, entries, rows, ids
            table, entries, rows, ids = Groups(), [], [], []
    if rows:
        yield table, entries, rows, ids


def _prepared(docs: DataFrame, id_column: str, text_column: str) -> list:
    return [
        F.col(id_column).cast("long").alias("__id"),
        F.col(text_column).cast("binary").alias("__text"),
    ]


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """A row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the lowered text.

    Rows are first written with the number of their representative, the first equal row of their map task; only
    representatives carry a text into the shuffle, and what their group turns out to be is joined back by that number.
    """

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, entries, rows, ids in folds(batches, budget):
            firsts = [reps[0] for reps in table.reps]
            table.reps = [[first] for first in firsts]
            yield from (_padded(b) for b in table.records(None))
            for at in range(0, len(rows), 50_000):
                part = slice(at, at + 50_000)
                yield _padded(None, [firsts[e] for e in entries[part]], rows[part], ids[part])

    def settle_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, None, budget):
            for at in range(0, len(table.texts), 2_000):
                out: list[tuple] = []
                for e in range(at, min(at + 2_000, len(table.texts))):
                    sha = hashlib.sha256(normal(table.texts[e])).hexdigest()
                    id_, row = table.best[e]
                    out += [(rep, id_, row, table.sizes[e], sha) for rep in table.reps[e]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.string()], strict=True)],
                    ["__rep", "__keep", "__keep_row", "__n", "__sha"],
                )

    kept_id = lambda c: F.when(F.col(c) != MISSING_ID, F.col(c))
    folded = scratch(
        docs.select(*_prepared(docs, id_column, text_column)).mapInArrow(
            releasing(fold), f"{FOLDED_DDL}, __member long, __own long, __own_id long"
        ),
        "exact",
    )
    records = folded.where("__hash is not null").select(*FOLDED.names)
    groups = records.repartition("__hash").mapInArrow(
        releasing(settle_groups), "__rep long, __keep long, __keep_row long, __n long, __sha string"
    )
    members = folded.where("__member is not null").select("__member", "__own", "__own_id")
    return members.join(groups, F.col("__member") == F.col("__rep")).select(
        kept_id("__own_id").alias(id_column),
        kept_id("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__own") == F.col("__keep_row")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def _padded(records: pa.RecordBatch | None, members: list | None = None, rows: list | None = None, ids: list | None = None):
    """Folded records, or rows with their representative, in the columns of both."""
    if records is not None:
        columns = [*records.columns, *[pa.nulls(records.num_rows, pa.int64())] * 3]
    else:
        columns = [*[pa.nulls(len(rows), f.type) for f in FOLDED], *[pa.array(c, pa.int64()) for c in (members, rows, ids)]]
    return pa.RecordBatch.from_arrays(columns, [*FOLDED.names, "__member", "__own", "__own_id"])


def drop_exact_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", budget: int = TABLE_BYTES
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    others = [f for f in docs.schema.fields if f.name not in (id_column, text_column)]
    carried_field = F.struct(*[docs[f"`{f.name}`"].alias(f"c{i}") for i, f in enumerate(others)])
    chosen = docs.select(*_prepared(docs, id_column, text_column), *([carried_field.alias("__carried")] if others else []))
    kind = to_arrow_type(chosen.schema["__carried"].dataType) if others else None
    more = f", __carried {chosen.schema['__carried'].dataType.simpleString()}" if others else ""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, _, _ in folds(batches, budget):
            table.reps = [[] for _ in table.reps]
            yield from table.records(kind)

    def settle_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, kind, budget):
            for records in table.records(kind):
                yield records.select(["__id", "__text", *(["__carried"] if kind else [])])

    kept = (
        chosen.mapInArrow(releasing(fold), FOLDED_DDL + more)
        .repartition("__hash")
        .mapInArrow(releasing(settle_groups), "__id long, __text binary" + more)
    )
    place = {f.name: f"__carried.c{i}" for i, f in enumerate(others)}
    id_value = F.when(F.col("__id") != MISSING_ID, F.col("__id"))
    return kept.select(
        *[
            id_value.cast(f.dataType).alias(f.name)
            if f.name == id_column
            else F.col("__text").cast(f.dataType).alias(f.name)
            if f.name == text_column
            else F.col(place[f.name]).alias(f.name)
            for f in docs.schema.fields
        ]
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP7_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
  from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from d
"""

"""Linear support vector machines with the squared hinge loss, all classes in one pass over the rows.

A class's machine minimises half the squared length of its weights plus the sum of ``cost`` times the squared hinge of its
rows; the last weight is that of a constant feature 1, so it is held down like the others. Newton steps are solved by
conjugate gradients. A step of either kind needs one pass: every block of rows adds up gradients, or products with the
Hessian, of all classes, and blocks are added by range of weights. Line searches try all step lengths in one pass. What
reaches the driver, and goes back to the tasks, are weights: classes times features.

Data of a single block need no exchange: the same steps run in one task. More data are dealt to the tasks of a barrier stage,
which keep their rows (many entries in files of their own, mapped into memory), tell each other their sums and all come to
the same weights. Where executors come and go, which barrier stages do not allow, every pass is a Spark job instead.
"""

import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagework.models.boosting import packed, sparse_parts, unpacked
from triagework.models.stages import with_label
from triagework.models.together import Together, message_folder, task_slots
from triagework.session import store

BLOCK_ROWS = 16_384
BLOCK_ENTRIES = 4_000_000
WEIGHT_RANGES = 8
#: Entries that a task keeps in memory; with more of them all lie in files.
HELD_ENTRIES = 16_000_000
#: Entries multiplied at once.
ENTRIES_AT_ONCE = 1 << 16
STEP_LENGTHS = 0.5 ** np.arange(20)


def runs(ends: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of groups that end at these entries, and of their entries, of bounded size."""
    at = 0
    while at < len(ends):
        start = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, start + ENTRIES_AT_ONCE, side="right")))
        yield slice(at, end), slice(start, int(ends[end - 1]))
        at = end


def group_sums(ends: np.ndarray, places: np.ndarray, values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Per group of entries, the sum of the entries' values times the rows of ``factors`` at their places.

    Columns are added up one by one; those of zeros only cost nothing.
    """
    out = np.zeros((len(ends), factors.shape[1]))
    columns = [(c, np.ascontiguousarray(factors[:, c])) for c in np.flatnonzero(factors.any(axis=0)).tolist()]
    for groups, entries in runs(ends) if columns else ():
        stops = ends[groups] - entries.start
        starts = np.concatenate([[0], stops[:-1]])
        some = np.flatnonzero(stops > starts)
        if len(some):
            own, starts, to = values[entries], starts.take(some), some + groups.start
            at = places[entries]
            for c, column in columns:
                out[to, c] = np.add.reduceat(column.take(at) * own, starts)
    return out


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in a nameless file of the task's own disk, mapped into memory."""
    if not len(array):
        return array
    with tempfile.TemporaryFile() as file:
        array.tofile(file)
        file.flush()
        return np.memmap(file, array.dtype, "r+", shape=array.shape)


class Rows:
    """Sparse rows: labels, where each row ends, and features and values of all entries; also feature by feature."""

    def __init__(self, labels: np.ndarray, ends: np.ndarray, features: np.ndarray, values: np.ndarray) -> None:
        self.labels, self.ends, self.features, self.values = labels, ends, features, values
        self.by_feature: tuple[np.ndarray, ...] | None = None
        self.keep: Callable[[np.ndarray], np.ndarray] = lambda array: array
        self.last: tuple[np.ndarray, np.ndarray] | None = None

    def payload(self) -> bytes:
        return packed(labels=self.labels, ends=self.ends, features=self.features, values=self.values)

    def to_files(self) -> None:
        """Keep the entries in files from now on."""
        self.keep = mapped
        self.features, self.values = mapped(self.features), mapped(self.values)
        if self.by_feature is not None:
            self.by_feature = self.by_feature[0], *map(mapped, self.by_feature[1:])

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Products of all rows with the columns of ``weights``, whose last row belongs to the constant feature."""
        return group_sums(self.ends, self.features, self.values, weights) + weights[-1]

    def times_again(self, weights: np.ndarray) -> np.ndarray:
        """The same, remembered for the weights of the last call."""
        if self.last is None or not np.array_equal(self.last[0], weights):
            self.last = weights.copy(), self.times(weights)
        return self.last[1]

    def added(self, factors: np.ndarray, width: int) -> np.ndarray:
        """Sums of the rows times the columns of ``factors``."""
        if self.by_feature is None:
            order = np.argsort(self.features, kind="stable")
            row = np.repeat(np.arange(len(self.labels), dtype=np.int32), np.diff(np.concatenate([[0], self.ends])))
            ends = np.cumsum(np.bincount(self.features, minlength=width))
            self.by_feature = ends, self.keep(row[order]), self.keep(self.values[order])
        return np.vstack([group_sums(*self.by_feature, factors), factors.sum(axis=0)])


@dataclass
class Problem:
    """Costs of each class's own rows and of the others, and the number of features."""

    own_costs: np.ndarray
    other_cost: float
    width: int

    def state(self, rows: Rows, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signs, costs, and how far each row is inside the margin of each class's machine."""
        own = rows.labels[:, None] == np.arange(len(self.own_costs))
        signs, costs = np.where(own, 1.0, -1.0), np.where(own, self.own_costs, self.other_cost)
        return signs, costs, np.maximum(1 - signs * rows.times_again(weights), 0)

    def gradient(self, rows: Rows, weights: np.ndarray) -> np.ndarray:
        """Of the losses; the loss itself is the last row."""
        signs, costs, short = self.state(rows, weights)
        return np.vstack([rows.added(-2 * costs * signs * short, self.width), (costs * short**2).sum(axis=0)])

    def curved(self, rows: Rows, both: np.ndarray) -> np.ndarray:
        """Product of the losses' Hessian at some weights with a direction per class."""
        weights, direction = np.split(both, 2, axis=1)
        _, costs, short = self.state(rows, weights)
        return rows.added(2 * costs * (short > 0) * rows.times(direction), self.width)

    def along(self, rows: Rows, both: np.ndarray) -> np.ndarray:
        """Losses per step length and class."""
        weights, direction = np.split(both, 2, axis=1)
        signs, costs, _ = self.state(rows, weights)
        at, move = rows.times_again(weights), rows.times(direction)
        return np.stack([(costs * np.maximum(1 - signs * (at + s * move), 0) ** 2).sum(axis=0) for s in STEP_LENGTHS])


Add = Callable[[str, np.ndarray], np.ndarray]


def minimise(add: Add, shape: tuple[int, int], tolerance: float, iterations: int) -> tuple[np.ndarray, int]:
    """Weights per class, and the passes over the rows they took.

    ``add`` gives the sums of a method of ``Problem`` over all rows. Ends when no class's gradient is longer than
    ``tolerance`` times that at 0, or no step lowers the loss any more.
    """
    passes = 0

    def total(name: str, *arrays: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return add(name, np.hstack(arrays))

    weights = np.zeros(shape)
    found = total("gradient", weights)
    gradient, loss = found[:-1], found[-1]
    first = np.sqrt((gradient**2).sum(axis=0))
    for _ in range(iterations):
        length = np.sqrt((gradient**2).sum(axis=0))
        open_ = length > tolerance * first
        if not open_.any():
            break
        # Conjugate gradients for all classes side by side; closer ones end earlier.
        goal = length * np.minimum(0.1, np.sqrt(length / np.maximum(first, 1e-300)))
        direction, rest = np.zeros(shape), np.where(open_, -gradient, 0)
        search, square = rest.copy(), (rest**2).sum(axis=0)
        for _ in range(min(200, shape[0])):
            going = np.sqrt(square) > goal
            if not (going & open_).any():
                break
            # Classes that are there already are not multiplied again.
            moving = np.where(going & open_, search, 0)
            curved = moving + total("curved", weights, moving)
            step = np.where(going & open_, square / np.maximum((moving * curved).sum(axis=0), 1e-300), 0)
            direction += step * search
            rest -= step * curved
            after = (rest**2).sum(axis=0)
            search = np.where(going, rest + after / np.maximum(square, 1e-300) * search, search)
            square = after
        slope = (gradient * direction).sum(axis=0)
        lengths = STEP_LENGTHS[:, None]
        losses = total("along", weights, direction)
        lengths_of = ((weights[None] + lengths[:, :, None] * direction) ** 2).sum(axis=1) / 2
        before = (weights**2).sum(axis=0) / 2 + loss
        fits = losses + lengths_of <= before + 1e-4 * lengths * slope
        chosen = np.where(fits.any(axis=0) & open_, STEP_LENGTHS[fits.argmax(axis=0)], 0)
        if not chosen.any():
            break
        weights = weights + chosen * direction
        found = total("gradient", weights)
        gradient, loss = found[:-1] + weights, found[-1]
    return weights, passes


def labelled_rows(features: DataFrame, label: Column, column: str = "features") -> tuple[DataFrame, int]:
    """Labels, places and values of the rows that have a label, and how many blocks they make."""
    places, values = sparse_parts(column)
    chosen = features.select(label.cast("int").alias("label"), places.alias("places"), values.alias("values"))
    chosen = chosen.where("label is not null")
    count, entries = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    return chosen, max(-(-count // BLOCK_ROWS), -(-entries // BLOCK_ENTRIES))


def blocks_in(batches: Iterable[pa.RecordBatch], limited: bool) -> Iterator[Rows]:
    """Blocks of labelled rows, of bounded size if ``limited``."""
    held: list[tuple[np.ndarray, ...]] = []

    def block() -> Rows:
        labels, lengths, features, values = (np.concatenate(p) for p in zip(*held, strict=True))
        held.clear()
        return Rows(labels, np.cumsum(lengths), features.astype(np.int32), values)

    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2)]
        full = sum(len(h[2]) for h in held) + len(flat[0]) > 2 * BLOCK_ENTRIES
        if held and limited and (full or sum(len(h[0]) for h in held) + len(lengths) > 2 * BLOCK_ROWS):
            yield block()
        held.append((batch.column(0).to_numpy(), lengths, *flat))
    if held:
        yield block()


def to_rows(chosen: DataFrame, parts: int) -> DataFrame:
    """Labelled rows as a stored table of ``parts`` blocks or more, of bounded size."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in blocks_in(batches, parts > 1):
            yield pa.RecordBatch.from_pydict({"payload": pa.array([made.payload()], pa.binary())})

    dealt = chosen.coalesce(1) if parts == 1 else chosen.repartition(parts)
    return store(dealt.mapInArrow(pack, "payload binary"), "svm-rows")


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for payload in batch.column(0):
            yield Rows(**unpacked(payload.as_py()))


def added_by_range(blocks: DataFrame, problem: Problem, name: str, weights: np.ndarray) -> np.ndarray:
    """Sums over all blocks of a method of ``problem``; blocks send their sums by range of rows of the result."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for rows in rows_of(batches):
            own = getattr(problem, name)(rows, weights)
            sums = own if sums is None else sums + own
        if sums is not None:
            parts = np.array_split(sums, WEIGHT_RANGES)
            yield pa.RecordBatch.from_pylist([{"part": i, "payload": packed(sums=p)} for i, p in enumerate(parts)])

    def join(table: pa.Table) -> pa.Table:
        total = sum(unpacked(p.as_py())["sums"] for p in table["payload"])
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int64()), "payload": [packed(sums=total)]})

    kind = "part long, payload binary"
    found = blocks.mapInArrow(add, kind).groupBy("part").applyInArrow(join, kind).collect()
    return np.concatenate([unpacked(bytes(r["payload"]))["sums"] for r in sorted(found, key=lambda r: r["part"])])


def solved_together(
    chosen: DataFrame, problem: Problem, shape: tuple[int, int], tolerance: float, iterations: int, tasks: int
) -> DataFrame:
    """The weights, as one stored row: tasks side by side keep the rows and add their sums up in the tasks' order."""
    folder = message_folder(chosen.sparkSession)

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        for rows in blocks_in(batches, True):
            held.append(rows)
            if sum(len(r.values) for r in held) > HELD_ENTRIES:
                for r in held:
                    if r.keep is not mapped:
                        r.to_files()
        others = Together(folder)

        def add(name: str, weights: np.ndarray) -> np.ndarray:
            own = b""
            if held:
                total = getattr(problem, name)(held[0], weights)
                for r in held[1:]:
                    total += getattr(problem, name)(r, weights)
                own = total.tobytes()
            told = [np.frombuffer(t).reshape(-1, shape[1]) for t in others.tell(own) if t]
            return sum(told[1:], told[0])

        weights, _ = minimise(add, shape, tolerance, iterations)
        if not others.own:
            yield pa.RecordBatch.from_pydict({"payload": pa.array([packed(weights=weights)], pa.binary())})

    return store(chosen.repartition(tasks).mapInArrow(solve, "payload binary", barrier=True), "svm-weights")


def fit_machines(
    features: DataFrame, label: Column, own_costs: list[float], width: int, other_cost: float = 1.0,
    tolerance: float = 1e-4, iterations: int = 100,
) -> np.ndarray:
    """Weights per feature (the constant one last) and class. No rows give weights of 0."""
    chosen, parts = labelled_rows(features, label)
    problem, shape = Problem(np.array(own_costs), other_cost, width), (width + 1, len(own_costs))
    if not parts:
        return np.zeros(shape)
    tasks = task_slots(features.sparkSession)
    if parts > 1 and tasks:
        found = solved_together(chosen, problem, shape, tolerance, iterations, tasks)
        return unpacked(bytes(found.first()["payload"]))["weights"]
    blocks = to_rows(chosen, parts)
    if parts > 1:
        spread = store(blocks.repartition(blocks.count()), "svm-blocks")
        return minimise(lambda name, w: added_by_range(spread, problem, name, w), shape, tolerance, iterations)[0]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            weights, _ = minimise(lambda name, w: getattr(problem, name)(rows, w), shape, tolerance, iterations)
            yield pa.RecordBatch.from_pydict({"payload": pa.array([packed(weights=weights)], pa.binary())})

    return unpacked(bytes(blocks.mapInArrow(solve, "payload binary").first()["payload"]))["weights"]


class LinearScores(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Margins of one linear machine per class as an array ``outputCol``, with ``prediction`` and ``predicted_label``."""

    labels = Param(Params._dummy(), "labels", "class labels", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "feature by feature, the constant one last", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str | None = None,
        outputCol: str | None = None,
        labels: list[str] | None = None,
        weights: list[float] | None = None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        labels = self.getOrDefault(self.labels)
        weights = np.array(self.getOrDefault(self.weights)).reshape(-1, len(labels))

        @F.arrow_udf("array<double>")
        def margins(places: pa.Array, values: pa.Array) -> pa.Array:
            lengths = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = [a.flatten().to_numpy(zero_copy_only=False) for a in (places, values)]
            rows = Rows(np.zeros(len(places), np.int32), np.cumsum(lengths), *flat)
            ends = pa.array(np.arange(len(places) + 1) * len(labels), pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(rows.times(weights).ravel()))

        name = self.getOutputCol()
        scored = dataset.withColumn(name, margins(*sparse_parts(self.getInputCol())))
        best = F.array_position(F.col(name), F.array_max(name)) - 1
        return with_label(scored.withColumn("prediction", best.cast("double")), labels)

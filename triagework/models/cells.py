"""A random forest over rows that fall into few different cells.

Rows with equal features are one cell. Each row gets a Poisson weight per tree from the hash of its key, in one pass; what
is kept is the weight, the weighted sum and the weighted sum of squares per (tree, cell), added before the shuffle. All
trees are grown from that table, every tree by a task of its own.

A split sends one value of a category to the left and all others to the right, as one-hot features do; the best one
lowers the squared error most, equal ones go by the category, then the value. A side needs ``min_rows`` rows. Hours are
added as whole thousandths, so neither the order of rows nor a retried task changes a tree.

The forest has at most 2^(depth+1) nodes a tree, and its cells are as many as the categories' values multiply to; both
are parts of the model.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagework.models.boosting import mixed

SCALE = 1000
#: Rows whose weights are held at once, for all trees.
ROWS_AT_ONCE = 4_096


def poisson_limits() -> np.ndarray:
    """Shares of 1 below which Poisson draws with mean 1 are 0, at most 1, at most 2, and so on."""
    parts = [math.exp(-1) / math.factorial(n) for n in range(20)]
    return np.cumsum(parts)


def drawn_weights(keys: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Weights of rows (by their keys' hashes) in all trees."""
    limits = poisson_limits()
    return np.stack([np.searchsorted(limits, mixed(keys, seed, t), side="right") for t in range(trees)], axis=1)


def cell_number(columns: list[str], categories: list[list[str]]) -> Column:
    """Number of a row's cell; the last value of each category stands for all that are not listed."""
    place = F.lit(0)
    for column, values in zip(columns, categories, strict=True):
        seen = F.array_position(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.col(column).cast("string"))
        place = place * F.lit(len(values) + 1) + F.when(seen > 0, seen - 1).otherwise(F.lit(len(values)))
    return place.cast("long")


def cell_sums(rows: DataFrame, key: str, cell: Column, target: str, trees: int, seed: int) -> DataFrame:
    """Weight, sum and sum of squares per (tree, cell): every task adds up its own rows first."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                keys, cells, y = (c.to_numpy() for c in batch.slice(at, ROWS_AT_ONCE).columns)
                order = np.argsort(cells, kind="stable")
                cells, y = cells[order], y[order, None]
                weights = drawn_weights(keys[order], trees, seed)
                edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                sums = np.stack([np.add.reduceat(v, edges) for v in (weights, weights * y, weights * y * y)], axis=2)
                for c, s in zip(cells[edges].tolist(), sums, strict=True):
                    held[c] = held[c] + s if c in held else s
        for c, s in held.items():
            columns = [pa.array(np.arange(trees)), pa.array(np.full(trees, c)), *[pa.array(s[:, i]) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "cell", "n", "total", "squares"])

    whole = F.round(F.col(target) * SCALE).cast("long")
    part = rows.select(F.xxhash64(key), cell, whole).mapInArrow(add, "tree long, cell long, n long, total long, squares long")
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in ("n", "total", "squares")]
    return part.groupBy("tree", "cell").agg(*sums)


def grow_tree(cells: np.ndarray, sums: np.ndarray, values: list[int], depth: int, min_rows: int) -> list[tuple]:
    """Nodes of a tree over cells (value numbers) with sums: category, value, left, right, mean; leaves have category -1."""
    nodes: list[tuple] = []

    def error(s: np.ndarray) -> np.ndarray:
        return s[..., 2] - s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)

    def grow(at: np.ndarray, left: int) -> int:
        own = len(nodes)
        nodes.append(())
        whole = sums[at].sum(axis=0)
        best = None
        if left:
            for column, count in enumerate(values):
                sides = np.zeros((count, 3))
                np.add.at(sides, cells[at, column], sums[at])
                others = whole - sides
                gain = error(whole) - error(sides) - error(others)
                gain[(sides[:, 0] < min_rows) | (others[:, 0] < min_rows)] = -np.inf
                top = int(gain.argmax()) if count else 0
                # Sums are whole thousandths: less than one of them is rounding.
                if count and gain[top] > max(1.0, 1e-9 * abs(whole[2])) and (best is None or gain[top] > best[0]):
                    best = gain[top], column, top
        mean = whole[1] / whole[0] / SCALE if whole[0] else 0.0
        if best is None:
            nodes[own] = (-1, 0, 0, 0, mean)
            return own
        here = cells[at, best[1]] == best[2]
        below = grow(at[here], left - 1), grow(at[~here], left - 1)
        nodes[own] = (best[1], best[2], *below, mean)
        return own

    grow(np.arange(len(cells)), depth)
    return nodes


def fit_cell_forest(
    rows: DataFrame, key: str, columns: list[str], target: str, trees: int = 300, depth: int = 12, min_rows: int = 5,
    seed: int = 42,
) -> "CellForest":
    """Fit on complete rows. No rows give a forest that predicts 0."""
    numbered = [
        sorted(r[0] for r in rows.select(F.col(c).cast("string")).distinct().collect()) for c in columns
    ]
    sizes = [len(v) for v in numbered]
    sums = cell_sums(rows, key, cell_number(columns, numbered), target, trees, seed)

    def grown(table: pa.Table) -> pa.Table:
        place = table["cell"].to_numpy()
        order = np.argsort(place)
        cells = np.stack(np.unravel_index(place[order], [n + 1 for n in sizes]), axis=1)
        numbers = np.stack([table[c].to_numpy() for c in ("n", "total", "squares")], axis=1)
        nodes = grow_tree(cells, numbers[order], sizes, depth, min_rows)
        parts = list(zip(*nodes, strict=True))
        names = ["category", "value", "left", "right"]
        plain = [pa.array(parts[i], pa.int64()) for i in range(4)]
        tree = pa.array([table["tree"][0].as_py()] * len(nodes), pa.int64())
        return pa.table([tree, pa.array(range(len(nodes)), pa.int64()), *plain, pa.array(parts[4], pa.float64())],
                        names=["tree", "node", *names, "mean"])

    found = (
        sums.groupBy("tree")
        .applyInArrow(grown, "tree long, node long, category long, value long, left long, right long, mean double")
        .toArrow()
        .sort_by([("tree", "ascending"), ("node", "ascending")])
    )
    ends = np.flatnonzero(found["node"].to_numpy() == 0)
    return CellForest(
        inputCols=columns,
        outputCol="predicted_raw",
        categories=numbered,
        starts=[*ends.tolist(), found.num_rows],
        nodes=[found[c].to_pylist() for c in ("category", "value", "left", "right")],
        means=found["mean"].to_pylist(),
    )


class CellForest(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the trees' values. Every cell's prediction is worked out once and looked up by the row's values.

    A value that training did not see equals no value, so it goes to the right at every split on its category.
    """

    categories = Param(Params._dummy(), "categories", "values of each column", TypeConverters.toList)
    starts = Param(Params._dummy(), "starts", "first node of every tree, and the end", TypeConverters.toListInt)
    nodes = Param(Params._dummy(), "nodes", "category, value, left and right of every node", TypeConverters.toList)
    means = Param(Params._dummy(), "means", "mean of every node", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCols: list[str] | None = None,
        outputCol: str | None = None,
        categories: list[list[str]] | None = None,
        starts: list[int] | None = None,
        nodes: list[list[int]] | None = None,
        means: list[float] | None = None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def predictions(self) -> np.ndarray:
        """Predictions of all cells; the last value of each axis stands for values not seen."""
        shape = [len(v) + 1 for v in self.getOrDefault(self.categories)]
        cells = np.indices(shape).reshape(len(shape), -1)
        category, value, left, right = (np.array(v, np.int64) for v in self.getOrDefault(self.nodes))
        means, starts = np.array(self.getOrDefault(self.means)), self.getOrDefault(self.starts)
        total = np.zeros(cells.shape[1])
        for start in starts[:-1]:
            node = np.zeros(cells.shape[1], np.int64)
            while (inner := category[start + node] >= 0).any():
                here = start + node[inner]
                hit = cells[category[here], np.flatnonzero(inner)] == value[here]
                node[inner] = np.where(hit, left[here], right[here])
            total += means[start + node]
        return (total / max(1, len(starts) - 1)).reshape(shape)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = self.predictions()
        place = cell_number(self.getInputCols(), self.getOrDefault(self.categories))
        table = F.split(F.lit(",".join(map(repr, found.ravel().tolist()))), ",").cast("array<double>")
        return dataset.withColumn(self.getOutputCol(), F.get(table, place.cast("int")))

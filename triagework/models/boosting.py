"""Second-order boosting of all classes at once on a soft-max loss.

Rows are binned once (per feature, at quantiles of its values other than 0) and kept as blocks of sparse codes with their
scores. A round fits one tree per class to the gradients and Hessians of the same scores. A level of all trees of a round
is one aggregation: every block sums gradients and Hessians per (class, node, feature bin), the sums are added per range
of features, each range offers its best split per node, and the driver takes the best of those. So what is shuffled and
collected grows with bins and nodes, not with rows. Sums are whole numbers (gradients times 2^20), so the trees do not
depend on how rows are dealt to blocks, and a retried task repeats them.

A value of 0 is absent: each split learns where absent values go. Rows are sampled per round by the hash of their key,
features per tree by a hash of their number.

Data that fit one block (``BLOCK_ROWS``, ``BLOCK_ENTRIES``) need no exchange: the same steps of many rounds run in one task.
More data are dealt by feature to tasks of a barrier stage that grow ``CHUNK`` rounds side by side: each holds all entries
of its features and the labels and scores of all rows (a few dozen bytes a row). The tasks tell each other their best
splits and which rows those send to the other side, so nothing as large as the bins is exchanged. Where executors come and
go, which barrier stages do not allow, a level is a Spark job as described above.

After every ``CHUNK`` rounds, or up to four times as many quick ones, scores and trees are written. Training stops while
it runs: once the loss of the rows that are only watched has not fallen for ``patience`` rounds, no further round is
started. Given a folder, a training whose session was lost goes on after its last complete chunk.

Rows without a label are left out. No rows, or one class only, give a model without trees, whose classes are equally
likely.
"""

import io
import json
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.models.stages import with_label
from triagework.models.together import Together, message_folder, task_slots
from triagework.session import new_output_dir
from triagework.sources.tickets import path_exists

BLOCK_ROWS = 16_384
BLOCK_ENTRIES = 4_000_000
CHUNK = 25
#: A chunk that ran in less time is followed by one of twice the rounds, up to so many times the first one's.
QUICK_SECONDS = 30
MOST_CHUNKS = 4
FEATURE_RANGES = 16
#: Parts of the features per task, so that tasks come to hold about equally many entries.
PARTS_PER_TASK = 16
PARALLEL_TREES = 4
SCALE = float(1 << 20)
LEAST_GAIN = 1e-6
#: Entries added up, and sums compared, at once.
ENTRIES_AT_ONCE = 1 << 17
SUMS_AT_ONCE = 1 << 15

STATE = "kind string, number long, payload binary, loss double"


@dataclass(frozen=True)
class BoostSettings:
    """Size and pace of training; without ``patience`` all rounds run."""

    rounds: int = 300
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    min_hessian: float = 3.0
    l2: float = 1.0
    bins: int = 256
    seed: int = 42
    patience: int | None = None


@dataclass
class Layout:
    """Upper values of every feature's bins but its last; a code numbers the bins of all features one after the other."""

    cuts: np.ndarray
    cut_ends: np.ndarray
    offsets: np.ndarray = field(init=False)
    feature_of: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        bins = np.diff(self.cut_ends) + 1
        self.offsets = np.concatenate([[0], np.cumsum(bins)])
        self.feature_of = np.repeat(np.arange(len(bins), dtype=np.int32), bins)

    @property
    def features(self) -> int:
        return len(self.offsets) - 1

    @property
    def codes(self) -> int:
        return int(self.offsets[-1])

    def code(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Codes of values: the first bin whose upper value is not below."""
        low, high = self.cut_ends[feature], self.cut_ends[feature + 1]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            above = open_ & (self.cuts[np.minimum(middle, len(self.cuts) - 1)] < value)
            low, high = np.where(above, middle + 1, low), np.where(open_ & ~above, middle, high)
        return self.offsets[feature] + low - self.cut_ends[feature]

    def upper_value(self, feature: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Values up to this one go left; below the first bin none does."""
        place = self.cut_ends[feature] + code - self.offsets[feature]
        values = np.append(self.cuts, np.inf)
        inside = place < self.cut_ends[feature + 1]
        found = np.where(inside, values[np.clip(place, 0, len(self.cuts))], np.inf)
        return np.where(code < self.offsets[feature], -np.inf, found)


@dataclass
class Tree:
    """Nodes of a complete binary tree, children of i at 2i + 1 and 2i + 2; a leaf has feature -1."""

    feature: np.ndarray
    code: np.ndarray
    absent_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        size = (2 << depth) - 1
        return Tree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(payload: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(payload)))


def mixed(values: np.ndarray, *salts: int) -> np.ndarray:
    """Hashes of whole numbers, as shares of 1."""
    x = values.astype(np.uint64)
    for salt in salts:
        x = (x ^ np.uint64(salt)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x.astype(np.float64) / 2.0**64


class Block:
    """Binned rows and their scores. Entries lie in the order of their codes."""

    def __init__(self, keys, labels, uses, entry_row, entry_code, scores) -> None:
        self.keys, self.labels, self.uses, self.scores = keys, labels, uses, scores
        self.entry_row, self.entry_code = entry_row, entry_code

    @staticmethod
    def from_rows(keys, labels, uses, rows, codes, classes: int) -> "Block":
        order = np.argsort(codes, kind="stable")
        scores = np.zeros((len(keys), classes))
        return Block(keys, labels, uses, rows[order].astype(np.int32), codes[order].astype(np.int32), scores)

    def payload(self) -> bytes:
        return packed(**vars(self))

    def probabilities(self) -> np.ndarray:
        powers = np.exp(self.scores - self.scores.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    def loss(self) -> tuple[float, int]:
        """Sum of the log losses of the watched rows, and their number."""
        watched = np.flatnonzero(self.uses & 2)
        shares = self.probabilities()[watched, self.labels[watched]]
        return float(-np.log(np.maximum(shares, 1e-15)).sum()), len(watched)


class Round:
    """A block during one round: gradients, the rows and features drawn, and the node of every row in every tree."""

    def __init__(self, block: Block, layout: Layout, settings: BoostSettings, number: int, learning: bool = True) -> None:
        self.block, self.layout, self.settings = block, layout, settings
        classes = block.scores.shape[1]
        shares = block.probabilities()
        hit = np.zeros_like(shares)
        hit[np.arange(len(block.labels)), block.labels] = 1
        # Gradients and Hessians as one number each, so that both are looked up and added at once.
        pairs = np.rint((shares - hit) * SCALE) + 1j * np.rint(np.maximum(2 * shares * (1 - shares), 1e-6) * SCALE)
        self.pairs = np.ascontiguousarray(pairs.T)
        drawn = (block.uses & 1 == 1) & (mixed(block.keys, settings.seed, number) < settings.row_share)
        # Entries lie by code, so those of a feature lie together.
        self.starts = np.searchsorted(block.entry_code, layout.offsets)
        counts = np.diff(self.starts)
        self.nodes = [np.zeros(len(block.keys), np.int32) for _ in range(classes)]
        self.drawn = drawn
        self.entries = []
        for c in range(classes if learning else 0):
            usable = np.repeat(drawn_features(layout, settings, number, c), counts)
            usable &= drawn[block.entry_row]
            self.entries.append((block.entry_row[usable], block.entry_code[usable]))

    def totals(self, c: int, level: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Places of the drawn rows among the nodes of the level, those that have one, and sums of whole nodes."""
        first, width = (1 << level) - 1, 1 << level
        node = self.nodes[c] - first
        node[(node < 0) | ~self.drawn] = -1
        at = np.flatnonzero(node >= 0)
        own, pairs = node.take(at), self.pairs[c].take(at)
        return node, at, [np.bincount(own, v, width) for v in (pairs.real, pairs.imag)]

    def sums(self, c: int, level: int) -> tuple[np.ndarray, ...]:
        """Sums per (node, code) as keys, gradients and Hessians, and those of whole nodes of the level."""
        pairs = self.pairs[c]
        node, at, totals = self.totals(c, level)
        rows, codes = self.entries[c]
        own = node[rows].astype(np.int16)
        # Entries lie by (node, code) of the level above; dealing them to the children keeps their codes in order.
        if level or (node[at] < 0).any():
            order = np.argsort(own, kind="stable")
            order = order[np.searchsorted(own[order], 0) :]
            rows, codes, own = rows[order], codes[order], own[order]
        self.entries[c] = rows, codes
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), *totals
        keys = own.astype(np.int64) * self.layout.codes + codes
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        added = np.add.reduceat(pairs[rows], edges)
        return keys[edges], added.real, added.imag, *totals

    def advance(self, c: int, tree: Tree, level: int) -> None:
        """Move every row to the child that the level's splits send it to."""
        self.move(c, tree, self.lefts(c, tree, level))

    def lefts(self, c: int, tree: Tree, level: int) -> np.ndarray:
        """Whether the level's splits send a row to the left, going by the entries of the block."""
        node = self.nodes[c]
        left = tree.absent_left.take(node)
        first = (1 << level) - 1
        inner = first + np.flatnonzero(tree.feature[first : 2 * first + 1] >= 0)
        # Nodes that are split by the same feature share one pass over its entries.
        for feature in np.unique(tree.feature[inner]).tolist():
            entries = slice(self.starts[feature], self.starts[feature + 1])
            rows = self.block.entry_row[entries]
            own = np.zeros(len(tree.feature), bool)
            own[inner] = tree.feature[inner] == feature
            here = np.flatnonzero(own.take(node.take(rows)))
            rows = rows.take(here)
            left[rows] = self.block.entry_code[entries].take(here) <= tree.code.take(node.take(rows))
        return left

    def move(self, c: int, tree: Tree, left: np.ndarray) -> None:
        node = self.nodes[c]
        self.nodes[c] = np.where((tree.feature >= 0).take(node), 2 * node + 2 - left, node)

    def finish(self, trees: list[Tree]) -> None:
        for c, tree in enumerate(trees):
            self.block.scores[:, c] += tree.value.take(self.nodes[c])


@dataclass
class NodeSums:
    """Sums of the nodes of a level per (node, code), by node, then code, and where each node that has some begins."""

    codes: np.ndarray
    gradients: np.ndarray
    hessians: np.ndarray
    nodes: list[int]
    starts: list[int]

    @staticmethod
    def of(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> "NodeSums":
        parts = [part for part in parts if len(part[1])]
        starts = np.cumsum([0, *[len(codes) for _, codes, *_ in parts]]).tolist()
        arrays = [np.concatenate([part[i] for part in parts]) if parts else np.zeros(0, np.int32) for i in (1, 2, 3)]
        return NodeSums(*arrays, [node for node, *_ in parts], starts)

    def part(self, node: int) -> tuple[np.ndarray, ...]:
        at = self.nodes.index(node) if node in self.nodes else None
        inside = slice(0, 0) if at is None else slice(self.starts[at], self.starts[at + 1])
        return self.codes[inside], self.gradients[inside], self.hessians[inside]


class WholeRound(Round):
    """A round on a block that holds all rows, maybe of some features only.

    Of two children only the one with fewer rows is added up: the other's sums are the parent's without them, which is
    exact, as sums are whole numbers. Features that are too rare in a node to split it are left out of it and all nodes
    below.
    """

    def __init__(self, block: Block, layout: Layout, settings: BoostSettings, number: int) -> None:
        super().__init__(block, layout, settings, number, False)
        self.pairs[:, ~self.drawn] = 0
        self.chosen = [drawn_features(layout, settings, number, c) for c in range(len(self.nodes))]
        self.held: list[NodeSums | None] = [None] * len(self.nodes)
        codes = block.entry_code
        self.edges = np.flatnonzero(np.concatenate([np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1], [True]]))
        self.present = codes.take(self.edges[:-1])
        self.present_feature = layout.feature_of.take(self.present)

    def level_sums(self, c: int, level: int, tree: Tree) -> tuple[NodeSums, np.ndarray, np.ndarray]:
        """Sums of the nodes of a level that may be split, and those of whole nodes."""
        node, at, totals = self.totals(c, level)
        # A node whose Hessian is below twice the least one has no split.
        splittable = totals[1] >= 2 * self.settings.min_hessian * SCALE
        if not level:
            found = [(0, *self.root(c))] if splittable[0] and len(at) else []
        else:
            found = self.children(c, level, tree, node, at, splittable)
        self.held[c] = self.common(NodeSums.of(found))
        return self.held[c], *totals

    def root(self, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, edges, parts, first = self.block.entry_row, self.edges, [np.zeros(0, complex)], 0
        while first < len(edges) - 1:
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + ENTRIES_AT_ONCE, side="right")) - 1)
            values = self.pairs[c].take(rows[edges[first] : edges[last]])
            parts.append(np.add.reduceat(values, edges[first:last] - edges[first]))
            first = last
        sums = np.concatenate(parts)
        kept = np.flatnonzero((sums.imag > 0) & self.chosen[c].take(self.present_feature))
        sums = sums.take(kept)
        return self.present.take(kept), sums.real.copy(), sums.imag.copy()

    def children(
        self, c: int, level: int, tree: Tree, node: np.ndarray, at: np.ndarray, splittable: np.ndarray
    ) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        above = (1 << (level - 1)) - 1
        counts = np.bincount(node[at], minlength=1 << level)
        parents = [n for n in self.held[c].nodes if tree.feature[above + n] >= 0 and splittable[2 * n : 2 * n + 2].any()]
        fewer = [2 * n + int(counts[2 * n + 1] < counts[2 * n]) for n in parents]
        added = self.added(c, node, at, fewer, 1 << level)
        place = np.zeros(self.layout.codes, np.int32)
        found = []
        for parent, child, (codes, gradients, hessians) in zip(parents, fewer, added, strict=True):
            all_codes, all_gradients, all_hessians = self.held[c].part(parent)
            place[all_codes] = np.arange(len(all_codes), dtype=np.int32)
            to = np.minimum(place.take(codes), len(all_codes) - 1)
            # Of features that were left out above, nothing is known.
            known = all_codes.take(to) == codes
            if not known.all():
                kept = np.flatnonzero(known)
                to, codes, gradients, hessians = (a.take(kept) for a in (to, codes, gradients, hessians))
            both = {child: (codes, gradients, hessians)}
            if splittable[child ^ 1]:
                rest_gradients, rest_hessians = all_gradients.copy(), all_hessians.copy()
                rest_gradients[to] -= gradients
                rest_hessians[to] -= hessians
                some = np.flatnonzero(rest_hessians > 0)
                both[child ^ 1] = all_codes.take(some), rest_gradients.take(some), rest_hessians.take(some)
            found += [(n, *both[n]) for n in sorted(both) if splittable[n]]
        return found

    def added(
        self, c: int, node: np.ndarray, at: np.ndarray, wanted: list[int], width: int
    ) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Codes, gradients and Hessians of each of some nodes, added up from the rows' entries."""
        number = np.zeros(width, np.int16)
        number[wanted] = np.arange(1, len(wanted) + 1)
        slot = np.zeros(len(node), np.int16)
        slot[at] = number[node[at]]
        some, entry_row = slot > 0, self.block.entry_row
        hits = [
            first + np.flatnonzero(some.take(entry_row[first : first + ENTRIES_AT_ONCE]))
            for first in range(0, len(entry_row), ENTRIES_AT_ONCE)
        ]
        hits = np.concatenate([*hits, np.zeros(0, np.int64)])
        rows, codes = entry_row.take(hits), self.block.entry_code.take(hits)
        own = slot.take(rows)
        if len(wanted) > 1:
            # Entries lie by code, and stay so inside a node.
            order = np.argsort(own, kind="stable")
            rows, codes, own = rows.take(order), codes.take(order), own.take(order)
        if not len(rows):
            return [(codes, np.zeros(0), np.zeros(0))] * len(wanted)
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (own[1:] != own[:-1])]))
        sums = np.add.reduceat(self.pairs[c].take(rows), starts)
        codes, own = codes.take(starts), own.take(starts)
        edges = np.searchsorted(own, np.arange(1, len(wanted) + 2))
        return [(codes[a:b], sums[a:b].real, sums[a:b].imag) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def common(self, found: NodeSums) -> NodeSums:
        """Without the features that are too rare in a node to split it."""
        least = self.settings.min_hessian * SCALE
        if not len(found.codes) or least <= 0:
            return found
        feature = self.layout.feature_of.take(found.codes)
        new = np.concatenate([[True], feature[1:] != feature[:-1]])
        new[found.starts[:-1]] = True
        starts = np.flatnonzero(new)
        enough = np.add.reduceat(found.hessians, starts) >= least
        if enough.all():
            return found
        kept = np.repeat(enough, np.diff(np.append(starts, len(feature))))
        at = np.flatnonzero(kept)
        arrays = [a.take(at) for a in (found.codes, found.gradients, found.hessians)]
        counts = np.add.reduceat(kept, found.starts[:-1], dtype=np.int64)
        some = np.flatnonzero(counts)
        return NodeSums(*arrays, [found.nodes[i] for i in some], [0, *np.cumsum(counts[some]).tolist()])


def drawn_features(layout: Layout, settings: BoostSettings, number: int, c: int) -> np.ndarray:
    """Whether each feature takes part in a tree: the share of them with the smallest hashes."""
    count = max(1, round(settings.feature_share * layout.features))
    order = np.argsort(mixed(np.arange(layout.features), settings.seed + 1, number, c), kind="stable")
    chosen = np.zeros(layout.features, bool)
    chosen[order[:count]] = True
    return chosen


def best_splits(
    keys: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, all_gradient: np.ndarray, all_hessian: np.ndarray,
    layout: Layout, settings: BoostSettings,
) -> list[tuple]:
    """The best split of every node that can be split, from sums per (node, code) in the order of these keys."""
    node = keys // layout.codes
    edges = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist()] if len(keys) else []
    nodes = node[edges].tolist()
    found = NodeSums((keys - node * layout.codes).astype(np.int32), gradient, hessian, nodes, [*edges, len(keys)])
    return splits_of(found, all_gradient, all_hessian, layout, settings)


def splits_of(
    sums: NodeSums, all_gradient: np.ndarray, all_hessian: np.ndarray, layout: Layout, settings: BoostSettings
) -> list[tuple]:
    """Per node that can be split: node, gain, feature, code, and whether absent goes left.

    Equal gains go by the feature, then the code, then absent values to the right. Whole features are looked at, so many at
    once that their sums stay near the processor.
    """
    if not len(sums.codes):
        return []
    feature = layout.feature_of.take(sums.codes)
    new = np.concatenate([[True], feature[1:] != feature[:-1], [True]])
    new[sums.starts] = True
    starts = np.flatnonzero(new)
    own = np.repeat(sums.nodes, np.diff(np.searchsorted(starts, sums.starts)))
    best: dict[int, tuple] = {}
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + SUMS_AT_ONCE, side="right")) - 1)
        inside, segments = slice(starts[first], starts[last]), slice(first, last)
        found = best_of_run(
            sums.codes[inside], feature[inside], sums.gradients[inside], sums.hessians[inside], starts[first : last + 1] - starts[first],
            own[segments], all_gradient, all_hessian, layout, settings,
        )
        for node, split in found:
            if node not in best or split < best[node]:
                best[node] = split
        first = last
    out = []
    for n, (loss, at, code, absent_left) in best.items():
        whole_g, whole_h = all_gradient[n] / SCALE, all_hessian[n] / SCALE
        gain = -loss / SCALE - whole_g * whole_g / (whole_h + settings.l2)
        if gain > LEAST_GAIN:
            out.append((n, float(gain), at, code, absent_left))
    return out


def best_of_run(
    codes: np.ndarray, feature: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, starts: np.ndarray, own: np.ndarray,
    all_gradient: np.ndarray, all_hessian: np.ndarray, layout: Layout, settings: BoostSettings,
) -> list[tuple[int, tuple]]:
    """Per node of a run of features, which begin at ``starts`` and belong to the nodes ``own``, the best split.

    It is told as minus its gain times ``SCALE``, feature, code, and whether absent goes left.
    """
    least, l2 = settings.min_hessian * SCALE, settings.l2 * SCALE
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    nodes = own[edges].tolist()
    ends, lengths = starts[1:] - 1, np.diff(starts)
    whole_g, whole_h = all_gradient.take(own), all_hessian.take(own)

    def highest(g: np.ndarray, h: np.ndarray, whole_g: np.ndarray, whole_h: np.ndarray, edges: np.ndarray) -> tuple[list, list]:
        """Per node minus the highest gain of a left side with these sums, and the first place that has it."""
        other_g, other_h = whole_g - g, whole_h - h
        bad = (h < least) | (other_h < least)
        gain = g * g
        gain /= h + l2
        other_g *= other_g
        other_h += l2
        other_g /= other_h
        gain += other_g
        gain[bad] = -np.inf
        if len(edges) == 1:
            at = int(gain.argmax())
            return [-float(gain[at])], [at]
        top = np.maximum.reduceat(gain, edges)
        hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(edges, len(gain)))))
        return (-top).tolist(), hits[np.searchsorted(hits, edges)].tolist()

    left_g, left_h = np.cumsum(gradient), np.cumsum(hessian)
    before_g, before_h = (np.concatenate([[0.0], total[ends[:-1]]]) for total in (left_g, left_h))
    absent_g, absent_h = whole_g - (left_g[ends] - before_g), whole_h - (left_h[ends] - before_h)
    left_g -= np.repeat(before_g, lengths)
    left_h -= np.repeat(before_h, lengths)
    if len(nodes) == 1:
        every_g, every_h = whole_g[0], whole_h[0]
    else:
        every_g, every_h = np.repeat(whole_g, lengths), np.repeat(whole_h, lengths)
    # Splits behind each bin with absent values on the right, or on the left; and absent values against all others.
    right, right_at = highest(left_g, left_h, every_g, every_h, starts[edges])
    left_g += np.repeat(absent_g, lengths)
    left_h += np.repeat(absent_h, lengths)
    left, left_at = highest(left_g, left_h, every_g, every_h, starts[edges])
    alone, alone_at = highest(absent_g, absent_h, whole_g, whole_h, edges)
    alone_feature = feature[starts[alone_at]]
    options = (
        zip(right, feature[right_at].tolist(), codes[right_at].tolist(), [False] * len(nodes), strict=True),
        zip(left, feature[left_at].tolist(), codes[left_at].tolist(), [True] * len(nodes), strict=True),
        zip(alone, alone_feature.tolist(), (layout.offsets[alone_feature] - 1).tolist(), [True] * len(nodes), strict=True),
    )
    return list(zip(nodes, map(min, *options), strict=True))


def set_level(
    tree: Tree, level: int, splits: list[tuple], all_gradient: np.ndarray, all_hessian: np.ndarray, settings: BoostSettings
) -> bool:
    """Enter a level's leaf values and splits; whether there is a split."""
    first = (1 << level) - 1
    for i in range(1 << level):
        tree.value[first + i] = -settings.step * all_gradient[i] / (all_hessian[i] + settings.l2 * SCALE)
    for node, _, feature, code, absent_left in splits:
        tree.feature[first + node], tree.code[first + node] = feature, code
        tree.absent_left[first + node] = absent_left
    return bool(splits)


def offered(state: WholeRound, c: int, level: int, tree: Tree) -> tuple[list[tuple], list[np.ndarray]]:
    """Best splits of a level by the block's own features, for a block that holds all rows, and sums of whole nodes."""
    if level == state.settings.depth:
        return [], state.totals(c, level)[2]
    sums, all_g, all_h = state.level_sums(c, level, tree)
    return splits_of(sums, all_g, all_h, state.layout, state.settings), [all_g, all_h]


def grow(block: Block, layout: Layout, settings: BoostSettings, number: int) -> list[Tree]:
    """The trees of a round on one block that holds all rows; the block's scores move on.

    The classes' trees are grown side by side: no other task runs then.
    """
    state = WholeRound(block, layout, settings, number)

    def grown(c: int) -> Tree:
        tree = Tree.empty(settings.depth)
        for level in range(settings.depth + 1):
            splits, totals = offered(state, c, level, tree)
            if not set_level(tree, level, splits, *totals, settings):
                break
            state.advance(c, tree, level)
        return tree

    with ThreadPool(min(PARALLEL_TREES, block.scores.shape[1])) as pool:
        trees = pool.map(grown, range(block.scores.shape[1]))
    state.finish(trees)
    return trees


def grow_together(
    block: Block, layout: Layout, settings: BoostSettings, number: int, tell: Callable[[bytes], list[bytes]]
) -> list[Tree]:
    """The trees of a round on a block that holds all rows but some features only; ``tell`` hands round what others found.

    All tasks come to the same trees.
    """
    state = WholeRound(block, layout, settings, number)
    trees = [Tree.empty(settings.depth) for _ in state.nodes]
    going = range(len(trees))
    for level in range(settings.depth + 1):
        found = {c: offered(state, c, level, trees[c]) for c in going}
        if level < settings.depth:
            offers = [json.loads(t) for t in tell(json.dumps([found[c][0] for c in going]).encode())]
            best = [best_offers([split for own in offers for split in own[i]]) for i in range(len(going))]
        else:
            best = [[] for _ in going]
        going = [c for c, splits in zip(going, best, strict=True) if set_level(trees[c], level, splits, *found[c][1], settings)]
        if not going:
            break
        # Rows go where absent values go unless the task that has the feature tells otherwise.
        usual = np.stack([trees[c].absent_left.take(state.nodes[c]) for c in going])
        other = np.stack([state.lefts(c, trees[c], level) for c in going]) ^ usual
        told = [t for t in tell(zlib.compress(np.packbits(other).tobytes(), 1) if other.any() else b"") if t]
        bits = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(t), np.uint8) for t in told]) if told else None
        if bits is not None:
            usual ^= np.unpackbits(bits, count=usual.size).astype(bool).reshape(usual.shape)
        for c, left in zip(going, usual, strict=True):
            state.move(c, trees[c], left)
    state.finish(trees)
    return trees


def best_offers(splits: list[tuple]) -> list[tuple]:
    """The best split of every node; equal gains go by the feature, then the code, then absent values to the right."""
    found: dict[int, tuple] = {}
    for node, gain, feature, code, absent in splits:
        rank = (-gain, feature, code, absent)
        if node not in found or rank < found[node][0]:
            found[node] = rank, (node, gain, feature, code, absent)
    return [split for _, split in sorted(found.values(), key=lambda x: x[1][0])]


def stopped(losses: list[float], patience: int | None) -> bool:
    """Whether the lowest loss lies ``patience`` rounds back."""
    return patience is not None and bool(losses) and len(losses) - 1 - int(np.argmin(losses)) >= patience


def sparse_parts(features: str) -> tuple[Column, Column]:
    """Places and values of a vector column, also of a dense one."""
    parts = F.unwrap_udt(features)
    size = F.when(parts["type"] == 1, F.size(parts["values"])).otherwise(F.lit(0))
    places = F.transform(F.array_repeat(F.lit(0), size), lambda _, i: i)
    return F.when(parts["type"] == 0, parts["indices"]).otherwise(places), parts["values"]


def fit_layout(train: DataFrame, features: str, width: int, bins: int) -> Layout:
    """Bins between quantiles of each feature's values; at most ``bins`` - 1 numbers a feature reach the driver."""
    places, values = sparse_parts(features)
    entries = train.select(F.inline_outer(F.arrays_zip(places.alias("place"), values.alias("value"))))
    shares = [i / bins for i in range(1, bins)]
    quantiles = F.array_distinct(F.percentile_approx("value", shares, 8 * bins))
    found = (
        entries.where("value is not null and value <> 0D")
        .groupBy("place")
        .agg(quantiles.alias("cuts"), F.max("value").alias("top"))
        .select("place", F.array_sort(F.filter("cuts", lambda x: x < F.col("top"))).alias("cuts"))
        .toArrow()
    )
    order = np.argsort(found["place"].to_numpy())
    cuts = found["cuts"].combine_chunks().take(pa.array(order))
    counts = np.zeros(width, np.int64)
    counts[found["place"].to_numpy()[order]] = cuts.value_lengths().to_numpy(zero_copy_only=False)
    return Layout(cuts.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]))


def to_blocks(rows: DataFrame, layout: Layout, key: str, label: Column, use: Column, features: str, classes: int) -> DataFrame:
    """The rows as a table of blocks; how many there are depends on rows and entries only.

    ``use`` is 1 for rows to learn from, 2 for rows to watch, 3 for both.
    """
    places, values = sparse_parts(features)
    chosen = rows.select(
        F.xxhash64(key).alias("key"), label.cast("int").alias("label"), use.alias("use"), places.alias("places"),
        values.alias("values"),
    ).where("label is not null")
    count, entries = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    parts = max(1, -(-count // BLOCK_ROWS), -(-entries // BLOCK_ENTRIES))
    dealt = chosen.coalesce(1) if parts == 1 else chosen.repartition(parts)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        sizes = np.zeros(2, np.int64)
        made_before = [0]

        def block() -> pa.RecordBatch:
            keys, labels, uses, lengths, features, values = (np.concatenate(p) for p in zip(*held, strict=True))
            row = np.repeat(np.arange(len(keys)), lengths)
            some = values != 0
            codes = layout.code(features[some], values[some])
            made = Block.from_rows(keys, labels, uses, row[some], codes, classes)
            held.clear()
            sizes[:] = 0
            made_before[0] += 1
            number = (TaskContext.get().partitionId() << 32) + made_before[0]
            return state_rows([{"kind": "block", "number": number, "payload": made.payload()}])

        for batch in batches:
            plain = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4)]
            if held and parts > 1 and (sizes[0] + len(lengths) > 2 * BLOCK_ROWS or sizes[1] + len(flat[0]) > 2 * BLOCK_ENTRIES):
                yield block()
            held.append((*plain, lengths.astype(np.int64), flat[0].astype(np.int64), flat[1]))
            sizes += len(lengths), len(flat[0])
        if held:
            yield block()

    return dealt.mapInArrow(pack, STATE)


STATE_ARROW = pa.schema([("kind", pa.string()), ("number", pa.int64()), ("payload", pa.binary()), ("loss", pa.float64())])


def state_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"loss": None, "payload": None, **row} for row in rows], schema=STATE_ARROW)


def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for payload in batch.column(batch.schema.get_field_index("payload")):
            yield Block(**unpacked(payload.as_py()))


def rounds_in_task(
    blocks: DataFrame, layout: Layout, settings: BoostSettings, first: int, last: int, losses: list[float]
) -> DataFrame:
    """Rounds ``first`` to ``last`` on a single block: its new state, the trees and the losses."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            seen = list(losses)
            for number in range(first, last):
                trees = grow(block, layout, settings, number)
                total, watched = block.loss()
                seen.append(total / watched if watched else 0.0)
                yield state_rows([
                    {"kind": f"tree{c}", "number": number, "payload": packed(**vars(t)), "loss": seen[-1]}
                    for c, t in enumerate(trees)
                ])
                if stopped(seen, settings.patience):
                    break
            yield state_rows([{"kind": "block", "number": 0, "payload": block.payload()}])

    return blocks.mapInArrow(run, STATE)


def to_columns(blocks: DataFrame, layout: Layout, parts: int) -> DataFrame:
    """Blocks without their entries (kind ``block``), and the entries by part of the features (kind ``column``)."""
    cut_ends = layout.cut_ends

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature_of = Layout(np.zeros(0), cut_ends).feature_of
        for batch in batches:
            for number, payload in zip(batch["number"].to_pylist(), batch["payload"], strict=True):
                block = Block(**unpacked(payload.as_py()))
                rows, codes = block.entry_row, block.entry_code
                block.entry_row, block.entry_code = rows[:0], codes[:0]
                yield pa.RecordBatch.from_pylist([{"part": -number, "kind": "block", "number": number, "payload": block.payload()}])
                part = (feature_of[codes] % parts).astype(np.int32)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[p] : edges[p + 1]]
                    payload = packed(rows=rows[own], codes=codes[own])
                    yield pa.RecordBatch.from_pylist([{"part": p, "kind": "column", "number": number, "payload": payload}])

    def join(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == "block":
            return table.select(["kind", "number", "payload"])
        found = [unpacked(p.as_py()) for p in table["payload"]]
        payload = packed(
            blocks=table["number"].to_numpy(), lengths=np.array([len(f["rows"]) for f in found]),
            rows=np.concatenate([f["rows"] for f in found]), codes=np.concatenate([f["codes"] for f in found]),
        )
        return pa.table({"kind": ["column"], "number": table["part"][:1].cast(pa.int64()), "payload": [payload]})

    dealt = blocks.select("number", "payload").mapInArrow(deal, "part long, kind string, number long, payload binary")
    return dealt.groupBy("part").applyInArrow(join, "kind string, number long, payload binary")


def rounds_together(
    blocks: DataFrame, columns: DataFrame, layout: Layout, settings: BoostSettings, first: int, last: int,
    losses: list[float], tasks: int,
) -> DataFrame:
    """Rounds ``first`` to ``last`` by tasks side by side: the blocks' new state, the trees and the losses."""
    cut_ends, folder = layout.cut_ends, message_folder(blocks.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, others = Layout(np.zeros(0), cut_ends), Together(folder)
        own, held = {}, []
        for batch in batches:
            for kind, number, payload in zip(*(batch[c] for c in ("kind", "number", "payload")), strict=True):
                if kind.as_py() == "block":
                    own[number.as_py()] = payload.as_py()
                else:
                    held.append(unpacked(payload.as_py()))
        told = [unpacked(t) for t in others.tell(packed(**{str(n): np.frombuffer(p, np.uint8) for n, p in own.items()}))]
        every = {int(n): Block(**unpacked(p.tobytes())) for t in told for n, p in t.items()}
        numbers = np.array(sorted(every))
        del told
        starts = np.concatenate([[0], np.cumsum([len(every[n].keys) for n in numbers.tolist()])])
        rows = [
            f["rows"] + np.repeat(starts[np.searchsorted(numbers, f["blocks"])], f["lengths"]).astype(np.int32) for f in held
        ]
        codes = [f["codes"] for f in held]
        held.clear()
        parts = [np.concatenate([getattr(every[n], a) for n in numbers.tolist()]) for a in ("keys", "labels", "uses", "scores")]
        every.clear()
        none = [np.zeros(0, np.int32)]
        block = Block.from_rows(*parts[:3], np.concatenate(rows or none), np.concatenate(codes or none), parts[3].shape[1])
        block.scores = parts[3]
        rows.clear()
        codes.clear()
        seen = list(losses)
        for number in range(first, last):
            trees = grow_together(block, layout, settings, number, others.tell)
            total, watched = block.loss()
            seen.append(total / watched if watched else 0.0)
            if not others.own:
                yield state_rows([
                    {"kind": f"tree{c}", "number": number, "payload": packed(**vars(t)), "loss": seen[-1]}
                    for c, t in enumerate(trees)
                ])
            if stopped(seen, settings.patience):
                break
        for n, payload in own.items():
            at = np.searchsorted(numbers, n)
            moved = Block(**unpacked(payload))
            moved.scores = block.scores[starts[at] : starts[at + 1]]
            yield state_rows([{"kind": "block", "number": n, "payload": moved.payload()}])

    both = blocks.select("kind", "number", "payload").unionByName(columns.select("kind", "number", "payload"))
    return both.repartition(tasks).mapInArrow(run, STATE, barrier=True)


def replayed(block: Block, layout: Layout, settings: BoostSettings, finished: list[list[Tree]], first: int) -> None:
    """Move a block's scores on by finished rounds."""
    for number, trees in enumerate(finished, first):
        state = Round(block, layout, settings, number, False)
        for c, tree in enumerate(trees):
            for level in range(settings.depth):
                state.advance(c, tree, level)
        state.finish(trees)


def exchange_level(
    blocks: DataFrame, layout: Layout, settings: BoostSettings, finished: list[list[Tree]], first: int,
    trees: list[Tree], level: int,
) -> tuple[dict[int, list[tuple]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Best splits and whole sums of a level, per class, over all blocks."""
    ranges = np.linspace(0, layout.features, FEATURE_RANGES + 1).astype(np.int64)
    edges = layout.offsets[ranges]
    number = first + len(finished)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            replayed(block, layout, settings, finished, first)
            state = Round(block, layout, settings, number)
            for c, tree in enumerate(trees):
                for above in range(level):
                    state.advance(c, tree, above)
                keys, g, h, all_g, all_h = state.sums(c, level)
                part = np.searchsorted(edges, keys % layout.codes, side="right") - 1
                yield pa.RecordBatch.from_pylist([
                    {"part": p, "c": c, "payload": packed(keys=keys[own], g=g[own], h=h[own], all_g=all_g, all_h=all_h)}
                    for p in range(FEATURE_RANGES)
                    for own in [part == p]
                ])

    def best(table: pa.Table) -> pa.Table:
        found = [unpacked(p.as_py()) for p in table["payload"]]
        keys = np.concatenate([f["keys"] for f in found])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        g, h = (
            np.add.reduceat(np.concatenate([f[v] for f in found])[order], starts) if len(keys) else np.zeros(0) for v in "gh"
        )
        all_g, all_h = (np.sum([f[v] for f in found], axis=0) for v in ("all_g", "all_h"))
        splits = best_splits(keys[starts], g, h, all_g, all_h, layout, settings) if level < settings.depth else []
        told = json.dumps({"splits": splits, "g": all_g.tolist(), "h": all_h.tolist()})
        return pa.table({"c": pa.array([table["c"][0].as_py()], pa.int64()), "told": [told]})

    found = (
        blocks.mapInArrow(sums, "part long, c long, payload binary")
        .groupBy("part", "c")
        .applyInArrow(best, "c long, told string")
        .collect()
    )
    splits: dict[int, list[tuple]] = {c: [] for c in range(len(trees))}
    totals = {}
    for row in found:
        told = json.loads(row["told"])
        totals[row["c"]] = np.array(told["g"]), np.array(told["h"])
        splits[row["c"]] += told["splits"]
    return {c: best_offers(offers) for c, offers in splits.items()}, totals


def rounds_by_exchange(
    blocks: DataFrame, layout: Layout, settings: BoostSettings, classes: int, first: int, last: int, losses: list[float]
) -> DataFrame:
    """Rounds ``first`` to ``last`` over many blocks: their new state, the trees and the losses."""
    finished: list[list[Tree]] = []
    seen = list(losses)
    for _ in range(first, last):
        trees = [Tree.empty(settings.depth) for _ in range(classes)]
        for level in range(settings.depth + 1):
            splits, totals = exchange_level(blocks, layout, settings, finished, first, trees, level)
            more = [set_level(trees[c], level, splits[c], *totals[c], settings) for c in range(classes)]
            if not any(more):
                break
        finished.append(trees)
        seen.append(watched_loss(blocks, layout, settings, finished, first) if settings.patience is not None else 0.0)
        if stopped(seen, settings.patience):
            break

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            replayed(block, layout, settings, finished, first)
            yield state_rows([{"kind": "block", "number": 0, "payload": block.payload()}])

    told = [
        (f"tree{c}", first + i, bytearray(packed(**vars(t))), seen[len(losses) + i])
        for i, trees in enumerate(finished)
        for c, t in enumerate(trees)
    ]
    return blocks.mapInArrow(move, STATE).unionByName(blocks.sparkSession.createDataFrame(told, STATE))


def watched_loss(
    blocks: DataFrame, layout: Layout, settings: BoostSettings, finished: list[list[Tree]], first: int
) -> float:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            replayed(block, layout, settings, finished, first)
            total, rows = block.loss()
            yield pa.RecordBatch.from_pydict({"total": [total], "rows": pa.array([rows], pa.int64())})

    total, rows = blocks.mapInArrow(run, "total double, rows long").agg(F.sum("total"), F.sum("rows")).first()
    return total / rows if rows else 0.0


@dataclass
class Boosted:
    """Trees per round and class, and the loss of the watched rows after each round that was run."""

    trees: list[list[Tree]]
    losses: list[float]
    layout: Layout


def boost(
    rows: DataFrame,
    label: Column,
    classes: int,
    width: int,
    settings: BoostSettings,
    key: str,
    train: Column | None = None,
    watch: Column | None = None,
    features: str = "features",
    path: str | None = None,
) -> Boosted:
    """Fit on the rows where ``train`` holds (all) and watch the loss of those where ``watch`` holds (none).

    ``label`` is the class number; ``path`` keeps the state. With a ``patience`` the rounds up to the lowest loss are kept.
    """
    spark = rows.sparkSession
    is_train = F.lit(True) if train is None else train
    use = is_train.cast("int") + 2 * (F.lit(False) if watch is None else watch).cast("int")
    base = path or new_output_dir(spark, "boosting")
    if path is None:
        delete_on_exit(spark, base)
    tasks = task_slots(spark)
    about = json.dumps({**asdict(settings), "width": width, "classes": classes, "together": tasks > 0}, sort_keys=True)
    check_about(spark, base, about)
    # Approximate quantiles may differ between runs, so bins are kept with the state.
    if not path_exists(spark, f"{base}/layout/_SUCCESS"):
        layout = fit_layout(rows.where(is_train & label.isNotNull()), features, width, settings.bins)
        kept = [(bytearray(packed(cuts=layout.cuts, cut_ends=layout.cut_ends)),)]
        spark.createDataFrame(kept, "payload binary").coalesce(1).write.mode("overwrite").parquet(f"{base}/layout")
    layout = Layout(**unpacked(bytes(spark.read.parquet(f"{base}/layout").first()["payload"])))
    if not path_exists(spark, f"{base}/start/_SUCCESS"):
        to_blocks(rows, layout, key, label, use, features, classes).write.mode("overwrite").parquet(f"{base}/start")
    now, at, trees, losses, chunk = "start", 0, [], [], CHUNK
    while True:
        following = f"rounds-{at:06d}"
        done = at >= settings.rounds or stopped(losses, settings.patience) or classes < 2
        if done:
            break
        if not path_exists(spark, f"{base}/{following}/_SUCCESS"):
            blocks = spark.read.schema(STATE).parquet(f"{base}/{now}").where("kind = 'block'")
            number, last, began = blocks.count(), min(at + chunk, settings.rounds), time.monotonic()
            if not number:
                break
            if number == 1:
                state = rounds_in_task(blocks.coalesce(1), layout, settings, at, last, losses)
            elif tasks:
                if not path_exists(spark, f"{base}/columns/_SUCCESS"):
                    parts = min(layout.features, max(PARTS_PER_TASK * tasks, 4 * number))
                    to_columns(blocks, layout, parts).write.mode("overwrite").parquet(f"{base}/columns")
                dealt = spark.read.parquet(f"{base}/columns")
                blocks = dealt.where("kind = 'block'") if not at else blocks
                columns = dealt.where("kind = 'column'")
                state = rounds_together(blocks, columns, layout, settings, at, last, losses, tasks)
            else:
                spread = blocks.repartition(number)
                state = rounds_by_exchange(spread, layout, settings, classes, at, last, losses)
            state.write.mode("overwrite").parquet(f"{base}/{following}")
            # Starting the tasks takes seconds, so quick rounds run more at once.
            if time.monotonic() - began < QUICK_SECONDS:
                chunk = min(2 * chunk, MOST_CHUNKS * CHUNK)
        added = spark.read.schema(STATE).parquet(f"{base}/{following}").where("kind like 'tree%'").collect()
        by_place = {(r["number"], int(r["kind"][4:])): r for r in added}
        for number in sorted({n for n, _ in by_place}):
            trees.append([Tree(**unpacked(bytes(by_place[number, c]["payload"]))) for c in range(classes)])
            losses.append(by_place[number, 0]["loss"])
        if path is None and now != "start":
            drop_folder(spark, f"{base}/{now}")
        now, at = following, len(trees)
    if settings.patience is not None and losses:
        trees = trees[: int(np.argmin(losses)) + 1]
    return Boosted(trees, losses, layout)


def check_about(spark: SparkSession, base: str, about: str) -> None:
    """A folder holds the state of one training only."""
    place = f"{base}/about"
    if path_exists(spark, f"{place}/_SUCCESS"):
        if spark.read.text(place).first()["value"] != about:
            raise ValueError(f"{base} holds the state of a training with other settings")
    else:
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(place)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


class SoftmaxTrees(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities of boosted trees as an array ``outputCol``, with ``prediction`` and ``predicted_label``.

    Nodes of all trees lie one after the other: rounds, then classes, then nodes of a complete tree of ``depth``.
    """

    labels = Param(Params._dummy(), "labels", "class labels", TypeConverters.toListString)
    depth = Param(Params._dummy(), "depth", "depth of every tree", TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "feature of each node, -1 for leaves", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "values up to it go left", TypeConverters.toListFloat)
    absentLeft = Param(Params._dummy(), "absentLeft", "1 where absent values go left", TypeConverters.toListInt)
    values = Param(Params._dummy(), "values", "score of each node", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str | None = None,
        outputCol: str | None = None,
        labels: list[str] | None = None,
        depth: int | None = None,
        features: list[int] | None = None,
        thresholds: list[float] | None = None,
        absentLeft: list[int] | None = None,
        values: list[float] | None = None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(found: Boosted, labels: list[str], depth: int, input_column: str, output_column: str) -> "SoftmaxTrees":
        trees = [t for row in found.trees for t in row]
        parts = {n: np.concatenate([getattr(t, n) for t in trees] or [np.zeros(0)]) for n in vars(Tree.empty(0))}
        feature = parts["feature"].astype(np.int64)
        inner = np.maximum(feature, 0)
        upper = np.where(feature >= 0, found.layout.upper_value(inner, parts["code"].astype(np.int64)), 0.0) if len(feature) else feature
        # JSON has no infinities.
        upper = np.clip(upper.astype(float), -np.finfo(float).max, np.finfo(float).max)
        return SoftmaxTrees(
            inputCol=input_column,
            outputCol=output_column,
            labels=labels,
            depth=depth,
            features=feature.tolist(),
            thresholds=upper.tolist(),
            absentLeft=parts["absent_left"].astype(int).tolist(),
            values=parts["value"].astype(float).tolist(),
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, depth = len(self.getOrDefault(self.labels)), self.getOrDefault(self.depth)
        size = (2 << depth) - 1
        shape = (-1, classes, size)
        feature = np.array(self.getOrDefault(self.features), np.int64).reshape(shape)
        threshold = np.array(self.getOrDefault(self.thresholds), np.float64).reshape(shape)
        absent = np.array(self.getOrDefault(self.absentLeft), bool).reshape(shape)
        value = np.array(self.getOrDefault(self.values), np.float64).reshape(shape)
        used = np.unique(feature[feature >= 0])
        slot = np.where(feature >= 0, np.searchsorted(used, feature), -1)

        @F.arrow_udf("array<double>")
        def shares(places: pa.Array, numbers: pa.Array) -> pa.Array:
            scores = np.zeros((len(places), classes))
            step = max(1, (1 << 22) // max(1, len(used)))
            for at in range(0, len(places), step):
                part = places.slice(at, step)
                rows = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                own = part.flatten().to_numpy(zero_copy_only=False)
                given = numbers.slice(at, step).flatten().to_numpy(zero_copy_only=False)
                table = np.full((len(part), len(used) + 1), np.nan)
                place = np.searchsorted(used, own)
                hit = (place < len(used)) & (given != 0)
                hit[hit] = used[place[hit]] == own[hit]
                table[rows[hit], place[hit]] = given[hit]
                every = np.arange(len(part))
                for trees in range(len(slot)):
                    for c in range(classes):
                        node = np.zeros(len(part), np.int64)
                        for _ in range(depth):
                            where = slot[trees, c][node]
                            x = table[every, where]
                            left = np.where(np.isnan(x), absent[trees, c][node], x <= threshold[trees, c][node])
                            node = np.where(where >= 0, 2 * node + np.where(left, 1, 2), node)
                        scores[at : at + step, c] += value[trees, c][node]
            powers = np.exp(scores - scores.max(axis=1, keepdims=True))
            powers /= powers.sum(axis=1, keepdims=True)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * classes, pa.int32()), pa.array(powers.ravel()))

        name = self.getOutputCol()
        scored = dataset.withColumn(name, shares(*sparse_parts(self.getInputCol())))
        best = F.array_position(F.col(name), F.array_max(name)) - 1
        return with_label(scored.withColumn("prediction", best.cast("double")), self.getOrDefault(self.labels))

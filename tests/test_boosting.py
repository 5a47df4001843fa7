import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from triagework.models import boosting
from triagework.models.boosting import Block, BoostSettings, Layout, SoftmaxTrees, boost, drawn_features, grow, mixed

SETTINGS = BoostSettings(rounds=4, depth=3, step=0.3, min_hessian=1.0, bins=8)


def small_rows(n=240, width=9, classes=3, seed=5):
    """Sparse rows whose class shows in two of the features; some values are negative, some stored zeros."""
    rng = np.random.default_rng(seed)
    table = np.where(rng.random((n, width)) < 0.4, rng.integers(-3, 9, (n, width)) / 2, 0.0)
    labels = (table[:, 0] > 1).astype(int) + (table[:, 1] > 0) * (rng.random(n) < 0.9)
    return table, np.minimum(labels, classes - 1)


@pytest.fixture(scope="module")
def rows(spark):
    table, labels = small_rows()
    data = [
        (i, int(y), Vectors.dense(x) if i % 7 == 0 else Vectors.sparse(len(x), [(j, v) for j, v in enumerate(x) if v or j == 3]))
        for i, (x, y) in enumerate(zip(table, labels, strict=True))
    ]
    return spark.createDataFrame(data, ["k", "y", "features"])


def plain_round(table, labels, scores, keys, layout, settings, number):
    """The round's trees by trying every split of every node over all rows, one after the other."""
    classes = scores.shape[1]
    shares = np.exp(scores - scores.max(axis=1, keepdims=True))
    shares /= shares.sum(axis=1, keepdims=True)
    drawn = mixed(keys, settings.seed, number) < settings.row_share
    added = np.zeros_like(scores)
    chosen_splits = []
    for c in range(classes):
        g = np.rint((shares[:, c] - (labels == c)) * boosting.SCALE) / boosting.SCALE
        h = np.rint(2 * shares[:, c] * (1 - shares[:, c]) * boosting.SCALE) / boosting.SCALE
        allowed = np.flatnonzero(drawn_features(layout, settings, number, c))

        def value(rows, g=g, h=h):
            rows = rows[drawn[rows]]
            return g[rows].sum() ** 2 / (h[rows].sum() + settings.l2)

        def split(rows, level, c=c, g=g, h=h, allowed=allowed, value=value):
            best = None
            if level < settings.depth:
                for f in allowed:
                    x = table[rows, f]
                    cuts = layout.cuts[layout.cut_ends[f] : layout.cut_ends[f + 1]]
                    for cut in [-np.inf, *cuts, np.inf]:
                        for absent_left in (False, True):
                            left = np.where(x == 0, absent_left, x <= cut)
                            sums = [h[r[drawn[r]]].sum() for r in (rows[left], rows[~left])]
                            if min(sums) < settings.min_hessian:
                                continue
                            gain = value(rows[left]) + value(rows[~left]) - value(rows)
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = gain, left
            if best is None:
                own = rows[drawn[rows]]
                added[rows, c] = -settings.step * g[own].sum() / (h[own].sum() + settings.l2)
                return
            chosen_splits.append(best[0])
            split(rows[best[1]], level + 1)
            split(rows[~best[1]], level + 1)

        split(np.arange(len(table)), 0)
    return scores + added, chosen_splits


def block_of(table, labels, layout, classes, use=1):
    row, feature = np.nonzero(table)
    keys = np.arange(len(table)) * 7919
    codes = layout.code(feature, table[row, feature])
    return Block.from_rows(keys, labels, np.full(len(table), use), row, codes, classes)


def layout_of(table, bins=8):
    cuts = []
    for column in table.T:
        values = np.unique(column[column != 0])
        cuts.append(values[:-1][:: max(1, len(values) // bins)])
    return Layout(np.concatenate(cuts), np.concatenate([[0], np.cumsum([len(c) for c in cuts])]))


def test_codes_and_upper_values():
    layout = Layout(np.array([1.0, 3.0, -2.0]), np.array([0, 2, 2, 3]))
    feature = np.array([0, 0, 0, 0, 1, 2, 2])
    values = np.array([0.5, 1.0, 2.0, 9.0, 4.0, -2.0, 0.1])
    codes = layout.code(feature, values)
    assert codes.tolist() == [0, 0, 1, 2, 3, 4, 5]
    assert layout.feature_of.tolist() == [0, 0, 0, 1, 2, 2]
    assert layout.upper_value(feature, codes).tolist() == [1, 1, 3, np.inf, np.inf, -2, np.inf]
    assert layout.upper_value(np.array([2]), np.array([3])).tolist() == [-np.inf]


@pytest.mark.parametrize("share", [1.0, 0.8])
def test_rounds_equal_brute_force(share):
    table, labels = small_rows(120, 6)
    settings = BoostSettings(rounds=3, depth=3, step=0.3, row_share=share, feature_share=share, min_hessian=1.0)
    layout = layout_of(table)
    block = block_of(table, labels, layout, 3)
    scores = np.zeros((len(table), 3))
    for number in range(3):
        trees = grow(block, layout, settings, number)
        scores, splits = plain_round(table, labels, scores, block.keys, layout, settings, number)
        assert sum((t.feature >= 0).sum() for t in trees) == len(splits) > 3
        assert block.scores == pytest.approx(scores, abs=1e-9)


def test_training_loss_falls_every_round():
    table, labels = small_rows(300, 8)
    settings = BoostSettings(rounds=12, depth=3, step=0.2, row_share=1.0, min_hessian=0.5)
    layout = layout_of(table)
    block = block_of(table, labels, layout, 3, use=3)
    losses = [block.loss()[0]]
    for number in range(12):
        grow(block, layout, settings, number)
        losses.append(block.loss()[0])
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False))


def test_hashes_are_even_shares():
    shares = mixed(np.arange(20_000), 42, 3)
    assert 0 <= shares.min() and shares.max() < 1 and abs((shares < 0.8).mean() - 0.8) < 0.01
    assert abs(np.corrcoef(shares, mixed(np.arange(20_000), 42, 4))[0, 1]) < 0.03


def trees_of(found):
    return [[(t.feature.tolist(), t.code.tolist(), t.absent_left.tolist(), t.value.tolist()) for t in r] for r in found.trees]


def test_many_blocks_give_the_same_trees(rows, monkeypatch):
    whole = boost(rows, F.col("y"), 3, 9, SETTINGS, "k")
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    monkeypatch.setattr(boosting, "CHUNK", 3)
    parted = boost(rows, F.col("y"), 3, 9, SETTINGS, "k")
    assert trees_of(parted) == trees_of(whole) and len(whole.trees) == 4
    assert sum((t.feature >= 0).sum() for r in whole.trees for t in r) > 12


def test_stage_scores_like_the_blocks(spark, rows, tmp_path):
    settings = BoostSettings(rounds=4, depth=3, step=0.3, row_share=1.0, min_hessian=1.0, bins=8)
    path = str(tmp_path / "state")
    found = boost(rows, F.col("y"), 3, 9, settings, "k", path=path)
    state = spark.read.parquet(f"{path}/rounds-000000").where("kind = 'block'").first()
    block = Block(**boosting.unpacked(bytes(state["payload"])))
    stage = SoftmaxTrees.of(found, ["a", "b", "c"], 3, "features", "scores")
    stage.write().overwrite().save(str(tmp_path / "stage"))
    loaded = SoftmaxTrees.load(str(tmp_path / "stage"))
    keys = {r.h: r.k for r in rows.select(F.xxhash64("k").alias("h"), "k").collect()}
    want = {keys[h]: p for h, p in zip(block.keys.tolist(), block.probabilities().tolist(), strict=True)}
    got = loaded.transform(rows).collect()
    assert len(got) == 240
    for r in got:
        assert r.scores == pytest.approx(want[r.k])
        assert r.predicted_label == "abc"[int(r.prediction)] and r.scores[int(r.prediction)] == max(r.scores)


def test_stops_while_it_runs_and_keeps_the_best_rounds(rows, monkeypatch):
    settings = BoostSettings(rounds=60, depth=3, step=0.9, row_share=1.0, min_hessian=0.0, bins=8, patience=3)
    train = F.col("k") % 3 > 0
    found = boost(rows, F.col("y"), 3, 9, settings, "k", train=train, watch=~train)
    best = int(np.argmin(found.losses))
    assert len(found.losses) == best + 4 < 60
    assert len(found.trees) == best + 1
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    parted = boost(rows, F.col("y"), 3, 9, settings, "k", train=train, watch=~train)
    assert parted.losses == pytest.approx(found.losses) and trees_of(parted) == trees_of(found)


def test_goes_on_after_the_last_complete_chunk(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "CHUNK", 2)
    whole = boost(rows, F.col("y"), 3, 9, SETTINGS, "k")
    path, plain, calls = str(tmp_path / "state"), boosting.rounds_in_task, []

    def lost(*arguments):
        calls.append(arguments[3])
        if len(calls) == 2:
            raise RuntimeError("session lost")
        return plain(*arguments)

    monkeypatch.setattr(boosting, "rounds_in_task", lost)
    with pytest.raises(RuntimeError):
        boost(rows, F.col("y"), 3, 9, SETTINGS, "k", path=path)
    found = boost(rows, F.col("y"), 3, 9, SETTINGS, "k", path=path)
    assert calls == [0, 2, 2] and trees_of(found) == trees_of(whole)
    with pytest.raises(ValueError):
        boost(rows, F.col("y"), 3, 9, BoostSettings(rounds=5), "k", path=path)


def test_one_class_and_no_rows(rows):
    for some, classes in ((rows, 1), (rows.limit(0), 3)):
        found = boost(some, F.lit(0), classes, 9, SETTINGS, "k")
        labels = list("abc")[:classes]
        scored = SoftmaxTrees.of(found, labels, 3, "features", "scores").transform(rows.limit(5)).collect()
        assert not found.trees and len(scored) == 5
        assert all(r.scores == pytest.approx([1 / classes] * classes) for r in scored)


def test_many_blocks_take_no_job_per_level(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    context = spark.sparkContext
    context.setJobGroup("levels", "boosting over many blocks")
    try:
        found = boost(rows, F.col("y"), 3, 9, BoostSettings(rounds=12, depth=3, step=0.3, min_hessian=1.0, bins=8), "k")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # One job per level would be at least 12 times 3 more than the same few jobs before and after.
    assert len(found.trees) == 12 and len(context.statusTracker().getJobIdsForGroup("levels")) < 36


def test_only_the_smaller_child_is_added_up(monkeypatch):
    """The other child's sums follow from the parent's; trees stay those of adding up every node."""
    table, labels = small_rows(400, 12)
    settings = BoostSettings(rounds=3, depth=4, step=0.3, row_share=0.8, feature_share=0.8, min_hessian=1.0)
    layout = layout_of(table)
    block, again = (block_of(table, labels, layout, 3) for _ in range(2))
    shares, added = [], boosting.WholeRound.added

    def counted(self, c, node, at, wanted, width):
        found = np.bincount(node[at], minlength=width)
        for n in wanted:
            shares.append((found[n], found[n ^ 1]))
        return added(self, c, node, at, wanted, width)

    monkeypatch.setattr(boosting.WholeRound, "added", counted)
    monkeypatch.setattr(boosting, "ENTRIES_AT_ONCE", 50)
    monkeypatch.setattr(boosting, "SUMS_AT_ONCE", 4)
    trees = [grow(block, layout, settings, number) for number in range(3)]
    assert len(shares) > 10 and all(own <= other for own, other in shares)
    plain = []
    for number in range(3):
        state = boosting.Round(again, layout, settings, number)
        grown = []
        for c in range(3):
            tree = boosting.Tree.empty(settings.depth)
            for level in range(settings.depth + 1):
                *sums, all_g, all_h = state.sums(c, level)
                splits = boosting.best_splits(*sums, all_g, all_h, layout, settings) if level < settings.depth else []
                if not boosting.set_level(tree, level, splits, all_g, all_h, settings):
                    break
                state.advance(c, tree, level)
            grown.append(tree)
        state.finish(grown)
        plain.append(grown)
    for found, expected in zip(trees, plain, strict=True):
        for a, b in zip(found, expected, strict=True):
            assert all((getattr(a, n) == getattr(b, n)).all() for n in vars(a))
    assert (block.scores == again.scores).all()


def test_nodes_split_by_one_feature_share_a_pass():
    """The rows of a level go to the left as node by node, and each feature's entries are read once."""
    table, labels = small_rows(300, 5)
    layout = layout_of(table)
    block = block_of(table, labels, layout, 3)
    state = boosting.Round(block, layout, SETTINGS, 0, False)
    tree = boosting.Tree.empty(3)
    state.nodes[0] = np.arange(300, dtype=np.int32) % 4 + 3
    tree.feature[3:7], tree.code[3:7], tree.absent_left[3:7] = [2, 2, 4, -1], layout.offsets[[2, 2, 4, 0]] + 1, [True, False, True, False]
    reads = []

    class Read(np.ndarray):
        def __getitem__(self, at):
            reads.append(at)
            return np.asarray(self)[at]

    codes = np.full(table.shape, -1)
    codes[block.entry_row, layout.feature_of[block.entry_code]] = block.entry_code
    block.entry_row = block.entry_row.view(Read)
    left = state.lefts(0, tree, 2)
    assert len(reads) == 2
    for row, node in enumerate(state.nodes[0]):
        if node < 6:
            code = codes[row, tree.feature[node]]
            assert left[row] == (tree.absent_left[node] if code < 0 else code <= tree.code[node])


def test_quick_rounds_run_more_at_once(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "CHUNK", 1)
    settings = BoostSettings(rounds=7, depth=3, step=0.3, min_hessian=1.0, bins=8)
    found = boost(rows, F.col("y"), 3, 9, settings, "k", path=str(tmp_path / "state"))
    assert sorted(p.name for p in (tmp_path / "state").glob("rounds-*")) == ["rounds-000000", "rounds-000001", "rounds-000003"]
    monkeypatch.setattr(boosting, "QUICK_SECONDS", 0)
    slow = boost(rows, F.col("y"), 3, 9, settings, "k", path=str(tmp_path / "slow"))
    assert len(list((tmp_path / "slow").glob("rounds-*"))) == 7 and trees_of(slow) == trees_of(found)

"""Array code of the isolation forest, run inside Spark tasks.

Trees follow Liu, Ting and Zhou (2008): a node splits a random non-constant
feature at a uniform point between its minimum and maximum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

EULER_GAMMA = 0.5772156649015329
TREES_PER_STEP = 64
ROWS_PER_STEP = 512


def mean_path(size):
    """Mean path length of an unsuccessful search among ``size`` rows."""
    size = np.asarray(size, dtype=np.float64)
    n = np.maximum(size, 2.0)
    mean = 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n
    return np.where(size > 1, mean, 0.0)


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """Well spread 64-bit order of row keys, another one for every salt."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flat_list(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenated values of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, column.flatten().to_numpy(zero_copy_only=False)


class SparseRows:
    """Rows of sparse features, as two list columns hold them."""

    def __init__(self, indices, values):
        lengths, self.cols = flat_list(indices)
        _, self.vals = flat_list(values)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number (within ``rows``), feature and value of every stored entry."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), lengths)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(self.starts[rows], lengths) + within
        return owner, self.cols[at], self.vals[at]

    def dense(self, rows: np.ndarray, used: np.ndarray | None = None):
        """Matrix of ``rows`` over the sorted features ``used`` (those present by default)."""
        owner, cols, vals = self.take(rows)
        if used is None:
            used = np.unique(cols)
        matrix = np.zeros((len(rows), max(len(used), 1)))
        if len(used):
            at = np.minimum(np.searchsorted(used, cols), len(used) - 1)
            hit = used[at] == cols
            matrix[owner[hit], at[hit]] = vals[hit]
        return matrix, used


def grow_tree(sample: np.ndarray, max_depth: int, rng: np.random.Generator) -> dict:
    """One tree, grown level by level; every level splits all its nodes at once."""
    count = len(sample)
    room = max(2 * count - 1, 1)
    feature = np.full(room, -1, dtype=np.int32)
    threshold = np.full(room, np.inf)
    left = np.arange(room, dtype=np.int32)
    size = np.zeros(room, dtype=np.int32)
    depth = np.zeros(room, dtype=np.int32)
    size[0], nodes = count, 1
    # ``active`` nodes own consecutive runs of ``rows``, of ``counts`` rows each.
    rows = np.arange(count)
    active, counts = np.array([0]), np.array([count])
    if count < 2:
        active = active[:0]
    for level in range(max_depth):
        if not len(active):
            break
        starts = np.cumsum(counts) - counts
        part = sample[rows]
        low = np.minimum.reduceat(part, starts, axis=0)
        high = np.maximum.reduceat(part, starts, axis=0)
        varies = high > low
        options = varies.sum(axis=1)
        pick, where = rng.random(len(active)), rng.random(len(active))
        splits = options > 0
        nth = np.floor(pick * options).astype(np.int64)
        chosen = (np.cumsum(varies, axis=1) > nth[:, None]).argmax(axis=1)
        node = np.arange(len(active))
        lo, hi = low[node, chosen], high[node, chosen]
        cut = lo + where * (hi - lo)
        cut = np.where(cut <= lo, np.nextafter(lo, hi), cut)

        born = nodes
        child = np.zeros(len(active), dtype=np.int64)
        child[splits] = born + 2 * np.arange(splits.sum())
        parents = active[splits]
        feature[parents], threshold[parents] = chosen[splits], cut[splits]
        left[parents] = child[splits]

        owner = np.repeat(node, counts)
        right = part[np.arange(len(rows)), chosen[owner]] >= cut[owner]
        moves = splits[owner]
        target = (child[owner] + right)[moves]
        rows = rows[moves]
        order = np.argsort(target, kind="stable")
        rows, target = rows[order], target[order]
        sizes = np.bincount(target - born, minlength=2 * len(parents))
        nodes = born + len(sizes)
        size[born:nodes], depth[born:nodes] = sizes, level + 1
        grows = sizes > 1
        rows = rows[grows[target - born]]
        active, counts = born + np.flatnonzero(grows), sizes[grows]
    return {
        "node": np.arange(nodes, dtype=np.int32),
        "feature": feature[:nodes],
        "threshold": threshold[:nodes],
        "left": left[:nodes],
        "size": size[:nodes],
        "path_length": depth[:nodes] + mean_path(size[:nodes]),
    }


def grow_trees(
    table: pa.Table, trees: range, group_hash: int, max_samples: int, seed: int
) -> dict:
    """The trees of one chunk; each draws its own sample, without repeats, from the pool."""
    keys = table["sample_key"].to_numpy()
    pool = SparseRows(table["indices"], table["values"])
    parts = []
    for tree in trees:
        order = mix(keys, seed * 1_000_003 + tree)
        drawn = np.arange(len(keys))
        if len(keys) > max_samples:
            drawn = np.argpartition(order, max_samples)[:max_samples]
        drawn = drawn[np.argsort(order[drawn])]
        sample, used = pool.dense(drawn)
        varies = sample.max(axis=0) > sample.min(axis=0)
        if varies.any():
            sample, used = np.ascontiguousarray(sample[:, varies]), used[varies]
        depth = int(np.ceil(np.log2(max(len(drawn), 2))))
        grown = grow_tree(sample, depth, np.random.default_rng([seed, group_hash, tree]))
        splits = grown["feature"] >= 0
        grown["feature"][splits] = used[grown["feature"][splits]]
        grown["tree"] = np.full(len(splits), tree, dtype=np.int32)
        grown["sample_size"] = np.full(len(splits), len(drawn), dtype=np.int32)
        parts.append(grown)
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


class Forest:
    """Trees of one group, packed for scoring."""

    def __init__(self, nodes: dict[str, np.ndarray]):
        order = np.lexsort((nodes["node"], nodes["tree"]))
        tree = nodes["tree"][order]
        roots = np.flatnonzero(np.diff(tree, prepend=tree[0] - 1))
        offset = np.repeat(roots, np.diff(roots, append=len(tree)))
        feature = nodes["feature"][order]
        self.used = np.unique(feature[feature >= 0])
        self.feature = np.searchsorted(self.used, np.maximum(feature, 0)).astype(np.intp)
        self.feature[feature < 0] = 0
        self.threshold = nodes["threshold"][order]
        self.left = (nodes["left"][order] + offset).astype(np.intp)
        self.path_length = nodes["path_length"][order]
        self.roots = roots.astype(np.intp)
        self.scale = mean_path(nodes["sample_size"][order][roots]).mean()

    def score(self, indices, values) -> np.ndarray:
        """``2 ** (-mean path / expected path)`` for every row."""
        rows = SparseRows(indices, values)
        if self.scale == 0:
            return np.ones(len(rows))
        scores = [
            self._score_block(rows, np.arange(start, min(start + ROWS_PER_STEP, len(rows))))
            for start in range(0, len(rows), ROWS_PER_STEP)
        ]
        return np.concatenate(scores) if scores else np.zeros(0)

    def _score_block(self, rows: SparseRows, block: np.ndarray) -> np.ndarray:
        # Few rows and trees at a time, so that the matrices stay in the cache.
        matrix, _ = rows.dense(block, self.used)
        flat = matrix.ravel()
        base = (np.arange(len(block)) * matrix.shape[1])[:, None]
        total = np.zeros(len(block))
        for start in range(0, len(self.roots), TREES_PER_STEP):
            roots = self.roots[start : start + TREES_PER_STEP]
            node = np.repeat(roots[None, :], len(block), axis=0)
            while True:
                # A leaf points at itself and its threshold is infinite.
                seen = flat.take(base + self.feature.take(node, mode="clip"), mode="clip")
                step = self.left.take(node, mode="clip")
                step += seen >= self.threshold.take(node, mode="clip")
                if np.array_equal(step, node):
                    break
                node = step
            total += self.path_length.take(node).sum(axis=1)
        return np.exp2(-(total / len(self.roots)) / self.scale)

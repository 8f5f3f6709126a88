"""Second-order boosted trees on histograms, with the penalties that Spark's own boosting does not have.

Features are binned once (at most ``BINS`` quantile cuts each). A level of a tree is one job: each task adds up first and
second derivatives per (node, feature, bin) over its rows, the tables of a node, of fixed size, are added up where they are shuffled to, and the split of the largest
regularised gain is taken there; the driver gets splits alone. Rows never leave their partition. Rows that fit one task (``PART_ROWS``) need no jobs
between the levels: there ``FOLD_ALONE`` trees are one job, and of two children only the one of fewer rows is added up, the other is what its parent has left. More than
``ALONE_ROWS`` of them are shared by processes of that task, one per core of its executor, which add up their tables of every level in shared memory.
Derivatives are rounded to a unit in which all sums are exact, so neither this nor the layout of rows changes a tree. Row blocks,
with their margins, are kept in the shared checkpoint folder and brought up to date every ``FOLD`` trees, so a lost
executor costs its blocks and a few trees.

With ``G`` and ``H`` the sums of derivatives in a leaf, its weight minimises ``G w + (H + reg_lambda) w^2 / 2 + alpha |w|``, cut to
``[-delta, delta]`` if ``delta`` is set. A split must lower twice that objective by more than ``gain`` and leave at least ``leaf`` of H on either side.
"""

from __future__ import annotations

import mmap
import os
import pickle
import sys
import traceback
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avalista.session import cut_lineage, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # task functions travel with the job

c = F.col
BINS = 256
BLOCK_ROWS = 1 << 13
FEW_CELLS = 3
FEW_NODES = 64
PART_ROWS = 10 << 20  # rows that one task takes rather than many a job per level
WORTH_ROWS = 1 << 14  # rows that are worth a task where they are prepared
ALONE_ROWS = 1 << 16  # rows that one process takes rather than many
FOLD, FOLD_ALONE = 10, 100
MOST_CODES = 1 << 12  # codes of columns that are added up as one
ADD_ROWS = 1 << 16
FAN_IN = 64  # tasks whose tables are added up


@dataclass
class Tree:
    """Nodes of a tree as arrays; ``feature`` is -1 in a leaf, rows with ``x <= threshold`` go left."""

    feature: np.ndarray
    threshold: np.ndarray
    cut: np.ndarray  # the threshold's place among the feature's cuts
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def walk(self, x: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The node in which each row ends; ``x`` has a row per feature and is compared with ``limits`` (thresholds of values, or cuts of bins)."""
        inner, n = np.flatnonzero(self.feature >= 0), x.shape[1]  # parents stand before their children
        if len(inner) <= FEW_NODES:
            node = np.zeros(n, np.min_scalar_type(len(self.feature)))
            for at in inner:
                _descend(node, x, at, self.feature[at], limits[at], self.left[at])
            return node
        node, row, level = np.zeros(n, np.int64), np.arange(n), np.zeros(len(self.feature), int)
        for at in inner:
            level[[self.left[at], self.right[at]]] = level[at] + 1
        for _ in range(level.max()):
            node = _step(node, x, row, self.feature, limits, self.left)
        return node

    def of_bins(self, x: np.ndarray) -> np.ndarray:
        return self.walk(x, self.cut)

    def of_values(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.walk(x, self.threshold)]


def _descend(node: np.ndarray, x: np.ndarray, at: int, feature: int, limit: float, left: int):
    """Move the rows in node ``at`` to its children, which are numbered behind it, the right one after the left one."""
    node += (node == at) * ((x[feature] > limit) + node.dtype.type(left - at))


def _step(node: np.ndarray, x: np.ndarray, row: np.ndarray, feature: np.ndarray, limits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """One level down for all rows at once, for trees of many nodes; rows in leaves stay."""
    inner = feature[node] >= 0
    return np.where(inner, left[node] + (x[feature[node], row] > limits[node]), node)


class BoostedTrees(Model, MLReadable, MLWritable):
    """A fitted model. Adds ``probability`` (a vector, as Spark's classifiers do) or the column ``predictionCol``."""

    def __init__(self, trees: list[Tree], step: float, base: float, width: int, classifier: bool, prediction: str = "prediction"):
        super().__init__()
        self.trees, self.step, self.base, self.width, self.classifier, self.prediction = trees, step, base, width, classifier, prediction

    def setPredictionCol(self, name: str) -> BoostedTrees:
        self.prediction = name
        return self

    @property
    def featureImportances(self):
        """Share of each feature in the gain of all splits."""
        total = np.zeros(self.width)
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, x = np.full(len(x), self.base), np.ascontiguousarray(x.T)
        for t in self.trees:
            out += self.step * t.of_values(x)
        return out

    def _transform(self, rows: DataFrame) -> DataFrame:
        trees = BoostedTrees(self.trees, self.step, self.base, self.width, self.classifier).margins

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(trees(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        out = rows.withColumn("_margin", margin(vector_to_array("features")))
        if not self.classifier:
            return out.withColumnRenamed("_margin", self.prediction)
        one = 1 / (1 + F.exp(-c("_margin")))
        return out.withColumn("probability", array_to_vector(F.array(1 - one, one))).withColumn(self.prediction, (c("_margin") > 0).cast("double")).drop("_margin")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        m = self.model
        extra = {"step": m.step, "base": m.base, "width": m.width, "classifier": m.classifier, "prediction": m.prediction}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra)
        size = [len(t.feature) for t in m.trees]
        columns = {"tree": np.repeat(np.arange(len(size)), size), "node": np.concatenate([np.arange(n) for n in size]) if size else np.zeros(0, int)}
        columns |= {k: np.concatenate([getattr(t, k) for t in m.trees]) if size else np.zeros(0) for k in Tree.__dataclass_fields__}
        self.sparkSession.createDataFrame(pa.table(columns)).coalesce(1).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.parquet(f"{path}/nodes").orderBy("tree", "node").toArrow()
        columns = {k: nodes[k].to_numpy() for k in ("tree", *Tree.__dataclass_fields__)}
        tree = columns.pop("tree")
        cuts = np.flatnonzero(np.diff(tree)) + 1
        parts = {k: np.split(v, cuts) for k, v in columns.items()}
        trees = [Tree(**{k: v[i] for k, v in parts.items()}) for i in range(len(cuts) + 1)] if len(tree) else []
        out = BoostedTrees(trees, meta["step"], meta["base"], meta["width"], meta["classifier"], meta["prediction"])
        return out._resetUid(meta["uid"])


def feature_cuts(vectors: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """For each position of ``features`` its distinct inner quantiles, from one aggregate."""
    width = len(vectors.select("features").head()["features"])
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    x = vectors.select(vector_to_array("features").alias("x"))
    row = x.agg(*[F.percentile_approx(c("x")[i], shares, 10 * bins).alias(str(i)) for i in range(width)]).first()
    return [np.unique(np.array(q, float)) for q in row]


def _blocks(vectors: DataFrame, label: str, weight: str, cuts: list[np.ndarray], base: float) -> DataFrame:
    """id, n, x (bins, one byte each, feature by feature), y, w and m (margins): one row per block of rows."""

    def tasks(batches):
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = part.column(0).flatten().to_numpy().reshape(part.num_rows, len(cuts))
                bins = np.stack([np.searchsorted(q, x[:, i], side="left") for i, q in enumerate(cuts)]).astype(np.uint8)
                y, w = (part.column(i).to_numpy().astype(float) for i in (1, 2))
                m = np.full(len(y), base)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(TaskContext.get().partitionId() << 32) + number]), pa.array([part.num_rows]), *[pa.array([v.tobytes()], pa.binary()) for v in (bins, y, w, m)]],
                    ["id", "n", "x", "y", "w", "m"])
                number += 1

    rows = vectors.select(vector_to_array("features").alias("x"), c(label).cast("double").alias("y"), c(weight).cast("double").alias("w"))
    return cut_lineage(rows.mapInArrow(tasks, "id bigint, n bigint, x binary, y binary, w binary, m binary"))


def _with_margins(blocks: DataFrame, trees: list[Tree], step: float) -> DataFrame:
    def tasks(batches):
        for batch in batches:
            margins = [_Block(batch, i, trees, step).m.tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(margins, pa.binary())], batch.schema.names)

    return cut_lineage(blocks.mapInArrow(tasks, blocks.schema))


def _derivatives(y: np.ndarray, w: np.ndarray, m: np.ndarray, classifier: bool) -> tuple[np.ndarray, np.ndarray]:
    if not classifier:
        return w * (m - y), w
    p = 1 / (1 + np.exp(-m))
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)


def _drawn(seed: list[int], block: int, n: int, share: float) -> np.ndarray:
    return np.random.default_rng([*seed, block]).random(n) < share


class _Block:
    """A block of rows: bins, labels, weights, margins, and the node each row is in. ``trees`` are those not yet in the margins."""

    def __init__(self, batch, i: int, trees: list[Tree], step: float):
        self.id = batch.column(0)[i].as_py()
        self.y, self.w, m = (np.frombuffer(batch.column(j)[i].as_py()) for j in (3, 4, 5))
        self.x = np.frombuffer(batch.column(2)[i].as_py(), np.uint8).reshape(-1, len(self.y))
        self.beyond = None
        self.m = m + step * sum(t.value[t.of_bins(self.x)] for t in trees)

    def start(self, classifier: bool, share: float, seed: list[int], units: tuple[float, float]):
        """Derivatives, in units, of the rows drawn for a tree; all rows are in its root."""
        g, h = _derivatives(self.y, self.w, self.m, classifier)
        drawn = _drawn(seed, self.id, len(g), share) if share < 1 else np.ones(len(g), bool)
        self.drawn, self.derivatives = drawn, [np.rint(v / u) for v, u in zip((g, h), units)]
        self.node = np.zeros(len(self.y), np.int64)
        self.cells = None

    def _sparse(self, used: np.ndarray, first: np.ndarray):
        """Of features with few cells only the rows beyond the first cell are listed, as most rows of a category's own feature are in it."""
        size = np.diff(first)
        if self.beyond is None:
            few = np.flatnonzero(size <= FEW_CELLS)
            at, row = np.nonzero(self.x[few])
            self.beyond = row, few[at], self.x[few[at], row]
        row, feature, x = self.beyond
        start = np.full(len(size), -1)
        start[used] = np.cumsum(size[used]) - size[used]
        ok = np.flatnonzero((start[feature] >= 0) & self.drawn[row])
        row = row[ok]
        self.cells = row, start[feature[ok]] + x[ok], [v[row] for v in self.derivatives]

    def add(self, total: np.ndarray, place: np.ndarray, used: np.ndarray, first: np.ndarray):
        """Add the derivatives of the drawn rows in the nodes that have a place to ``total``, (places, cells of the used features, 2)."""
        if self.cells is None:
            self._sparse(used, first)
        places, n_cells = total.shape[:2]
        all_ = np.where(self.drawn, place[self.node], -1)
        row, cell, derivatives = self.cells
        slot = all_[row]
        ok = np.flatnonzero(slot >= 0)
        cell = slot[ok] * n_cells + cell[ok]
        beyond = [np.bincount(cell, v[ok], places * n_cells).reshape(places, n_cells) for v in derivatives]
        rows = np.flatnonzero(all_ >= 0)
        slot, derivatives, lo = all_[rows], [v[rows] for v in self.derivatives], 0
        whole = [np.bincount(slot, v, places) for v in derivatives]
        for f in used:
            size = int(first[f + 1] - first[f])
            if size <= FEW_CELLS:
                for k in (0, 1):
                    beyond[k][:, lo] = whole[k]
            else:
                cell = slot * size + self.x[f][rows]
                for k, v in enumerate(derivatives):
                    beyond[k][:, lo : lo + size] = np.bincount(cell, v, places * size).reshape(places, size)
            lo += size
        for k in (0, 1):
            total[:, :, k] += beyond[k]


def _first_cells(total: np.ndarray, used: np.ndarray, first: np.ndarray):
    """Of features with few cells the first one holds the whole node's sums until all blocks are added; leave there what the others do not have."""
    lo = 0
    for f in used:
        size = int(first[f + 1] - first[f])
        if size <= FEW_CELLS:
            total[:, lo] -= total[:, lo + 1 : lo + size].sum(1)
        lo += size


class _Rows:
    """All rows of one task by column, for trees that need no other task.

    Columns that agree bin by bin are added up once; features that are never beyond their first cell in the same row share one column of codes; and columns
    of few codes are joined into one, whose table is then added up along the others. Sums are exact, so the trees are the same.
    """

    def __init__(self, blocks: list[_Block], first: np.ndarray, done: list[Tree], step: float):
        self.ids, self.sizes = [b.id for b in blocks], [len(b.y) for b in blocks]
        self.y, self.w, self.m = (np.concatenate([getattr(b, k) for b in blocks]) for k in "ywm")
        self.x = np.concatenate([b.x for b in blocks], axis=1)
        self.m = self.m + step * sum(t.value[t.of_bins(self.x)] for t in done)
        self.first = first
        self._join(self._columns())

    def _columns(self) -> list[tuple]:
        """(codes, their number, members): a feature stands with its first code, and with whether its first cell is the rest of the rows."""
        size, plain, shared = np.diff(self.first), [], []
        for f, n in enumerate(size.tolist()):
            x = self.x[f]
            if n > FEW_CELLS:
                same = next((k for k in plain if k[1] == n and np.array_equal(k[0], x)), None)
                if same:
                    same[2].append((f, 0, False))
                else:
                    plain.append((x, n, [(f, 0, False)]))
                continue
            beyond = x > 0
            at = next((i for i, (codes, k, _) in enumerate(shared) if k + n - 1 <= 256 and not (beyond & (codes > 0)).any()), None)
            if at is None:
                at = len(shared)
                shared.append((np.zeros(len(x), np.uint8), 1, []))
            codes, k, members = shared[at]
            shared[at] = np.where(beyond, x + np.uint8(k - 1), codes), k + n - 1, [*members, (f, k, True)]
        return plain + shared

    def _join(self, columns: list[tuple]):
        """Groups of columns: (codes, numbers of codes, members of each column)."""
        self.groups = []
        for codes, n, members in sorted(columns, key=lambda k: -k[1]):
            at = next((i for i, (_, sizes, _) in enumerate(self.groups) if np.prod(sizes) * n <= MOST_CODES), None)
            if at is None:
                self.groups.append((codes.astype(np.uint16), [n], [members]))
            else:
                joined, sizes, all_ = self.groups[at]
                self.groups[at] = joined * np.uint16(n) + codes, [*sizes, n], [*all_, members]

    def start(self, classifier: bool, share: float, seed: list[int], units: tuple[float, float], used: np.ndarray, depth: int):
        """Derivatives, in units, and codes of the rows drawn for a tree; all rows are in its root."""
        g, h = _derivatives(self.y, self.w, self.m, classifier)
        drawn = np.arange(len(g))
        if share < 1:
            drawn = np.flatnonzero(np.concatenate([_drawn(seed, i, n, share) for i, n in zip(self.ids, self.sizes)]))
        self.begin(drawn, [np.rint(v[drawn] / u) for v, u in zip((g, h), units)], used, depth)

    def begin(self, drawn: np.ndarray, derivatives: list[np.ndarray], used: np.ndarray, depth: int):
        self.drawn, self.derivatives = drawn, derivatives
        self.node = np.zeros(len(self.y), np.min_scalar_type(2 ** (depth + 1)))
        self.start_of = np.full(len(self.first) - 1, -1)
        size = np.diff(self.first)[used]
        self.start_of[used] = np.cumsum(size) - size
        self.taken = [(codes[drawn], sizes, members) for codes, sizes, members in self.groups if any(self.start_of[f] >= 0 for column in members for f, *_ in column)]

    def go_down(self, nodes: list[dict], among: list[int]):
        """Move the rows of these nodes, if split, into their children."""
        split = [at for at in among if "feature" in nodes[at]]
        if len(split) > FEW_NODES:
            feature, cut, left = (np.array([n.get(k, other) for n in nodes]) for k, other in (("feature", -1), ("cut", 0), ("left", 0)))
            self.node = _step(self.node, self.x, np.arange(len(self.node)), feature, cut, left).astype(self.node.dtype)
            return
        for at in split:
            _descend(self.node, self.x, at, nodes[at]["feature"], nodes[at]["cut"], nodes[at]["left"])

    def sums(self, place: np.ndarray, places: int, cells: int) -> np.ndarray:
        """The derivatives of the drawn rows in the nodes that have a place, (places, cells of the used features, 2)."""
        total = np.zeros((places, cells, 2))
        slot = place[self.node[self.drawn]]
        rows = np.flatnonzero(slot >= 0)
        tables = [np.zeros((2, places * int(np.prod(sizes)))) for _, sizes, _ in self.taken]
        for lo in range(0, len(rows), ADD_ROWS):
            part = rows[lo : lo + ADD_ROWS]
            at, derivatives = slot[part], [v[part] for v in self.derivatives]
            for (codes, sizes, _), table in zip(self.taken, tables):
                n = int(np.prod(sizes))
                cell = at * n + codes[part]
                for k, v in enumerate(derivatives):
                    table[k] += np.bincount(cell, v, places * n)
        for (_, sizes, columns), table in zip(self.taken, tables):
            table = table.reshape(2, places, *sizes)
            whole = table.reshape(2, places, -1).sum(2)
            for axis, members in enumerate(columns):
                others = tuple(i + 2 for i in range(len(sizes)) if i != axis)
                column = table.sum(others) if others else table
                for f, code, rest in members:
                    lo, n = int(self.start_of[f]), int(self.first[f + 1] - self.first[f])
                    if lo >= 0:
                        found = column[:, :, code : code + n - rest]
                        total[:, lo + rest : lo + n] = found.transpose(1, 2, 0)
                        if rest:
                            total[:, lo] = (whole - found.sum(2)).T
        return total


class _Crew:
    """Processes of one task that do the same work, each with its share of the rows, and add up their tables.

    They wait for each other through pipes; if one ends, the pipes close, and the others fail. Tables lie in memory that all share, in two turns, so that
    nobody writes over what another one still reads.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most, self.turn, self.rank, self.children = size, most, 0, 0, []
        self.shared = np.frombuffer(mmap.mmap(-1, 2 * size * most * 8)).reshape(2, size, most)
        up, down = [[os.pipe() for _ in range(size)] for _ in range(2)]
        for rank in range(1, size):
            pid = os.fork()
            if pid == 0:
                self.rank = rank
                break
            self.children.append(pid)
        own = range(1, size) if self.rank == 0 else [self.rank]
        self.into = [(down if self.rank == 0 else up)[i][1] for i in own]
        self.out = [(up if self.rank == 0 else down)[i][0] for i in own]
        for end in {x for pipe in up + down for x in pipe}.difference(self.into, self.out):
            os.close(end)

    def _wait(self):
        for step in (self._hear, self._tell) if self.rank == 0 else (self._tell, self._hear):
            step()

    def _hear(self):
        for end in self.out:
            if not os.read(end, 1):
                raise RuntimeError("a process that grows trees has ended")

    def _tell(self):
        for end in self.into:
            os.write(end, b".")

    def of_all(self, total: np.ndarray) -> np.ndarray:
        """The sum of all processes' tables. Sums are exact, so all get the same."""
        if self.size == 1:
            return total
        tables, self.turn = self.shared[self.turn], 1 - self.turn
        tables[self.rank, : total.size] = total.ravel()
        self._wait()
        return tables[:, : total.size].sum(0).reshape(total.shape)

    def end(self):
        for end in self.into + self.out:
            os.close(end)
        for pid in self.children:
            os.waitpid(pid, 0)


def _grow(rows: _Rows, used: np.ndarray, first: np.ndarray, depth: int, units: np.ndarray, p: dict, of_all=lambda total: total) -> list[dict]:
    """Nodes of one tree over all rows; ``of_all`` adds up the tables of those that have a share of them."""
    cells = int(sum(first[f + 1] - first[f] for f in used))
    nodes, open_, summed, tables = [{"sums": None}], [0], [0], {}
    for _ in range(depth):
        place = np.full(len(nodes), -1)
        place[summed] = np.arange(len(summed))
        tables |= zip(summed, of_all(rows.sums(place, len(summed), cells)))
        for at in open_:
            if at not in tables:
                parent, other = nodes[at]["parent"], nodes[at]["other"]
                tables[at] = tables[parent] - tables[other]
        tables = {at: tables[at] for at in open_}
        found = best_splits(np.stack([tables[at] for at in open_]) * units, used, first, p)
        if nodes[0]["sums"] is None:
            nodes[0]["sums"] = tables[0][: first[used[0] + 1] - first[used[0]]].sum(0) * units
        among = open_
        open_, summed = _split(nodes, open_, found)
        if not open_:
            return nodes
        rows.go_down(nodes, among)
    return nodes


def _split(nodes: list[dict], open_: list[int], found: list) -> tuple[list[int], list[int]]:
    """Give the nodes their children; returns all of them, and of each two the one of fewer rows."""
    following, fewer = [], []
    for at, split in zip(open_, found):
        if split is not None:
            gain, f, k, left, right = split
            children = len(nodes), len(nodes) + 1
            nodes[at] |= {"feature": f, "cut": k, "gain": gain, "left": children[0], "right": children[1]}
            nodes += [{"sums": s, "parent": at, "other": o} for s, o in zip((left, right), children[::-1])]
            following += children
            fewer.append(children[int(right[1] < left[1])])
    return following, fewer


def _grow_alone(blocks: DataFrame, cores: int, cuts: list[np.ndarray], first: np.ndarray, done: list[Tree], draws: list, units: tuple, step: float, depth: int, share: float,
                classifier: bool, p: dict) -> list[Tree]:
    """The trees of these draws, that follow the ones already ``done``, in one task of as many processes as ``cores``."""
    penalties = (p["alpha"], p["reg_lambda"], p["delta"])

    def grown(mine, crew):
        rows, trees = _Rows([_Block(batch, i, [], step) for batch, i in mine], first, done, step), []
        for seed, used in draws:
            rows.start(classifier, share, seed, units, used, depth)
            trees.append(_tree(_grow(rows, used, first, depth, np.array(units), p, crew.of_all), cuts, penalties))
            rows.m = rows.m + step * trees[-1].value[rows.node]
        return trees

    def tasks(batches):
        all_ = [(batch, i) for batch in batches for i in range(batch.num_rows)]
        crew = _Crew(min(cores, len(all_)), 2 ** max(0, depth - 1) * int(first[-1]) * 2)
        try:
            trees = grown(all_[crew.rank :: crew.size], crew)
        except BaseException:
            if crew.rank == 0:
                raise
            traceback.print_exc()
            os._exit(1)
        finally:
            if crew.rank == 0:
                crew.end()
        if crew.rank:
            os._exit(0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([vars(t) for t in trees])], pa.binary())], ["trees"])

    found = blocks.coalesce(1).mapInArrow(tasks, "trees binary").collect()
    return [Tree(**t) for t in pickle.loads(found[0]["trees"])]


def _executor_cores(spark) -> int:
    context = spark.sparkContext
    return context.defaultParallelism if context.master.startswith("local[") else int(spark.conf.get("spark.executor.cores", "1"))


def _best_of_level(blocks: DataFrame, trees: list[Tree], tree: Tree, open_: list[int], used: np.ndarray, first: np.ndarray, units: tuple, step: float, share: float,
                   classifier: bool, seed: list[int], p: dict, parts: int) -> list[tuple]:
    """The sums of derivatives and the best split of every open node. ``trees`` are those not yet in the margins."""
    cells = int(sum(first[f + 1] - first[f] for f in used))
    place = np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))

    def tasks(batches):
        total = np.zeros((len(open_), cells, 2))
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, trees, step)
                block.start(classifier, share, seed, units)
                block.node = tree.of_bins(block.x)
                block.add(total, place, used, first)
        _first_cells(total, used, first)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(open_)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["node", "sums"])

    def add(batches):
        tables = {}
        for batch in batches:
            for node, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                tables[node] = tables.get(node, 0) + np.frombuffer(sums.as_py()).reshape(1, cells, 2)
        for node, sums in tables.items():
            sums = sums * np.array(units)
            found = sums[0, : first[used[0] + 1] - first[used[0]]].sum(0), best_splits(sums, used, first, p)[0]
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], ["node", "found"])

    tables = blocks.mapInArrow(tasks, "node int, sums binary").repartition(min(parts, len(open_)), "node")
    rows = tables.mapInArrow(add, "node int, found binary").collect()
    return [pickle.loads(r["found"]) for r in sorted(rows, key=lambda r: r["node"])]


def leaf_weight(g, h, alpha: float, reg_lambda: float, delta: float):
    w = -np.sign(g) * np.maximum(np.abs(g) - alpha, 0) / np.maximum(h + reg_lambda, 1e-300)
    return np.clip(w, -delta, delta) if delta else w


def worth(g, h, alpha: float, reg_lambda: float, delta: float):
    """Twice what the best weight of a leaf takes off the objective."""
    w = leaf_weight(g, h, alpha, reg_lambda, delta)
    return -(2 * g * w + (h + reg_lambda) * w * w + 2 * alpha * np.abs(w))


def best_splits(sums: np.ndarray, used: np.ndarray, first: np.ndarray, p: dict) -> list:
    """For each node (gain, feature, cut, sums left, sums right) of its best split, or None; ``sums`` is (nodes, cells of the used features, 2). Ties go to the first feature and cut."""
    penalties = (p["alpha"], p["reg_lambda"], p["delta"])
    size = np.array([first[f + 1] - first[f] for f in used])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    whole = sums[:, : size[0]].sum(1)[:, None]
    left = sums.copy()
    for lo, n in zip(start[size > 2], size[size > 2]):
        np.cumsum(sums[:, lo : lo + n], axis=1, out=left[:, lo : lo + n])
    right = whole - left
    fits = (left[..., 1] >= max(p["leaf"], 1e-12)) & (right[..., 1] >= max(p["leaf"], 1e-12))
    fits[:, start + size - 1] = False  # nothing is right of the last cell
    gains = worth(left[..., 0], left[..., 1], *penalties) + worth(right[..., 0], right[..., 1], *penalties) - worth(whole[..., 0], whole[..., 1], *penalties)
    gains = np.where(fits, gains, -np.inf)
    found = []
    for i, tops in enumerate(np.maximum.reduceat(gains, start, axis=1).tolist()):
        best = None
        for j, top in enumerate(tops):
            if top > max(p["gain"], 1e-12) and (best is None or top > tops[best] * (1 + 1e-12)):
                best = j
        if best is None:
            found.append(None)
        else:
            k = int(gains[i, start[best] : start[best] + size[best]].argmax())
            found.append((tops[best], int(used[best]), k, left[i, start[best] + k], right[i, start[best] + k]))
    return found


def fit_boosted(vectors: DataFrame, label: str, weight: str, classifier: bool, trees: int, step: float, depth: int, rows: float = 1.0, columns: float = 1.0,
                gain: float = 0.0, leaf: float = 1.0, alpha: float = 0.0, reg_lambda: float = 1.0, delta: float = 0.0, seed: int = 0, bins: int = BINS) -> BoostedTrees:
    """Fit on ``features``. ``rows`` and ``columns`` are the shares drawn for each tree; a classifier starts from even odds, a regression from the weighted mean."""
    p, penalties = {"gain": gain, "leaf": leaf, "alpha": alpha, "reg_lambda": reg_lambda, "delta": delta}, (alpha, reg_lambda, delta)
    n_rows, mean, low, high, heaviest = vectors.agg(
        F.count("*"), F.sum(c(label) * c(weight)) / F.sum(weight), F.min(c(label).cast("double")), F.max(c(label).cast("double")), F.max(c(weight).cast("double"))).first()
    if not n_rows:
        raise ValueError("no rows to train on")
    base = 0.0 if classifier else float(mean)
    even = spread(vectors.select("features", label, weight), n_rows, min(WORTH_ROWS, max(1, PART_ROWS // 64)), FAN_IN)
    cuts = feature_cuts(even, bins)
    width, first = len(cuts), np.concatenate([[0], np.cumsum([len(q) + 1 for q in cuts])])
    blocks = _blocks(even, label, weight, cuts, base)
    steepest = 1.0 if classifier else 4 * max(high - base, base - low)
    units = tuple(2.0 ** (np.ceil(np.log2(max(n_rows * heaviest * x, 1e-300))) - 52) for x in (steepest, 1.0))  # sums stay below 2 ** 53 of them
    draws = [([seed, number], np.sort(np.random.default_rng([seed, number]).permutation(width)[: max(1, int(width * columns))])) for number in range(trees)]
    done: list[Tree] = []
    if n_rows <= PART_ROWS:
        cores = 1 if n_rows <= ALONE_ROWS else _executor_cores(vectors.sparkSession)
        for start in range(0, trees, FOLD_ALONE):
            done += _grow_alone(blocks, cores, cuts, first, done, draws[start : start + FOLD_ALONE], units, step, depth, rows, classifier, p)
        return BoostedTrees(done, step, base, width, classifier)
    parts, fresh = blocks.rdd.getNumPartitions(), []
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for number, (key, used) in enumerate(draws):
            if len(fresh) == FOLD:
                old, blocks = blocks, _with_margins(blocks, fresh, step).persist(StorageLevel.MEMORY_AND_DISK)
                blocks.count()
                old.unpersist()
                fresh = []
            nodes, open_ = [{"sums": None}], [0]
            for _ in range(depth):
                found = _best_of_level(blocks, fresh, _tree(nodes, cuts, penalties), open_, used, first, units, step, rows, classifier, key, p, parts)
                if nodes[0]["sums"] is None:
                    nodes[0]["sums"] = found[0][0]
                open_, _ = _split(nodes, open_, [split for _, split in found])
                if not open_:
                    break
            fresh.append(_tree(nodes, cuts, penalties))
            done.append(fresh[-1])
    finally:
        blocks.unpersist()
    return BoostedTrees(done, step, base, width, classifier)


def fit_forest(vectors: DataFrame, label: str, trees: int, depth: int, leaf: float, seed: int, bins: int = 32) -> BoostedTrees:
    """A forest of regression trees over all features: each is fitted to the rows as often as drawn with replacement, and their mean is predicted.

    With derivatives of the squared loss at the mean label the gain of a split is what it takes off the variance, and the weight of a leaf is its mean. The
    trees need nothing of each other: the processes of one task share its rows and grow some trees each. For ``PART_ROWS`` rows at most.
    """
    n_rows, mean, low, high = vectors.agg(F.count("*"), F.avg(c(label).cast("double")), F.min(c(label).cast("double")), F.max(c(label).cast("double"))).first()
    if not n_rows:
        raise ValueError("no rows to train on")
    even = spread(vectors.select("features", label, F.lit(1.0).alias("_weight")), n_rows, min(WORTH_ROWS, max(1, PART_ROWS // 64)), FAN_IN)
    cuts = feature_cuts(even, bins)
    width, first = len(cuts), np.concatenate([[0], np.cumsum([len(q) + 1 for q in cuts])])
    blocks, cores = _blocks(even, label, "_weight", cuts, mean), min(_executor_cores(vectors.sparkSession), trees)
    units = np.array([2.0 ** (np.ceil(np.log2(max(16 * n_rows * x, 1e-300))) - 52) for x in (high - low, 1.0)])
    p, used = {"gain": 1e-10 * (high - low) ** 2, "leaf": leaf, "alpha": 0.0, "reg_lambda": 0.0, "delta": 0.0}, np.arange(width)

    def tree(rows, number):
        times = np.concatenate([np.random.default_rng([seed, number, i]).poisson(1.0, n) for i, n in zip(rows.ids, rows.sizes)])
        drawn = np.flatnonzero(times)
        weights = times[drawn].astype(float)
        rows.begin(drawn, [np.rint(v / u) for v, u in zip((weights * (mean - rows.y[drawn]), weights), units)], used, depth)
        return vars(_tree(_grow(rows, used, first, depth, units, p), cuts, (0.0, 0.0, 0.0)))

    def tasks(batches):
        rows = _Rows([_Block(batch, i, [], 1.0) for batch in batches for i in range(batch.num_rows)], first, [], 1.0)
        children, found = [], {}
        for rank in range(1, cores):
            out, into = os.pipe()
            pid = os.fork()
            if pid == 0:
                try:
                    with os.fdopen(into, "wb") as file:
                        pickle.dump({k: tree(rows, k) for k in range(rank, trees, cores)}, file)
                    os._exit(0)
                except BaseException:
                    traceback.print_exc()
                    os._exit(1)
            os.close(into)
            children.append((pid, out))
        found |= {k: tree(rows, k) for k in range(0, trees, cores)}
        for pid, out in children:
            with os.fdopen(out, "rb") as file:
                grown = file.read()
            if os.waitpid(pid, 0)[1]:
                raise RuntimeError("a process that grows trees has ended")
            found |= pickle.loads(grown)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([found[k] for k in range(trees)])], pa.binary())], ["trees"])

    grown = blocks.coalesce(1).mapInArrow(tasks, "trees binary").collect()
    return BoostedTrees([Tree(**t) for t in pickle.loads(grown[0]["trees"])], 1 / trees, mean, width, False)


def _tree(nodes: list[dict], cuts: list[np.ndarray], penalties: tuple) -> Tree:
    inner = [n.get("feature", -1) for n in nodes]
    value = [0.0 if n["sums"] is None else float(leaf_weight(*n["sums"], *penalties)) for n in nodes]
    return Tree(
        np.array(inner), np.array([cuts[f][n["cut"]] if f >= 0 else 0.0 for f, n in zip(inner, nodes)]), np.array([n.get("cut", 0) for n in nodes]),
        np.array([n.get("left", 0) for n in nodes]), np.array([n.get("right", 0) for n in nodes]), np.array(value), np.array([n.get("gain", 0.0) for n in nodes]))

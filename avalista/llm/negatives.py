"""Hard negatives by threshold joins over an L2-bounded inverted index, thresholds lowered until every window is full.

Vectors are made integer (``floor(scale * x)``), so scores are exact inner products. An anchor's *positives* are the best rows of
its label; for each positive, its *negatives* are the best rows of other labels whose score lies in a window below the positive's.

One search works like this. Each window asks for the first ``k`` rows whose score lies between its ``lo`` and ``hi``.

1. Dimensions are ordered by their mean square, so that the first ones decide most of a score.
2. A task goes through its rows in chunks, and through the anchors in groups. For a group, ``tau`` is the smallest ``lo`` in units of its anchor's
   norm. A row's last dimensions, of a norm below ``tau``, are left out of the index: without a hit in the others the row can reach no
   window (Cauchy-Schwarz). Rows sorted by what they index make each dimension's posting list a run of rows.
3. Partial scores are added up over the lists, a few dimensions at a time. Rows that reach no anchor even with the product
   of the remaining norms are dropped on the way; pairs that still may are scored exactly at the end.
4. A task returns at most ``k`` rows a window, of those in it.

``lo`` starts where a bounded sample of rows suggests that some ``2k`` rows lie above it. After each search, windows with fewer than ``k``
rows are searched again just below, four times as deep by the sample, down to their own lower end. So the sample changes the work, not the result.

Anchors are the query set of this search: they are taken in blocks of some ``ANCHORS``, each searched against all rows. The driver holds a block,
its windows and counts, never the rows found, which are written to the shared scratch folder.

Odd cases: rows without id, label or vector, or with a null or non-finite component, take no part. Missing components of shorter vectors count as
zero. Repeated rows count as often as they stand, equal anchors once; rows of the anchor's own id are never its positives or negatives. Equal scores go
by ascending id. Scores are 64-bit. Empty tables and tables without an anchor give an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avalista.session import scratch_dir

ANCHORS = 1 << 13
GROUP = 256  # anchors that share an index
CHUNK = 1 << 12  # rows of a chunk
DIMS = 8  # dimensions added between two prunings
SAMPLE = 1 << 12
DEPTHS = 7  # thresholds that the sample gives a window before its lower end
TOP = 1 << 62


def vectors(rows: DataFrame, id_: str, label: Column, embedding: str, scale: float) -> DataFrame:
    """id, label and the integer vector of the rows that take part."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.select(F.col(id_).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(sound, whole).alias("vec")).filter(
        "id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")


def _matrix(column: pa.Array, order: np.ndarray) -> np.ndarray:
    """The vectors as rows, dimensions in order, missing ones zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    if len(sizes) and (sizes == len(order)).all():
        return values.reshape(-1, len(order))[:, order]
    out = np.zeros((len(sizes), len(order)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = place < len(order)
    out[row[known], place[known]] = values[known]
    return out[:, order]


def _tails(x: np.ndarray) -> np.ndarray:
    """Norms of x[:, d:] for every d up to the width, a little too large rather than too small."""
    squares = np.cumsum(np.square(x.astype(float))[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1)) * (1 + 1e-9)


def _reaching(q: np.ndarray, q_tails: np.ndarray, least: np.ndarray, x: np.ndarray, x_tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that may score ``least`` or more: all that do, and few others."""
    width = q.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        tau = np.nanmin(np.where(least > 0, least / q_tails[:, 0], 0)) if len(least) else 0
    length = (x_tails[:, :width] >= tau).sum(1) if tau > 0 else np.full(len(x), width)
    rows = np.argsort(-length, kind="stable")[: int((length > 0).sum())]
    end = np.minimum(-(-length[rows] // DIMS) * DIMS, width)  # whole steps are indexed
    score = np.zeros((len(q), len(rows)))
    slack = 1e-9 * q_tails[:, :1]
    for d in range(0, width, DIMS):
        n = int(np.searchsorted(-end, -d, side="left"))  # posting list of these dimensions: rows[:n]
        if n == 0:
            break
        to = min(d + DIMS, width)
        score[:, :n] += q[:, d:to].astype(float) @ x[rows[:n], d:to].astype(float).T
        reach = score[:, :n] + q_tails[:, to, None] * x_tails[rows[:n], to] + slack * x_tails[rows[:n], 0]
        stay = np.concatenate([(reach >= least[:, None]).any(0), np.ones(len(rows) - n, bool)])
        if stay.mean() < 0.75:
            rows, end, score = rows[stay], end[stay], score[:, stay]
    reach = score + q_tails[:, end] * x_tails[rows, end] + slack * x_tails[rows, 0]
    a, r = np.nonzero(reach >= least[:, None])
    return a, rows[r]


def _first(w: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each window."""
    order = np.lexsort((ids, -score, w))
    w = w[order]
    rank = np.arange(len(w)) - np.searchsorted(w, w, side="left")
    order = order[rank < k]
    return w[rank < k], score[order], ids[order]


def window_rows(rows: DataFrame, anchors: dict, windows: dict, order: np.ndarray, same: bool, k: int) -> DataFrame:
    """w, id, score: for each window the rows in it that may be among its first k, at most k from a task.

    ``anchors`` has arrays id, label, vec (dimensions in order); ``windows`` has w, anchor (place, ascending), lo and hi.
    """
    groups = []
    for g in range(0, len(anchors["id"]), GROUP):
        at = slice(*np.searchsorted(windows["anchor"], [g, g + GROUP]))
        if at.start == at.stop:
            continue
        w, of, lo, hi = (windows[c][at] for c in ("w", "anchor", "lo", "hi"))
        asked, first = np.unique(of, return_index=True)
        least = np.minimum.reduceat(lo, first).astype(float)
        groups.append((anchors["id"][asked], anchors["label"][asked], anchors["vec"][asked], least - 1e-9 * np.abs(least), w, lo, hi, first, np.diff(np.append(first, len(of)))))

    def tasks(batches):
        tails = [_tails(g[2]) for g in groups]
        found = [np.zeros(0, np.int64)] * 3

        def merge(parts):
            both = (np.concatenate(x) for x in zip(found, *parts))
            return list(_first(*both, k))

        new, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = _matrix(part.column(2), order)
                x_tails = _tails(x)
                for (a_id, a_label, q, least, w, lo, hi, first, count), q_tails in zip(groups, tails):
                    a, r = _reaching(q, q_tails, least, x, x_tails)
                    fits = (a_id[a] != ids[r]) & ((a_label[a] == labels[r]) == same)
                    a, r = a[fits], r[fits]
                    for i in range(0, len(a), 1 << 16):
                        a_, r_ = a[i : i + (1 << 16)], r[i : i + (1 << 16)]
                        score = np.einsum("ij,ij->i", q[a_], x[r_])
                        ends = np.cumsum(count[a_])  # every window of the anchor
                        pair = np.repeat(np.arange(len(a_)), count[a_])
                        at_w = np.arange(len(pair)) + np.repeat(first[a_] - (ends - count[a_]), count[a_])
                        inside = (score[pair] >= lo[at_w]) & (score[pair] <= hi[at_w])
                        pair, at_w = pair[inside], at_w[inside]
                        new.append((w[at_w], score[pair], ids[r_[pair]]))
                        size += len(pair)
                    if size > 1 << 20:
                        found, new, size = merge(new), [], 0
        found = merge(new)
        if len(found[0]):
            w, score, ids = found
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(ids), pa.array(score)], ["w", "id", "score"])

    return rows.mapInArrow(tasks, "w bigint, id bigint, score bigint")


def _depths(anchors: dict, windows: dict, sample: dict, n_rows: int, same: bool, k: int) -> np.ndarray:
    """For each window, thresholds in falling order: the sample's scores at depths that grow fourfold, then its lower end."""
    out = np.repeat(windows["lo"][:, None], DEPTHS + 1, axis=1)
    first = -(-2 * k * len(sample["id"]) // max(n_rows, 1)) + 1
    depth = first * 4 ** np.arange(DEPTHS) - 1
    for at in range(0, len(anchors["id"]), GROUP):
        scores = anchors["vec"][at : at + GROUP].astype(float) @ sample["vec"].astype(float).T
        for i in range(*np.searchsorted(windows["anchor"], [at, at + GROUP])):
            a = windows["anchor"][i]
            fits = (sample["id"] != anchors["id"][a]) & ((sample["label"] == anchors["label"][a]) == same)
            s = scores[a - at][fits]
            s = -np.sort(-s[(s >= windows["lo"][i]) & (s <= windows["hi"][i])])
            known = depth[depth < len(s)]
            out[i, : len(known)] = np.floor(s[known]).astype(np.int64)
    return out


def fill_windows(rows: DataFrame, anchors: dict, windows: dict, order: np.ndarray, sample: dict, n_rows: int, same: bool, k: int, path: str) -> DataFrame:
    """w, rank, id, score of the first k rows of every window; what searches find is written under ``path``."""
    spark = rows.sparkSession
    depths = _depths(anchors, windows, sample, n_rows, same, k)
    hi, left, step, wrote = windows["hi"].copy(), np.full(len(windows["hi"]), k), 0, False
    place = {w: i for i, w in enumerate(windows["w"].tolist())}
    open_ = np.flatnonzero(windows["lo"] <= hi)
    schema = "w bigint, id bigint, score bigint"
    while len(open_):
        lo = depths[open_, min(step, DEPTHS)]
        live = lo <= hi[open_]  # a tie of two depths leaves nothing between them
        asked = {"w": windows["w"][open_][live], "anchor": windows["anchor"][open_][live], "lo": lo[live], "hi": hi[open_][live]}
        if live.any():
            to, wrote = f"{path}/search-{step}", True
            window_rows(rows, anchors, asked, order, same, k).write.parquet(to)
            for row in spark.read.schema(schema).parquet(to).groupBy("w").count().collect():
                left[place[row["w"]]] -= row["count"]
        hi[open_] = np.minimum(hi[open_], lo - 1)
        open_ = open_[(left[open_] > 0) & (hi[open_] >= windows["lo"][open_])]
        step += 1
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if wrote else spark.createDataFrame([], schema)
    top = Window.partitionBy("w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("w", "rank", "id", "score")


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
                   id_: str = "vec_id", label: str | Column = "label", embedding: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. For each anchor and each of its first ``positives``, the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    spark = rows.sparkSession
    known = vectors(rows, id_, F.col(label) if isinstance(label, str) else label, embedding, scale)
    path = scratch_dir(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    n_rows, n_anchors, width = known.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("vec"))).first()
    if not n_anchors or not width:
        return spark.createDataFrame([], schema)
    draw = F.pmod(F.xxhash64("id", "vec"), F.lit(max(1, n_rows // SAMPLE))) == 0
    drawn = known.filter(draw).limit(2 * SAMPLE).toArrow()
    plain = np.arange(width)
    order = np.argsort(-np.square(_matrix(drawn["vec"], plain).astype(float)).sum(0), kind="stable") if drawn.num_rows else plain
    sides = lambda t: {"id": t["id"].to_numpy(), "label": t["label"].to_numpy(), "vec": _matrix(t["vec"], order)}
    sample = sides(drawn)

    blocks = math.ceil(n_anchors / ANCHORS)
    for b in range(blocks):
        mine = known.filter(F.col("id") % every == 0).filter(F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)) == b)
        anchors = sides(mine.distinct().orderBy("label", "id", "vec").toArrow())  # of a label together, as they share an index
        n = len(anchors["id"])
        if n == 0:
            continue
        place = np.arange(n)
        every_row = {"w": place, "anchor": place, "lo": np.full(n, -TOP), "hi": np.full(n, TOP)}
        best = fill_windows(known, anchors, every_row, order, sample, n_rows, True, positives, f"{path}/positives-{b}")
        best = best.orderBy("w", "rank").toArrow()  # at most ``positives`` rows an anchor of this block
        of, score = best["w"].to_numpy(), best["score"].to_numpy()
        asked = {"w": np.arange(len(of)), "anchor": of, "lo": -(-low * score // 100), "hi": high * score // 100}
        found = fill_windows(known, anchors, asked, order, sample, n_rows, False, negatives, f"{path}/negatives-{b}")
        names = spark.createDataFrame(pa.table({"_w": asked["w"], "anchor_id": anchors["id"][of], "positive_id": best["id"].to_numpy(), "positive_score": score}))
        found.join(F.broadcast(names), F.col("w") == F.col("_w")).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.parquet(f"{path}/out/block={b}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")

"""Toxicity score of whole documents: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first 3, 4 and 5 letters.
Filters of several widths run over the word sequence; each is max-pooled over the whole
document, and a logistic layer turns the pooled values into a logit. Words are runs of word characters in
lower case. Label, language, source and id are never inputs of the score.

Fitting uses every labelled row that may be learned from, whole. The rows are written once, dealt over shards by id; an epoch
is a job in which each shard goes over all of its rows in small batches from the same weights, a chunk of rows in memory at a time, and
one task averages what the shards, ``MOST_SHARDS`` at most, come to; the driver holds one set of weights, of the same size for any table.
A part of the rows, drawn by hash of the id, is kept from the gradient to calibrate: a logistic map of logits to probabilities, fitted by
sums over all of them, and a decision threshold per language, the cut in steps of ``1 / CUTS`` with the fewest errors among all.
Texts are read in windows of words with a running maximum, so responses do not take memory by a text's length.

Null and empty texts have no words and get the score of the bare intercept; a null id is never learned from;
conflicting labels of one id count as toxic; a language without enough calibration rows (or null) gets the general threshold; with no
labelled rows of either class every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from avalista.llm.common import cut_lineage, free_names, give_back, shuffle_partitions

WORD = re.compile(r"\w+")
WINDOW = 1 << 15  # words scored at a time
CHUNK_ROWS, CHUNK_CHARS = 1 << 10, 1 << 22  # rows of a shard that are in memory at a time, as far as one text is not larger
SHARD_ROWS, MOST_SHARDS = 1 << 11, 64  # a shard has so many rows or more
CUTS = 1 << 12


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    epochs: int = 8  # of few rows
    least_epochs: int = 3  # of many: all rows are gone over so often at least
    visits: int = 1 << 16  # rows gone over, repeats counted, beyond which more epochs than the least are not needed
    batch: int = 32
    rate: float = 0.03
    decay: float = 1e-4
    kept: float = 0.25  # share of the rows that calibrates
    least: int = 20  # toxic calibration rows a language needs for its own threshold
    seed: int = 11


@dataclass
class Model:
    settings: Settings
    embed: np.ndarray
    convs: list[np.ndarray] = field(default_factory=list)  # per width: width x dim x filters
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def state(self) -> dict:
        """Plain values, as a broadcast variable carries them to tasks."""
        return {**vars(self), "settings": asdict(self.settings)}

    @classmethod
    def of(cls, state: dict) -> Model:
        return cls(**{**state, "settings": Settings(**state["settings"])})


class Vocabulary:
    """Numbers the words of a batch and holds the hashed features of each."""

    def __init__(self, buckets: int):
        self.buckets, self.number, self.features = buckets, {}, array("i")

    def ids(self, text: str) -> np.ndarray:
        number, out = self.number, []
        for word in WORD.findall(text.lower()):
            n = number.get(word)
            if n is None:
                n = number[word] = len(number)
                self.features.extend(self._hash(word))
            out.append(n)
        return np.array(out, np.int32)

    def _hash(self, word: str) -> list[int]:
        found = [zlib.crc32(f"w{word}".encode()) % self.buckets]
        for n in (3, 4, 5):
            found.append(zlib.crc32(f"{n}{word[:n]}".encode()) % self.buckets if len(word) > n else self.buckets)
        return found

    def table(self) -> np.ndarray:
        """Words x features, as bucket numbers."""
        return np.array(self.features, np.int32).reshape(-1, 4)

    def vectors(self, embed: np.ndarray) -> np.ndarray:
        """Word vectors, and a last row of zeros for the padding behind a text."""
        if not self.features:
            return np.zeros((1, embed.shape[1]), np.float32)
        x = embed[self.table()].sum(1)
        return np.vstack([x, np.zeros((1, embed.shape[1]), np.float32)]).astype(np.float32)


def _responses(ids: np.ndarray, tables: list[np.ndarray], pad: int) -> np.ndarray:
    """Response of one width's filters at each word; ``tables`` has one words x filters table per place."""
    padded = np.concatenate([ids, np.full(len(tables) - 1, pad, ids.dtype)])
    total = tables[0][padded[: len(ids)]]
    for j, t in enumerate(tables[1:], 1):
        total = total + t[padded[j : j + len(ids)]]
    return total


def _pool(ids: np.ndarray, tables: list[list[np.ndarray]], pad: int) -> np.ndarray:
    """Maximum response of every filter over the whole text, window by window. Windows overlap by the widest filter."""
    best, over = None, max(map(len, tables)) - 1
    for start in range(0, len(ids), WINDOW):
        part = ids[start : start + WINDOW + over]
        here = np.concatenate([_responses(part, t, pad)[:WINDOW].max(0) for t in tables])
        best = here if best is None else np.maximum(best, here)
    return best


def logits(texts, model: Model) -> np.ndarray:
    words = Vocabulary(model.settings.buckets)
    ids = [words.ids(t or "") for t in texts]
    x = words.vectors(model.embed)
    pad = len(x) - 1
    tables = [[x @ conv[j] for j in range(len(conv))] for conv in model.convs]
    out = np.full(len(ids), model.base, np.float64)
    for i, row in enumerate(ids):
        if len(row):
            out[i] += np.maximum(_pool(row, tables, pad) + model.bias, 0) @ model.out
    return out


def scores(texts, model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return _probability(model, logits(texts, model))


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, grad, rate):
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        return rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


def _highest(ids: np.ndarray, tables: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum response of one width's filters over the whole text and its first place, window by window."""
    best = where = None
    for start in range(0, len(ids), WINDOW):
        response = _responses(ids[start : start + WINDOW + len(tables) - 1], tables, pad)[:WINDOW]
        at, top = response.argmax(0) + start, response.max(0)
        best, where = (top, at) if best is None else (np.maximum(best, top), np.where(top > best, at, where))
    return best, where


class Weights:
    """A network in training, with the state of its step sizes."""

    def __init__(self, settings: Settings, shares: tuple[float, float]):
        s, rng = settings, np.random.default_rng(settings.seed)
        n_filters = s.filters * len(s.widths)
        self.settings, self.weight = s, np.array([0.5 / x for x in shares], np.float32)  # of a clean and a toxic row
        self.embed = rng.normal(0, 0.05, (s.buckets + 1, s.dim)).astype(np.float32)
        self.embed[-1] = 0
        self.convs = [rng.normal(0, 0.3, (w, s.dim, s.filters)).astype(np.float32) for w in s.widths]
        self.bias, self.out, self.base = np.zeros(n_filters, np.float32), rng.normal(0, 0.3, n_filters).astype(np.float32), np.zeros(1, np.float32)
        self.adams = {k: _Adam(v.shape) for k, v in self.dense().items()}
        self.square = np.full(s.buckets + 1, 1e-8, np.float32)

    def dense(self) -> dict:
        """The parameters that every row moves, by name."""
        return {**dict(enumerate(self.convs)), "bias": self.bias, "out": self.out, "base": self.base}

    def go_over(self, texts: list, labels: np.ndarray, rate: float, rng) -> None:
        """One pass over the rows in small batches, in an order drawn from ``rng``."""
        words = Vocabulary(self.settings.buckets)
        ids = [words.ids(t or "") for t in texts]
        features, labels = words.table(), np.asarray(labels, np.float32)
        del words  # the words' numbers are needed no longer
        order = rng.permutation(len(ids))
        for at in range(0, len(order), self.settings.batch):
            take = order[at : at + self.settings.batch]
            self._step([ids[i] for i in take], labels[take], features, rate)

    def _step(self, ids: list[np.ndarray], labels: np.ndarray, features: np.ndarray, rate: float) -> None:
        s, embed, convs = self.settings, self.embed, self.convs
        used, local = np.unique(np.concatenate(ids), return_inverse=True)
        x = np.vstack([embed[features[used]].sum(1), np.zeros((1, s.dim), np.float32)]) if len(used) else np.zeros((1, s.dim), np.float32)
        pad, ends = len(x) - 1, np.cumsum([len(row) for row in ids])
        tables = [[x @ conv[j] for j in range(len(conv))] for conv in convs]
        pooled, where = np.zeros((len(ids), len(self.out)), np.float32), np.zeros((len(ids), len(self.out)), np.int64)
        full = np.array([len(row) > 0 for row in ids])
        mine = [local[e - len(row) : e] for row, e in zip(ids, ends)]
        for r, row in enumerate(mine):
            if len(row):
                for k, t in enumerate(tables):
                    cols = slice(k * s.filters, (k + 1) * s.filters)
                    pooled[r, cols], where[r, cols] = _highest(row, t, pad)
        z = np.where(full[:, None], pooled + self.bias, 0)
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.base[0], -30, 30)))
        g = ((p - labels) * self.weight[labels.astype(int)] / len(ids)).astype(np.float32)
        gh = g[:, None] * self.out * (z > 0)
        dx, dconvs = np.zeros_like(x), [np.zeros_like(c) for c in convs]
        for k, conv in enumerate(convs):
            cols = slice(k * s.filters, (k + 1) * s.filters)
            for j in range(len(conv)):
                place = np.full((len(ids), s.filters), pad, np.int64)
                for r, row in enumerate(mine):
                    if len(row):
                        to = where[r, cols] + j
                        place[r] = np.where(to < len(row), row[np.minimum(to, len(row) - 1)], pad)
                gk = gh[:, cols]
                dconvs[k][j] = np.einsum("rf,rfd->df", gk, x[place])
                np.add.at(dx, place, gk[:, :, None] * conv[j].T[None])
        for k, conv in enumerate(convs):
            conv -= self.adams[k].step(dconvs[k] + s.decay * conv, rate)
        self.bias -= self.adams["bias"].step(gh.sum(0), rate)
        self.out -= self.adams["out"].step(h.T @ g + s.decay * self.out, rate)
        self.base -= self.adams["base"].step(np.array([g.sum()], np.float32), rate)
        hit = np.flatnonzero(np.abs(dx[:-1]).sum(1))
        if len(hit):  # each word's gradient goes to all of its features, with a step of its own per bucket
            to = features[used[hit]]
            rows_to, grads = to.ravel(), np.repeat(dx[hit], to.shape[1], axis=0)
            np.add.at(self.square, rows_to, (grads * grads).mean(1))
            np.add.at(embed, rows_to, -rate * 2 * grads / np.sqrt(self.square[rows_to])[:, None])
            embed[-1] = 0

    def average(self, shards) -> None:
        """Take over what shards, given as (rows, weights), came to from here: means by rows, of a bucket's vector the mean of the steps of those that took one."""
        rows, dense = 0, {}
        embed, square, moved = np.zeros(self.embed.shape), np.zeros(len(self.square)), np.zeros(len(self.square))
        for n, other in shards:
            rows += n
            for k, v in other.dense().items():
                adam = other.adams[k]
                dense[k] = [x + n * y for x, y in zip(dense.get(k, (0, 0, 0)), (v.astype(float), adam.m.astype(float), adam.v.astype(float)))]
                self.adams[k].t = max(self.adams[k].t, adam.t)
            took = other.square != self.square
            moved += took
            embed += other.embed - self.embed
            square[took] += other.square[took]
        if not rows:
            return
        for k, v in self.dense().items():
            v[...], self.adams[k].m[...], self.adams[k].v[...] = (x / rows for x in dense[k])
        self.embed += (embed / np.maximum(moved, 1)[:, None]).astype(np.float32)
        self.square = np.where(moved > 0, square / np.maximum(moved, 1), self.square).astype(np.float32)

    def state(self) -> dict:
        """Plain values, as they go to tasks and back."""
        return {**vars(self), "settings": asdict(self.settings), "adams": {k: vars(a) for k, a in self.adams.items()}}

    @classmethod
    def of(cls, state: dict) -> Weights:
        out = cls.__new__(cls)
        vars(out).update({**state, "settings": Settings(**state["settings"]), "adams": {}})
        for k, v in state["adams"].items():
            out.adams[k] = _Adam(v["m"].shape)
            vars(out.adams[k]).update(v)
        return out

    def model(self) -> Model:
        return Model(self.settings, self.embed, self.convs, self.bias, self.out, float(self.base[0]))


def _epochs(n_rows: int, s: Settings):
    """Number and rate of the epochs over so many rows."""
    count = min(s.epochs, max(s.least_epochs, -(-s.visits // max(n_rows, 1))))
    return [(epoch, s.rate * (1 - epoch / count)) for epoch in range(count)]


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], settings: Settings = Settings()) -> Model:
    """Train on the texts, all in memory, then calibrate on the part kept back."""
    s, rng = settings, np.random.default_rng(settings.seed)
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(s, np.zeros((1, 1)), constant=float(labels.mean()) if len(labels) else 0.0)
    back = np.zeros(len(texts), bool)
    for y in (0, 1):  # the same share of either class is kept back
        rows = rng.permutation(np.flatnonzero(labels == y))
        back[rows[: int(len(rows) * s.kept)]] = True
    rows = np.flatnonzero(~back)
    weights = Weights(s, (1 - labels[rows].mean(), labels[rows].mean()))
    for _, rate in _epochs(len(rows), s):
        weights.go_over([texts[i] for i in rows], labels[rows], rate, rng)
        weights.embed *= 1 - s.decay
    model, kept = weights.model(), np.flatnonzero(back)
    if len(set(labels[kept].tolist())) == 2:
        _calibrate(model, [texts[i] for i in kept], labels[kept], [langs[i] for i in kept])
    return model


def _probability(model: Model, raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -40, 40)))


def _logistic_map(sums, middle: float, spread: float) -> tuple[float, float]:
    """Slope and shift of the map from logits to probabilities; ``sums(a, b)`` gives gradient and second derivatives over the rows at a z + b."""
    ab = np.array([1.0, 0.0])
    for _ in range(60):
        g0, g1, h00, h01, h11 = sums(*ab)
        hess = np.array([[h00, h01], [h01, h11]]) + 1e-4 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, np.array([g0, g1]) + 1e-4 * ab), -2, 2)
        ab -= step
        if np.abs(step).max() < 1e-7:
            break
    return float(ab[0] / spread), float(ab[1] - ab[0] * middle / spread)


def _calibrate(model: Model, texts, labels: np.ndarray, langs) -> None:
    """Logistic map of logits to probabilities (smoothed targets), then the threshold of fewest errors, in general and per language."""
    raw = np.concatenate([logits(texts[i : i + 64], model) for i in range(0, len(texts), 64)])
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    middle, spread = raw.mean(), raw.std() + 1e-6
    z = (raw - middle) / spread

    def sums(a, b):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, v = p - target, p * (1 - p)
        return d @ z, d.sum(), v @ (z * z), v @ z, v.sum()

    model.slope, model.shift = _logistic_map(sums, middle, spread)
    found = _probability(model, raw)
    model.thresholds[""] = 0.5
    for lang in sorted({x for x in langs if x}):
        at = np.array([x == lang for x in langs])
        if labels[at].sum() >= model.settings.least:
            model.thresholds[lang] = _best_cut(found[at], labels[at])


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors; of equally good cuts the one nearest to one half."""
    steps = np.unique(np.concatenate([[0.0], p, [1.0]]))
    cuts = np.concatenate([(steps[1:] + steps[:-1]) / 2, [0.5]])
    errors = [int(((p >= c) != (y == 1)).sum()) for c in cuts]
    return float(min(zip(errors, np.abs(cuts - 0.5), cuts))[2])


def held_out(id_col) -> object:
    """Every fifth id by checksum is never learned from; a null id is one of these."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on all labelled rows; the driver gets weights, counts and thresholds alone."""
    s = settings
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).withColumnRenamed("doc_id", "l_id")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    found = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("l_id"))
    found = found.repartition(max(cores, shuffle_partitions(docs.sparkSession)), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "y")).alias("row")).select("doc_id", "row.*")
    rows = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(s.seed))).withColumn("back", F.pmod("draw", F.lit(1 << 20)) < int(s.kept * (1 << 20)))
    rows = cut_lineage(rows.sortWithinPartitions("draw", "doc_id"))
    counts = {(r["back"], r["y"]): r["n"] for r in rows.groupBy("back", "y").agg(F.count("*").alias("n")).collect()}
    per_class = [sum(n for (_, y), n in counts.items() if y == k) for k in (0, 1)]
    if not all(per_class):
        return Model(s, np.zeros((1, 1)), constant=float(per_class[1] > 0))
    apart = all(counts.get((back, y)) for back in (False, True) for y in (0, 1))  # of very few rows, all are fitted on and none calibrate
    fitted = rows.filter(~F.col("back")) if apart else rows
    n_clean, n_toxic = [counts[False, y] for y in (0, 1)] if apart else per_class
    weights = Weights(s, (n_clean / (n_clean + n_toxic), n_toxic / (n_clean + n_toxic)))
    shards = fitted.select("text", "y").coalesce(max(1, min(cores, MOST_SHARDS, (n_clean + n_toxic) // SHARD_ROWS)))
    for epoch, rate in _epochs(n_clean + n_toxic, s):
        weights = _epoch(shards, weights, epoch, rate)
        weights.embed *= 1 - s.decay
    model = weights.model()
    if apart:
        _calibrate_rows(model, rows.filter("back"))
    return model


def _epoch(shards: DataFrame, weights: Weights, epoch: int, rate: float) -> Weights:
    """One epoch: every partition of ``shards`` goes over its rows from the same weights, and one task averages them."""
    start = shards.sparkSession.sparkContext.broadcast(pickle.dumps(weights.state()))

    def chunks(batches):
        texts, labels, chars = [], [], 0
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                texts.append(text.as_py())
                labels.append(y)
                chars += len(texts[-1])
                if len(texts) == CHUNK_ROWS or chars >= CHUNK_CHARS:
                    yield texts, labels
                    texts, labels, chars = [], [], 0
        if texts:
            yield texts, labels

    def train(batches):
        part, mine, rows = TaskContext.get().partitionId(), Weights.of(pickle.loads(start.value)), 0
        rng = np.random.default_rng([mine.settings.seed, epoch, part])
        for texts, labels in chunks(batches):
            mine.go_over(texts, labels, rate, rng)
            rows += len(texts)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([pickle.dumps(mine.state())], pa.binary())], ["part", "n", "weights"])
        give_back()

    def average(batches):
        mean = Weights.of(pickle.loads(start.value))
        mean.average((b.column(1)[i].as_py(), Weights.of(pickle.loads(b.column(2)[i].as_py()))) for b in batches for i in range(b.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mean.state())], pa.binary())], ["weights"])
        give_back()

    trained = shards.mapInArrow(train, "part int, n bigint, weights binary").repartition(1).sortWithinPartitions("part")
    found = Weights.of(pickle.loads(trained.mapInArrow(average, "weights binary").first()["weights"]))
    start.destroy()
    return found


def _calibrate_rows(model: Model, rows: DataFrame) -> None:
    """As ``_calibrate``, by sums over all rows; thresholds are cuts in steps of ``1 / CUTS``."""
    sent = rows.sparkSession.sparkContext.broadcast(model.state())

    def tasks(batches):
        model = Model.of(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(logits(part.column(0).to_pylist(), model))], ["lang", "y", "raw"])

    raw = cut_lineage(rows.select("text", "lang", "y").mapInArrow(tasks, "lang string, y int, raw double"))
    n, n1, middle, spread = raw.agg(F.count("*"), F.sum("y"), F.avg("raw"), F.stddev_pop("raw")).first()
    spread += 1e-6
    z = (F.col("raw") - middle) / spread
    target = F.when(F.col("y") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n - n1 + 2))

    def clipped(x, limit):
        return F.greatest(F.least(x, F.lit(float(limit))), F.lit(-float(limit)))

    def sums(a, b):
        p = 1 / (1 + F.exp(-clipped(z * float(a) + float(b), 30)))
        at = raw.select(z.alias("z"), (p - target).alias("d"), (p * (1 - p)).alias("v"))
        return at.agg(F.sum(F.col("d") * F.col("z")), F.sum("d"), F.sum(F.col("v") * F.col("z") * F.col("z")), F.sum(F.col("v") * F.col("z")), F.sum("v")).first()

    model.slope, model.shift = _logistic_map(sums, middle, spread)
    p = 1 / (1 + F.exp(-clipped(F.col("raw") * model.slope + model.shift, 40)))
    model.thresholds = {"": 0.5} | {r["lang"]: r["cut"] for r in best_cuts(raw.select("lang", "y", p.alias("p")), model.settings.least).collect()}


def best_cuts(scored: DataFrame, least: int) -> DataFrame:
    """lang and cut: of each language with ``least`` toxic rows or more the cut, in steps of ``1 / CUTS``, with the fewest errors, of equally good ones the nearest to one half."""
    steps = scored.filter(F.col("lang") != "").groupBy("lang", F.floor(F.col("p") * CUTS).cast("int").alias("step")).agg(
        F.sum("y").cast("bigint").alias("toxic"), F.sum(1 - F.col("y")).cast("bigint").alias("clean"))
    middle = steps.select("lang").distinct().select("lang", F.lit(CUTS // 2).alias("step"), F.lit(0).cast("bigint").alias("toxic"), F.lit(0).cast("bigint").alias("clean"))
    by_step = Window.partitionBy("lang").orderBy("step")  # a row per language and step
    rows = steps.unionByName(middle).groupBy("lang", "step").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).select(
        "lang", "step", F.sum("toxic").over(Window.partitionBy("lang")).alias("all_toxic"),
        (F.coalesce(F.sum("toxic").over(by_step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         + F.sum("clean").over(by_step.rowsBetween(0, Window.unboundedFollowing))).alias("below"),
        (F.sum("toxic").over(by_step.rowsBetween(Window.unboundedPreceding, 0))
         + F.coalesce(F.sum("clean").over(by_step.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))).alias("above"))
    cuts = rows.filter(F.col("all_toxic") >= least).select("lang", F.inline(F.array(
        F.struct(F.col("below").alias("errors"), (F.col("step") / CUTS).alias("cut")), F.struct(F.col("above").alias("errors"), ((F.col("step") + 1) / CUTS).alias("cut")))))
    return cuts.groupBy("lang").agg(F.min(F.struct("errors", F.abs(F.col("cut") - 0.5).alias("off"), "cut"))["cut"].alias("cut"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``threshold`` (by language) and ``toxic`` (score reaches it) as its last columns.

    Where ``docs`` has a column of such a name, that stays, and the new one has underscores before it.
    """
    kept, (score, limit, toxic) = docs.columns, free_names(docs, "score", "threshold", "toxic")
    task_model = docs.sparkSession.sparkContext.broadcast(model.state())
    names = [*kept, score]

    def tasks(batches):
        model = Model.of(task_model.value)
        for batch in batches:
            text = batch.column(kept.index("text"))
            values, first, held, chars = [], 0, [], 0
            for value in text:
                value = value.as_py() or ""
                if held and chars + len(value) > 1 << 20:
                    values.append(scores(held, model))
                    held, chars = [], 0
                held.append(value)
                chars += len(value)
            if held:
                values.append(scores(held, model))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values) if values else [], pa.float64())], names)

    rows = docs.select(*kept)
    scored = rows.mapInArrow(tasks, StructType([*rows.schema.fields, StructField(score, DoubleType())]))
    general = model.thresholds.get("", 0.5)
    own = [x for pair in model.thresholds.items() if pair[0] for x in map(F.lit, pair)]
    threshold = F.coalesce(F.element_at(F.create_map(*own), F.col("lang")), F.lit(general)) if own and "lang" in kept else F.lit(general)
    return scored.withColumn(limit, threshold).withColumn(toxic, F.col(score) >= F.col(limit))

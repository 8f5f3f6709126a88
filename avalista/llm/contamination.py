"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts become sets of five-word shingles (words in lower case, ASCII punctuation parts words). A plain MinHash of a long
document says nothing about a short item inside it, so documents are partitioned by the size of their set:
partition ``p`` holds sets of up to ``2**p`` shingles and is sketched with ``4 * 2**p`` bins of a one-permutation
MinHash, the smallest hash in each bin. So a shingle of an item that a document holds is its bin's minimum with a
probability of 0.88 at least, whatever the document's size. An item is sketched once for every partition: bins are
nested, so it is enough to note for each shingle the first partition in which it is a minimum.

Candidates share more sketch values than six standard deviations below what a containment of ``threshold`` leads to;
each is verified on full sets. For an item so short that this leaves no more than one value, a sketch may miss all it shares, so
its candidates come from all of a document's shingles that it may have, not from the sketch. A bitmap of fixed size over the hashes of all items lets a task drop, at the scan, document values that no item
has; where it fills up, more values pass and are dropped in the join instead.

An item or document of fewer than five words has its whole sequence as its one shingle; without words it matches nothing. Repeated
rows count once; rows that share an id but not the text are searched one by one and reported with the largest containment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avalista.llm.common import bitmap, cut_lineage, free_names, passes
from avalista.llm.shingles import WordHasher, distinct, shingle_hashes

WORDS = 5
THRESHOLD = 0.8
FINE = 2  # bins per shingle, as a power of two
SURVIVES = 0.78  # least probability that a shared shingle is the minimum of its bin in both sketches


def partition_of(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def is_minimum(values: np.ndarray, partition: int) -> np.ndarray:
    """Which of the ascending values is the smallest of its bin."""
    mask = np.zeros(len(values), bool)
    bins = values & np.uint64((1 << min(60, partition + FINE)) - 1)
    mask[np.unique(bins, return_index=True)[1]] = True
    return mask


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def item_shingles(items: DataFrame) -> DataFrame:
    """Per distinct item row: item_id, item_key, and ``shingles``: its set, each with the first partition it is a minimum in."""

    def tasks(batches):
        hasher = WordHasher(plain=True)
        for batch in batches:
            for first, words, offsets in hasher.groups(batch.column(2)):
                values, at = distinct(*shingle_hashes(words, offsets, WORDS), len(offsets) - 1)
                rows = []
                for i in range(len(offsets) - 1):
                    mine = values[at[i] : at[i + 1]]
                    start = np.full(len(mine), 64)
                    for p in range(63, -1, -1):
                        kept = is_minimum(mine, p)
                        start[kept] = p
                        if len(mine) == 0 or kept.sum() == 1:
                            start[kept] = 0
                            break
                    rows.append([{"h": int(h), "p": int(p)} for h, p in zip(_signed(mine), start)])
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(rows, pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32())])))],
                    ["item_id", "item_key", "shingles"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.xxhash64("text").alias("item_key"), "text").dropDuplicates(["item_id", "item_key"])
    return rows.mapInArrow(tasks, f"item_id {kind}, item_key bigint, shingles array<struct<h:bigint,p:int>>").filter(F.size("shingles") > 0)


def document_sketches(docs: DataFrame, bits: np.ndarray, short_bits: np.ndarray) -> DataFrame:
    """Per document that may hold an item: id, text_key, partition, and of its values that pass the bitmap the sketch's, all, and those of short items."""
    sent, sent_short = docs.sparkSession.sparkContext.broadcast(bits), docs.sparkSession.sparkContext.broadcast(short_bits)

    def tasks(batches):
        hasher = WordHasher(plain=True)
        for batch in batches:
            for first, words, offsets in hasher.groups(batch.column(2)):
                values, at = distinct(*shingle_hashes(words, offsets, WORDS), len(offsets) - 1)
                passing = passes(values.view(np.int64), sent.value)
                many = np.add.reduceat(np.append(passing, False), at[:-1]) if len(at) > 1 else np.zeros(0)
                rows, parts, sketch, every, short = [], [], [], [], []
                for i in np.flatnonzero((many > 0) & (np.diff(at) > 0)):
                    mine, ok = values[at[i] : at[i + 1]], passing[at[i] : at[i + 1]]
                    p = partition_of(len(mine))
                    least = ok & is_minimum(mine, p)
                    few = mine[ok]
                    few = few[passes(few.view(np.int64), sent_short.value)]
                    if least.any() or len(few):
                        rows.append(first + int(i))
                        parts.append(p)
                        sketch.append(_signed(mine[least]))
                        every.append(_signed(mine[ok]))
                        short.append(_signed(few))
                if rows:
                    took = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(took), batch.column(1).take(took), pa.array(parts, pa.int32()),
                         pa.array(sketch, pa.list_(pa.int64())), pa.array(every, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int64()))],
                        ["doc_id", "text_key", "part", "sketch", "every", "short"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(tasks, f"doc_id {kind}, text_key bigint, part int, sketch array<bigint>, every array<bigint>, short array<bigint>")


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item it contains: doc_id, text_key, item_id, n_shared, n_item, containment."""
    sets = cut_lineage(item_shingles(items))
    item_rows = sets.select("item_id", "item_key", F.size("shingles").alias("n_item"), F.explode("shingles").alias("s")).select("item_id", "item_key", "n_item", "s.*")
    expected = F.col("n_item") * threshold * SURVIVES
    cutoff = expected - 6 * F.sqrt(expected * (1 - SURVIVES))
    short_rows, long_rows = item_rows.filter(cutoff <= 1), item_rows.filter(cutoff > 1)
    found = cut_lineage(document_sketches(docs, bitmap(item_rows.select("h")), bitmap(short_rows.select("h"))).dropDuplicates(["doc_id", "text_key"]))

    values = found.select("doc_id", "text_key", "part", F.explode("sketch").alias("h"))
    every = found.select("doc_id", "text_key", F.explode("short").alias("h"))
    pair = ["doc_id", "text_key", "item_id", "item_key", "n_item"]
    met = F.count("*").alias("met")
    by_sketch = values.join(long_rows, "h").filter(F.col("part") >= F.col("p")).groupBy(*pair).agg(met).filter(F.col("met") >= cutoff)
    by_all = every.join(short_rows, "h").groupBy(*pair).agg(met).filter(F.col("met") / F.col("n_item") >= threshold)
    candidates = by_sketch.unionByName(by_all)
    theirs = found.select(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key"), "every")
    full = sets.select(F.col("item_id").alias("i_id"), F.col("item_key").alias("i_key"), F.col("shingles.h").alias("full"))
    verified = (
        candidates.join(theirs, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_key") == F.col("d_key")))
        .join(full, F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_key") == F.col("i_key")))
        .withColumn("n_shared", F.size(F.array_intersect("every", "full")))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .filter(F.col("containment") >= threshold)
    )
    return verified.select("doc_id", "text_key", "item_id", "n_shared", "n_item", "containment")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item: doc_id, item_id, n_shared, n_item, containment."""
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("best")
    pairs = search(docs, items, threshold).groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", F.col("best.n_shared").cast("bigint").alias("n_shared"), F.col("best.n_item").cast("bigint").alias("n_item"), "best.containment")


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text contains no item."""
    id_, key, at = free_names(docs, "_id", "_key", "_at")
    hit = search(docs, items, threshold).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    rows = docs.withColumn(at, F.xxhash64("text"))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(at) == F.col(key)), "left_anti").select(*docs.columns)

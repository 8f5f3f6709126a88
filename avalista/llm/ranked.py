"""Ranked lexical search: inverted lists cut into blocks of similar documents, skipped only where exact bounds allow it.

A document's score for a query is the sum, over the query's distinct terms, of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``,
with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m = 10 + (90 * n * N) div L``: all integers, so bounds are exact.

1. One pass over the texts keeps, of every document, its length and the counts of the terms that the queries hold (the forward rows).
   Spark sums them to N, L and df.
2. A search task takes its forward rows in shards of bounded size. There a term's posting list is *clustered*: its documents are
   assigned to the nearest of some of their own number in a random projection of the documents' impact vectors, and each cluster is a
   block. A block's *summary* is the coordinatewise maximum of its documents' impacts, so the query's sum over a summary is no
   smaller than any score in the block.
3. A query visits the lists of those of its terms without which no document can reach the k-th best score known so far, blocks of the
   largest bound first. A block is left out only if its bound is below that score (documents that reach it may still win by id).
   Documents of the other blocks are scored in full from the forward rows.
4. A task returns at most k documents per query; Spark ranks those of all tasks.

The k-th best score of about ``SAMPLE`` documents, searched first, is a lower bound for everybody: it changes what is skipped, never the result.
Queries are worked off in blocks of about ``ENTRIES`` terms, which bounds what a task is sent.

Odd cases: null and empty texts have no terms and rank nowhere; each row of ``docs`` is a document, repeated or not, a null id sorts
first; query rows of one id (or of the null id) make one query of all their terms; empty tables give an empty result; other columns
of either table are not read, whatever their names. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from avalista.llm.common import cut_lineage
from avalista.llm.shingles import WordHasher, mix

ENTRIES = 1 << 20  # query terms of a block of queries
SHARD_DOCS, SHARD_ENTRIES = 1 << 13, 1 << 21
SAMPLE = 1 << 14
BLOCK_DOCS = 32
SKETCH = 32  # dimensions of the projection that blocks are clustered in


def _counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def query_terms(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """item and h, the hash of a term, once for every term of an item."""

    def tasks(batches):
        hasher = WordHasher(plain=True)
        for batch in batches:
            for first, hashes, offsets in hasher.groups(batch.column(1)):
                row = np.repeat(np.arange(first, first + len(offsets) - 1), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(hashes.view(np.int64))], ["item", "h"])

    kind = queries.schema[id_column].dataType.simpleString()
    return queries.select(F.col(id_column), F.col(text_column)).mapInArrow(tasks, f"item {kind}, h bigint").distinct()


def forward_rows(docs: DataFrame, id_column: str, text_column: str, vocabulary: np.ndarray) -> DataFrame:
    """doc, n (terms with repeats), terms (places in the sorted ``vocabulary`` of hashes) and tf, for every document with a term."""

    def tasks(batches):
        hasher = WordHasher(plain=True)
        for batch in batches:
            for first, hashes, offsets in hasher.groups(batch.column(1)):
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[place] == hashes
                rows = np.flatnonzero(np.diff(offsets))
                terms, tf = [], []
                for i in rows:
                    part = slice(offsets[i], offsets[i + 1])
                    values, counts = _counts(place[part][known[part]])
                    terms.append(values.astype(np.int32))
                    tf.append(counts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + rows)), pa.array(np.diff(offsets)[rows]), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))],
                    ["doc", "n", "terms", "tf"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(tasks, f"doc {kind}, n bigint, terms array<int>, tf array<int>")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Shard:
    """Documents of a task with their posting lists, which are cut into blocks when a query first asks for them."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, length: int):
        top = 90 * int(n.max(initial=0)) * n_docs
        m = 10 + (90 * n * n_docs // length if top < 1 << 63 else np.array([90 * int(x) * n_docs // length for x in n], np.int64))
        impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
        held = impact > 0
        self.sizes = np.add.reduceat(np.append(held, False), np.cumsum(sizes) - sizes).astype(np.int64) * (sizes > 0) if len(sizes) else sizes
        self.terms, self.impact = terms[held], impact[held]
        self.starts = np.cumsum(self.sizes) - self.sizes
        doc = np.repeat(np.arange(len(n)), self.sizes)
        order = np.argsort(self.terms, kind="stable")
        listed, at = np.unique(self.terms[order], return_index=True)
        self.most = dict(zip(listed.tolist(), np.maximum.reduceat(self.impact[order], at).tolist())) if len(at) else {}
        self.lists = dict(zip(listed.tolist(), np.split(doc[order], at[1:])))
        self.vocabulary, self.cut = len(weights), {}
        # impact vectors, projected by a random sign per term and dimension
        bits = mix(self.terms.astype(np.uint64) + np.uint64(1))
        self.sketch = np.zeros((len(n), SKETCH), np.float32)
        share = np.sqrt(self.impact.astype(np.float32))
        for d in range(SKETCH):
            sign = ((bits >> np.uint64(d)) & np.uint64(1)).astype(np.float32) * 2 - 1
            self.sketch[:, d] = np.bincount(doc, share * sign, len(n))
        self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-9)

    def blocks(self, term: int):
        """The documents of a list in block order, the blocks' sizes, and the summaries: terms, largest impacts, entries per block."""
        if term not in self.cut:
            docs = self.lists[term]
            centres = self.sketch[docs[:: BLOCK_DOCS]]
            block = np.concatenate([np.argmax(self.sketch[docs[i : i + 4096]] @ centres.T, axis=1) for i in range(0, len(docs), 4096)])
            block = np.unique(block, return_inverse=True)[1]
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
            at = _ranges(self.starts[docs], self.sizes[docs])
            key = np.repeat(block, self.sizes[docs]) * self.vocabulary + self.terms[at]
            by_key = np.argsort(key)
            keys = key[by_key]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, largest = keys[first], np.maximum.reduceat(self.impact[at[by_key]], first)
            self.cut[term] = docs, np.bincount(block), keys % self.vocabulary, largest, np.bincount(keys // self.vocabulary)
        return self.cut[term]

    def search(self, asked: np.ndarray, best: list, floor: int, k: int, ids) -> None:
        """Merge this shard's documents into ``best``, the sorted (-score, id) of the k best so far; scores below ``floor`` can't win."""
        terms = sorted((t for t in asked.tolist() if t in self.most), key=lambda t: self.most[t])
        if not terms:
            return
        mask = np.zeros(self.vocabulary, bool)
        mask[terms] = True
        seen = np.zeros(len(self.sizes), bool)
        least = lambda: max(floor, 1, -best[-1][0] if len(best) == k else 0)
        reach = np.cumsum([self.most[t] for t in terms])
        for i in reversed(range(len(terms))):
            if reach[i] < least():  # documents that hold this term and weaker ones only
                break
            docs, sizes, summary, largest, entries = self.blocks(terms[i])
            bound = _sums(np.where(mask[summary], largest, 0), entries)
            starts, order = np.cumsum(sizes) - sizes, np.argsort(-bound, kind="stable")
            for j in range(0, len(order), 16):
                now = order[j : j + 16]
                now = now[bound[now] >= least()]
                if not len(now):
                    break
                rows = docs[_ranges(starts[now], sizes[now])]
                rows = rows[~seen[rows]]
                if not len(rows):
                    continue
                seen[rows] = True
                at = _ranges(self.starts[rows], self.sizes[rows])
                score = _sums(np.where(mask[self.terms[at]], self.impact[at], 0), self.sizes[rows])
                may = score >= least()
                rows, score = rows[may], score[may]
                if len(score) > k:  # ids matter only among those that tie with the k-th
                    may = score >= np.partition(score, len(score) - k)[len(score) - k]
                    rows, score = rows[may], score[may]
                best += [(-s, ids[r]) for s, r in zip(score.tolist(), rows.tolist())]
                best.sort(key=lambda x: (x[0], x[1] is not None, x[1]))
                del best[k:]


def _search(forward: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, floors: list[int], k: int) -> DataFrame:
    """query (place in ``items``), doc, score: what may be among the k best of all, at most k rows of a task for a query."""

    def tasks(batches):
        best, held, size = [[] for _ in items], [], 0

        def work():
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["doc"].to_pylist()
            lists, tf = rows["terms"].combine_chunks(), rows["tf"].combine_chunks()
            shard = Shard(rows["n"].to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64), weights, n_docs, length)
            for asked, found, floor in zip(items, best, floors):
                shard.search(asked, found, floor, k, ids)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SHARD_DOCS // 8)
                held.append(part)
                size += len(part.column(2).flatten())
                at += part.num_rows
                if size >= SHARD_ENTRIES or sum(x.num_rows for x in held) >= SHARD_DOCS:
                    work()
                    held, size = [], 0
        if held:
            work()
        rows = [(q, i, -s) for q, found in enumerate(best) for s, i in found]
        if rows:
            query, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())], ["query", "doc", "score"])

    kind = forward.select("doc").limit(0).toArrow().schema.field(0).type
    return forward.mapInArrow(tasks, f"query int, doc {forward.schema['doc'].dataType.simpleString()}, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` documents of the highest score above 0 for each query, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    entries = cut_lineage(query_terms(queries, item_id, text))
    blocks = max(1, math.ceil(entries.count() / ENTRIES))
    out = None
    for b in range(blocks):
        rows = entries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "h").toArrow()
        if rows.num_rows == 0:
            continue
        hashes = rows["h"].to_numpy().view(np.uint64)
        vocabulary, place = np.unique(hashes, return_inverse=True)
        items = rows["item"].to_pylist()
        cuts = [i for i in range(1, len(items)) if items[i] != items[i - 1]]
        asked, names = np.split(place, cuts), [items[i] for i in [0, *cuts]]

        forward = cut_lineage(forward_rows(docs, doc_id, text, vocabulary))
        n_docs, length = forward.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        held = forward.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[held["t"].to_numpy()] = held["count"].to_numpy()
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

        floors = [0] * len(asked)
        if n_docs > 2 * SAMPLE:
            some = forward.filter(F.pmod(F.xxhash64("doc", "n"), F.lit(n_docs // SAMPLE)) == 0)
            top = Window.partitionBy("query").orderBy(F.desc("score"))
            kth = _search(some, asked, weights, n_docs, length, floors, k).withColumn("r", F.row_number().over(top)).filter(F.col("r") == k)
            for row in kth.collect():
                floors[row["query"]] = row["score"]
        found = _search(forward, asked, weights, n_docs, length, floors, k)
        place_of = spark.createDataFrame(list(enumerate(names)), f"place int, item {entries.schema['item'].dataType.simpleString()}")
        found = found.join(F.broadcast(place_of), F.col("query") == F.col("place"))
        top = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_first())
        part = found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select(
            F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
        part = part if blocks == 1 else cut_lineage(part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = f"{item_id} {entries.schema['item'].dataType.simpleString()}, rank int, {doc_id} {docs.schema[doc_id].dataType.simpleString()}, score bigint"
        return spark.createDataFrame([], schema)
    return out

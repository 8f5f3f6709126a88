"""Near-duplicate groups: banded MinHash, odd sketches, links confirmed on full shingle sets.

1. One pass over the texts gives each document its set of word shingles (64-bit hashes), ``HASHES`` MinHash samples of it,
   band keys of ``ROWS`` samples each, and an odd sketch: the samples are thrown into a bitmap of ``SKETCH`` bits, each flipping its bit.
   The number of bits in which two odd sketches differ estimates the share of differing samples, precisely so at high similarity.
2. Documents with equal sets are one class (exact copies and whitespace variants never pair up). Only class representatives go on.
3. In each band bucket every member is paired with one centre, not with each other. A pair goes on if its set sizes and its odd
   sketches allow the threshold (six standard deviations of slack), and is linked if the full sets confirm it.
4. Links give components. A bucket whose members have all come together needs nothing more. The members of the others are grouped (buckets that share a
   member form one group, so a pair meets once and not once per band) and dealt in blocks of about ``BLOCK`` shingles; each pair of blocks
   is one task's work. There, rows of different components that share a band and whose sketches allow it are compared on their full
   sets, and rows that a link has joined are not compared again; a task returns fewer links than it has rows. So no
   link between components is lost to the star, and a group of thousands of near copies gives thousands of links, not their square.

With four rows and 32 bands a pair at the threshold of 0.8 shares no bucket with a probability of 5e-8.

A document without words is linked with nothing and is its own group. A null id takes no part: its group is null. Rows
with the same id and text are equal rows of one class. Node ids are 64-bit hashes of the sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from avalista.llm.common import bitmap, by_group, cut_lineage, free_names, passes
from avalista.llm.components import connected_components
from avalista.llm.shingles import WordHasher, distinct, mix, shingle_hashes

HASHES, ROWS, SKETCH = 128, 4, 512
SLACK = 0.21  # six standard deviations of the estimate at 0.8
BLOCK = 1 << 20
_rng = np.random.default_rng(8)
FACTORS = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SALTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per row of its whole set, order-free."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def minhashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows x HASHES: the smallest value of each row under each of the hash functions. Rows must not be empty."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, HASHES), np.uint32)
    for i, factor in enumerate(FACTORS):
        out[:, i] = np.minimum.reduceat(short * factor, at[:-1])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    bands = HASHES // ROWS
    keys = np.tile(SALTS[:bands], (len(samples), 1))
    for r in range(ROWS):
        keys = mix(keys ^ samples[:, r::ROWS].astype(np.uint64))
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Rows x SKETCH / 64 words: every sample flips one bit."""
    bit = (mix(samples.astype(np.uint64) ^ SALTS[None, :]) % np.uint64(SKETCH)).astype(np.int64)
    flips = np.zeros((len(samples), SKETCH), np.uint8)
    np.add.at(flips, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, n (size of the set), node (hash of the set), bands, odd; the last three null for a row without words."""

    def tasks(batches):
        hasher = WordHasher()
        for batch in batches:
            for first, hashes, offsets in hasher.groups(batch.column(2)):
                n_rows = len(offsets) - 1
                values, at = distinct(*shingle_hashes(hashes, offsets, words), n_rows)
                full = np.flatnonzero(np.diff(at))
                keys, bands, odd = set_keys(values, at), [None] * n_rows, [None] * n_rows
                if len(full):
                    samples = minhashes(values, np.append(at[full], at[-1]))
                    for i, b, o in zip(full, _signed(band_keys(samples)), _signed(odd_sketches(samples))):
                        bands[i], odd[i] = b, o
                empty = np.diff(at) == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n_rows), batch.column(1).slice(first, n_rows), pa.array(np.diff(at)), pa.array(_signed(keys), mask=empty),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n", "node", "bands", "odd"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(tasks, f"doc_id {kind}, text_key bigint, n bigint, node bigint, bands array<bigint>, odd array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and ``values`` (the sorted set) of the wanted (node, doc_id), from a second pass over the texts of these ids."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("doc_id").alias("h"))))

    def tasks(batches):
        hasher = WordHasher()
        for batch in batches:
            batch = batch.filter(pa.array(passes(batch.column(1).to_numpy(), sent.value)))
            for first, hashes, offsets in hasher.groups(batch.column(2)):
                n_rows = len(offsets) - 1
                values, at = distinct(*shingle_hashes(hashes, offsets, words), n_rows)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_signed(values)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n_rows), pa.array(_signed(set_keys(values, at))), sets], ["doc_id", "node", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    sets = rows.mapInArrow(tasks, f"doc_id {kind}, node bigint, values array<bigint>")
    keep = wanted.select(F.col("doc_id").alias("w_id"), F.col("node").alias("w_node"))
    return sets.join(keep, (F.col("doc_id") == F.col("w_id")) & (F.col("node") == F.col("w_node"))).select("node", "values").dropDuplicates(["node"])


def _allowed(threshold: int):
    """Whether set sizes and odd sketches of the sides a and b allow the threshold (per hundred)."""
    differ = F.expr("aggregate(zip_with(a_odd, b_odd, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    # n bits, k samples a side: 2k(1-J) flips set n/2 (1 - (1 - 2/n)**flips) bits
    share = F.greatest(1 - 2 * differ / F.lit(float(SKETCH)), F.lit(1e-6))
    estimate = 1 + F.log(share) * (SKETCH / (4.0 * HASHES))
    return (100 * F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n")) & (estimate >= threshold / 100 - SLACK), estimate


def _with_sides(pairs: DataFrame, nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    for side in ("a", "b"):
        half = nodes.select(F.col("node").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{new}") for c, new in columns.items()])
        pairs = pairs.join(half, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    return pairs


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = _with_sides(pairs, sets, {"values": "set"})
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.filter(100 * shared >= threshold * (F.size("a_set") + F.size("b_set") - shared)).select("a", "b")


def _block_links(rows: DataFrame, threshold: int) -> DataFrame:
    """Links a, b that join rows of different components. ``rows`` has grp, node, comp, n, bands, odd and values."""
    blocks = rows.groupBy(F.col("grp").alias("_grp")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(blocks, F.col("grp") == F.col("_grp")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})

    def compare(rows):
        node, comp, mine = (rows[c].to_numpy() for c in ("node", "comp", "mine"))
        comp = comp.copy()
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        if (comp == comp[0]).all():
            return
        bands, odd = np.stack(rows["bands"].to_numpy()), np.stack(rows["odd"].to_numpy()).view(np.uint64)
        sets = rows["values"].to_numpy()
        size = np.array([len(x) for x in sets])
        at = np.concatenate([[0], np.cumsum(size)])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        held = np.zeros(codes.max() + 1, bool)
        left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        cut, found = threshold / 100 - SLACK, []
        for i in left:
            js = right[comp[right] != comp[i]]
            if low == high:
                js = js[js > i]
            js = js[100 * np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i])]
            js = js[(bands[js] == bands[i]).any(1)]
            differ = np.bitwise_count(odd[js] ^ odd[i]).sum(1)  # of unsigned words
            js = js[1 + np.log(np.maximum(1 - 2 * differ / SKETCH, 1e-6)) * SKETCH / (4 * HASHES) >= cut]
            if not len(js):
                continue
            own = codes[at[i] : at[i + 1]]
            held[own] = True
            each = np.concatenate([codes[at[j] : at[j + 1]] for j in js])
            shared = np.add.reduceat(held[each].astype(np.int64), np.concatenate([[0], np.cumsum(size[js])[:-1]]))
            held[own] = False
            for j in js[100 * shared >= threshold * (size[js] + size[i] - shared)]:
                if comp[j] != comp[i]:
                    found.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = ["grp", "low", "high", "node", "comp", "mine", "bands", "odd", "values"]
    return by_group(dealt.select(*columns), ["grp", "low", "high"], ["node"], compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """Per document row: doc_id, text_key, n_shingles, node, component_id (smallest id of the group) and kept (is that id). ``threshold`` is per hundred."""
    marks = cut_lineage(signatures(docs, words))
    known = marks.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nodes = cut_lineage(known.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min_by(F.struct("bands", "odd"), "doc_id").alias("mark")
    ).select("node", "rep", "copies", "n", "mark.*"))

    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("count")).filter("count > 1")
    members = cut_lineage(keys.join(buckets, "key"))
    stars = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    allowed, _ = _allowed(threshold)
    pairs = cut_lineage(_with_sides(stars, nodes, {"n": "n", "odd": "odd"}).filter(allowed).select("a", "b"))

    def sets_of(used):
        return cut_lineage(full_sets(docs, nodes.join(used, F.col("node") == F.col("w")).select("node", F.col("rep").alias("doc_id")), words))

    links = cut_lineage(confirm(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()), threshold))
    labels = connected_components(links)

    def comps(df, node, to):
        side = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        return df.join(side, F.col(node) == F.col("_n"), "left").withColumn(to, F.coalesce("_l", node)).drop("_n", "_l")

    crowded = comps(members.filter("count > 2").select("key", "centre", "node"), "node", "comp")
    split = crowded.groupBy(F.col("key").alias("_key")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("_key")
    apart = cut_lineage(crowded.join(split, F.col("key") == F.col("_key")).select(F.col("centre").alias("a"), F.col("node").alias("b"), "comp").distinct())
    if apart.limit(1).count():
        groups = connected_components(apart).select(F.col("node").alias("g_node"), F.col("label").alias("grp"))
        rows = apart.select(F.col("b").alias("w"), "comp").distinct()
        sets = sets_of(rows.select("w")).withColumnRenamed("node", "s_node")
        rows = rows.join(groups, F.col("w") == F.col("g_node")).join(sets, F.col("w") == F.col("s_node"))
        rows = rows.join(nodes.select("node", "n", "bands", "odd"), F.col("w") == F.col("node"))
        links = links.unionByName(cut_lineage(_block_links(rows.select("grp", "node", "comp", "n", "bands", "odd", "values"), threshold)))
        labels = connected_components(links)

    joined = comps(nodes.select("node", "rep", "copies"), "node", "root")
    ids = joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("rows")).filter("rows > 1")
    groups = joined.join(ids.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component_id")
    return marks.join(groups, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "node",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each group of ``docs``: of its smallest id, and of rows equal in id and text the first by the other columns. Rows without words all stay."""
    id_, key, n, kept, at, nth = free_names(docs, "_id", "_key", "_n", "_kept", "_at", "_nth")
    marks = near_duplicates(docs, words, threshold).select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("n_shingles").alias(n), F.col("kept").alias(kept)).distinct()
    rows = docs.withColumn(at, F.xxhash64("text"))
    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(at) == F.col(key)))
    others = [c for c in docs.columns if c not in ("doc_id", "text") and not isinstance(docs.schema[c].dataType, MapType)]
    again = F.row_number().over(Window.partitionBy("doc_id", at).orderBy(*others or [F.lit(0)]))
    single = joined.withColumn(nth, F.when(F.col("doc_id").isNotNull() & (F.col(n) > 0), again).otherwise(1))
    return single.filter(F.col(kept) & (F.col(nth) == 1)).select(*docs.columns)

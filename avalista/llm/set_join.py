"""Jaccard self-join of word-shingle sets by partitioning the universe of shingles, exact by the pigeonhole principle.

1. One pass over the texts gives each document the size and the hash of its set. Documents of equal sets are one *node*; only nodes are joined.
2. Sets are put into size bands such that two sets that may link lie in the same band or in neighbouring ones. For each band, the universe of
   shingles is cut by hash into ``H + 1`` segments, ``H`` being the largest symmetric difference that a pair whose larger set lies in the band may have.
   If every segment of a pair differed, so would more than H shingles.
3. The *index* side (the smaller set of a pair, of the band or the one below) files every one of its segment subsets; in the segments that are
   *flexible* (every eighth, or all if there are no more than eight) also the subsets that lack one element.
4. The *probe* side (the larger set) spends ``H(size) + 1`` units on segments: a segment looked up as it is costs one unit's worth, a flexible one
   looked up with a difference of up to one (its own one-deletion subsets against filed ones, and itself against filed deletions) covers two. Which segments
   are left out and which are looked up in both ways is chosen by cost: how often subsets of this key occur, from a table of ``SLOTS`` counters over the
   filed subsets of all nodes. So frequent subsets (empty ones, boilerplate) are avoided where others can cover for them. Any such choice is exact.
5. A pair of candidates goes on if its sizes allow the threshold and so do its *parity bitmaps* (as many bits as the set has shingles or up to twice that; each
   shingle flips one): two bitmaps differ in no more bits than the sets have different shingles, so this excludes only what cannot link. What goes on is
   verified on the full sets.
6. Sets that meet under a key are not all paired up. In every key's bucket its members are paired with one centre, and the links found give
   components. What is then left are the buckets that hold members of several components. Their members are dealt in blocks of about ``BLOCK`` shingles; each pair of
   blocks of a bucket is one task's work. A first pass keeps the members whose bitmaps allow a link with a member of another component; a second one, over these
   with their full sets, returns fewer links than it has rows, as what a link has joined is not compared again. So no link between components is lost, and
   none is looked for within one.

Odd cases: a row without words is linked with nothing; a null id takes no part and its component is null; rows of one id are texts of
their own, each with the component of its text; an empty table gives an empty result; texts of any length are read whole; other columns are not read. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from avalista.llm.common import bitmap, by_group, cut_lineage, free_shuffles, passes
from avalista.llm.components import connected_components
from avalista.llm.near_dups import confirm, full_sets, set_keys
from avalista.llm.shingles import WordHasher, distinct, mix, shingle_hashes

SLOTS = 1 << 16
FLEXIBLE = 8
BLOCK = 1 << 23


def bands(threshold: int, most: int) -> np.ndarray:
    """The smallest size of each band, up to the one that holds ``most``, and of two more."""
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // threshold + 1)
    return np.array(out + [100 * out[-1] // threshold + 1])


def difference(size, threshold: int):
    """The largest symmetric difference of a linked pair whose larger set has this size."""
    return (100 - threshold) * 2 * size // (100 + threshold)


class Segments:
    """The subsets of a batch of sets in the segments of one band each; ``band`` per set, values sorted within a set."""

    def __init__(self, values: np.ndarray, at: np.ndarray, band: np.ndarray, starts: np.ndarray, threshold: int):
        self.parts = difference(starts[band + 1] - 1, threshold) + 1
        self.first = np.concatenate([[0], np.cumsum(self.parts)])  # of each set's segments
        self.row = np.repeat(np.arange(len(band)), np.diff(at))
        segment = ((values >> np.uint64(32)) * self.parts[self.row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        self.place = self.first[self.row] + segment  # ascending, as values are
        ends = np.searchsorted(self.place, np.arange(self.first[-1] + 1))
        self.sizes = np.diff(ends)
        self.marks = mix(values ^ np.uint64(0x5BD1E9955BD1E995))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.marks)])
        self.sums = sums[ends[1:]] - sums[ends[:-1]]
        number = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.parts)
        parts = np.repeat(self.parts, self.parts)
        self.name = mix((np.repeat(band, self.parts).astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
        self.flexible = (number % FLEXIBLE == 0) | (parts <= FLEXIBLE)
        self.whole = self._keys(self.sums, self.sizes, self.name)
        self.lacking = None

    @staticmethod
    def _keys(sums, sizes, name):
        return mix(sums ^ mix(name + sizes.astype(np.uint64)))

    def without_one(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the one-deletion subsets of flexible segments, and the segment of each."""
        if self.lacking is None:
            which = np.flatnonzero(self.flexible[self.place])
            place = self.place[which]
            self.lacking = self._keys(self.sums[place] - self.marks[which], self.sizes[place] - 1, self.name[place]), place
        return self.lacking


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(8)).astype(np.int64) & (SLOTS - 1)


LACKING = np.uint64(0x9D39247E33776D41)  # tells filed deletions from filed subsets


def allocate(seg: Segments, sizes: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment of each set: whether it is looked up, and whether with a difference of one.

    All segments, less the dearest ones beyond the units needed; then, as long as that is cheaper, one of
    the dearest is left out for a flexible one that is looked up both ways.
    """
    cost = counts[_slot(seg.whole)].astype(float)
    keys, place = seg.without_one()
    more = np.bincount(place, counts[_slot(keys)], len(cost)) + cost  # what looking up both ways adds
    need = difference(sizes, threshold) + 1
    used, both = np.ones(len(cost), bool), np.zeros(len(cost), bool)
    for i in range(len(sizes)):
        a, b = seg.first[i], seg.first[i + 1]
        order = a + np.argsort(-cost[a:b], kind="stable")
        spare = (b - a) - need[i]
        used[order[:spare]] = False
        ups = a + np.flatnonzero(seg.flexible[a:b])
        ups = ups[np.argsort(more[ups], kind="stable")]
        j = spare
        for up in ups:
            if not used[up]:
                continue
            while j < len(order) and (order[j] == up or both[order[j]]):
                j += 1
            if j == len(order) or cost[order[j]] <= more[up]:
                break
            used[order[j]], both[up] = False, True
            j += 1
    return used, both


def _sets(batch, hasher, words, sent=None):
    """For the texts (column 2) of a batch: ids, values, offsets; only of rows whose column 1 passes ``sent``."""
    if sent is not None:
        batch = batch.filter(pa.array(passes(batch.column(1).to_numpy(), sent)))
    for first, hashes, offsets in hasher.groups(batch.column(2)):
        n_rows = len(offsets) - 1
        values, at = distinct(*shingle_hashes(hashes, offsets, words), n_rows)
        yield batch.column(0).slice(first, n_rows), values, at


def parities(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap per set, in which each shingle flips a bit: 64-bit words, and the offsets of each set's. Lengths are powers of two."""
    n = np.diff(at)
    words = (1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)) // 64
    first = np.concatenate([[0], np.cumsum(words)])
    place = (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.repeat(words * 64 - 1, n).astype(np.uint64)).astype(np.int64)
    flips = np.bincount(np.repeat(first[:-1] * 64, n) + place, minlength=first[-1] * 64) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64), first


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), node (hash of the set, null without words) and its parity bitmap."""

    def tasks(batches):
        hasher = WordHasher()
        for batch in batches:
            for ids, values, at in _sets(batch, hasher, words):
                n = np.diff(at)
                bits, first = parities(values, at)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), pa.array(set_keys(values, at).view(np.int64), mask=n == 0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(bits))],
                    ["doc_id", "n", "node", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.lit(0).alias("_"), "text").mapInArrow(tasks, f"doc_id {kind}, n bigint, node bigint, bits array<bigint>")


class Sets:
    """The sets of a batch with what the join files and looks up of them."""

    def __init__(self, values: np.ndarray, at: np.ndarray, starts: np.ndarray, threshold: int):
        self.values, self.at, self.starts, self.threshold = values, at, starts, threshold
        self.nodes, self.n = set_keys(values, at), np.diff(at)
        self.band = np.searchsorted(starts, self.n, side="right") - 1  # -1: empty

    def segments(self, rows: np.ndarray, band: np.ndarray):
        """The segments of the rows in the given bands; bands without room for a difference are left out, as nodes differ."""
        room = difference(self.starts[band + 1] - 1, self.threshold) > 0
        rows, band = rows[room], band[room]
        if not len(rows):
            return rows, None
        values = np.concatenate([self.values[self.at[i] : self.at[i + 1]] for i in rows])
        return rows, Segments(values, np.concatenate([[0], np.cumsum(self.n[rows])]), band, self.starts, self.threshold)

    def filed(self):
        """Segments of the sets in their own band, and in the next one if they may be large enough for it and it is not the last."""
        rows = np.flatnonzero(self.n > 0)
        yield self.segments(rows, self.band[rows])
        rows = rows[(100 * self.n[rows] >= self.threshold * self.starts[self.band[rows] + 1]) & (self.band[rows] + 3 < len(self.starts))]
        yield self.segments(rows, self.band[rows] + 1)


def _passed(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), "text")


def subset_counts(docs: DataFrame, sent, words: int, starts: np.ndarray, threshold: int) -> np.ndarray:
    """How many filed subsets of all nodes fall into each of ``SLOTS`` slots."""

    def tasks(batches):
        hasher, table = WordHasher(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, values, at in _sets(batch, hasher, words, sent.value):
                for _, seg in Sets(values, at, starts, threshold).filed():
                    if seg is not None:
                        table += np.bincount(_slot(seg.whole), minlength=SLOTS)
        held = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(table[held])], ["slot", "count"])

    rows = _passed(docs).mapInArrow(tasks, "slot bigint, count bigint").groupBy("slot").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["count"].to_numpy()
    return out


def entries(docs: DataFrame, sent, words: int, starts: np.ndarray, threshold: int, counts, lacking=None) -> DataFrame:
    """key, node, n, filed, probe: what the nodes file and look up; a subset that is both is one row.

    ``lacking`` is a bitmap of the keys looked up among filed deletions; others of those are left out. Without it, only these look-ups are returned.
    """

    def tasks(batches):
        hasher = WordHasher()
        for batch in batches:
            for _, values, at in _sets(batch, hasher, words, sent.value):
                sets, out = Sets(values, at, starts, threshold), []
                for own, (rows, seg) in zip((True, False), sets.filed()):
                    if seg is None:
                        continue
                    owner, used = np.repeat(rows, seg.parts), np.zeros(len(seg.whole), bool)
                    if own:  # a set is looked up in its own band
                        used, both = allocate(seg, sets.n[rows], counts.value, threshold)
                        out.append((seg.whole[both] ^ LACKING, owner[both], False, True))
                    if lacking is None:
                        break
                    keys, place = seg.without_one()
                    if own:
                        out.append((keys[both[place]], owner[place[both[place]]], False, True))
                    out.append((seg.whole, owner, True, used))
                    known = passes((keys ^ LACKING).view(np.int64), lacking.value)
                    out.append((keys[known] ^ LACKING, owner[place[known]], True, False))
                for keys, owner, filed, probe in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(sets.nodes[owner].view(np.int64)), pa.array(sets.n[owner]), *[pa.array(np.full(len(keys), x)) for x in (filed, probe)]],
                        ["key", "node", "n", "filed", "probe"])

    return _passed(docs).mapInArrow(tasks, "key bigint, node bigint, n bigint, filed boolean, probe boolean")


def candidates(docs: DataFrame, nodes: DataFrame, n_nodes: int, most: int, words: int, threshold: int) -> DataFrame:
    """key, node, n, centre: the members of every bucket that holds something looked up and something else that is filed."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(bitmap(nodes.select(F.xxhash64("rep").alias("h")), 1 << min(25, max(16, (16 * n_nodes).bit_length()))))
    starts = bands(threshold, most)
    counts = context.broadcast(subset_counts(docs, sent, words, starts, threshold))
    lacking = context.broadcast(bitmap(entries(docs, sent, words, starts, threshold, counts).select(F.col("key").alias("h"))))
    key = Window.partitionBy("key")
    found = entries(docs, sent, words, starts, threshold, counts, lacking).withColumns({
        "lo": F.min("node").over(key), "hi": F.max("node").over(key), "asked": F.bool_or("probe").over(key),
        "centre": F.min(F.when(F.col("filed"), F.col("node"))).over(key)})
    found = cut_lineage(found.filter("lo < hi AND asked AND centre IS NOT NULL").select("key", "node", "n", "centre").distinct())
    for held in (sent, counts, lacking):
        held.destroy()
    return found


def allowed(threshold: int):
    """Whether the sizes and the parity bitmaps of the sides a and b allow the threshold."""
    shorter = F.least(F.size("a_bits"), F.size("b_bits"))

    def folded(side):  # lengths of two sides whose sizes fit are equal or differ by a factor of two
        return F.when(F.size(side) == shorter, F.col(side)).otherwise(
            F.zip_with(F.slice(side, F.lit(1), shorter), F.slice(side, shorter + 1, shorter), lambda x, y: x.bitwiseXOR(y)))

    differ = F.aggregate(F.zip_with(folded("a_bits"), folded("b_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    fits = 100 * F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n")
    return F.when(fits, (100 + threshold) * differ <= (100 - threshold) * (F.col("a_n") + F.col("b_n"))).otherwise(False)


def _with_sides(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        half = nodes.select(F.col("node").alias(f"_{side}"), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits"))
        pairs = pairs.join(half, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    return pairs


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks of its bucket that its own block is part of: low, high, and its own as ``mine``."""
    sizes = rows.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, F.col("key") == F.col("_key")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("_key", "blocks", "other")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and their offsets."""
    column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


class Bucket:
    """The rows of a pair of blocks: for a row, those of other components that sizes and bitmaps allow."""

    def __init__(self, rows: pa.Table, threshold: int):
        self.node, self.comp, mine, self.n = (rows[c].to_numpy() for c in ("node", "comp", "mine", "n"))
        self.comp, self.threshold = self.comp.copy(), threshold
        self.low, self.high = rows["low"][0].as_py(), rows["high"][0].as_py()
        self.left, self.right = np.flatnonzero(mine == self.low), np.flatnonzero(mine == self.high)
        words, at = _lists(rows["bits"])
        words, self.width = words.view(np.uint64), np.diff(at)
        self.bits, self.place = {}, {}
        for w in np.unique(self.width).tolist():  # every row of w words, or of twice as many, as w words
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            self.place[w] = np.full(len(self.n), -1)
            self.place[w][own], self.place[w][twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            one = np.arange(w)
            self.bits[w] = np.concatenate([words[at[own][:, None] + one], words[at[twice][:, None] + one] ^ words[at[twice][:, None] + w + one]])

    def partners(self, i: int) -> np.ndarray:
        n, t, out = self.n, self.threshold, []
        js = self.right[self.comp[self.right] != self.comp[i]]
        js = js[js > i] if self.low == self.high else js
        js = js[100 * np.minimum(n[js], n[i]) >= t * np.maximum(n[js], n[i])]
        shorter = np.minimum(self.width[js], self.width[i])
        for w in np.unique(shorter).tolist():
            ks = js[shorter == w]
            for k in range(0, len(ks), 4096):
                part = ks[k : k + 4096]
                differ = np.bitwise_count(self.bits[w][self.place[w][part]] ^ self.bits[w][self.place[w][i]]).sum(1, dtype=np.int64)
                out.append(part[(100 + t) * differ <= (100 - t) * (n[part] + n[i])])
        return np.concatenate(out) if out else js


BUCKET = ["key", "low", "high", "node", "comp", "mine", "n", "bits"]


def bucket_members(rows: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Of ``rows`` (key, node, comp, n), those that may link with a row of another component of their bucket, with their bitmaps from ``nodes``."""

    def keep(rows):
        if len(set(rows["comp"].to_pylist())) > 1:
            bucket, found = Bucket(rows, threshold), np.zeros(len(rows), bool)
            for i in bucket.left:
                js = bucket.partners(i)
                found[js] = True
                found[i] |= len(js) > 0
            yield from rows.filter(pa.array(found)).select(["key", "node", "comp", "n", "bits"]).to_batches()

    dealt = _dealt(rows).join(nodes.select(F.col("node").alias("_node"), "bits"), F.col("node") == F.col("_node"))  # bitmaps travel once
    return by_group(dealt.select(*BUCKET), ["key", "low", "high"], ["node"], keep, "key bigint, node bigint, comp bigint, n bigint, bits array<bigint>")


def bucket_links(rows: DataFrame, threshold: int) -> DataFrame:
    """Links a, b that join the components within each bucket, as far as they can be joined. ``rows`` has key, node, comp, n, bits and values."""

    def link(rows):
        bucket, found = Bucket(rows, threshold), []
        values, at = _lists(rows["values"])
        codes = np.unique(values, return_inverse=True)[1]
        held = np.zeros(len(values) + 1, bool)
        comp, n = bucket.comp, bucket.n
        for i in bucket.left:
            js = bucket.partners(i)
            if not len(js):
                continue
            held[codes[at[i] : at[i + 1]]] = True
            ends = np.cumsum(n[js])
            total = np.concatenate([[0], np.cumsum(held[codes[np.arange(ends[-1]) + np.repeat(at[js] - (ends - n[js]), n[js])]])])
            shared = total[ends] - total[ends - n[js]]
            held[codes[at[i] : at[i + 1]]] = False
            for j in js[100 * shared >= threshold * (n[js] + n[i] - shared)]:
                if comp[j] != comp[i]:
                    found.append((bucket.node[i], bucket.node[j]))
                    comp[comp == comp[j]] = comp[i]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return by_group(_dealt(rows).select(*BUCKET, "values"), ["key", "low", "high"], ["node"], link, "a bigint, b bigint")


def joined(docs: DataFrame, words: int = 4, threshold: int = 85) -> DataFrame:
    """Per document row: doc_id, n_shingles, node and component_id, the smallest doc_id reachable by links. ``threshold`` is per hundred."""
    marks = cut_lineage(document_sets(docs, words))
    known = marks.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nodes = cut_lineage(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min_by("bits", "doc_id").alias("bits")))
    n_nodes, most = nodes.agg(F.count("*"), F.max("n")).first()
    whole = nodes.select("node", "rep", F.col("node").alias("root"))

    def sets_of(used):
        """The full sets of the nodes in the column ``w``."""
        return cut_lineage(full_sets(docs, nodes.join(used.distinct(), F.col("node") == F.col("w")).select("node", F.col("rep").alias("doc_id")), words))

    def with_label(df, labels, node, to):
        return df.join(labels.select(F.col("node").alias("_n"), F.col("label").alias("_l")), F.col(node) == F.col("_n"), "left").withColumn(to, F.coalesce("_l", node)).drop("_n", "_l")

    if n_nodes > 1:
        members = candidates(docs, nodes, n_nodes, most, words, threshold)
        free_shuffles(docs.sparkSession)  # here and below: what is written is behind a checkpoint, and the next shuffles are large
        stars = members.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        stars = cut_lineage(_with_sides(stars, nodes).filter(allowed(threshold)).select("a", "b"))
        free_shuffles(docs.sparkSession)
        labels = connected_components(confirm(stars, sets_of(stars.select(F.explode(F.array("a", "b")).alias("w"))), threshold))
        free_shuffles(docs.sparkSession)

        rows = with_label(members.select("key", "node", "n"), labels, "node", "comp")
        split = rows.groupBy(F.col("key").alias("_key")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        rows = rows.join(split, F.col("key") == F.col("_key")).select("key", "node", "comp", "n")
        rows = cut_lineage(bucket_members(rows, nodes, threshold))
        free_shuffles(docs.sparkSession)
        sets = sets_of(rows.select(F.col("node").alias("w"))).withColumnRenamed("node", "_node")
        links = bucket_links(rows.join(sets, F.col("node") == F.col("_node")).drop("_node"), threshold)
        links = with_label(with_label(links, labels, "a", "a_comp"), labels, "b", "b_comp")  # between the components of before
        joins = connected_components(links.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
        free_shuffles(docs.sparkSession)
        whole = with_label(with_label(nodes.select("node", "rep"), labels, "node", "comp"), joins, "comp", "root")

    ids = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = whole.join(ids.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component_id")
    return marks.join(named, F.col("node") == F.col("_node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "node", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))

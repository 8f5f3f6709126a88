"""I-Match fingerprints over randomised lexicon subsets, as column expressions.

Terms are runs of letters and digits in lower case. The lexicon holds the terms whose share of documents lies in ``BAND``
(an inverse-document-frequency band): words that nearly all texts have tell nothing, words that hardly any has do not last. Document
frequencies are counted over all documents in ``2**BUCKET_BITS`` hash buckets, so both the count's shuffle and the lexicon, a
bitmap of buckets, have a fixed size at any corpus size.

A classic I-Match digest changes with any one term. Here each of ``FAMILIES`` families draws a random bit pattern, which fixes
``len(LEVELS)`` random subsets of the lexicon: the terms whose hash begins with the pattern's first 2, 3, ... 12 bits, so about a quarter, an
eighth, ... a 4096th of it. The subsets are the same for every text. A text's fingerprint holds one digest of each subset, over all of the
text's sorted distinct terms in it (0 where it has none), and one of the whole lexicon. As usual with randomised lexicons, one equal digest is a
match: likeness is the share of families in which some subset gives both texts the same digest, not counting empty ones, and 1 where
the digests of the whole lexicon are equal. Dense subsets tell near copies of short texts, sparse ones those of long texts or after many edits.
A text with no lexicon term uses all its terms.

Null texts count as empty: their digests are those of no terms, all 0. Equal texts have equal fingerprints. Rows with a null id come first in the
order of documents; equal ids are ordered by the hash of their texts, repeated rows are each returned. An empty table gives an empty result. Very
long texts are used whole. Columns are added beside those of the input; helper columns take names that the input does not have.
"""

from __future__ import annotations

import random
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avalista.llm.common import free_names, shuffle_partitions
from avalista.operators.ordered import part_of
from avalista.session import broadcast_if_small

BAND = (0.0005, 0.03)
BUCKET_BITS = 19
FAMILIES = 16
LEVELS = range(2, 13)  # leading bits that a subset fixes
PART_ROWS = 1 << 14  # rows of a range of ids
_draw = random.Random(31)
PATTERNS = [_draw.getrandbits(62) for _ in range(FAMILIES)]
SPLIT = r"[^\p{L}\p{N}]+"


def _terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents per hash bucket of terms."""
    term = docs.select(F.explode(_terms(F.col(text_col))).alias("term")).filter("term <> ''")
    return term.groupBy(F.xxhash64("term").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("bucket")).agg(F.count("*").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> Column:
    """The buckets inside the band, as a literal array of ``2**(BUCKET_BITS - 6)`` 64-bit words; the driver holds no more than these."""
    words = docs.sparkSession.range(1 << (BUCKET_BITS - 6)).withColumnRenamed("id", "word")
    n = docs.agg(F.count("*")).scalar()
    inside = document_frequencies(docs, text_col).filter((F.col("df") >= n * F.lit(band[0])) & (F.col("df") <= n * F.lit(band[1])))
    bits = inside.groupBy(F.shiftright("bucket", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits"))
    dense = words.join(bits, F.col("word") == F.col("_word"), "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("w"))
    return F.lit(np.array(dense.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"])).first()[0], np.int64))


def with_fingerprint(df: DataFrame, text_col: str, known: Column, into: str) -> DataFrame:
    """Add the digests of a text column: ``whole`` (the lexicon) and ``families`` (an array of its subsets' digests for each). ``known`` comes from ``lexicon``."""
    mask = (1 << BUCKET_BITS) - 1
    word = lambda h: F.get(known, F.shiftright(h.bitwiseAND(F.lit(mask)), 6).cast("int"))
    inside = lambda h: F.bit_get(word(h), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    all_, in_, kept_, wide_ = free_names(df, "_all", "_in", "_kept", "_wide")
    out = df.withColumn(all_, F.transform(F.filter(_terms(F.col(text_col)), lambda t: t != ""), lambda t: F.xxhash64(t)))
    out = out.withColumn(in_, F.filter(all_, inside))
    out = out.withColumn(kept_, F.array_sort(F.transform(F.when(F.size(in_) > 0, F.col(in_)).otherwise(F.col(all_)), lambda h: F.shiftrightunsigned(h, 2))))
    subset = lambda terms, pattern, below: F.filter(terms, lambda h: h.bitwiseXOR(pattern) < below)
    digest = lambda terms: F.shiftright(F.xxhash64(terms), 32).cast("int")  # noqa: E731  (the hash of no terms is its small seed, so 0 here)
    below = [F.lit(1 << (62 - bits)) for bits in LEVELS]
    widest = F.transform(F.array(*map(F.lit, PATTERNS)), lambda c: F.struct(c.alias("c"), subset(F.col(kept_), c, below[0]).alias("terms")))
    dense = lambda w: F.transform(F.array(*below[:3]), lambda b: digest(subset(w["terms"], w["c"], b)))
    sparse = lambda w: F.transform(F.array(*below[3:]), lambda b: digest(subset(w["few"], w["c"], b)))
    families = lambda w: F.concat(dense(w), sparse(w))
    narrowed = lambda w: F.struct(w["c"].alias("c"), w["terms"].alias("terms"), subset(w["terms"], w["c"], below[3]).alias("few"))
    out = out.withColumn(wide_, F.transform(widest, narrowed))  # the sparse subsets lie inside the fourth, so they are looked for there
    return out.withColumn(into, F.struct(digest(F.col(kept_)).alias("whole"), F.transform(wide_, families).alias("families"))).drop(all_, in_, kept_, wide_)


def written(mark: Column) -> Column:
    """The digests in order, eight hexadecimal digits each."""
    digits = lambda d: F.lower(F.lpad(F.hex(d.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.concat(digits(mark["whole"]), F.array_join(F.transform(F.flatten(mark["families"]), digits), ""))


def likeness(one: Column, other: Column) -> Column:
    """Share of the families in which a subset's digest agrees; 1 if that of the whole lexicon does."""
    agrees = lambda a, b: F.exists(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda same: same).cast("int")
    agree = F.aggregate(F.zip_with(one["families"], other["families"], agrees), F.lit(0), lambda s, x: s + x)
    return F.when(one["whole"] == other["whole"], F.lit(1.0)).otherwise(agree / F.lit(float(FAMILIES)))


def with_next(df: DataFrame, id_col: str, text_col: str, columns: dict[str, str], parts: int | None = None) -> DataFrame:
    """Add columns of the next row in ascending order of id (after the last: the first), under new names.

    Rows are dealt to ranges of id and text hash, so rows of one id spread over ranges too, and looked up inside a range; there are as many
    ranges as the rows need. The first row of a range is also sent, as a marked copy, to the end of the range before it;
    so no window spans more than a range. The driver sees a sample of keys for the cuts.
    """
    key_, hash_, part_, copy_, head_, before_, spot_ = free_names(df, "_key", "_hash", "_part", "_copy", "_head", "_before", "_spot")
    parts = parts or max(2 * shuffle_partitions(df.sparkSession), ceil(df.count() / PART_ROWS))
    keyed = df.withColumns({key_: F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))), hash_: F.xxhash64(text_col)})
    placed = keyed.withColumn(part_, part_of(keyed, [F.col(key_).asc(), F.col(hash_).asc()], parts))
    heads = placed.groupBy(part_).agg(F.min(F.struct(key_, hash_)).alias(head_))  # one row per range
    earlier = F.coalesce(F.lag(part_).over(Window.orderBy(part_)), F.max(part_).over(Window.partitionBy(F.lit(0))))
    heads = broadcast_if_small(heads.select(head_, earlier.alias(before_)))
    spot = lambda part, copy: F.struct(F.col(part).cast("int").alias("part"), F.lit(copy).alias("copy"))
    marked = placed.join(heads, F.struct(key_, hash_) == F.col(head_), "left")  # one pass: copies are made from the rows, not read again
    spots = F.when(F.col(head_).isNull(), F.array(spot(part_, 0))).otherwise(F.array(spot(part_, 0), spot(before_, 1)))
    dealt = marked.withColumn(spot_, F.explode(spots)).withColumns({part_: F.col(spot_)["part"], copy_: F.col(spot_)["copy"]})
    dealt = dealt.drop(head_, before_, spot_).repartition(parts, part_)
    order = Window.partitionBy(part_).orderBy(copy_, key_, hash_)
    out = dealt.withColumns({n: F.lead(c).over(order) for c, n in columns.items()}).filter(F.col(copy_) == 0)
    return out.drop(key_, hash_, part_, copy_)


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the beginning of another."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))

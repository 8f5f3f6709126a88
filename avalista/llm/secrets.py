"""Secret scan with multipart credential linking.

Strong secrets (``assign``, ``access``, ``hex``) are found by pattern alone. Weaker
parts of a credential, an ``identifier`` (user or client id), a ``weak`` secret (a short
assigned value or a bare mixed token) and an ``endpoint`` (URL or host with port), are common in
ordinary text, so each is reported only when its complement stands in the same
scope, at most ``scope`` code points away:

* an identifier needs a secret (strong or weak) in scope,
* a weak secret needs an identifier (an access id counts) in scope,
* an endpoint needs both.

The parts of all documents meet in one interval join: parts are dealt to bins of the
scope's width, equi-joined on document and bin, and kept when their gap is small
enough. A part that may be reported stands in the bins of its start and of its end, a partner in all
bins that it reaches, so a part of any length meets what comes before and behind it.
A bin holds at most ``scope`` start and end positions, so a very long document
spreads over many keys and no key can grow with the data.

Null text counts as empty; a null id is kept; repeated rows are each returned; columns
other than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from avalista.llm.common import cut_lineage, free_names

KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")
BASE = KINDS[:3]
SCOPE = 240

# fixed values: the strong patterns; a match counts if its group reaches the length
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

# the weak parts
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""",
    re.I | re.A,
)
IDENTIFIER_WORDS = ("user", "login", "clientid", "client_id", "accountid", "account_id", "access")
WEAK = re.compile(r"""(?<![A-Za-z0-9])(?:password|passwd|pwd|pass|secret|token|api_?key|private_?key)["']?\x20*[:=]\x20*["']?([^\s"',;]{4,})""", re.I | re.A)
WEAK_WORDS = (*ASSIGN_WORDS, "pwd", "pass", "private")
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}:\d{2,5}(?!\d)""")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


def strong_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    """The strong spans of a text, by start, then kind."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_parts(text: str, low: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidate parts outside the strong spans; none where a text has no identifier at all."""
    identifiers = []
    if any(w in low for w in IDENTIFIER_WORDS):
        identifiers = [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    if not identifiers and not any(kind == "access" for kind, _, _ in strong):
        return []
    found = []
    if any(w in low for w in WEAK_WORDS):
        found += [("weak", *m.span()) for m in WEAK.finditer(text)]
    mixed = (any("a" <= c <= "z" for c in m[0]) and any("A" <= c <= "Z" for c in m[0]) and any("0" <= c <= "9" for c in m[0])
             for m in BARE.finditer(text))
    found += [("weak", *m.span()) for m, ok in zip(BARE.finditer(text), mixed) if ok]
    found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    starts, ends, kept = [], [], []  # what is taken, as disjoint intervals in order
    for _, start, end in sorted(strong, key=lambda s: s[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for part in sorted({*identifiers, *found}, key=lambda s: (KINDS.index(s[0]), s[1], s[2])):
        at = bisect_right(ends, part[1])  # the first interval that ends behind the part's start
        if at == len(ends) or starts[at] >= part[2]:
            kept.append(part)
            if part[0] != "endpoint":
                starts.insert(at, part[1])
                ends.insert(at, part[2])
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, ``text_key``, strong spans and candidate parts, in one pass over the texts."""

    def tasks(batches):
        for batch in batches:
            strong, weak = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                low = text.lower()
                strong.append(strong_spans(text, low))
                weak.append(weak_parts(text, low, strong[-1]))
            as_rows = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in spans], SPANS) for spans in (strong, weak)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *as_rows], ["id", "text_key", "strong", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tasks, f"id {kind}, text_key bigint, strong {SPANS_DDL}, parts {SPANS_DDL}")


def link_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The candidate parts whose complement stands in scope: id, text_key, kind, start, end."""
    part = F.explode(F.concat("strong", "parts")).alias("part")
    parts = scanned.filter(F.size("parts") > 0).select("id", "text_key", part).select("id", "text_key", "part.*").distinct()
    side = F.when(F.col("kind").isin("identifier", "access"), "id").when(F.col("kind") == "endpoint", "at").otherwise("secret")
    bins = F.array_distinct(F.array(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))
    here = parts.withColumns({"side": side, "bin": F.explode(bins)})
    other = parts.select(
        F.col("id").alias("o_id"), F.col("text_key").alias("o_key"), side.alias("o_side"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor((F.col("start") - scope) / scope) - 1, F.floor((F.col("end") + scope) / scope))).alias("o_bin"),
    )
    gap = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    same = (F.col("id").eqNullSafe(F.col("o_id")) & (F.col("text_key") == F.col("o_key")) & (F.col("bin") == F.col("o_bin"))
            & (F.col("side") != F.col("o_side")) & (gap <= scope))
    has = lambda what: F.max(F.col("o_side") == what)
    met = here.join(other, same).groupBy("id", "text_key", "kind", "start", "end").agg(has("id").alias("by_id"), has("secret").alias("by_secret"))
    return met.filter(
        ((F.col("kind") == "identifier") & F.col("by_secret"))
        | ((F.col("kind") == "weak") & F.col("by_id"))
        | ((F.col("kind") == "endpoint") & F.col("by_id") & F.col("by_secret"))
    ).select("id", "text_key", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document row: ``id``, ``text_key``, ``base`` (strong spans) and ``spans`` (strong and linked), by start, then kind."""
    scanned = cut_lineage(scan(docs, id_col, text_col))
    span = F.struct("kind", "start", "end")
    linked = link_parts(scanned, scope).groupBy(F.col("id").alias("l_id"), F.col("text_key").alias("l_key")).agg(F.collect_set(span).alias("linked"))
    found = scanned.join(linked, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")), "left")
    everything = F.concat("strong", F.coalesce("linked", F.array().cast(SPANS_DDL)))
    return found.select("id", "text_key", F.col("strong").alias("base"), by_place(everything).alias("spans"))


def by_place(spans: Column) -> Column:
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    back = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.transform(F.array_sort(F.transform(spans, order)), back)


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_secrets(docs: DataFrame, scope: int = SCOPE, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and ``n_chars``, if there is such a column, set anew where a text changed."""
    id_, key, spans, at = free_names(docs, "_id", "_key", "_spans", "_at")
    found = find_secrets(docs, scope=scope).filter(F.size("spans") > 0)
    cuts = found.select(F.col("id").alias(id_), F.col("text_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([id_, key])
    joined = docs.withColumn(at, F.xxhash64("text")).join(cuts, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(at) == F.col(key)), "left")
    rows = joined.select(*docs.columns, spans)
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def tasks(batches):
        for batch in batches:
            columns, cuts = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            if len(hit := np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))):
                texts = columns[at_text].to_pylist()
                for i in hit:
                    texts[i] = masked(texts[i], [(s["start"], s["end"]) for s in cuts[int(i)].as_py()], mark)
                columns[at_text] = pa.array(texts, columns[at_text].type)
                if at_chars is not None:
                    chars = columns[at_chars].to_pylist()
                    for i in hit:
                        chars[i] = len(texts[i])
                    columns[at_chars] = pa.array(chars, columns[at_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(tasks, StructType(rows.schema.fields[:-1]))


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """A text with every span, by start, replaced; what overlaps an earlier span lengthens it."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])

"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

Encoding:

1. Tasks split texts into words as the tokenizer's own steps do (special strings first, then NFC, lower case, its split pattern) and
   number the distinct words of a block of rows (``DISTINCT`` words, some MB of text). A row shrinks to the numbers of its words.
2. The blocks' words are dealt by hash, so that all occurrences of a word meet in one partition of the distinct-word table, where it is encoded once.
3. Ids go back to the blocks; each block joins them to its rows by the numbers, which keep the words' positions.

So the shuffles carry two bytes per word occurrence and each block's distinct words, never an occurrence as a row, and
the words that make up most of a corpus cost one row per block. A word of a third of all occurrences is no hot key.

Decoding looks every id up in the table of pieces, whose size the tokenizer fixes (49,408 here), so that side travels to all tasks.

``ids`` are packed as little-endian unsigned 32-bit integers. A null text counts as empty and has no ids; null ids are kept; repeated
rows and rows of equal text are each returned; the columns named in ``keep`` come back with them. The tokenizer's file
is read on the driver; its layout is checked, and anything but this kind of tokenizer is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from avalista.llm.common import shuffle_partitions

DISTINCT = 60_000
BLOCK_CHARS = 1 << 23
BLOCK, PLACES, WORDS = "_bpe_block", "_bpe_numbers", "_bpe_words"
# fixed values: the tokenizer's pattern; below U+0250 the classes of letters, numbers and white space can be written out
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
ANY = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}"))


def read_tokenizer(path: str) -> dict:
    """The tokenizer's file as text, its special strings, and its pieces by id."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    steps = [s["type"] for s in spec["normalizer"]["normalizers"]], [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or split["pattern"] != {"Regex": PATTERN} or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path}: not a lower-casing word BPE of the kind this operator splits for")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = {**{i: p for p, i in spec["model"]["vocab"].items()}, **{i: s for s, i in special.items()}}
    return {"text": text, "special": special, "pieces": pieces}


def _lower(text: str) -> str:
    """Lower case character by character: no special final sigma."""
    return text.replace("Σ", "σ").lower()


def plain_words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = _lower(text)
    return (ANY if BEYOND_LATIN.search(text) else LATIN).findall(text)


class Splitter:
    def __init__(self, special):
        self.special = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return plain_words(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else plain_words(part)
        return out


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the next free code points."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def split_blocks(docs: DataFrame, keep: list[str], special: dict[str, int], parts: int) -> DataFrame:
    """Rows of two kinds by block: a row per document with its words' numbers, and a row with the block's words, dealt in ``parts``."""
    names = [*keep, BLOCK, PLACES, WORDS]

    def tasks(batches):
        split, held, numbers, chars = Splitter(special), [], _Numbers(), 0
        types = None

        def flush():
            words = list(numbers)
            raw = [w.encode() for w in words]
            part = np.array([zlib.crc32(w) % parts for w in raw], np.int64)
            order = np.argsort(part, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            width = np.uint16 if len(words) <= 1 << 16 else np.uint32
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            blobs = [pa.compress(b"\n".join(raw[i] for i in order[a:b]), "zstd", asbytes=True) for a, b in zip(cuts, cuts[1:])]
            rows = [pa.compress(place[n].astype(width).tobytes(), "zstd", asbytes=True) + np.array([len(n), np.dtype(width).itemsize], "<u4").tobytes() for _, n in held]
            # named by content, so a block that is made again has the same name
            name = int.from_bytes(hashlib.blake2b(b"".join(rows + blobs), digest_size=8).digest(), "little", signed=True)
            columns = [pa.array([*(values[k] for values, _ in held), None], t) for k, t in enumerate(types)]
            sizes = np.diff(cuts).astype("<u4").tobytes()
            columns += [pa.array([name] * (len(rows) + 1), pa.int64()), pa.array([*rows, sizes], pa.binary()), pa.array([*[None] * len(rows), blobs], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            types = [batch.column(k).type for k in range(len(keep))]
            kept = list(zip(*(batch.column(k).to_pylist() for k in range(len(keep))))) if keep else [()] * batch.num_rows
            for values, text in zip(kept, batch.column(len(keep))):
                text = text.as_py() or ""
                found = split(text)
                held.append((values, np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))))
                chars += len(text)
                if len(numbers) >= DISTINCT or chars >= BLOCK_CHARS:
                    yield flush()
                    held, numbers, chars = [], _Numbers(), 0
        if held:
            yield flush()

    rows = docs.select(*keep, "text")
    fields = [StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(tasks, StructType([*fields, StructField(BLOCK, LongType()), StructField(PLACES, BinaryType()), StructField(WORDS, ArrayType(BinaryType()))]))


def encode_words(blocks: DataFrame, source: str, special: dict[str, int], parts: int) -> DataFrame:
    """The distinct-word table: block, part and the ids of the block's words of that part; every word is encoded once."""
    sent = blocks.sparkSession.sparkContext.broadcast(source)
    width = len(blocks.columns)

    def pick(batches):
        for batch in batches:
            block, words = batch.column(width - 3), batch.column(width - 1)
            for i in np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False)):
                blobs = words[int(i)].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[int(i)].as_py()] * len(blobs), pa.int64()), pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())],
                    ["block", "part", "words"])

    def encode(batches):
        from tokenizers import Tokenizer

        model, letters, known = Tokenizer.from_str(sent.value).model, byte_letters(), {}
        table = str.maketrans({chr(b): c for b, c in letters.items()})

        def ids_of(word: str) -> bytes:
            if word in special:
                ids = [special[word]]
            else:
                ids = [t.id for t in model.tokenize(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(table))]
            return np.array(ids, "<u4").tobytes()

        for batch in batches:
            out = []
            for blob in batch.column(2):
                blob = blob.as_py()
                ids = []
                for word in unpack(blob).decode().split("\n") if blob else []:
                    if word:
                        found = known.get(word)
                        if found is None:
                            found = known[word] = ids_of(word)
                        ids.append(found)
                lengths = np.array([len(x) // 4 for x in ids], "<u4")
                both = np.concatenate([lengths, np.frombuffer(b"".join(ids), "<u4")])
                small = both.astype("<u2") if both.size == 0 or both.max() < 1 << 16 else both
                out.append(pa.compress(small.tobytes(), "zstd", asbytes=True) + np.array([len(lengths), small.nbytes, small.itemsize], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "part", "ids"])

    dealt = blocks.mapInArrow(pick, "block bigint, part int, words binary").repartition(parts, "part")
    return dealt.mapInArrow(encode, "block bigint, part int, ids binary")


def unpack(data: bytes) -> bytes:
    """A zstd frame whose size is found by reading it."""
    with pa.input_stream(pa.BufferReader(data), compression="zstd") as stream:
        return stream.read()


def encode_documents(docs: DataFrame, tokenizer: dict, keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``ids`` of every row of ``docs``. ``tokenizer`` comes from ``read_tokenizer``."""
    keep, parts = list(keep), shuffle_partitions(docs.sparkSession)
    blocks = split_blocks(docs, keep, tokenizer["special"], parts).repartition(parts, BLOCK)
    words = encode_words(blocks, tokenizer["text"], tokenizer["special"], parts)

    def join(left, right):
        right = right.sort_by("part")
        packed = {}
        for part, ids in zip(right["part"].to_pylist(), right["ids"].to_pylist()):
            packed.setdefault(part, ids)  # equal blocks have equal tables
        lengths, ids = [], []
        for part in sorted(packed):
            data = packed[part]
            n, size, item = np.frombuffer(data[-12:], "<u4")
            both = np.frombuffer(pa.decompress(data[:-12], int(size), "zstd"), "<u2" if item == 2 else "<u4")
            lengths.append(both[:n].astype(np.int64))
            ids.append(both[n:].astype("<u4"))
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        rows = left.filter(left[WORDS].is_null())
        out = []
        for data in rows[PLACES].to_pylist():
            n, item = np.frombuffer(data[-8:], "<u4")
            at = np.frombuffer(pa.decompress(data[:-8], int(n) * int(item), "zstd"), "<u2" if item == 2 else "<u4") if n else np.zeros(0, np.int64)
            many = lengths[at]
            ends = np.cumsum(many)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - many), many)
            out.append(ids[take].tobytes())
        return pa.Table.from_arrays([*(rows[k] for k in keep), pa.array(out, pa.binary())], [*keep, "ids"])

    schema = StructType([*blocks.schema.fields[: len(keep)], StructField("ids", BinaryType())])
    return blocks.groupBy(BLOCK).cogroup(words.groupBy("block")).applyInArrow(join, schema)


def decode_documents(encoded: DataFrame, tokenizer: dict, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: their pieces, joined by a space, as the tokenizer has no decoder of its own."""
    size = max(tokenizer["pieces"], default=-1) + 1
    pieces = encoded.sparkSession.sparkContext.broadcast([tokenizer["pieces"].get(i, "") for i in range(size)])
    kept = [c for c in encoded.columns if c != text_col]
    at = kept.index(ids_col)

    def tasks(batches):
        table = pieces.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # a few texts at a time
                part = batch.slice(start, 256)
                texts = [" ".join(map(table.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*kept, text_col])

    rows = encoded.select(*kept)
    return rows.mapInArrow(tasks, StructType([*rows.schema.fields, StructField(text_col, StringType())]))

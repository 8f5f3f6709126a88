"""Fingerprints, main text, toxicity, BPE and the pipeline, against plain versions over the small tables."""

import hashlib
import html
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from avalista.llm import bpe, html_main, imatch, toxicity
from avalista.llm.queries import QUERIES, public_tokenizer

DOCS = "doc_id long, text string, _key string, lang string"


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


# --- I-Match ---


def edit(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def xxh(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def plain_prints(texts):
    """Fingerprints of texts over the lexicon of the first list, term by term."""
    terms = lambda text: {t for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t}
    counts = Counter(xxh(t.encode()) % (1 << imatch.BUCKET_BITS) for text in texts for t in terms(text))
    low, high = (share * len(texts) for share in imatch.BAND)

    def digest(hashes):
        seed = 42
        for h in sorted(hashes):
            seed = xxh(struct.pack("<q", h), seed)
        return f"{seed >> 32:08x}"

    def of(text):
        found = [xxh(t.encode()) for t in terms(text)]
        kept = [h >> 2 for h in [h for h in found if low <= counts[h % (1 << imatch.BUCKET_BITS)] <= high] or found]
        subsets = [[h for h in kept if h >> (62 - bits) == pattern >> (62 - bits)] for pattern in imatch.PATTERNS for bits in imatch.LEVELS]
        return "".join(map(digest, [kept, *subsets]))

    return of


def plain_likeness(one, other):
    one, other = (re.findall(".{8}", x) for x in (one, other))
    same, n = [a == b != "0" * 8 for a, b in zip(one[1:], other[1:])], len(imatch.LEVELS)
    return 1.0 if one[0] == other[0] else np.mean([any(same[i : i + n]) for i in range(0, len(same), n)])


def test_imatch_query(spark, sf):
    docs = sorted(table(sf, "documents"), key=lambda r: r["doc_id"])
    rows = {r.doc_id: r for r in QUERIES["op4_imatch"](spark, sf).collect()}
    assert len(rows) == len(docs)
    plain = plain_prints([r["text"] for r in docs])
    for r, following in zip(docs, docs[1:] + docs[:1]):
        got, changed = rows[r["doc_id"]], edit(r["text"] or "", following["text"] or "")
        assert got.n_chars == len(r["text"] or "")
        assert got.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (got.fingerprint, got.edited_fingerprint) == (plain(r["text"]), plain(changed))
        assert got.near_next == pytest.approx(plain_likeness(got.fingerprint, rows[following["doc_id"]].fingerprint))
        assert got.near_edited == pytest.approx(plain_likeness(got.fingerprint, got.edited_fingerprint))
    near, far = [r.near_edited for r in rows.values()], [r.near_next for r in rows.values()]
    assert np.mean(near) > 0.2 > 0.05 > np.mean(far) and np.mean(np.array(near) > np.array(far)) > 0.9


@pytest.mark.parametrize("parts", [1, 4])
def test_next_row(frame, parts):
    rows = [(i * 7 % 50 - 3, f"t{i}", "clash", "en") for i in range(40)] + [(5, "again", "clash", "en"), (5, None, "clash", "en"), (None, "no id", "clash", "en")]
    found = imatch.with_next(frame(rows, DOCS), "doc_id", "text", {"text": "after"}, parts).collect()
    order = sorted((r for r in found), key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id))
    ids = [r.doc_id for r in order]
    assert len(found) == len(rows) and found[0]._key == "clash"
    texts = {}
    for r in order:
        texts.setdefault(r.doc_id, set()).add(r.text)
    unique = list(dict.fromkeys(ids))
    for i, key in enumerate(unique):
        afters = [r.after for r in order if r.doc_id == key]
        following = unique[(i + 1) % len(unique)]
        inside = len(afters) - 1  # rows of one id follow each other, the last goes on to the next id
        assert sum(a in texts[following] for a in afters) >= 1 and sum(a in texts[key] for a in afters) >= inside


def test_imatch_edges(frame):
    docs = frame([(1, None, "c", "en"), (2, "", "c", "en"), (3, "x", "c", "en"), (4, "word " * 100_000 + "end", "c", "en"), (4, "word " * 100_000 + "end", "c", "en")], DOCS)
    rows = imatch.with_fingerprint(docs, "text", imatch.lexicon(docs), "mark").collect()
    marks = {r.doc_id: (r.mark.whole, *map(tuple, r.mark.families)) for r in rows}
    assert marks[1] == marks[2] != marks[3] != marks[4] and len(rows) == 5
    empty = frame([], DOCS)
    assert imatch.with_next(imatch.with_fingerprint(empty, "text", imatch.lexicon(empty), "mark"), "doc_id", "text", {"text": "after"}).collect() == []


# --- main text ---


def article(page):
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", page, re.S)[1])).split())


def test_main_text_query(spark, sf):
    pages = {r["page_id"]: r for r in table(sf, "pages")}
    rows = QUERIES["op6_main_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id]["html"]) and r.n_chars == len(r.text) and r.url == pages[r.page_id]["url"]


def test_reading_blocks():
    page = """<html><head><title>t</title><script>if (a<b) {"</p>"}</script></head><BODY class=x><p>one <b>bo</b>ld<br>two&nbsp;&amp; 3 &lt; 4
      <p>next<!-- <p>no --><ul><li>a<li>b <a href="x>y">link</a></ul><select><option>o</select>tail < end"""
    blocks = html_main.read_blocks(page)
    assert [b.text for b in blocks] == ["one bold two & 3 < 4", "next", "a", "b link", "tail < end"]
    assert blocks[2].path[-2:] == ("/ul", "/li") and blocks[2].parent == blocks[3].parent and blocks[3].linked > 0.5 > blocks[2].linked
    assert html_main.read_blocks("") == [] and html_main.read_blocks("<p>&#x20;</p>") == []
    assert "k" in " ".join(b.text for b in html_main.read_blocks("<a 'x" * 3 + "<p>k</p>"))  # quotes that never close


@pytest.mark.parametrize("page", [
    "<div " * 200_000, "<div>x" * 170_000, "<a \">\" " * 150_000, "<a '\"> " * 120_000, "<button>x" * 110_000, "<div>" * 80_000 + "</p>" * 150_000, "<script>" * 120_000, "<!--" * 250_000,
], ids=["open", "nested", "quotes", "odd", "buttons", "ends", "scripts", "comments"])
def test_long_broken_pages_are_read_in_linear_time(page):
    start = time.perf_counter()
    html_main.read_blocks(page)
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("page", ["<button class=x>Menu<article><p>One two.</p></article>", "<object data=x>Menu<article><p>One two.</p></article>", "<svg>Menu<div><p>One two.</p>"])
def test_unclosed_elements_do_not_swallow_the_page(page):
    assert [b.text for b in html_main.read_blocks(page)] == ["One two."]


def test_other_layouts(spark, sf):
    pages = [html_main.read_blocks(r["html"]) for r in table(sf, "pages")]
    taught = [(b, html_main.teach(b)) for b in pages]
    weights = html_main.learn(spark.read.parquet(f"{sf}/pages.parquet"))
    lines = [b.text for blocks, y in taught for b, ok in zip(blocks, y) if ok]
    rest = [b.text for blocks, y in taught for b, ok in zip(blocks, y) if not ok]
    made = [html_main.dress([b for b, ok in zip(blocks, y) if ok], rest, lines, random.Random(i)) for i, (blocks, y) in enumerate(taught * 4)]
    found = [html_main.label(b, z) for (b, _), z in zip(made, html_main.logits([b for b, _ in made], weights, html_main.Features(html_main.Settings())))]
    assert np.mean(np.concatenate([a == y for a, (_, y) in zip(found, made)])) > 0.97


def test_page_edges(spark, sf, frame):
    weights = html_main.learn(spark.read.parquet(f"{sf}/pages.parquet"))
    long = "<article>" + "<p>some words of a long page, and more.</p>" * 20_000 + "</article>"
    rows = [(1, None, "clash"), (2, "", "clash"), (3, "<<<>>>&&;", "clash"), (4, long, "clash"), (4, long, "clash"), (None, "<article><p>Hi there, you.</p></article>", "clash")]
    got = sorted(((r.page_id, r.text) for r in html_main.extract(frame(rows, "page_id long, html string, text string"), weights).collect()), key=str)
    assert len(got) == 6 and {t for i, t in got if i in (1, 2)} == {""}
    assert {t for i, t in got if i == 4} == {" ".join(["some words of a long page, and more."] * 20_000)}
    empty = frame([], "page_id long, html string, text string")
    assert html_main.extract(empty, html_main.learn(empty, html_main.Settings(epochs=1))).collect() == []


# --- toxicity ---


def test_toxicity_query(spark, sf):
    labels = {r["doc_id"]: r["toxic"] for r in table(sf, "labels")}
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    assert len(rows) == len(table(sf, "documents"))
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    learned = [(rows[i].score, y) for i, y in labels.items() if not rows[i].held_out]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in learned]) > 0.9


def made_up(n, seed):
    draw, vocab = random.Random(seed), [f"w{i}" for i in range(3000)]
    out = []
    for i in range(n):
        words, toxic = draw.choices(vocab, k=draw.randint(5, 200)), i % 4 == 0
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["vile", "foul", "vilest"]))
        out.append((" ".join(words), int(toxic), "en" if i % 3 else "fr"))
    return out


def test_held_out_accuracy():
    rows, other = made_up(1200, 1), made_up(400, 2)
    model = toxicity.fit([r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows])
    p = toxicity.scores([r[0] for r in other], model)
    y = np.array([r[1] for r in other])
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97 and set(model.thresholds) == {"", "en", "fr"}
    long = " ".join(f"w{i % 3000}" for i in range(200_000))
    assert toxicity.scores([long + " vile", long], model)[0] > 0.5 > toxicity.scores([long], model)[0]


def test_toxicity_edges(spark, frame):
    docs = frame([(i, t, "c", lang) for i, (t, _, lang) in enumerate(made_up(60, 3))] + [(100, None, "c", None), (101, "", "c", "xx"), (None, "w1", "c", "en"), (1, "w2 vile", "c", "en")], DOCS)
    labels = frame([(i, y, "k") for i, (_, y, _) in enumerate(made_up(60, 3))] + [(None, 1, "k"), (2, None, "k"), (3, 1, "k"), (3, 0, "k")], "doc_id long, toxic int, y string")
    quick = toxicity.Settings(epochs=1)
    scored = toxicity.score_documents(docs.withColumn("score", F.lit("clash")), toxicity.learn(docs, labels, quick)).collect()
    assert len(scored) == 64 and len({r.score for r in scored if r.doc_id in (100, 101)}) == 1
    none = toxicity.learn(docs, labels.filter("toxic > 5"), quick)
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), none).collect() == []


def test_every_labelled_row_is_learned_from(spark, frame, monkeypatch):
    texts = [(i, "x " * (31_000 if i < 40 else 1) + ("vile" if i % 2 else "w"), "c", "en") for i in range(7000)]  # some of over 60,000 characters
    docs, labels = frame(texts, DOCS), frame([(i, i % 2) for i in range(7000)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "_epoch", lambda shards, weights, *_: seen.append(shards.count()) or weights)
    monkeypatch.setattr(toxicity, "_calibrate_rows", lambda model, rows: seen.append(rows.count()))
    toxicity.learn(docs, labels)
    assert len(set(seen[:-1])) == 1 and seen[0] + seen[-1] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(7000))
    assert len(seen) == 1 + 8 and 0.2 < seen[-1] / (seen[0] + seen[-1]) < 0.3


def test_shards_learn_together(frame, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 256)
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    rows = made_up(2400, 1)
    docs, labels = frame([(i, t, "c", lang) for i, (t, _, lang) in enumerate(rows)], DOCS), frame([(i, y) for i, (_, y, _) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    other = made_up(400, 2)
    p, y = toxicity.scores([r[0] for r in other], model), np.array([r[1] for r in other])
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97 and set(model.thresholds) == {"", "en", "fr"}


def test_cuts_have_the_fewest_errors(frame):
    draw = random.Random(5)
    rows = [(lang, int(draw.random() < 0.3), round(draw.random(), 3)) for lang in ("en", "fr", None, "") for _ in range(200)] + [("xx", 1, 0.2)] * 5
    got = {r.lang: r.cut for r in toxicity.best_cuts(frame(rows, "lang string, y int, p double"), 20).collect()}
    assert set(got) == {"en", "fr"}
    for lang, cut in got.items():
        mine = [(y, p) for x, y, p in rows if x == lang]
        errors = [sum((p >= c / toxicity.CUTS) != (y == 1) for y, p in mine) for c in range(toxicity.CUTS + 1)]
        best = [c / toxicity.CUTS for c, e in enumerate(errors) if e == min(errors)]
        assert abs(cut - 0.5) == min(abs(c - 0.5) for c in best) and cut in best


# --- BPE ---

ODD = ["Hello, World's <|endoftext|>it''s   x\x1cy É İ ΣΑΣ ﬁ 12½ _a_ <|startoftext|>end", None, "", "  ", "é́ Å ǅ ß ẞ 中文字 한국어 　x ①² ª№", "\x85a\xa0b​c d﻿ e­f",
       "I'VE can'tx 'S ''d", "<|endoftext|><|ENDOFTEXT|>", "a" * 3000, " 𝔘 😀😀 é" * 3, "İı K ſ", "नमस्ते ไทย ابجد", "x\x00yͅ ᾼ", "same word " * 30_000]


def whole(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, sf):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in table(sf, "documents")}
    rows = QUERIES["op10_bpe_round_trip"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, back = whole(plain, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("distinct", [bpe.DISTINCT, 3])
def test_odd_texts(frame, monkeypatch, distinct):
    monkeypatch.setattr(bpe, "DISTINCT", distinct)  # blocks of a few words
    plain, tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), public_tokenizer()
    rows = [(i, t, f"k{i}") for i, t in enumerate(ODD + ODD[:3])] + [(None, "no id", "k")]
    docs = frame(rows, "doc_id long, text string, block string")
    got = {(r.doc_id, r.block): (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.decode_documents(bpe.encode_documents(docs, tokenizer, ("doc_id", "block")), tokenizer).collect()}
    assert got == {(i, k): whole(plain, t) for i, t, k in rows}
    assert bpe.encode_documents(docs.limit(0), tokenizer).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


# --- pipeline ---


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    toxic = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    ids = [r.doc_id for r in rows]
    assert len(set(ids)) == len(ids) and set(ids) <= toxic and len(ids) > 0.6 * docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secret_scan", "bpe"]
    masked = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, docs, sf).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == whole(plain, masked[r.doc_id].text)[0] and r.n_chars == len(masked[r.doc_id].text)


def test_stages_keep_columns(spark, sf):
    """Names, types and values: no stage puts a column of its own in the place of one it was given."""
    clashing = ["_key", "_spans", "score", "threshold", "toxic", "node", "h"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({x: F.lit(f"{x} clash") for x in clashing})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        same = [x for x in docs.columns if name != "secret_scan" or x not in ("text", "n_chars")]
        assert out.count() and out.select(*same).exceptAll(docs.select(*same)).count() == 0
        assert stage(spark, docs.limit(0), sf).collect() == []

"""Near duplicates, contamination and repeated passages against brute force over the small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from avalista.llm import components, contamination, near_dups, passages
from avalista.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, node long, text_key string, h long"
rng = random.Random(3)
VOCAB = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(4000)]


def prose(seed, n):
    return random.Random(seed).choices(VOCAB, k=n)


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k, pattern=r"[^\x20\x09-\x0D]+"):
    words = re.findall(pattern, lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)] if words else [])


def groups_of(rows, k, threshold):
    """id -> (set size, smallest id of its group), all pairs that share a shingle compared."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    for ids in having.values():
        shared.update((a, b) for a in ids for b in ids if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_query(spark, sf):
    want = groups_of([(r["doc_id"], r["text"]) for r in table(sf, "documents")], 4, 80)
    got = {r.doc_id: r for r in QUERIES["op3_near_duplicates"](spark, sf).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def crowd():
    """A group of near copies around the threshold, that one centre does not join."""
    base, rows = prose(1, 120), []
    for i in range(150):
        words, change = list(base), random.Random(i)
        for _ in range(change.randint(0, 6)):
            words[change.randrange(120)] = change.choice(VOCAB)
        rows.append((i, " ".join(words)))
    return rows + [(200 + i, " ".join(prose(50 + i, 60))) for i in range(20)]


@pytest.mark.parametrize("block", [near_dups.BLOCK, 2000])
def test_crowded_buckets_lose_no_link(frame, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)  # small blocks deal one group over many tasks
    rows = crowd()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(frame([(*r, "en", 1, "k", 2) for r in rows], DOCS)).collect()}
    assert got == groups_of(rows, 5, 80)


def test_near_duplicate_edges(frame):
    long = " ".join(prose(9, 200_000))
    rows = [(5, "a b c"), (6, "A  b\tc"), (7, "a b"), (1, None), (2, ""), (3, " \n"), (None, "a b c"), (8, long), (9, long + " end"), (10, "a b c d e"), (10, "a b c d e"), (11, "a b c d e")]
    docs = frame([(*r, "en", 1, "k", 2) for r in rows], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, True),
                          (8, 199_996, 8, True), (9, 199_997, 8, False), (10, 1, 10, True), (10, 1, 10, True), (11, 1, 10, False)], key=str)
    kept = near_dups.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(map(str, [5, 7, 1, 2, 3, None, 8, 10]))


def test_empty_tables(frame):
    empty, items = frame([], DOCS), frame([], "item_id long, text string")
    assert near_dups.near_duplicates(empty).collect() == [] and near_dups.without_duplicates(empty).collect() == []
    assert passages.repeated_passages(empty).collect() == []
    assert contamination.contaminated(empty, items).collect() == [] and contamination.without_items(empty, items).collect() == []
    one = frame([(1, "a b c d e f", "en", 1, "k", 2)], DOCS)
    assert contamination.contaminated(one, items).collect() == [] and len(contamination.without_items(one, items).collect()) == 1


def test_components(frame):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (300, 200)]
    got = {r.node: r.label for r in components.connected_components(frame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in (100, 101, 102)}, 200: 200, 300: 200}


PLAIN = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def contained(docs, items):
    sets = {(i, t): shingles(t, 5, PLAIN) for i, t in items}
    out = {}
    for d, text in docs:
        mine = shingles(text, 5, PLAIN)
        for (i, _), s in sets.items():
            if s and len(s & mine) >= 0.8 * len(s):
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (len(s & mine) / len(s), len(s & mine), len(s)))
    return out


def test_contamination_query(spark, sf):
    want = contained([(r["doc_id"], r["text"]) for r in table(sf, "documents")], [(r["item_id"], r["text"]) for r in table(sf, "benchmark")])
    rows = QUERIES["op2_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id): (r.containment, r.n_shared, r.n_item) for r in rows} == want and len(rows) == len(want) > 0


def test_short_items_in_long_documents(frame):
    items = [(i, " ".join(prose(100 + i, n))) for i, n in enumerate([6, 9, 14, 30, 60, 200])] + [(20, "x y z"), (21, None), (22, ""), (None, " ".join(prose(200, 20))), (0, "one two three four five six")]
    docs = []
    for d in range(24):
        words = prose(500 + d, random.Random(d).choice([40, 900, 15_000]))
        at = len(words) // 2
        item = items[d % len(items)][1] or ""
        if d % 3 == 0:
            item = item.upper().replace(" ", ", ")
        docs.append((d if d else None, " ".join(words[:at]) + f" {item}! " + " ".join(words[at:])))
    docs += [(50, "x y z"), (51, "x y z w"), (52, None), (3, docs[4][1]), (3, docs[4][1])]
    want = contained(docs, items)
    docs_df = frame([(*r, "en", 1, "k", 2) for r in docs], DOCS)
    items_df = frame([(*r, "p") for r in items], "item_id long, text string, part string")
    got = {(r.doc_id, r.item_id): (r.containment, r.n_shared, r.n_item) for r in contamination.contaminated(docs_df, items_df).collect()}
    assert got == want and (50, 20) in got and (51, 20) not in got
    left = contamination.without_items(docs_df, items_df)
    hit = {(d, t) for d, t in docs if contained([(d, t)], items)}
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((x for x in docs if x not in hit), key=str)


def covered(rows, lengths):
    out = {i: np.zeros(n, bool) for i, n in lengths.items()}
    for r in rows:
        out[r.doc_id][r.start : r.end] = True
        out[r.other_id][r.other_start : r.other_end] = True
    return out


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def test_every_exact_run_is_covered(spark, sf):
    docs = {r["doc_id"]: words_of(r["text"]) for r in table(sf, "documents")}
    rows = QUERIES["op1_repeated_passages"](spark, sf).collect()
    assert all(r.identity >= 0.8 and r.end - r.start >= 50 and r.doc_id != r.other_id for r in rows)
    runs = defaultdict(set)
    for i, words in docs.items():
        for k in range(len(words) - 49):
            if len(set(words[k : k + 50])) > 10:  # a run of one word says nothing
                runs[tuple(words[k : k + 50])].add(i)
    found = covered(rows, {i: len(w) for i, w in docs.items()})
    for i, words in docs.items():
        for k in range(len(words) - 49):
            if len(runs.get(tuple(words[k : k + 50]), ())) > 1:
                assert found[i][k : k + 50].all(), (i, k)


def test_fuzzy_passages(frame):
    passage, rows = prose(7, 80), []
    for i in range(30):
        words, change = list(passage), random.Random(i)
        for _ in range(5):
            words[change.randrange(80)] = change.choice(VOCAB)
        if i % 4 == 1:
            del words[change.randrange(80)]
        if i % 4 == 2:
            words.insert(change.randrange(80), "extra")
        rows.append((i, " ".join(prose(900 + i, 100 + 10 * i) + words + prose(1900 + i, 60))))
    clean = [(100 + i, " ".join(prose(5000 + i, 300))) for i in range(20)] + [(200, " ".join(passage[:30])), (201, None), (202, ""), (None, rows[0][1])]
    very_long = " ".join(prose(77, 300_000))
    extra = [(300, very_long), (301, very_long[1000:]), (300, very_long)]
    found = passages.repeated_passages(frame([(*r, "en", 1, "k", 2) for r in rows + clean + extra], DOCS)).collect()
    named = {r.doc_id for r in found} | {r.other_id for r in found}
    assert named == {*range(30), 300, 301}
    for r in found:
        if r.doc_id < 300:
            at = 100 + 10 * r.doc_id  # the passage, and a few words that agree by chance around it
            assert at - 12 <= r.start and r.end <= at + 81 + 12 and r.end - r.start >= 50 and r.identity >= 0.8
    big = [r for r in found if r.doc_id >= 300 or r.other_id >= 300]
    assert len(big) == 1 and big[0].n_equal >= 299_000
    assert not any(r.doc_id == r.other_id for r in found)


def test_alignment_parts():
    x, y = np.array([1, 2, 3, 4, 5, 6]), np.array([1, 2, 9, 4, 5])
    assert passages.common_words(x, y) == 4 and passages.common_words(x[:0], y) == 0
    assert passages.reach(x, y) == (2, 2) and passages.reach(x[2:3], y[2:3]) == (0, 0)
    chains = passages.chain(np.array([1, 10, 20, 500, 510]), np.array([5, 14, 24, 90, 100]))
    assert [c.tolist() for c in chains] == [[0, 1, 2], [3, 4]]
    assert passages.chain(np.array([5, 5]), np.array([1, 9])) == []


@pytest.mark.parametrize("apart", [100, 200, 300])
def test_exact_passages_apart_are_both_found(frame, apart):
    rows = []
    for i in range(2):
        rows.append((i, " ".join(prose(10 + i, 40) + prose(1, 100) + prose(20 + i, apart) + prose(2, 100) + prose(30 + i, 40))))
    found = passages.repeated_passages(frame([(*r, "en", 1, "k", 2) for r in rows], DOCS)).collect()
    for start in (40, 140 + apart):
        assert any(r.start <= start and r.end >= start + 100 and r.other_start <= start and r.other_end >= start + 100 for r in found)
    assert all(r.identity >= 0.8 and r.end - r.start >= 50 for r in found)


def test_parts_of_an_alignment():
    apart = np.concatenate([np.arange(100), np.arange(300, 400)])
    assert sorted(passages.parts(apart, apart, 50, 0.8)) == [(0, 100, 0, 100, 100), (300, 400, 300, 400, 100)]
    assert passages.parts(apart[:49], apart[:49], 50, 0.8) == []
    x, y = np.array([1, 2, 3, 4, 5, 6]), np.array([1, 2, 9, 4, 5])
    assert [p.tolist() for p in passages.common_places(x, y)] == [[0, 1, 3, 4]] * 2


def test_many_items_of_five_and_six_words(frame):
    items = [(i, " ".join(prose(3000 + i, 5 + i % 2))) for i in range(300)]
    docs = [(d, " ".join(" ".join(prose(7000 + 300 * d + i, 20)) + " " + t for i, t in items)) for d in range(3)]
    want = contained(docs, items)
    items_df = frame([(*r, "p") for r in items], "item_id long, text string, part string")
    rows = contamination.contaminated(frame([(*r, "en", 1, "k", 2) for r in docs], DOCS), items_df).collect()
    assert {(r.doc_id, r.item_id): (r.containment, r.n_shared, r.n_item) for r in rows} == want and len(rows) == len(want) == 900


@pytest.mark.parametrize("many", [0, 1])
def test_every_copy_of_a_passage_is_found(frame, many):
    passage = prose(1, 80)
    once = prose(10, 40) + passage + prose(11, 40)
    thrice = sum((prose(20 + i, 40) + passage for i in range(3)), []) + prose(30, 40)
    rows = [(many, " ".join(thrice)), (1 - many, " ".join(once))]
    found = passages.repeated_passages(frame([(*r, "en", 1, "k", 2) for r in rows], DOCS)).collect()
    spans = [(r.start, r.end) for r in found if r.doc_id == many] + [(r.other_start, r.other_end) for r in found if r.other_id == many]
    for start in (40, 160, 280):
        assert any(a <= start and b >= start + 80 for a, b in spans), (start, spans)


def test_recall_of_fuzzy_passages(frame):
    rows, planted = [], {}
    for i, (n, identity) in enumerate([(n, identity) for n in (50, 80, 120) for identity in (0.8, 0.85, 0.9)] * 20):
        draw = random.Random(i)
        passage = prose(10_000 + i, n)
        other = list(passage)
        for at in draw.sample(range(1, n - 1), round(n * (1 - identity))):
            other[at] = f"changed{at}"
        rows += [(2 * i, " ".join(prose(20_000 + i, 60) + passage + prose(30_000 + i, 60))), (2 * i + 1, " ".join(prose(40_000 + i, 90) + other + prose(50_000 + i, 60)))]
        planted[2 * i + 1] = (n, identity)
    found = defaultdict(int)
    for r in passages.repeated_passages(frame([(*r, "en", 1, "k", 2) for r in rows], DOCS)).collect():
        if r.other_id == r.doc_id - 1 and r.doc_id in planted:
            n, identity = planted[r.doc_id]
            found[r.doc_id] = max(found[r.doc_id], min(r.end, 90 + n) - max(r.start, 90))
    for kind in set(planted.values()):
        hits = [found[d] >= kind[0] / 2 for d in planted if planted[d] == kind]
        assert sum(hits) >= (0.85 if kind == (50, 0.8) else 1) * len(hits), (kind, sum(hits))


def test_passage_of_two_frequent_pieces(frame):
    one, two = prose(1, 30), prose(2, 30)
    docs = [prose(100 + i, 40) + (one if i % 2 else two) + prose(200 + i, 40) for i in range(60)]
    docs += [prose(300 + i, 40) + one + two + prose(400 + i, 40) for i in range(2)]
    found = passages.repeated_passages(frame([(i, " ".join(words), "en", 1, "k", 2) for i, words in enumerate(docs)], DOCS)).collect()
    assert [(r.other_id, r.doc_id) for r in found if r.start <= 40 and r.end >= 100 and r.doc_id > r.other_id] == [(60, 61)]


def test_passage_of_three_frequent_pieces(frame):
    one, two, three = prose(1, 22), prose(2, 22), prose(3, 22)
    docs = [prose(100 + i, 40) + (one + two if i % 2 else two + three) + prose(300 + i, 40) for i in range(120)]
    docs += [prose(500 + i, 40) + one + two + three + prose(600 + i, 40) for i in range(2)]
    found = passages.repeated_passages(frame([(i, " ".join(words), "en", 1, "k", 2) for i, words in enumerate(docs)], DOCS)).collect()
    assert [(r.other_id, r.doc_id) for r in found if r.start <= 40 and r.end >= 106] == [(120, 121)]


def test_both_documents_of_a_passage_are_named(spark, tmp_path):
    passage = prose(1, 80)
    rows = [(i, " ".join(prose(10 + i, 30) + passage + prose(20 + i, 30)), "en", 1, "k", 2) for i in range(2)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.other_id) for r in QUERIES["op1_repeated_passages"](spark, str(tmp_path)).collect()}
    assert found == {(0, 1), (1, 0)}


def test_words_to_skip():
    x, y = np.arange(20, dtype="<u4"), np.arange(100, 120, dtype="<u4")
    y[3:9] = x[2:8]
    assert passages.resume(x, y) == (2, 3) and passages.resume(x[:4], y[:4]) is None and passages.resume(x[:2], y) is None


def test_seeds_are_counted_in_shares(frame, monkeypatch):
    """Bitmaps of the seeds of two and of three documents or more, whatever a task deals at once; a seed counts once a document."""
    monkeypatch.setattr(passages, "SEED_ROWS", 40)
    texts = [prose(i % 4, 90) + prose(10 + i % 6, 60) + prose(100 + i, 30) * 2 for i in range(12)]
    known = Counter()
    for words in texts:
        hasher = passages.WordHasher()
        [(_, words, offsets)] = hasher.groups(pa.array([" ".join(words)]))
        known.update(set(passages.find_seeds(words, offsets)[2].tolist()))
    two, more = passages.shared_seeds(frame([(i, " ".join(words)) for i, words in enumerate(texts)], "doc_id long, text string"))
    for found, least in ((two, 2), (more, 3)):
        bits = {h % passages.SEED_BITS for h, n in known.items() if n >= least}
        assert set(np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")).tolist()) == bits and bits


def test_only_copies_have_their_words_counted(frame, capsys):
    docs = frame([(1, "a  b\tc"), (2, "x y"), (3, "a  b\tc"), (4, None), (5, None), (6, ""), (7, ""), (None, "x y")], "doc_id long, text string")
    again, _ = passages.copies(docs)
    assert {tuple(r) for r in again.collect()} == {(3, 1, 3), (7, 6, 0)}
    again.explain(True)
    assert "regexp" not in capsys.readouterr().out


@pytest.mark.parametrize("crowd", [passages.CROWD, 16])
def test_passages_whose_anchors_hold_only_a_piece(frame, monkeypatch, crowd):
    """Every piece of the passage is frequent, changed words break up what the two documents share, and neither is an anchor."""
    monkeypatch.setattr(passages, "CROWD", crowd)  # small blocks deal one seed over many tasks
    ids = [r.i for r in frame([(i,) for i in range(102)], "i long").orderBy(F.xxhash64("i")).collect()]  # the first ones are anchors
    pieces = [prose(8000 + i, 13) for i in range(5)]
    docs = [(i, prose(8100 + i, 80) + pieces[k % 5] + prose(8300 + i, 80)) for k, i in enumerate(ids[:-2])]
    both = sorted(ids[-2:])
    for other, i in enumerate(both, 1):
        passage = [w for j, piece in enumerate(pieces) for w in [*piece, f"x{other}{j}"]]
        docs.append((i, prose(8600 + i, 70 * other) + passage + prose(8700 + i, 60)))
    found = passages.repeated_passages(frame([(i, " ".join(words), "en", 1, "k", 2) for i, words in docs], DOCS)).collect()
    assert [[r.other_id, r.doc_id] for r in found] == [both]
    assert found[0].n_equal >= 60 and 128 <= found[0].start <= 142 and found[0].end >= 200


def test_long_repeats_of_one_word_meet(frame):
    """An exact run in two documents, while the anchors of its seed hold shorter ones."""
    docs = [(i, prose(9100 + i, 40) + ["der"] * (20 if i < 60 else 70) + prose(9300 + i, 40)) for i in range(62)]
    found = passages.repeated_passages(frame([(i, " ".join(words), "en", 1, "k", 2) for i, words in docs], DOCS)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(61, 60)} and max(r.n_equal for r in found) >= 70

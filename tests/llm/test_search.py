"""Ranked search, hard negatives and the set join against SQL twins and brute force."""

import math
import random
import re
from collections import Counter

import pytest
from check import compare, connect

from avalista.llm import negatives, ranked, set_join
from avalista.llm.queries import QUERIES, SQL

rng = random.Random(11)
WORDS = ["w" + "".join(rng.choices("abcdefgh", k=3)) for _ in range(120)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(WORDS[min(int(r.expovariate(0.05)), 119)] for _ in range(n))


def ranking(docs, queries, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n_docs, length = len(docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    asked = {}
    for q, t in queries:
        asked.setdefault(q, set()).update(terms(t))
    out = set()
    for q, ts in asked.items():
        found = []
        for i, t in docs:
            tf, m = Counter(t), 10 + 90 * len(t) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * tf[x] // (1000 * tf[x] + 8 * m)) for x in ts if tf[x])
            if score:
                found.append((-score, i is not None, i if i is not None else 0))
        out |= {(q, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_jaccard_join", "op13_ranked_search"])
def test_same_as_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), SQL[name]) == ""


@pytest.mark.parametrize("sizes", [{}, {"SHARD_DOCS": 40, "SAMPLE": 20, "BLOCK_DOCS": 3}, {"ENTRIES": 30, "SHARD_ENTRIES": 50}])
def test_ranked_search(frame, monkeypatch, sizes):
    """Small shards, blocks and query blocks change no row; copies tie, a null id sorts first."""
    for name, value in sizes.items():
        monkeypatch.setattr(ranked, name, value)
    docs = [(i, prose(i, 5 + i % 60), "x") for i in range(300)] + [(1000 + i, prose(7, 30), "x") for i in range(25)]
    docs += [(None, prose(7, 30), "x"), (2000, None, "x"), (2001, "", "x"), (2002, " ... ", None), (3, prose(9, 20), "x"), (2003, "Ünï " + prose(5, 20000), "x")]
    queries = [(i, prose(400 + i, 12)) for i in range(8)] + [(8, None), (9, "unheardof"), (10, "ÜNï Ünï"), (None, prose(7, 30)), (0, prose(13, 4))]
    got = ranked.search(frame(docs, "doc_id long, text string, score string"), frame(queries, "item_id long, text string"))
    rows = got.collect()
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in rows} == ranking([d[:2] for d in docs], queries) and len(rows) == len(set(rows))


def test_ranked_search_without_rows(frame):
    docs, none = frame([(1, "a b")], "doc_id long, text string"), frame([], "doc_id long, text string")
    asked, nothing = frame([(1, "a")], "item_id long, text string"), frame([], "item_id long, text string")
    assert ranked.search(none, asked).collect() == ranked.search(docs, nothing).collect() == []


def mined(rows, every, k, n, low=30, high=90):
    rows = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in rows if i % every == 0}:
        score = lambda r: sum(map(int.__mul__, v, r[2]))  # noqa: B023, E731
        best = lambda rs, m: sorted((-s, j) for s, j in rs)[:m]
        for p, pid in best([(score(r), r[0]) for r in rows if r[1] == c and r[0] != i], k):
            p = -p
            fits = [(score(r), r[0]) for r in rows if r[1] != c and r[0] != i and low * p <= 100 * score(r) <= high * p]
            out += [(i, pid, rank + 1, j, p, -s) for rank, (s, j) in enumerate(best(fits, n))]
    return sorted(out)


def odd_vectors():
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    rows = []
    for i in range(420):
        c = r.randrange(5)
        rows.append((i, c if r.random() < 0.6 else r.randrange(5), [x + r.gauss(0, 0.4) for x in centres[c]], "x"))
    rows += [(500 + i, 1, rows[3][2], "y") for i in range(40)]  # equal scores
    rows += [(600, 2, [0.0] * 12, ""), (610, 2, [1.0] * 5, ""), (620, 2, [], ""), (630, 9, [1.0] * 12, "")]  # zero, short, empty, alone with its label
    rows += [(640, None, [1.0] * 12, ""), (650, 1, None, ""), (None, 1, [1.0] * 12, ""), (660, 1, [None] + [1.0] * 11, ""), (670, 1, [float("nan")] * 12, ""), (680, 1, [float("inf")] * 12, "")]
    return rows + [rows[20], rows[20], rows[7]]  # an anchor and another row again


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 50, "GROUP": 7, "SAMPLE": 30, "ANCHORS": 15}, {"SAMPLE": 400, "DEPTHS": 1, "DIMS": 5}])
def test_hard_negatives(frame, monkeypatch, sizes):
    """Small chunks, groups, blocks and samples change no row."""
    for name, value in sizes.items():
        monkeypatch.setattr(negatives, name, value)
    rows = odd_vectors()
    got = negatives.hard_negatives(frame(rows, "vec_id long, label int, embedding array<double>, id string"), every=10, positives=4, negatives=6)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == mined([r[:3] for r in rows], 10, 4, 6)


def test_hard_negatives_without_rows(frame):
    schema = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(1, 1, [1.0])], [(0, None, [1.0])], [(0, 1, [])], [(0, 1, [1.0])]):
        assert negatives.hard_negatives(frame(rows, schema)).collect() == []


def test_index_leaves_out_only_what_cannot_reach():
    """The index finds every pair at or above the threshold, and far from all pairs."""
    import numpy as np

    r = np.random.default_rng(5)
    q, x = (np.floor(256 * r.normal(0, 1, (n, 32)) * np.linspace(2, 0.1, 32)).astype(np.int64) for n in (20, 3000))
    scores = q @ x.T
    least = np.quantile(scores, 0.995, axis=1)
    a, rows = negatives._reaching(q, negatives._tails(q), least, x, negatives._tails(x))
    assert set(zip(*np.nonzero(scores >= least[:, None]))) <= set(zip(a, rows)) and len(a) < scores.size / 20


def classes(docs, k, threshold):
    """(id, set size, smallest id of its component) of every row, by comparing all pairs."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)] if words else [])

    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, s) in enumerate(sets):
        for y, (j, t) in enumerate(sets[:x]):
            if s and t and None not in (i, j) and 100 * len(s & t) >= threshold * len(s | t):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = i if i is None else min(least.get(find(x), i), i)
    return sorted(((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def families(n_words, changes, copies, seed):
    """Copies of a text with some words replaced, dropped or put in: Jaccard on both sides of the threshold."""
    r = random.Random(seed)
    base = ["v%d" % r.randrange(3000) for _ in range(n_words)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randint(0, changes)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = ["v%d" % r.randrange(3000)] * r.randrange(2)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("threshold,block", [(85, 1 << 23), (85, 300), (70, 1 << 23)])
def test_jaccard_join(frame, monkeypatch, threshold, block):
    """Components of every size band, of families around the threshold, in whole buckets and in blocks."""
    monkeypatch.setattr(set_join, "BLOCK", block)
    texts = families(120, 7, 90, 1) + families(40, 2, 40, 2) + families(9, 1, 40, 3) + families(600, 30, 25, 4) + families(11, 2, 40, 5) + families(2500, 70, 4, 6)
    shared = " ".join(f"s{i}" for i in range(60))  # a passage that makes up a part of many texts
    texts += [shared + " " + t for t in families(25, 25, 30, 7)] + ["one", "ONE", "one two", "one  two", "a b c d", "a b c d e", "", " ", None]
    docs = [(i, t, "x") for i, t in enumerate(texts)]
    docs += [docs[3], docs[100], (None, texts[0], "x"), (None, None, "x"), (3, "another text of this id", "x")]
    got = set_join.joined(frame(docs, "doc_id long, text string, node string"), threshold=threshold).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == classes([d[:2] for d in docs], 4, threshold)


def test_jaccard_join_without_rows(frame):
    schema = "doc_id long, text string"
    assert set_join.joined(frame([], schema)).collect() == []
    got = set_join.joined(frame([(1, None), (2, ""), (None, "a b"), (3, "a b")], schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("1", 0, 1), ("2", 0, 2), ("3", 1, 3), ("None", 1, None)]


def test_every_allocation_is_exact():
    """Whatever the counters say, a pair within the threshold meets under a key."""
    import numpy as np

    r = np.random.default_rng(1)
    starts = set_join.bands(85, 4000)
    for n in (7, 9, 13, 30, 100, 700, 3000):
        for _ in range(30):
            h = int(set_join.difference(n, 85))
            whole = np.sort(r.integers(0, 1 << 63, n + h, dtype=np.uint64) * np.uint64(2))
            cut = r.permutation(len(whole))[:h]
            x, y = np.delete(whole, cut[: h // 2]), np.delete(whole, cut[h // 2 :])  # differ in h
            if 100 * (n + h - h) < 85 * (n + h):
                continue
            x, y = sorted((x, y), key=len)
            filed = {k for _, s in set_join.Sets(x, np.array([0, len(x)]), starts, 85).filed() if s is not None for k in [*s.whole, *(s.without_one()[0] ^ set_join.LACKING)]}
            sets = set_join.Sets(y, np.array([0, len(y)]), starts, 85)
            rows, seg = next(sets.filed())
            counts = r.integers(0, 50, set_join.SLOTS) ** 3
            used, both = set_join.allocate(seg, sets.n[rows], counts, 85)
            keys, place = seg.without_one()
            assert filed & {*seg.whole[used], *(seg.whole[both] ^ set_join.LACKING), *keys[both[place]]}


def test_a_subset_that_is_filed_and_looked_up_is_one_row(spark, frame):
    """A row per key and node, whichever of the two it stands for, so nothing travels twice."""
    import numpy as np

    docs = frame([(i, " ".join(f"{i % 3}w{j}" for j in range(60 + i))) for i in range(9)], "doc_id long, text string")
    send = spark.sparkContext.broadcast
    everything = np.full(1 << 10, -1)
    rows = set_join.entries(docs, send(everything), 4, set_join.bands(85, 80), 85, send(np.ones(set_join.SLOTS, np.int64)), send(everything)).collect()
    assert len({(r["key"], r["node"]) for r in rows}) == len(rows)
    assert any(r["filed"] and r["probe"] for r in rows) and any(r["filed"] and not r["probe"] for r in rows)

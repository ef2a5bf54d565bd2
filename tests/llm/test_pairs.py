"""Jaccard join, substring dedup and decontamination against brute force, with nulls, repeats, ties and empty tables."""

import hashlib
import random

import numpy as np
import pytest

from fleetpulse.llm import decontamination, jaccard_join, substring_dedup
from fleetpulse.llm.components import components

SCHEMA = "doc_id long, text string, n long, cls string, key string, h long"


def split(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Ünï", " x", "A"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, license_ = some(70), some(12)
    texts = [None, "", " \n\t ", "one", "One", "two words", "two  WORDS", " ".join(some(3000))]
    for _ in range(12):
        base = some(rng.randint(8, 120))
        texts.append(" ".join(base))
        texts.append("\n".join(base))
        for edits in (1, 2, 5):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    for _ in range(10):
        texts.append(" ".join(some(rng.randint(0, 60)) + passage[rng.randint(0, 10) :] + some(20)))
        texts.append(" ".join(some(rng.randint(1, 9)) + license_))
    out = [(i, t) for i, t in enumerate(texts)]
    out += [out[20], out[20], (20, "another text under a known id"), (None, texts[9]), (None, "no id here at all, and nothing like it")]
    rng.shuffle(out)
    return [(i, t, 1, "x", "y", 2) for i, t in out]  # further columns with names used inside


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def lower(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in split(text)]


def shingles(text):
    w = lower(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_groups(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    key = lambda x: tuple(-1 if v is None else v for v in x)
    return sorted(((r[0], len(sets[i]), least.get(find(i), r[0]) if sets[i] else r[0]) for i, r in enumerate(rows)), key=key)


@pytest.mark.parametrize(("short", "block", "known", "boundary"), [(16, 256, 64, None), (0, 256, 64, 40), (0, 3, 2, 0)])
def test_jaccard_join(docs, rows, monkeypatch, short, block, known, boundary):
    monkeypatch.setattr(jaccard_join, "KNOWN", known)
    monkeypatch.setattr(jaccard_join, "MARK", 16 * known)
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "light_boundary", lambda *_: boundary)
    found = jaccard_join.membership(jaccard_join.LinkedSets(docs)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, found), key=key) == brute_groups(rows)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 3, 60, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n, np.uint64))))
        assert jaccard_join._parity_gap(jaccard_join._parity(a), jaccard_join._parity(b)) <= len(np.setxor1d(a, b))


def brute_cut(rows, size=50):
    owner = {}
    for r in rows:
        w = split(r[1])
        for i in range(len(w) - size + 1):
            if r[0] is not None:
                owner[tuple(w[i : i + size])] = min(owner.get(tuple(w[i : i + size]), r[0]), r[0])
    out = []
    for r in rows:
        w, gone = split(r[1]), set()
        for i in range(len(w) - size + 1):
            if r[0] is not None and owner[tuple(w[i : i + size])] < r[0]:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0] if r[0] is not None else -1, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(docs, rows):
    found = substring_dedup.report(substring_dedup.Repeats(docs)).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found) == brute_cut(rows)
    kept = substring_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sum(len(split(r.text)) for r in kept.collect()) == sum(n - gone for _, n, gone, _ in brute_cut(rows))


def test_rows_under_one_id_are_judged_by_their_own_words(spark):
    copied, unique = " ".join(f"c{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(3, copied), (7, copied), (7, unique), (7, "a short text"), (7, None), (None, copied), (8, copied + " and more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(substring_dedup.drop_repeats(frame).collect(), key=str)
    want = [(3, copied), (7, ""), (7, unique), (7, "a short text"), (7, None), (None, copied), (8, "and more")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)
    items = spark.createDataFrame([(None, unique), (1, "a short text")], "item_id long, text string")
    left = decontamination.drop_contaminated(frame, items).collect()
    assert sorted(map(tuple, left), key=str) == sorted([r for r in rows if r[1] not in (unique, "a short text")], key=str)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in found:
        seen, todo = {node}, [node]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        assert found[node] == min(seen)


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[-1] + 1))
        before = now
    return before[-1]


def test_decontamination(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, some(rng.randint(12, 40))) for k in range(8)] + [(8, ["lone"]), (9, [])]
    docs = [(None, " ".join(items[0][1])), (0, None), (1, ""), (2, "a LONE word"), (3, " ".join(some(500)))]
    for k in range(40):
        text = list(items[k % 8][1])
        for _ in range(k // 8):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(([], [rng.choice(words)], [text[at], rng.choice(words)]))
        docs.append((10 + k, " ".join(some(rng.randint(0, 30)) + text + some(rng.randint(0, 30))).upper()))
    expected = {}
    for doc, text in docs:
        w = (text or "").lower().split()
        for item, own in items:
            n = len(own)
            best = [(distance(w[i : i + n], own), i, n) for i in range(len(w) - n + 1)] if n and doc is not None else []
            if best and min(best)[0] <= int(n * decontamination.EDITS):
                expected[doc, item] = min(best)
    table = spark.createDataFrame([(k, " ".join(w), 1) for k, w in items] + [(None, "w1 w2", 1), (5, None, 1)], "item_id long, text string, distance long")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r[0], r[1]): tuple(r)[2:] for r in decontamination.contaminations(frame, table).collect()}
    assert set(found) <= set(expected)
    assert len(found) >= 0.97 * len(expected)
    exact = {k for k, v in expected.items() if v[0] == 0}
    assert exact and all(found[k] == expected[k] for k in exact)
    assert all(found[k][0] == expected[k][0] for k in found)
    left = {r.doc_id for r in decontamination.drop_contaminated(frame, table).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in found}


@pytest.mark.parametrize(("n", "trials"), [(1, 4), (12, 120), (50, 120), (100, 120), (200, 120), (400, 60)])
def test_recall_at_the_allowed_edits(n, trials):
    """Against brute force, on texts with as many edits as an item of that length may have."""
    rng = random.Random(n)
    vocabulary = np.random.default_rng(n).integers(1, 1 << 63, 300, np.uint64)
    edits = int(n * decontamination.EDITS)
    items = [[rng.randrange(300) for _ in range(n)] for _ in range(5)]
    table = vocabulary[np.array(items)]
    how = decontamination.sampling(n, edits, len(items))
    readings = [decontamination._sorted(r) for r in decontamination.cgk_readings(table, how)]
    known = {"edits": decontamination.EDITS, "by_length": {n: (np.arange(5), table, how, readings)}}
    texts, expected = [], set()
    for trial in range(trials):
        text = list(items[trial % 5])
        for _ in range(edits):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(([], [rng.randrange(300)], [text[at], rng.randrange(300)]))
        text = (text + [rng.randrange(300) for _ in range(n)])[:n]
        texts.append(text)
        own = trial % 5
        expected |= {(trial, own, d) for d in [distance(text, items[own])] if d <= edits}
    found = set(zip(*(x.tolist() for x in decontamination.matched(known, vocabulary[np.array(texts)]))))
    assert expected and found <= expected
    assert len(found) >= 0.95 * len(expected)


def test_more_walks_for_longer_items_and_more_places_for_more_items():
    ways = {n: decontamination.sampling(n, int(n * decontamination.EDITS), 5) for n in (12, 100, 400)}
    work = [len(w.salts) / w.read.sum(axis=1)[0] for w in ways.values()]
    assert work == sorted(work)
    few, many = decontamination.sampling(40, 6, 5), decontamination.sampling(40, 6, 5000)
    assert many.read.sum(axis=1)[0] > few.read.sum(axis=1)[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.membership(jaccard_join.LinkedSets(none)).count() == 0
    assert substring_dedup.report(substring_dedup.Repeats(none)).count() == 0
    assert substring_dedup.drop_repeats(none).count() == 0
    assert decontamination.contaminations(none, items).count() == 0

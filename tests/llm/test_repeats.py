import hashlib
import random

import numpy as np
import pytest

from folioforge.llm import automaton_dedup, lpf_dedup, repeats
from folioforge.llm.lpf_dedup import previous_factors


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(70):
        body = [rng.choice(words) for _ in range(rng.choice([0, 3, 30, 120, 300]))]
        kind = rng.random()
        if kind < 0.5:
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 15) : rng.randint(40, 70)]
        if kind < 0.1 and rows:
            body = rows[rng.randrange(len(rows))][1].split()
            if body and kind < 0.06:
                body[rng.randrange(len(body))] = "edit"
        if kind > 0.9:
            body += body
        rows.append((i * 3 % 70, rng.choice([" ", "\n", "  "]).join(body)))
    rows += [(100, "Der " * 200), (101, "Der " * 90), (102, None), (103, "")]
    return rows


def brute_bytes(rows, w):
    seen, out = set(), []
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - w + 1):
            x = data[s : s + w]
            if x in seen:
                gone[s : s + w] = True
            seen.add(x)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, w):
    seen, out = {}, []
    for i, t in sorted(rows):
        words = (t or "").split()
        gone = [False] * len(words)
        for s in range(len(words) - w + 1):
            x = tuple(words[s : s + w])
            if seen.setdefault(x, i) < i:
                gone[s : s + w] = [True] * w
        kept = " ".join(a for a, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 3, 1])
def test_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", {"byte": hot, "word": hot})
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, h int").repartition(3)
    got = sorted(tuple(r) for r in lpf_dedup.remove_repeats(docs).collect())
    assert got == brute_bytes(rows, 100)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("hot", [20_000, 3, 1])
def test_words_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", {"byte": hot, "word": hot})
    rows = corpus(6)
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, d int").repartition(3)
    got = sorted(tuple(r) for r in automaton_dedup.remove_repeats(docs, width=20, gram=5).collect())
    assert got == brute_words(rows, 20)
    assert sum(r[2] for r in got) > 100
    got = sorted(tuple(r) for r in automaton_dedup.remove_repeats(docs).collect())
    assert got == brute_words(rows, 50)


def test_repeated_rows_nulls_and_empty(spark):
    text = "one two three four five six seven eight nine ten " * 30
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in automaton_dedup.remove_repeats(docs).collect()}
    assert got == {(1, 0), (None, 300), (2, 0)}
    got = {(r.doc_id, r.n_removed) for r in lpf_dedup.remove_repeats(docs).collect()}
    assert got == {(1, len(text) - 49), (None, len(text)), (2, 0)}
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert lpf_dedup.remove_repeats(nothing).count() == automaton_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3, 1])
def test_many_texts_of_one_id_and_of_none(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", {"byte": hot, "word": hot})
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    passages, rows = [], []
    for i in range(600):  # each repeats a passage of its own, so the order among them does not matter
        passages.append(words(60))
        body = words(rng.randint(5, 60))
        at = rng.randint(0, len(body))
        rows.append((None if i % 3 else 7, " ".join(body[:at] + passages[-1] + body[at:])))
    rows.append((1, " ".join(w for p in passages for w in p)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    last = 1 << 40
    brute = [(last if i is None else i, t) for i, t in rows]
    named = lambda got: sorted((last if r[0] is None else r[0], *r[1:]) for r in got)
    assert named(lpf_dedup.remove_repeats(docs).collect()) == brute_bytes(brute, 100)
    assert named(automaton_dedup.remove_repeats(docs).collect()) == brute_words(brute, 50)


def test_the_largest_id_is_no_null(spark):
    words = [f"word{i}" for i in range(60)]
    docs = spark.createDataFrame([(3, " ".join(words)), ((1 << 63) - 1, "x " + " ".join(words)), (None, "y " + " ".join(words))], "doc_id long, text string")
    for remove in (lpf_dedup.remove_repeats, automaton_dedup.remove_repeats):
        assert {r.doc_id: r.n_removed > 0 for r in remove(docs).collect()} == {3: False, (1 << 63) - 1: True, None: True}


def test_previous_factors_of_one_text():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[1500:1600], data[2200:2290] = data[100:200], data[1510:1600]
    depth = 20
    starts = np.arange(len(data) - depth + 1)
    got = previous_factors(data, starts, depth) >= depth
    raw, seen = data.tobytes(), set()
    for s in starts.tolist():
        x = raw[s : s + depth]
        assert got[s] == (x in seen)
        seen.add(x)


def test_automaton_statistics():
    rng = random.Random(1)
    parts = [[rng.choice("ab") for _ in range(30)] for _ in range(5)]
    automaton = automaton_dedup.SuffixAutomaton()
    for p in parts:
        automaton.add(p)
    joined = ["".join(p) for p in parts]
    text = [rng.choice("abc") for _ in range(80)]
    for i, m in enumerate(automaton.statistics(text)):
        assert m == max(k for k in range(i + 2) if k == 0 or any("".join(text[i + 1 - k : i + 1]) in j for j in joined))


def test_anchors_do_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    x[100:110] = x[90]  # ties
    x[200], x[203] = (x[200] >> np.uint64(12)) << np.uint64(12) | np.uint64(9), (x[200] >> np.uint64(12)) << np.uint64(12) | np.uint64(3)
    x[200:204].sort()
    x[200], x[203] = x[203], x[200]  # equal high bits, the later one is smaller
    x[200:204] >>= np.uint64(8)
    alone = repeats.least_places(x, 20)
    padded = np.concatenate([rng.integers(0, 1 << 63, 100_000).astype(np.uint64), x, rng.integers(0, 1 << 63, 400_000).astype(np.uint64)])
    within = repeats.least_places(padded, 20)[100_000 : 100_000 + len(alone)] - 100_000
    assert (alone == within).all()
    assert all(alone[i] == i + min(range(20), key=lambda k: (x[i + k], k)) for i in range(len(alone)))

import collections
import itertools
import math
import random
import re
import types
import zlib

import numpy as np

from folioforge.llm import context_mixing as cm
from folioforge.llm import knn_quality, language_id
from folioforge.llm.common import fold
from folioforge.llm.features import linear_svm, randomized_svd

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ein ch der und ie ge ung en ver".split(), "fr": "eau ou le é ai on que ment la eux".split(), "es": "ción ar os la do ñ el que mi as".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 60)), lang) for i in range(n)]


def test_language_held_out(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", "de"), (1002, "12 !!", "fr"), (1003, "der ein schung", None), (None, "eaule quement", "fr")]
    docs = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in rows], "doc_id long, text string, lang string, score double")
    model = language_id.train(docs.where(fold("doc_id", 5) != 0))
    assert sorted(map(len, model.families)) and sum(map(len, model.families)) == 4
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(i, g) for i, _, g in rows[:400] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]._lang_pred == g for i, g in held]) > 0.95
    assert [got[i]._lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]._lang_score == 0
    assert got[1003]._lang_pred == "de" and all(0 <= r._lang_score <= 1 for r in got.values())
    nothing = language_id.train(docs.where("lang is null"))
    assert {r._lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        t = text(rng, rng.choice(list(SYLLABLES)), rng.randint(20, 60))
        good = rng.random() < 0.7
        rows.append((i, t if good else t.upper().replace(" ", "!! "), int(good)))
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in rows] + [(900, None, "q"), (901, "", "q"), (None, "x", "q")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = knn_quality.train(docs, labels.where(fold("doc_id", 3) != 1))
    got = {r.doc_id: r.score for r in knn_quality.score(docs, model).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == q for i, q in held]) > 0.95
    assert got[900] == got[901] == model.prior and all(0 <= s <= 1 for s in got.values())
    empty = knn_quality.train(docs, labels.limit(0))
    assert {r.score for r in knn_quality.score(docs, empty).collect()} == {0.5}
    assert knn_quality.score(docs.limit(0), model).count() == 0


def test_neighbour_votes_are_exact():
    rng = np.random.default_rng(1)
    x = rng.random((60, 1 << knn_quality.BITS)).astype(np.float32)
    y = rng.integers(0, 2, 60)
    model = knn_quality.NeighbourModel(x, y)
    q = rng.random((9, x.shape[1])).astype(np.float32)
    a = (q * model.idf) / np.linalg.norm(q * model.idf, axis=1)[:, None] @ model.base
    cosine = (a / np.linalg.norm(a, axis=1)[:, None]) @ model.points.T
    prior = knn_quality.PRIOR_AT**knn_quality.POWER
    for row, got in zip(cosine, model.score(q), strict=True):
        near = np.argsort(-row)[: knn_quality.K]
        w = np.maximum(row[near], 0).astype(float) ** knn_quality.POWER
        assert abs(got - ((w * y[near]).sum() + prior * y.mean()) / (w.sum() + prior)) < 1e-5


def test_linear_algebra():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.sign(x @ [1, -2, 0.5, 0, 0] + 0.3)
    w = linear_svm(x, y, epochs=100)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97
    low = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 30))
    v = randomized_svd(low, 4)
    assert np.allclose(low @ v @ v.T, low)


def test_codes_are_prefix_free():
    rng = np.random.default_rng(4)
    lengths = cm.huffman_lengths(rng.integers(1, 10_000, 300))
    code = cm.Code(lengths)
    words = sorted(format(c, f"0{n}b") for c, n in zip(code.code.tolist(), lengths.tolist(), strict=True))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    assert sum(2.0**-n for n in lengths.tolist()) == 1.0
    size, node, low = code.steps(np.arange(300))
    assert sorted(set(node.tolist())) == list(range(299)) == list(range(code.nodes))
    prefixes = {}
    for s, (c, n) in enumerate(zip(code.code.tolist(), lengths.tolist(), strict=True)):
        at = int(size[:s].sum())
        for d in range(n):  # nodes are those of the prefixes
            assert prefixes.setdefault(format(c, f"0{n}b")[:d], node[at + d]) == node[at + d]
            assert low[at + d] & 1 == c >> (n - 1 - d) & 1


def test_both_outcomes_of_a_bit_sum_to_one():
    half = len(cm._COST) // 2
    assert np.allclose(2.0 ** -cm._COST[:half] + 2.0 ** -cm._COST[half:], 1)


def test_context_mixing(spark, monkeypatch):
    rows = [(i, t.replace("th", "TH")) for i, t, _ in corpus(300)] + [(800, None), (801, ""), (802, "zz\tzz\nqq"), (None, "the the")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int").repartition(3)
    got = sorted((r.asDict() for r in cm.score_texts(docs).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\n"] for i, t in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if i is not None and not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), n, held[r["doc_id"]])
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    monkeypatch.setattr(cm, "FAN_IN", 1)  # sums in two steps
    again = {r.doc_id: r.score for r in cm.score_texts(docs).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in got)
    again = {r.doc_id: r.score for r in cm.score_texts(docs.repartition(5)).collect()}  # weights learned in another order
    assert all(abs(again[r["doc_id"]] / r["score"] - 1) < 0.1 for r in got)
    assert all(math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / (len((dict(rows)[r["doc_id"]] or "").encode()) + 1)) for r in got)
    assert cm.score_texts(docs.limit(0)).count() == 0
    nothing = cm.score_texts(docs.where("doc_id is null")).collect()
    assert [(r.train_tokens, r.n_known) for r in nothing] == [(0, 0)] and nothing[0].score < 0


def test_context_mixing_learns_from_all_documents(spark, monkeypatch):
    rows = [(i, f"{t} rare{i}") for i, t, _ in corpus(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    mixers, score = [], cm._score
    monkeypatch.setattr(cm, "_score", lambda mixer, *rest: (mixers.append(mixer), score(mixer, *rest))[1])
    cm.score_texts(docs).count()
    texts = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    buffer, offsets = cm.text_buffer(cm.pa.array(texts))
    coder = mixers[0].coder
    assert coder.counts.sum() + coder.weight[-2:].sum() - 2 == sum(len(t.split()) + 1 for t in texts)
    assert mixers[0].fitted > sum(len(s[1]) for s in coder.streams(cm.Words(buffer, offsets))[1]) / cm.STRIDE - 100
    # The summed tables are those of one pass over all training documents.
    one = cm.Counter(coder)
    one.add(coder.streams(cm.Words(buffer, offsets))[1])
    for cells, counts in zip([*mixers[0].cells[0][1:], *mixers[0].cells[1]], [*one.tables[0][1:], *one.tables[1]], strict=True):
        assert np.array_equal(cells, cm._cells(counts[::2], counts[1::2]))
    assert np.array_equal(coder.letters.length, cm.ConditionalCode(letter_pairs(w for t in texts for w in t.split())).length)


def letter_pairs(words):
    pairs = np.zeros(256 * 256, np.int64)
    for w in words:
        for a, b in itertools.pairwise(b" " + w.encode() + b" "):
            pairs[a * 256 + b] += 1
    return pairs


def test_score_equals_bit_by_bit():
    """The score of texts from plain loops over their code bits, with exact logistic functions."""
    rng = random.Random(3)
    texts = ["".join(text(rng, rng.choice(list(SYLLABLES)), 30)) for _ in range(60)] + [text(rng, "en", 900)]
    words_of = [t.lower().split() for t in texts]
    words = cm.Words(*cm.text_buffer(cm.pa.array([" ".join(w) for w in words_of])))
    hashes, counts = np.unique(words.hash, return_counts=True)
    name = dict(zip([w for ws in words_of for w in ws], words.hash.tolist(), strict=True))
    keep = counts >= 2
    coder = cm.Coder(hashes[keep], counts[keep], int(counts[~keep].sum()), len(texts), letter_pairs(w for ws in words_of for w in ws), 16)
    counter = cm.Counter(coder)
    streams = coder.streams(words)[1]
    counter.add(streams)
    tables = [types.SimpleNamespace(**dict(zip(("place", "part", "salt", "used", "counts", "large"), row, strict=True))) for b in counter.rows(0) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    mixer = cm.Mixer(coder, tables)
    got = mixer.cost(len(texts), streams)
    symbol = {int(h): i for i, h in enumerate(coder.words)}
    escape = len(symbol) + 1

    def code_bits(code, s):
        return [code.code[s] >> (code.length[s] - 1 - d) & 1 for d in range(code.length[s])]

    for i, ws in enumerate(words_of):
        bits = [b for w in ws for b in code_bits(coder.code, symbol.get(name[w], escape))] + code_bits(coder.code, len(symbol))
        spelled = [b for w in ws if name[w] not in symbol for a, c in itertools.pairwise(b" " + w.encode() + b" ") for b in code_bits(coder.letters.parts[a], c)]
        total = 0.0
        for kind, outcomes in enumerate((bits, spelled)):
            at = int(streams[kind][0][:i].sum())
            assert (streams[kind][1][at : at + len(outcomes)] & 1).tolist() == outcomes
            own, pull, blocks = np.zeros(3), [], 0
            for k, bit in enumerate(outcomes):
                cell = [int(t[s[at + k]]) for t, s in zip(mixer.cells[kind], streams[kind][2], strict=True)]
                x = np.array([(c >> 2) / 4 - 7.875 for c in cell])
                depth = kind * cm.DEPTHS + int(streams[kind][1][at + k] >> 1)
                mixed = float(np.clip((mixer.weight[depth * 9 + 3 * (cell[1] & 3) + (cell[2] & 3)] + own) @ x, -8, 8))
                final = (mixed + float(mixer.refined[depth, int((mixed + 8.25) * 2)])) / 2
                total += math.log2(1 + math.exp(-final if bit else final))
                pull.append((bit - 1 / (1 + math.exp(-mixed))) * x)
                if len(pull) == cm.BLOCK * (1 + blocks // cm.GROW):
                    own, pull, blocks = own + cm.RATE / (len(pull) + 64) * np.sum(pull, 0), [], blocks + 1
        assert abs(got[i] / total - 1) < 0.02, (got[i], total)


def test_language_equals_brute_force(spark):
    rows = corpus(120, seed=7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    mask = (1 << 64) - 1

    def vector(t):
        out = np.zeros(1 << language_id.BITS)
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
        for salt, (_, order) in enumerate(language_id.GRAMS, 1):
            for i in range(len(data) - order + 1):
                key = (int.from_bytes(data[i : i + order], "big") + (salt << 56)) * 0x9E3779B97F4A7C15 & mask
                key = (key ^ key >> 29) * 0x9E3779B97F4A7C15 & mask
                out[key >> (64 - language_id.BITS)] += 1
        out = np.sqrt(out)
        return out / (np.linalg.norm(out) or 1)

    def brute(t):
        x = np.append(vector(t), 1)
        family = int(np.argmax([w @ x for w in model.family_w]))
        members = model.families[family]
        support = {a: sum(1 / (1 + np.exp(-2 * (model.pairs[min(a, b), max(a, b)] @ x) * (1 if a < b else -1))) for b in members if b != a) for a in members}
        return model.langs[max(members, key=lambda a: (support[a], -a))]

    got = {r.doc_id: r._lang_pred for r in language_id.predict(docs, model).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


def test_no_language_is_lost(spark):
    docs = spark.createDataFrame([(i, f"word{i} text", f"l{min(i, 30)}") for i in range(200)], "doc_id long, text string, lang string")
    assert language_id.train(docs, sample=5).langs == sorted(f"l{i}" for i in range(31))


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"some words {i} of text") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(150)], "doc_id long, quality int")
    assert len(knn_quality.train(docs, labels, sample=20).label) == 20
    assert len(knn_quality.train(docs, labels).label) == 50


def test_weights_are_fitted_on_every_bit():
    rng = random.Random(6)
    words = cm.Words(*cm.text_buffer(cm.pa.array([text(rng, "en", 400) for _ in range(40)])))
    hashes, counts = np.unique(words.hash, return_counts=True)
    keep = counts >= 2
    coder = cm.Coder(hashes[keep], counts[keep], int(counts[~keep].sum()), 40, np.ones(256 * 256, np.int64), 16)
    counter, streams = cm.Counter(coder), coder.streams(words)[1]
    for _ in range(2):
        counter.add(streams)
    list(counter.rows(0))
    assert counter.met.sum() == 2 * sum(len(low) for _, low, _ in streams) > 50_000


def test_looked_up_grades_are_the_computed_ones():
    counts = np.random.default_rng(1).integers(0, 1 << np.arange(1, 21).repeat(500)[:, None], (10_000, 2)).astype(np.uint32)
    grade, level = cm._met(counts.view(np.uint64).reshape(-1))
    zeros, ones = counts.astype(np.float32).T
    assert np.array_equal(grade, cm._grade(zeros, ones)) and np.array_equal(level, cm._level(zeros + ones))


def test_tokens_merged_for_counting_count_the_same():
    rng = random.Random(8)
    texts = [text(rng, lang, 300) for lang in list(SYLLABLES) * 4]
    words = cm.Words(*cm.text_buffer(cm.pa.array([*texts, "", *texts[:5], "once"])))
    hashes, counts = np.unique(words.hash, return_counts=True)
    keep = counts >= 2
    coder = cm.Coder(hashes[keep], counts[keep], int(counts[~keep].sum()), len(texts) + 7, np.ones(256 * 256, np.int64), 16)
    single, merged = cm.Counter(coder), cm.Counter(coder)
    for _ in range(3):  # from the second time on, bits are fitted on counts
        single.add(coder.streams(words)[1])
        merged.add(coder.streams(words, merged=True)[1])
    for a, b in zip(single.tables[0][1:] + single.tables[1], merged.tables[0][1:] + merged.tables[1], strict=True):
        assert a.any() and np.array_equal(a, b)
    assert np.array_equal(single.met, merged.met)
    bits, fewer = (coder.streams(words, merged=m)[1][0] for m in (False, True))
    assert len(fewer[1]) < 0.9 * len(bits[1]) and fewer[3].sum() == len(bits[1])


def test_a_path_meets_few_blocks_of_nodes():
    lengths = cm.huffman_lengths((1e6 / np.arange(1, 5001)).astype(np.int64))
    code = cm.Code(lengths)
    size, node, _ = code.steps(np.arange(5000))
    assert np.array_equal(np.unique(node), np.arange(code.nodes))
    depth = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
    root = node[np.arange(len(node)) - depth % cm.LEVELS]
    assert size.max() > 2 * cm.LEVELS and ((node >= root) & (node < root + (1 << cm.LEVELS) - 1)).all()
    assert len(np.unique(np.stack([np.repeat(np.arange(5000), size), root]), axis=1).T) == np.sum(-(-size // cm.LEVELS))

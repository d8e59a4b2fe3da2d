import random
import zlib

import numpy as np
import pytest

from folioforge.llm.bfd_packing import END_ID, OpenWindows, best_fit_decreasing, default_tokenizer, pack

ROWS = [
    (1, "Hello world, it's FINE  today\n\tnew line"),
    (2, ""),
    (3, None),
    (4, "the quick brown fox <|endoftext|> jumps " * 600),
    (5, "été café  naïve 你好　世界 é ΑΣ "),
    (5, "été café  naïve 你好　世界 é ΑΣ "),
    (None, "no id x1f\x1fy"),
]


def test_pieces_cover_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    docs = spark.createDataFrame([(i, t, 7) for i, t in ROWS], "doc_id long, text string, length int")
    got = pack(docs, default_tokenizer()).collect()
    want = {}
    for i, t in ROWS:
        want[i] = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID], "<u4")
    for i, ids in want.items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        for r in pieces:
            assert r.doc_tokens == len(ids)
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        copies = sum(1 for x, _ in ROWS if x == i)
        assert sum(r.length for r in pieces) == len(ids) * copies
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs, default_tokenizer()).count() == 0


def naive(sizes, window):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(window - s)
    return len(left)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = 64
    sizes = rng.integers(1, window + 1, 400)
    counts = np.bincount(sizes, minlength=window + 1)
    plan = best_fit_decreasing(counts, window)
    used = {}
    for size, low, high, first, offset in plan.tolist():
        for k in range(high - low):
            used.setdefault(first + k, []).append((offset, size))
    assert sum(len(x) for x in used.values()) == len(sizes)
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= window
    assert len(used) == naive(sizes.tolist(), window)


def test_segment_tree_finds_tightest():
    tree = OpenWindows(16)
    for c in (3, 9, 9, 14):
        tree.push(c, c * 10, 1)
    assert [tree.tightest(s) for s in (1, 3, 4, 9, 10, 14, 15)] == [3, 3, 9, 9, 14, 14, 0]
    tree.pop(9, 1)
    tree.pop(9, 1)
    assert tree.tightest(4) == 14


def test_tokens_of_random_unicode_equal_the_whole_tokenizer():
    """Texts of all kinds of characters, pieces that meet in one batch, and a cache that starts anew."""
    from tokenizers import Tokenizer

    from folioforge.llm import bfd_packing
    from folioforge.llm.texthash import text_buffer

    rng = random.Random(17)
    ranges = [(32, 127), (32, 127), (97, 123), (160, 256), (0x100, 0x250), (0x300, 0x370), (0x370, 0x500), (0x5D0, 0x700), (0x900, 0xA00), (0x1E00, 0x2100), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0xFF00, 0xFFF0), (0x1F600, 0x1F650), (9, 14), (0x30, 0x3A)]
    special = ["'s", "n't", "<|endoftext|>", "ß", "İ", "ﬁ", "\u200b", "\xa0", "\u3000", "1234567", "ÀÉ", "×÷", "Ω", "a\u0301"]

    def word():
        if rng.random() < 0.2:
            return rng.choice(special)
        low, high = rng.choice(ranges)
        return "".join(chr(rng.randrange(low, high)) for _ in range(rng.randint(1, 8)))

    texts = ["".join(word() + rng.choice(["", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    whole = Tokenizer.from_file(default_tokenizer())
    want = [e.ids + [END_ID] for e in whole.encode_batch(texts, add_special_tokens=False)]
    tokens = bfd_packing.WordTokens(default_tokenizer())
    got = []
    for at in range(0, len(texts), 100):
        if at == 700:
            tokens._reset()
        ids, bounds = tokens.encode(*text_buffer(bfd_packing.pa.array(texts[at : at + 100])))
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    wrong = [k for k in range(len(texts)) if got[k] != want[k]]
    assert not wrong, [(texts[k], got[k][:20], want[k][:20]) for k in wrong[:3]]

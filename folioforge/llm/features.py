"""Hashed n-gram features of whole texts, and small linear algebra on them."""

from __future__ import annotations

import numpy as np

_BIG = np.uint64(0x9E3779B97F4A7C15)

#: Bytes by shape: capitals, small letters (and all bytes of other scripts), digits; others as they are.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _grams(values: np.ndarray, order: int, salt: int, bits: int) -> np.ndarray:
    n = len(values) - order + 1
    key = values[:n].copy()
    for j in range(1, order):
        key <<= np.uint64(8)
        key |= values[j : n + j]
    key += np.uint64(salt) << np.uint64(56)
    key *= _BIG
    key ^= key >> np.uint64(29)
    key *= _BIG
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def hashed_counts(buffer: np.ndarray, offsets: np.ndarray, kinds: list[tuple[str, int]], bits: int) -> np.ndarray:
    """Counts (documents x 2**bits, float32) of n-grams of bytes or shapes that lie within one document."""
    docs, dims = len(offsets) - 1, 1 << bits
    out = np.zeros(docs * dims, np.float32)
    if not len(buffer):
        return out.reshape(docs, dims)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    views = {"byte": buffer.astype(np.uint64)}
    if any(kind == "shape" for kind, _ in kinds):
        views["shape"] = _SHAPE[buffer]
    if any(kind == "lower" for kind, _ in kinds):
        low = buffer.copy()
        low[(low >= 65) & (low <= 90)] += 32
        views["lower"] = low.astype(np.uint64)
    for salt, (kind, order) in enumerate(kinds, 1):
        if len(buffer) < order:
            continue
        h = _grams(views[kind], order, salt, bits)
        inside = owner[: len(h)] == owner[order - 1 :]
        out += np.bincount((owner[: len(h)] * dims + h)[inside], minlength=docs * dims)
    return out.reshape(docs, dims)


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def linear_svm(x: np.ndarray, sign: np.ndarray, cost: float = 4.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """L2-loss linear SVM by dual coordinate descent (Hsieh et al., ICML 2008); the last weight is the bias."""
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float32)
    share = np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    inverse = share / cost  # each class weighs the same: 1 / (2 C_i)
    q = np.einsum("ij,ij->i", x, x).astype(float) + 1 + inverse
    alpha, w, bias = np.zeros(len(x)), np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = sign[i] * (float(w @ x[i]) + bias) - 1 + inverse[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            step = (new - alpha[i]) * sign[i]
            if step:
                w += np.float32(step) * x[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def randomized_svd(x: np.ndarray, rank: int, seed: int = 0, rounds: int = 4) -> np.ndarray:
    """Right singular vectors (columns) of x: Halko, Martinsson and Tropp (2011)."""
    rng = np.random.default_rng(seed)
    rank = min(rank, *x.shape)
    y = x @ rng.normal(size=(x.shape[1], min(rank + 16, min(x.shape)))).astype(x.dtype)
    for _ in range(rounds):
        y, _ = np.linalg.qr(y)
        y, _ = np.linalg.qr(x.T @ y)
        y = x @ y
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return vt[:rank].T.copy()

"""Property test: the streamed float32-screened kernel equals brute force in float64."""

import numpy as np
from hypothesis import given, settings, strategies as st

from vectriage.operators.knn import _Kernel, _dkey


def _brute(Q, B, ids, k, metric):
    # the same row-wise float64 formulas as the kernel's exact step, so that
    # only screening and merging are under test (not summation order)
    out = []
    for q in Q:
        Qr = np.broadcast_to(q, B.shape)
        if metric == "cosine":
            Bu = B / np.sqrt(np.einsum("ij,ij->i", B, B))[:, None]
            qu = np.broadcast_to(q / np.sqrt(q @ q), B.shape)
            d = np.clip(1.0 - np.einsum("ij,ij->i", qu, Bu), 0.0, 2.0)
        elif metric == "euclidean":
            diff = Qr - B
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        else:
            d = -np.einsum("ij,ij->i", Qr, B)
        order = np.lexsort((ids, _dkey(d)))
        out.append(list(ids[order[:k]]))
    return out


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10_000), n=st.integers(1, 120), dim=st.integers(1, 40), k=st.integers(1, 12),
       metric=st.sampled_from(["cosine", "euclidean", "dot"]), batch=st.integers(1, 50),
       dup=st.booleans(), scale=st.sampled_from([1e-3, 1.0, 1e3]))
def test_kernel_equals_brute_force(seed, n, dim, k, metric, batch, dup, scale):
    rng = np.random.default_rng(seed)
    B = rng.normal(size=(n, dim)) * scale
    if dup and n > 3:
        B[n // 2:] = B[: n - n // 2]          # many exact ties
    B = B[np.abs(B).sum(axis=1) > 0] if metric == "cosine" else B
    ids = rng.permutation(len(B)).astype(np.int64)
    Q = np.vstack([rng.normal(size=(3, dim)) * scale, B[:2]]) if len(B) >= 2 else rng.normal(size=(3, dim))
    kern = _Kernel(Q, metric, k, np.int64)
    kern.max_buf = 7
    for s in range(0, len(B), batch):
        kern.add(ids[s:s + batch], B[s:s + batch])
    qrow, got, _, _ = kern.result()
    exp = _brute(Q, B, ids, k, metric)
    for i in range(len(Q)):
        assert list(got[qrow == i]) == exp[i]

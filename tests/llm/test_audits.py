"""Line dedup, source audit and whitening against brute force, on rows with every awkward case."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectriage.llm import line_dedup, source_audit, whitening

CLASHING = ("key", "k1", "shard", "filter", "salt", "refs", "top", "terms", "vec", "idx", "gid", "p", "x", "n", "id", "component")
WHITE = " \t\n\x0b\x0c\r"
LOWER = {k: k + 32 for k in range(65, 91)}


def line_rows(seed: int = 5) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 9)))
    lines = [" ".join(word() for _ in range(rnd.randrange(4, 9))) for _ in range(25)] + ["short", "é" * 20, "x" * 19, "y" * 20]
    form = lambda s: rnd.choice((s, s.upper(), f"  {s}\t", f"{s}\r", f"\x0b{s}"))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, " \t\n" + lines[0])]
    for i in range(60):
        rows.append((i + 5, "\n".join(form(rnd.choice(lines)) if rnd.random() < 0.5 else word() * 6 for _ in range(rnd.randrange(1, 12)))))
    rows.append((70, "\n".join(form(rnd.choice(lines)) for _ in range(5000))))
    rows += [rows[9], rows[20], (30, lines[3] + "\n" + lines[4]), (None, lines[3] + "\n" + lines[5]), (None, lines[6]), (None, None)]
    return rows


def kept_lines(rows, min_chars=20, min_docs=3):
    """Sorted (id, lines, dropped, kept text) of every row."""
    key = lambda s: s.strip(WHITE).translate(LOWER)
    below = lambda i: -math.inf if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for k in {key(s) for s in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [s for s in lines if len(held[key(s)]) < min_docs or below(i) == max(map(below, held[key(s)]))]
        out.append((below(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def found_lines(df):
    return sorted((-math.inf if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


def line_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("extra") for c in CLASHING})


def test_line_dedup(spark, tmp_path):
    rows = line_rows()
    docs = line_docs(spark, rows)
    store = line_dedup.LineStore(spark, str(tmp_path / "a")).insert(docs)
    got = found_lines(line_dedup.deduplicate(store, docs))
    assert got == kept_lines(rows) and any(x[2] for x in got)
    digest = sorted((-math.inf if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_digest(docs).collect())
    assert digest == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in kept_lines(rows))


def test_line_dedup_is_reversible(spark, tmp_path):
    rows = line_rows()
    first, second = [r for r in rows if r[0] is not None and r[0] % 3], [r for r in rows if r[0] is None or r[0] % 3 == 0]
    store = line_dedup.LineStore(spark, str(tmp_path / "a")).insert(line_docs(spark, first))
    before = {r["shard"]: (r["n"], sorted(np.frombuffer(r["filter"], np.uint16).tolist())) for r in store.filters.collect()}
    store.insert(line_docs(spark, second))
    assert found_lines(line_dedup.deduplicate(store, line_docs(spark, rows))) == kept_lines(rows)
    again = line_dedup.LineStore(spark, str(tmp_path / "a"))          # another driver finds the last version
    assert again.version == 2
    again.insert(line_docs(spark, first[:10]))                       # documents that are there already change nothing
    assert found_lines(line_dedup.deduplicate(again, line_docs(spark, rows))) == kept_lines(rows)
    again.delete(spark.createDataFrame([(r[0],) for r in second], "doc_id long"))
    assert found_lines(line_dedup.deduplicate(again, line_docs(spark, first))) == kept_lines(first)
    after = {r["shard"]: r["n"] for r in again.filters.collect() if r["n"]}
    assert after == {s: n for s, (n, _) in before.items() if n}
    for r in again.filters.collect():                                # each key has one fingerprint in its filter
        assert np.count_nonzero(np.frombuffer(r["filter"], np.uint16)) == r["n"]


def test_line_store_ignores_what_was_not_committed(spark, tmp_path):
    rows = line_rows()[:40]
    store = line_dedup.LineStore(spark, str(tmp_path / "a")).insert(line_docs(spark, rows))
    line_docs(spark, rows).select("doc_id").write.parquet(str(tmp_path / "a" / "refs" / "v2"))     # a driver lost half way
    store = line_dedup.LineStore(spark, str(tmp_path / "a"))
    assert store.version == 1 and found_lines(line_dedup.deduplicate(store, line_docs(spark, rows))) == kept_lines(rows)
    more = [(1000 + i, t) for i, t in rows if i is not None]
    store.insert(line_docs(spark, more))
    assert found_lines(line_dedup.deduplicate(store, line_docs(spark, rows + more))) == kept_lines(rows + more)


def test_line_dedup_without_rows(spark, tmp_path):
    docs = line_docs(spark, line_rows()).where("false")
    assert line_dedup.dedup_digest(docs).count() == 0


def test_cuckoo_filter():
    rnd = np.random.default_rng(1)
    k1, k2 = rnd.integers(-2**63, 2**63, (2, 20_000))
    cuckoo = line_dedup.Cuckoo.sized(20_000)
    assert cuckoo.add(k1, k2) and cuckoo.contains(k1, k2).all()
    assert np.count_nonzero(cuckoo.slots) == 20_000
    other = rnd.integers(-2**63, 2**63, (2, 20_000))
    assert cuckoo.contains(*other).mean() < 0.005
    cuckoo.remove(k1[:15_000], k2[:15_000])
    assert cuckoo.contains(k1[15_000:], k2[15_000:]).all() and cuckoo.contains(k1[:15_000], k2[:15_000]).mean() < 0.005
    assert np.count_nonzero(cuckoo.slots) == 5_000 and cuckoo.holds(20_000)
    with pytest.raises(ValueError):
        line_dedup.Cuckoo.sized(10).remove(k1[:1], k2[:1])
    small = line_dedup.Cuckoo.sized(4)
    assert not small.add(k1[:100], k2[:100])


# ---------------------------------------------------------------- source audit

def brute_audit(rows, min_df=3, top=200):
    docs = [(lang or "", source or "", [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= min_df)
        v = len(kept)
        whole = Counter(w for d in own for w in d[2] if df[w] >= min_df)
        share = lambda c, n: 1 + (10**9 * (c + 1)) // (n + v)
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if df[w] >= min_df) for s in {d[1] for d in own}}
        p = {s: {w: share(c[w], c.total()) for w in kept} for s, c in counts.items()}
        q = {w: share(whole[w], whole.total()) for w in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in p:
            pairs = [(sum(f(p[s][w], p[t][w]) for w in kept), t) for t in p if t != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(items[:top] if part == "term" else items, 1)]
    return sorted(out)


def audit_rows(seed=2):
    rnd = random.Random(seed)
    words = ["Ab", "ab", "é", "Éa", "zz", "naïve", "a-b", "x1y", "日本", "_q", "w" * 500, "~", "[k]"]
    rows = []
    for i in range(120):
        lang = rnd.choice(["en", "en", "en", "de", "", None])
        source = rnd.choice(["web", "web", "web", "web", "news", "Üb", None, f"s{rnd.randrange(4)}"])
        rows.append((lang, source, rnd.choice([None, ""]) if rnd.random() < 0.1 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(30)))))
    rows += [rows[3], rows[3], ("fr", "one", "seul"), ("it", "a", "uno due"), ("it", "b", None), ("it", "c", "tre"), ("es", "x", "hola " * 20_000),
             ("es", "y", "hola"), ("es", "y", "hola"), ("es", "z", "99 !")]
    return rows


def audit_docs(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(4).withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.mark.parametrize("cells, buffer", [(1 << 21, 1 << 20), (24, 8)])
def test_source_audit(spark, monkeypatch, cells, buffer):
    monkeypatch.setattr(source_audit, "CELLS", cells)
    monkeypatch.setattr(source_audit, "BUFFER", buffer)
    rows = audit_rows()
    got = sorted(tuple(r) for r in source_audit.audit(audit_docs(spark, rows)).collect())
    assert got == brute_audit(rows)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "it" and r[4] == 0 for r in got)


def test_source_audit_limits_and_nothing(spark):
    rows = audit_rows()
    got = sorted(tuple(r) for r in source_audit.audit(audit_docs(spark, rows), min_df=1, top=2).collect())
    assert got == brute_audit(rows, 1, 2)
    assert source_audit.audit(audit_docs(spark, rows).where("false")).count() == 0
    assert source_audit.audit(audit_docs(spark, [("a", "x", None), ("a", "y", "1 2")])).count() == 2


# ---------------------------------------------------------------- whitening

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit("extra") for c in CLASHING if c != "id"})


def whitened(spark, rows, k=4):
    return whitening.whiten(vectors(spark, rows), k, id_col="vec_id").collect()


def check_whitened(rows, got, k=4, tol=1e-9):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in good]), axis=0)
    n, s = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    rank = np.linalg.matrix_rank(cov)
    m = min(k, rank)
    assert len(got) == m * len(good)
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r)
    for i, x in good:
        mine = sorted((r for r in by[i]), key=lambda r: r.component)
        assert {r.component for r in mine} == set(range(1, m + 1))
        assert all(r.n == n and int(r.deviation) == sum(int(n * a - b) ** 2 for a, b in zip(x, s)) for r in mine)
        assert all(abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine)
    for c in range(m):                                               # simple roots: the component itself, up to its sign
        apart = min([abs(values[c] - v) for j, v in enumerate(values) if j != c], default=1) / values[c]
        if apart > 1e-6:
            w = {i: (x - s / n) @ vecs[:, c] / math.sqrt(values[c]) for i, x in good}
            pairs = [(w[r.id], r.whitened) for r in got if r.component == c + 1]
            assert min(max(abs(a - b) for a, b in pairs), max(abs(a + b) for a, b in pairs)) < tol


def test_whitening(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(60, 6)) @ rnd.normal(size=(6, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100, base[3].tolist()), (100, base[3].tolist()), (101, base[4].tolist())]
    rows += [(200, None), (201, []), (202, [1.0, None] + [0.0] * 4), (203, [math.nan] * 6), (204, [math.inf] + [0.0] * 5), (205, [-0.0] * 6)]
    check_whitened(rows, whitened(spark, rows))
    got = whitening.whiten(vectors(spark, [(None, v) for _, v in rows]), id_col="vec_id").collect()
    assert len(got) == 4 * 64 and all(r.id is None for r in got)


def test_whitening_of_few_directions_and_equal_roots(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    check_whitened(line, whitened(spark, line))
    cross = [(i, [s if j == k else 0.0 for j in range(5)]) for i, (k, s) in enumerate((k, s) for k in range(5) for s in (1.0, -1.0))]
    got = whitened(spark, cross)                                     # five equal roots
    check_whitened(cross, got)
    assert len(got) == 40
    two = cross + [(50, [3.0, 0.0, 0.0, 0.0, 0.0]), (51, [-3.0, 0.0, 0.0, 0.0, 0.0]), (52, [0.0, 3.0, 0.0, 0.0, 0.0]), (53, [0.0, -3.0, 0.0, 0.0, 0.0])]
    check_whitened(two, whitened(spark, two, 3), 3)
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert whitening.whiten(vectors(spark, cross).where("false"), id_col="vec_id").count() == 0
    with pytest.raises(Exception, match="widths"):
        whitened(spark, [(1, [1.0, 2.0]), (2, [1.0])])


def test_exact_sums_of_large_entries(spark):
    x = np.array([[2**62, -2**63, 5], [-7, 2**40 + 1, 2**63 - 1], [-1, 0, -1]], np.int64)
    assert (whitening.exact_gram(x) == x.astype(object).T @ x.astype(object)).all()
    rows = [(i, [1e15 * (i + 1), -3e14 * i * i, 1e30]) for i in range(4)]
    got = whitened(spark, rows)
    assert len(got) == 8 and all(r.n == 4 and r.identity_error < 1e-9 for r in got)      # the last entry is one long for all


def test_polynomial_and_roots():
    rnd = random.Random(3)
    a = [[Fraction(0)] * 5 for _ in range(5)]
    b = np.array([[rnd.randrange(-9, 10) for _ in range(5)] for _ in range(5)], object)
    c = b @ b.T

    def det(m):
        return m[0][0] if len(m) == 1 else sum((-1) ** j * m[0][j] * det([r[:j] + r[j + 1:] for r in m[1:]]) for j in range(len(m)))

    p = 2147483647
    poly = whitening.charpoly_mod((c % p).astype(np.int64), p)
    for t in (0, 1, 7, 1000):
        want = det([[(t if i == j else 0) - int(c[i, j]) for j in range(5)] for i in range(5)])
        assert sum(int(v) * t**k for k, v in enumerate(poly)) % p == want % p
    # (x - 3)^2 (x - 5) x, then two roots 2^-40 apart
    assert whitening.roots_above([0, -45, 39, -11, 1], 2, 0) == 3 and whitening.roots_above([0, -45, 39, -11, 1], 3, 0) == 1
    roots, bits = whitening.largest_roots([0, -45, 39, -11, 1], 3)
    assert [m for _, m in roots] == [1, 2, 2] and [(n + 1) >> bits for n, _ in roots] == [5, 3, 3]
    one = 1 << 40
    roots, bits = whitening.largest_roots([one * (one + 1), -(2 * one + 1), 1], 2)
    assert [m for _, m in roots] == [1, 1] and [(n + 1) >> bits for n, _ in roots] == [one + 1, one]
    assert len(a) == 5


def test_components_of_roots_that_nearly_meet():
    """Two roots apart by 2^-55 of their size: a double cannot tell them, the null space can."""
    u = np.array([[3, 4, 0], [-4, 3, 0], [0, 0, 5]], object)          # orthogonal, rows of length 5
    roots = [2**60 + 32, 2**60, 7]
    c = sum(r * np.outer(v, v) for r, v in zip(roots, u))            # eigenvalues 25 r
    for r, v in zip(roots, u):
        got = whitening.null_space(c, (25 * r) << 192, 192, 1)[0]
        want = v.astype(float) / 5
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-15

"""Quality classifier trained from weak labels.

Method: heuristic labellers (``LABELLERS``) vote low, fine or abstain on every
document.  Expectation-maximisation on the counts of all vote patterns of the
corpus estimates each labeller's accuracy (its chances of every vote, given
the class) and the share of low documents; the patterns number at most
3^labellers, so the counts have a fixed size.  The posterior of a document's
pattern is its training label: a linear scorer over hashed word and
word-shape features is fitted to these posteriors by logistic regression and
scores all documents.

The scorer is fitted on at most about ``train_rows`` documents, chosen by a
hash of the id, each id once; the votes and their counts cover every document.  No labels
are used; the ``labels`` table only measures the result in tests.

Edge cases: a null or empty text, or one without words, has only abstentions
and the features of no word; it is scored like any other.  Rows are
independent apart from the counts, so repeated rows get the same score and
count twice; rows with a null id are counted and scored but are not among the
documents of the fit, unless there are no others; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectriage.llm.common import BYTE_CODE, LOWER, U64, freeing, hash_share, keyed_texts, mix, Roller, row_ranges, text_bytes, word_bounds

DIM = 512
SHAPE_DIM = 256

IS_UPPER, IS_LETTER, IS_DIGIT = (np.zeros(256, bool) for _ in range(3))
IS_UPPER[65:91] = True
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
IS_DIGIT[48:58] = True
IS_MARK = np.zeros(256, bool)
IS_MARK[[*b"#*$%&|<>{}~^\\=_"]] = True
IS_SHOUT = np.zeros(256, bool)
IS_SHOUT[[*b"!?"]] = True

# Fixed values: (metric, low above this, fine up to this) of each labeller.
LABELLERS = (
    ("marked_words", 0.15, 0.01), ("mark_bytes", 0.03, 0.002), ("capitals", 0.5, 0.1), ("shouts", 0.05, 0.005),
    ("same_as_before", 0.25, 0.05), ("repeated_words", 0.85, 0.6), ("long_words", 0.3, 0.05),
)


def word_facts(raw: np.ndarray, offsets: np.ndarray) -> dict:
    """Arrays over words of some rows: names, shapes, flags; and ``first``, ``rows``."""
    starts, ends, first = word_bounds(raw, offsets)
    b = raw[int(offsets[0]):int(offsets[-1])]

    def count(table):
        sums = np.zeros(len(b) + 1, np.int32)
        np.cumsum(table[b], out=sums[1:])
        return sums[ends] - sums[starts]

    size = ends - starts
    f = {"first": first, "rows": np.repeat(np.arange(len(first) - 1), np.diff(first)), "size": size, "starts": starts, "ends": ends, "bytes": b,
         "name": mix(Roller(BYTE_CODE[LOWER[b]]).of(starts, ends)), "upper": count(IS_UPPER), "letters": count(IS_LETTER),
         "digits": count(IS_DIGIT), "marks": count(IS_MARK), "shouts": count(IS_SHOUT)}
    new_row = np.ones(len(starts), bool)
    new_row[1:] = f["rows"][1:] != f["rows"][:-1]
    f["again"] = np.zeros(len(starts), bool)
    f["again"][1:] = (f["name"][1:] == f["name"][:-1]) & ~new_row[1:]
    return f


def row_means(f: dict, values: np.ndarray) -> np.ndarray:
    n = len(f["first"]) - 1
    return np.bincount(f["rows"], weights=values, minlength=n) / np.maximum(np.diff(f["first"]), 1)


def metrics(f: dict) -> dict:
    """The labellers' metrics of each row."""
    n, words = len(f["first"]) - 1, np.diff(f["first"])
    total = lambda v: np.bincount(f["rows"], weights=v, minlength=n)
    order = np.lexsort((f["name"], f["rows"]))
    new = np.ones(len(order), bool)
    new[1:] = (f["name"][order][1:] != f["name"][order][:-1]) | (f["rows"][order][1:] != f["rows"][order][:-1])
    distinct = np.bincount(f["rows"][order][new], minlength=n)
    return {
        "marked_words": row_means(f, f["marks"] > 0), "mark_bytes": total(f["marks"]) / np.maximum(total(f["size"]), 1),
        "capitals": total(f["upper"]) / np.maximum(total(f["letters"]), 1), "shouts": total(f["shouts"]) / np.maximum(total(f["size"]), 1),
        # Long texts repeat words by themselves: what counts is the share beyond the square root of their length.
        "same_as_before": row_means(f, f["again"]), "repeated_words": 1 - np.minimum(distinct / np.maximum(words ** 0.85, 1), 1),
        "long_words": row_means(f, f["size"] > 24),
    }


def votes(f: dict) -> np.ndarray:
    """Pattern of votes of each row in base 3: 0 abstains, 1 fine, 2 low."""
    m, words = metrics(f), np.diff(f["first"])
    pattern = np.zeros(len(words), np.int64)
    for i, (name, low, fine) in enumerate(LABELLERS):
        vote = np.where(m[name] > low, 2, np.where(m[name] <= fine, 1, 0))
        pattern += np.where(words > 0, vote, 0) * 3 ** i
    return pattern


def hashed_features(f: dict) -> np.ndarray:
    """Rows of ``DIM`` features: square roots of shares of hashed word shapes, and of hashed words."""
    n = len(f["first"]) - 1
    last = f["bytes"][f["ends"] - 1] if len(f["ends"]) else np.zeros(0, np.uint8)
    kind = np.where(IS_LETTER[last], 0, last).astype(U64)
    case = np.where(f["upper"] == 0, 0, np.where(f["upper"] * 2 > f["letters"] + 1, 2, 1)).astype(U64)
    shape = (kind + (case << U64(8)) + (np.minimum(f["size"] // 4, 7).astype(U64) << U64(10)) + (f["again"].astype(U64) << U64(13))
             + (np.minimum(f["marks"], 3).astype(U64) << U64(14)) + (np.minimum(f["digits"], 3).astype(U64) << U64(16)))
    out = np.zeros((n, DIM), np.float32)
    words = np.maximum(np.diff(f["first"]), 1)[:, None]
    for column, width, base in ((mix(shape + U64(77)), SHAPE_DIM, 0), (f["name"], DIM - SHAPE_DIM, SHAPE_DIM)):
        at = f["rows"] * width + (column % U64(width)).astype(np.int64)
        out[:, base:base + width] = np.sqrt(np.bincount(at, minlength=n * width).reshape(n, width) / words)
    return out


def fit_votes(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[np.ndarray, dict]:
    """(posterior of low for each pattern, accuracies) by expectation-maximisation over counts of vote patterns."""
    vote = np.stack([patterns // 3 ** i % 3 for i in range(len(LABELLERS))], 1)
    low = np.where((vote == 2).any(1), 0.9, 0.02)
    for _ in range(steps):
        share = np.clip((counts * low).sum() / counts.sum(), 1e-4, 1 - 1e-4)
        chance = np.zeros((2, len(LABELLERS), 3))
        for c, weight in ((0, counts * (1 - low)), (1, counts * low)):
            for i in range(len(LABELLERS)):
                chance[c, i] = (np.bincount(vote[:, i], weights=weight, minlength=3) + 0.5) / (weight.sum() + 1.5)
        each = np.arange(len(LABELLERS))
        score = np.log(share) - np.log(1 - share) + (np.log(chance[1, each, vote]) - np.log(chance[0, each, vote])).sum(1)
        low = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
    return low, {"share": float(share), "chance": chance}


def fit_scorer(x: np.ndarray, label: np.ndarray, steps: int = 300, l2: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels, by Adam on full gradients."""
    w, mean, var = (np.zeros(x.shape[1] + 1) for _ in range(3))
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1).astype(np.float32)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w.astype(np.float32), -30, 30)))
        g = x1.T @ (p - label).astype(np.float32) / len(x) + l2 * w
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def _facts_of(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in row_ranges(offsets):
                yield batch.slice(a, b - a).column("doc_id"), word_facts(raw, offsets[a:b + 1])


def _patterns(docs: DataFrame) -> DataFrame:
    def run(batches):
        for ids, f in _facts_of(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(votes(f))], names=["doc_id", "pattern"])

    return docs.mapInArrow(freeing(run), "doc_id long, pattern long")


def _training(docs: DataFrame) -> DataFrame:
    def run(batches):
        for _, f in _facts_of(batches):
            rows = [r.astype(np.float32).tobytes() for r in hashed_features(f)]
            yield pa.RecordBatch.from_arrays([pa.array(votes(f)), pa.array(rows, pa.binary())], names=["pattern", "features"])

    return docs.mapInArrow(freeing(run), "pattern long, features binary")


def train(docs: DataFrame, train_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: posteriors by vote pattern, labellers' chances, and the scorer's weights."""
    texts = keyed_texts(docs, id_col, text_col)
    counted = _patterns(texts).groupBy("pattern").agg(F.count("*").alias("n")).collect()     # at most 3^labellers rows
    if not counted:
        return {"weights": np.zeros(DIM), "bias": 0.0, "low": {}, "votes": {}}
    patterns, counts = np.array([r.pattern for r in counted]), np.array([r.n for r in counted], float)
    low, accuracies = fit_votes(patterns, counts)
    by_pattern = dict(zip(patterns.tolist(), low.tolist()))
    # Null or often repeated ids share one hash: without them, and with each id once, the choice stays bounded.
    chosen = texts.where(F.col("doc_id").isNotNull() & hash_share("doc_id", train_rows / counts.sum())).dropDuplicates(["doc_id"])
    rows = _training(chosen).collect()
    if not rows:
        rows = _training(texts.limit(train_rows)).collect()
    rows.sort(key=lambda r: (r.pattern, r.features))      # the fit doesn't depend on partitioning
    x = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, DIM)
    weights, bias = fit_scorer(x, np.array([by_pattern[r.pattern] for r in rows]))
    return {"weights": weights, "bias": bias, "low": by_pattern, "votes": accuracies}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, low, posterior): the scorer's chance that a document is low, and that of its votes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for ids, f in _facts_of(batches):
            z = hashed_features(f).astype(float) @ m["weights"] + m["bias"]
            posterior = [m["low"].get(p, 0.5) for p in votes(f).tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.array(posterior, pa.float64())],
                                             names=["doc_id", "low", "posterior"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(freeing(run), "doc_id long, low double, posterior double")


def classify(docs: DataFrame, limit: float = 0.5, train_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality_score, weak_posterior, kept): kept when the chance of being low is under ``limit``."""
    model = train(docs, train_rows, id_col, text_col)
    return score(docs, model, id_col, text_col).select(
        "doc_id", (1 - F.col("low")).alias("quality_score"), (1 - F.col("posterior")).alias("weak_posterior"), (F.col("low") < limit).alias("kept"))


def accepted(docs: DataFrame, limit: float = 0.5, train_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that ``classify`` keeps; no row leaves its partition."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, train_rows, id_col, text_col))

    def run(batches):
        m = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, offsets = text_bytes(batch.column(text_col))
                z = [np.zeros(0), *(hashed_features(word_facts(raw, offsets[a:b + 1])).astype(float) @ m["weights"] + m["bias"] for a, b in row_ranges(offsets))]
                yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500))) < limit))

    return docs.mapInArrow(freeing(run), docs.schema)

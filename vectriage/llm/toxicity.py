"""Toxicity scores from gradient-boosted trees over dense features.

Method: every text becomes a short dense vector: densities of two lexicons (a
fixed list, and stems mined from the training labels), how often they occur
near a second-person word, shares of capitals and punctuation, and rates of
obfuscated words.  Boosted trees are fitted on labelled training rows, and an
isotonic regression on training rows that the trees have not seen turns their
margin into a score between 0 and 1.

Training rows are those whose crc32 of the id as text is not 1 modulo 3, at
most about ``train_rows`` of them, chosen by a hash of the id.  The score of a
document depends on its text alone.

Edge cases: null, empty and wordless texts have the zero vector and are scored
like any other; rows are independent, so repeated rows get equal results; a
null id is not a training row and not held out; without two classes among the
training rows the score is their share of toxic rows (0 without rows); extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from vectriage.llm.common import BYTE_CODE, LOWER, U64, hash_share, keep, keyed_texts, mix, Roller, row_ranges, text_bytes, word_bounds

# Insults and slurs of the built-in lexicon, and second-person words.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless trash scum clown clowns disgusting fool fools ugly hate "
    "kill die garbage filth filthy vermin pig jerk creep bastard imbecile cretin dimwit lowlife freak shut idiota imbécil estúpido "
    "basura asqueroso idiote imbécile stupide ordure dégoûtant dumm dummkopf abschaum widerlich"
).split()
SECOND_PERSON = "you your yours yourself u ur tu tú te ti vos usted su vous toi ton ta votre du dich dir dein euch ihr sie".split()
STEMS = (4, 5)                       # bytes of a word's start that make a stem
NEAR = 4                             # words
FEATURES = ("words", "fixed", "fixed_any", "mined", "mined_any", "mined_weight", "near_you", "you", "capitals", "shouted_words", "shouts",
            "punctuation", "obfuscated", "stretched", "long_words")
_UPPER, _LETTER, _DIGIT, _PUNCT, _SHOUT, _LEET = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_PUNCT[[*b".,;:!?\"'()[]{}-_/*#@$%&+=<>|~^`\\"]] = True
_SHOUT[[*b"!?"]] = True
_LEET[[*b"*@$013457!#"]] = True
_KEPT = _LETTER | _DIGIT


def _name(words) -> np.ndarray:
    """Names of lower-case words, as ``_facts`` gives them."""
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(mix(Roller(BYTE_CODE[b]).of(np.array([0]), np.array([len(b)])))[0])
    return np.sort(np.array(out, U64))


def _facts(raw: np.ndarray, offsets: np.ndarray) -> dict:
    starts, ends, first = word_bounds(raw, offsets)
    b = raw[int(offsets[0]):int(offsets[-1])]
    lower = LOWER[b]
    kept = Roller(BYTE_CODE[lower], _KEPT[b])
    plain = Roller(BYTE_CODE[lower])

    def count(table, s=starts, e=ends):
        sums = np.zeros(len(b) + 1, np.int32)
        np.cumsum(table[b], out=sums[1:])
        return sums[e] - sums[s]

    same = np.zeros(256, bool)
    f = {"first": first, "rows": np.repeat(np.arange(len(first) - 1), np.diff(first)), "size": ends - starts,
         "name": mix(kept.of(starts, ends)), "stems": [], "upper": count(_UPPER), "letters": count(_LETTER), "punct": count(_PUNCT),
         "shout": count(_SHOUT), "leet_inside": np.zeros(len(starts), np.int32), "stretched": np.zeros(len(starts), bool)}
    for n in STEMS:
        cut = np.minimum(starts + n, ends)
        f["stems"].append(np.where(ends - starts >= n, mix(plain.of(starts, cut) + U64(n)), U64(0)))
    inner = np.maximum(ends - 1, starts)
    f["leet_inside"] = count(_LEET, np.minimum(starts + 1, inner), inner) * (f["letters"] > 1)
    triple = np.zeros(len(b) + 1, np.int32)
    if len(b) > 2:
        same = (lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2]) & _LETTER[b[2:]]
        np.cumsum(same, out=triple[1:len(b) - 1])
        triple[len(b) - 1:] = triple[len(b) - 2]
        f["stretched"] = (triple[np.maximum(ends - 2, starts)] - triple[starts]) > 0
    return f


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def dense_features(f: dict, mined: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; ``mined``: sorted names of mined stems with their weights."""
    rows, n = f["rows"], len(f["first"]) - 1
    words = np.diff(f["first"])
    share = lambda v: np.bincount(rows, weights=v, minlength=n) / np.maximum(words, 1)
    total = lambda v: np.bincount(rows, weights=v, minlength=n)
    insult, you = _in(f["name"], _name(INSULTS)), _in(f["name"], _name(SECOND_PERSON))
    strength = np.zeros(len(rows))
    for names in (f["name"], *f["stems"]):
        hit = _in(names, mined)
        if hit.any():
            strength[hit] = np.maximum(strength[hit], weight[np.searchsorted(mined, names[hit])])
    toxic = insult | (strength > 0)
    near = np.zeros(len(rows), bool)
    for k in range(1, NEAR + 1):
        same = rows[k:] == rows[:-k]
        near[k:] |= you[:-k] & same
        near[:-k] |= you[k:] & same
    size, letters = np.maximum(total(f["size"]), 1), np.maximum(total(f["letters"]), 1)
    return np.column_stack([
        np.log1p(words), share(insult), np.minimum(total(insult), 5), share(strength > 0), np.minimum(total(strength > 0), 5), total(strength) / np.maximum(words, 1),
        share(toxic & near), share(you), total(f["upper"]) / letters, share((f["upper"] > 1) & (f["upper"] == f["letters"])), total(f["shout"]) / size,
        total(f["punct"]) / size, share(f["leet_inside"] > 0), share(f["stretched"]), share(f["size"] > 20)])


def _facts_of(batches, columns):
    with np.errstate(over="ignore"):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in row_ranges(offsets):
                part = batch.slice(a, b - a)
                yield [part.column(c) for c in columns], _facts(raw, offsets[a:b + 1])


def mine_stems(train: DataFrame, lexicon_size: int = 2_000, support: int = 5, lift: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """(sorted names, weights) of words and word starts that are frequent in toxic training rows and rare in others."""
    def run(batches):
        for (label,), f in _facts_of(batches, ["toxic"]):
            toxic = label.to_numpy(zero_copy_only=False).astype(bool)
            pairs = [np.unique(np.column_stack([names, f["rows"].astype(U64)]), axis=0) if len(names) else np.zeros((0, 2), U64)
                     for names in (f["name"], *f["stems"])]
            pairs = np.concatenate(pairs)
            name, at = np.unique(pairs[:, 0], return_inverse=True)
            hit = toxic[pairs[:, 1].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.bincount(at, minlength=len(name))),
                                              pa.array(np.bincount(at, weights=hit, minlength=len(name)).astype(np.int64))], names=["stem", "n", "t"])

    all_rows, all_toxic = train.agg(F.count("*"), F.sum("toxic")).first()
    clean = max(all_rows - (all_toxic or 0), 1)
    counts = train.mapInArrow(run, "stem long, n long, t long").where("stem <> 0").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rate = (F.col("t") / max(all_toxic or 0, 1)) / ((F.col("n") - F.col("t") + 0.5) / clean)
    best = counts.where(F.col("t") >= support).withColumn("lift", rate).where(F.col("lift") >= lift).orderBy(F.desc("t"), "stem").limit(lexicon_size).collect()
    names = np.array([r.stem for r in best], np.int64).view(U64)
    order = np.argsort(names)
    return names[order], np.log(np.array([r.lift for r in best], float))[order]


def features(docs: DataFrame, mined: tuple[np.ndarray, np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, extra..., features array<double>)."""
    shared = docs.sparkSession.sparkContext.broadcast(mined)
    columns = ["doc_id", *extra]
    kinds = dict(docs.dtypes)

    def run(batches):
        for own, f in _facts_of(batches, columns):
            x = dense_features(f, *shared.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*own, flat], names=[*columns, "features"])

    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", features array<double>")


def training_part(doc_id):
    """True for rows that may teach: crc32 of the id as text is not 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.7, train_rows: int = 20_000, trees: int = 20, depth: int = 3,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    texts = keyed_texts(docs, id_col, text_col)
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(training_part(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = marked.count()
    chosen = marked.where(hash_share("doc_id", train_rows / max(total, 1)))
    train = keep(texts.join(chosen, "doc_id"))
    seen = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    scored = features(texts, mined := mine_stems(train)) if len(seen) > 1 else texts
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    if len(seen) < 2:
        out = scored.select("doc_id", held, F.lit(float(max(seen, default=0))).alias("score"))
    else:
        own = keep(features(train, mined, ("toxic",)).select(
            array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"),
            (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0).alias("calibrate")))
        trees_model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, maxBins=32).fit(own.where("not calibrate"))
        margin = vector_to_array("rawPrediction")[1].alias("margin")
        seen_by_none = trees_model.transform(own.where("calibrate")).select(margin, "label")
        curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(seen_by_none)
        rated = trees_model.transform(scored.withColumn("features", array_to_vector("features"))).select("doc_id", margin)
        out = curve.transform(rated).select("doc_id", held, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))

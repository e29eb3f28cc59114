"""Divergence audit of the sources of each language, on exact term counts.

Terms are runs of letters A-Z, a-z and everything beyond ASCII, A-Z
lower-cased.  Nulls in text, language and source read as ''.

1. Tasks cut the texts into terms and count them: an exact sparse vector per
   document.  No vocabulary is fitted first (see README: one on the driver, as
   ``CountVectorizer`` keeps it, outgrows the driver, in one fit or in many);
   terms keep their own names.
2. Group sums in the manner of ``Summarizer``, kept sparse: a task adds the
   vectors of its documents per (language, source), with the number of documents
   of each term, and hands on a row per group and term; one that gathers over
   ``BUFFER`` rows hands them on early.  Spark adds the rows of the tasks, dealt by
   term, and keeps the terms of ``min_df`` documents of their language or more.
3. Smoothed shares p = 1 + floor(10^9 (count + 1) / (N + V)) by integral
   division.  The divergence of p from q is the sum over all V kept terms of
   floor((p - q)^2 / q).
4. Pairs of sources, block of terms by block: a task holds the shares of the
   sources that have a term of the block, as many terms as fit ``CELLS``
   numbers, and adds up its terms.  Terms that a source lacks have its share
   for count 0, so a pair of sources without terms in the block needs one
   number, and a pair with one such source only the distinct shares of the
   other.

Bounds: nothing of the vocabulary reaches the driver; sums and blocks are
bounded as above; the result itself has a row per ordered pair of sources of a
language.  A source or a language of a third of all rows, or a term of every
document, is summed in every task first.

Edge cases: repeated rows are documents of their own; empty texts and texts
without terms count in their group, which then has N = 0; a language without
kept terms has pairs of value 0; a source alone in its language has no pairs;
ties rank by the item's UTF-8 bytes; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vectriage.llm.common import LOWER, freeing, keep, row_ranges, text_bytes

IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
SHARE = 1_000_000_000
BUFFER = 1 << 20
CELLS = 1 << 21


def document_vectors(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, row, place in the vocabulary, count): sparse vectors of the texts at offsets ``at`` of ``raw``."""
    b = LOWER[raw]
    inside = IN_TERM[b]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]                     # terms end with their text
    first[at[:-1][full]] = inside[at[:-1][full]]
    last[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = np.zeros(len(starts) + 1, np.int32)  # the texts are one or at most a megabyte
    np.cumsum(ends - starts, out=size[1:])
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(size), pa.py_buffer(b[inside].tobytes())).dictionary_encode()
    row = np.searchsorted(at, starts, "right") - 1
    cell = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy().astype(np.int64)
    cell, count = np.unique(cell, return_counts=True)
    return coded.dictionary, cell // max(len(coded.dictionary), 1), cell % max(len(coded.dictionary), 1), count


def group_sums(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) summed in tasks: occurrences of each term in each group, and documents that have it."""
    def run(batches):
        tables, held = [], 0
        add = lambda t: t.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(
            ["lang", "source", "term", "n", "docs"])
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault(g, len(names)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
            langs, sources = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
            for lo, hi in row_ranges(offsets):
                words, row, word, count = document_vectors(raw[int(offsets[lo]):int(offsets[hi])], offsets[lo:hi + 1] - offsets[lo])
                if not len(row):
                    continue
                cell = group[lo + row] * len(words) + word
                order = np.argsort(cell, kind="stable")
                cell, count = cell[order], count[order]
                cut = np.r_[0, np.flatnonzero(np.diff(cell)) + 1]
                own, n, d = cell[cut], np.add.reduceat(count, cut), np.diff(np.r_[cut, len(cell)])
                of = pa.array(own // len(words))
                tables.append(pa.table({"lang": langs.take(of), "source": sources.take(of), "term": words.take(pa.array(own % len(words))),
                                        "n": pa.array(n.astype(np.int64)), "docs": pa.array(d.astype(np.int64))}))
                held += len(cut)
                if held > BUFFER:
                    tables = [add(pa.concat_tables(tables))]
                    held = tables[0].num_rows
                    if held > BUFFER // 2:
                        yield from tables[0].to_batches(max_chunksize=1 << 16)
                        tables, held = [], 0
        if tables:
            yield from add(pa.concat_tables(tables)).to_batches(max_chunksize=1 << 16)

    return docs.mapInArrow(freeing(run), "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_df: int) -> DataFrame:
    """(lang, source, term, n, lang_n, lead): counts of the terms that ``min_df`` documents of the language have; ``lead``: once a term."""
    sums = group_sums(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    every = sums.select("lang", "source", "term", "n", F.sum("docs").over(w).alias("df"), F.sum("n").over(w).alias("lang_n"),
                        (F.row_number().over(w.orderBy("source")) == 1).alias("lead"))
    return every.where(F.col("df") >= min_df).drop("df")


def share(count, n, v):
    """1 + floor(10^9 (count + 1) / (n + v)), exact: in longs, or decimals where these could overflow."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = ((wide(count) + F.lit(1)) * F.lit(SHARE)).cast("decimal(38,0)")
    slow = F.call_function("div", top, (wide(n) + wide(v)).cast("decimal(38,0)"))
    fast = F.call_function("div", (count.cast("long") + 1) * F.lit(SHARE), n.cast("long") + v.cast("long"))
    return (F.when(count < 9_000_000_000, fast).otherwise(slow) + 1).cast("long")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _block_pairs(rows: pa.Table) -> pa.Table:
    """Sums over the terms of one block for every ordered pair of sources of the language.

    ``rows``: entries (term, gid, p) and, with a null term, every source (gid, its share of count 0) and the block's number of terms.
    """
    is_source = rows.column("term").is_null().to_numpy()
    gid, p = rows.column("gid").to_numpy(), rows.column("p").to_numpy()
    size = int(rows.column("terms").to_numpy()[is_source][0])
    order = np.argsort(gid[is_source])
    ids, p0 = gid[is_source][order], p[is_source][order]
    coded = rows.column("term").combine_chunks().filter(pa.array(~is_source)).dictionary_encode()
    who = np.searchsorted(ids, gid[~is_source])
    here, at = np.unique(who, return_inverse=True)
    terms, col = coded.dictionary, coded.indices.to_numpy()
    shares = np.repeat(p0[here][:, None], len(terms), 1)
    shares[at, col] = p[~is_source]
    total = _f(p0[:, None], p0[None, :]) * size                            # as if nobody had a term of the block
    spare = size - len(terms)                                              # terms of the block that nobody has
    away = np.setdiff1d(np.arange(len(ids)), here)
    for k, g in enumerate(here):
        values, times = np.unique(shares[k], return_counts=True)
        total[g, away] = (_f(values[:, None], p0[away][None, :]) * times[:, None]).sum(0) + spare * _f(p0[g], p0[away])
        total[away, g] = (_f(p0[away][None, :], values[:, None]) * times[:, None]).sum(0) + spare * _f(p0[away], p0[g])
        total[g, here] = _f(shares[k], shares).sum(1) + spare * _f(p0[g], p0[here])
    a, b = np.nonzero(~np.eye(len(ids), dtype=bool))
    return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64()), "value": pa.array(total[a, b], pa.int64())})


def audit(docs: DataFrame, min_df: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of each source from the others, and its ``top`` terms against its language."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    entries = keep(kept_terms(docs, min_df))
    v = entries.groupBy("lang").agg(F.count_if("lead").alias("v"))
    n = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # One row per group: the sources of the languages, not documents.
    known = keep(docs.select("lang", "source").distinct().join(v, "lang", "left").join(n, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total")).withColumn(
        "gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")))
    held = known.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v"), F.sum("total").alias("lang_total"))
    counted = entries.join(known.select("lang", "source", "gid", "total"), ["lang", "source"]).join(held, "lang").withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("v")))
    by_term = (counted.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
               .where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                F.expr("(p - q) * (p - q) div q").alias("value")))

    # As many terms in a block as keep its shares within CELLS; terms are dealt by hash.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("sources") / F.lit(CELLS)), F.least(F.lit(16), F.ceil(F.col("v") / 1000))).cast("int")
    block = F.expr("pmod(xxhash64(term), blocks)").alias("block")
    sized = entries.where("lead").join(held.select("lang", blocks.alias("blocks")), "lang").select("lang", block).groupBy("lang", "block").agg(F.count("*").alias("terms"))
    zero = known.where("v > 0").withColumn("p", share(F.lit(0), F.col("total"), F.col("v")))
    sources = sized.join(zero, "lang").select("lang", "block", F.lit(None).cast("string").alias("term"), "gid", "p", "terms")
    cells = counted.select("lang", blocks.alias("blocks"), "term", "gid", "p").select("lang", block, "term", "gid", "p", F.lit(None).cast("long").alias("terms"))

    def pairs(key, rows):
        out = _block_pairs(rows)
        return out.append_column("lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))

    summed = cells.unionByName(sources).groupBy("lang", "block").applyInArrow(pairs, "a long, b long, value long, lang string").groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))
    empty = known.where("v = 0")
    none = empty.select("lang", F.col("gid").alias("a"), "source").join(empty.select("lang", F.col("gid").alias("b"), F.col("source").alias("item")), "lang").where(
        "a <> b").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    names = known.select("lang", "gid", "source")
    by_pair = (summed.join(names.withColumnRenamed("gid", "a"), ["lang", "a"])
               .join(names.select("lang", F.col("gid").alias("b"), F.col("source").alias("item")), ["lang", "b"])
               .select("lang", "source", F.lit("pair").alias("part"), "item", "value")).unionByName(none)

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = by_term.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.unionByName(by_pair.withColumn("rank", place)).select("lang", "source", "part", "item", "value", "rank")

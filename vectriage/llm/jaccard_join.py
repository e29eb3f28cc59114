"""N-gram Jaccard join of documents.

Method: a blocked sparse matrix product.  Rows of the incidence matrix are
documents (one for each distinct n-gram set), columns are n-grams, named by
64-bit fingerprints.  Overlap counts are accumulated over blocks of columns,
and a row or pair is discarded as soon as a bound from its sizes shows that
it cannot reach the threshold: a partner of a document with s n-grams shares
at least ``need(s) = ceil(num * s / den)`` of them.

1. Sizes and fingerprints of all sets; equal sets become one class.
2. First block of columns: the lowest ``prefix(s) = s - need(s) + ell(s)``
   fingerprints of each set.  Linked sets of sizes s and t have at least
   ``min(ell(s), ell(t))`` n-grams in common there, so a document goes on only
   if at least ``ell(need(s))`` of its block occur in another document's.
   Occurrence is decided in buckets of columns; a task sends an n-gram that it
   saw in several documents only once, so a frequent n-gram does not fill its
   bucket.
3. Classes left over: their blocks in order of frequency, and the same bound
   once more.  Only the first ``prefix(s) - ell(need(s)) + 1`` columns in that
   order can hold the first common column of a linked pair.
4. Rows that meet in such a column are gathered by the smallest row of the
   column.  A large gathering is dealt out as pairs of blocks.  A task counts
   the overlaps of its block pair by a matrix product and returns, not the
   pairs, but each row's number of links and a spanning forest of them.  A
   pair that meets in several gatherings counts in the one with the smallest
   name.
5. Components of the forests, then back to all documents.

Texts and n-grams cross the network as packed arrays.  From step 3 on, the
copies of a document are one row.

Edge cases: null or empty texts, and texts without words, have an empty set
and no links; a text with fewer than n words has its whole word sequence as
its one n-gram; a row with a null id has no component and no links; repeated
rows are copies of one another; an id of several texts has a row's result for
each text, linked by itself; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectriage.llm.common import (U64, components, freeing, if_few, keep, keyed_texts, mix, packed, placed, places, release, row_ranges, text_bytes,
                                  word_hashes)

STEP = U64(0xD6E8FEB86659FD93)
MANY = np.int64(-(1 << 63))


def ngram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram fingerprints of all rows one after the other, first place of each row + total)."""
    words, first = word_hashes(raw, offsets, lower=True)
    sums = np.zeros(max(len(words) - n + 1, 0), U64)
    factor = U64(1)
    for k in range(n):
        factor = factor * STEP
        if len(sums):
            sums += words[k:k + len(sums)] * factor
    sums = mix(sums)
    parts, sizes = [], np.zeros(len(first), np.int64)
    for r in range(len(first) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= n:
            own = np.unique(sums[a:b - n + 1])
        elif b > a:
            whole = U64(b - a)
            for k in range(a, b):
                whole = whole * STEP + words[k]
            own = mix(np.array([whole], U64))
        else:
            continue
        parts.append(own)
        sizes[r + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(sizes)


def _set_batches(batches, n: int):
    """(ids, n-grams, first places) of bounded ranges of rows."""
    with np.errstate(over="ignore"):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in row_ranges(offsets):
                grams, first = ngram_sets(raw, offsets[a:b + 1], n)
                yield batch.column("doc_id").slice(a, b - a), grams, first


class Bounds:
    """need, ell and prefix of the module's text, for arrays and as SQL over the column ``size``.

    ``share``: thousandths of a set in its first block of columns, beyond what may be missing in a partner.
    """

    def __init__(self, num: int, den: int, share: int):
        self.num, self.den, self.share = num, den, share
        self.need_sql = f"(({num} * size + {den - 1}) div {den})"
        self.ell_sql = f"greatest(1, {share} * size div 1000)"
        self.least_sql = f"greatest(1, {share} * {self.need_sql} div 1000)"
        self.prefix_sql = f"(size - {self.need_sql} + {self.ell_sql})"

    def prefix(self, size):
        return size - (self.num * size + self.den - 1) // self.den + np.maximum(1, self.share * size // 1000)


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, s1, s2): size and 128-bit fingerprint of the n-gram set."""
    def run(batches):
        for ids, grams, first in _set_batches(batches, n):
            total = np.zeros((2, len(grams) + 1), U64)
            np.cumsum(mix(grams), out=total[0, 1:])
            np.cumsum(mix(grams ^ STEP), out=total[1, 1:])
            by_row = total[:, first[1:]] - total[:, first[:-1]]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), *(pa.array(x.view(np.int64)) for x in by_row)],
                                             names=["doc_id", "size", "s1", "s2"])

    return docs.mapInArrow(freeing(run), "doc_id long, size long, s1 long, s2 long")


def _bucket_rows(docs: DataFrame, n: int, bounds: Bounds, buckets: int, chunk: int) -> DataFrame:
    """(bucket, grams, owners): packed columns by range of their mixed names; owner MANY: of several documents of the task.

    Rows with a negative bucket carry (document, count) of columns already known to be shared.
    """
    cuts = np.array([b * (1 << 64) // buckets for b in range(1, buckets)], U64)

    def send(parts):
        gram = mix(np.concatenate([p[0] for p in parts]))
        doc = np.concatenate([p[1] for p in parts])
        order = np.argsort(gram, kind="stable")
        gram, doc = gram[order], doc[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(gram)))
        # a repeated row holds the same column again; that is not another document
        single = doc[start] == np.maximum.reduceat(doc, start)
        single &= doc[start] == np.minimum.reduceat(doc, start)
        known, count = np.unique(doc[~np.repeat(single, length)], return_counts=True)
        gram, doc = gram[start], np.where(single, doc[start], MANY)
        cut = [0, *np.searchsorted(gram, cuts), len(gram)]
        rows = [(b, packed(gram[cut[b]:cut[b + 1]]), packed(doc[cut[b]:cut[b + 1]])) for b in range(buckets) if cut[b + 1] > cut[b]]
        if len(known):
            rows.append((-1 - int(known[0]) % buckets, packed(known), packed(count.astype(np.int64))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                                           pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "grams", "owners"])

    def run(batches):
        parts, size = [], 0
        for ids, grams, first in _set_batches(batches, n):
            sizes = np.diff(first)
            place = np.arange(len(grams)) - np.repeat(first[:-1], sizes)
            low = place < np.repeat(bounds.prefix(sizes), sizes)
            parts.append((grams[low], np.repeat(ids.to_numpy(), sizes)[low]))
            size += len(parts[-1][0])
            if size >= chunk:
                yield send(parts)
                parts, size = [], 0
        if size:
            yield send(parts)

    return docs.mapInArrow(freeing(run), "bucket long, grams binary, owners binary")


def _shared_of_bucket(slots: int):
    """Function for one bucket: (slot, docs, counts), how many of a document's columns other documents have too, packed by slot."""
    def run(table: pa.Table) -> pa.Table:
        gram = np.concatenate([np.frombuffer(x.as_py(), U64) for x in table.column("grams")])
        doc = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("owners")])
        if table.column("bucket")[0].as_py() < 0:
            ids, count = gram.view(np.int64), doc
        else:
            order = np.argsort(gram)
            gram, doc = gram[order], doc[order]
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            start = np.flatnonzero(new)
            many = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            ids, count = np.unique(doc[np.repeat(many, np.diff(np.append(start, len(gram)))) & (doc != MANY)], return_counts=True)
        slot = (mix(ids.view(U64)) % U64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        cut = np.searchsorted(slot[order], np.arange(slots + 1))
        rows = [(k, packed(ids[order[a:b]]), packed(count[order[a:b]].astype(np.int64))) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return pa.table({"slot": pa.array([r[0] for r in rows], pa.int64()), "docs": pa.array([r[1] for r in rows], pa.binary()),
                         "counts": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _sum_of_slot(table: pa.Table) -> pa.Table:
    """(doc_id, shared) of one slot of documents."""
    doc, count = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(c)]) for c in ("docs", "counts"))
    ids, place = np.unique(doc, return_inverse=True)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "shared": pa.array(np.bincount(place, weights=count).astype(np.int64))})


def _packed_sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for ids, grams, first in _set_batches(batches, n):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(first)), pa.array([packed(grams[a:b]) for a, b in zip(first[:-1], first[1:])], pa.binary())],
                names=["doc", "size", "grams"])

    return docs.mapInArrow(freeing(run), "doc long, size long, grams binary")


def _block_columns(sets: DataFrame, bounds: Bounds) -> DataFrame:
    """(doc, size, gram) for the first block of columns of each set."""
    def run(batches):
        for batch in batches:
            doc, size = batch.column("doc").to_numpy(), batch.column("size").to_numpy()
            count = bounds.prefix(size)
            grams = [np.frombuffer(g.as_py(), np.int64)[:k] for g, k in zip(batch.column("grams"), count)]
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, count)), pa.array(np.repeat(size, count)),
                                                  pa.array(np.concatenate(grams))], names=["doc", "size", "gram"])

    return sets.mapInArrow(freeing(run), "doc long, size long, gram long")


def _codes(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column, columns) of the entries that at least two of the arrays have."""
    values, column, count = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    shared = count > 1
    renumbered = np.cumsum(shared) - 1
    use = shared[column]
    return row[use], renumbered[column[use]], int(shared.sum())


def overlap_counts(arrays: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Matrix of common entries of each two arrays, accumulated over blocks of columns."""
    row, column, columns = _codes(arrays)
    out = np.zeros((len(arrays), len(arrays)), np.float32)
    for a in range(0, columns, width):
        here = (column >= a) & (column < a + width)
        block = np.zeros((len(arrays), min(width, columns - a)), np.float32)
        block[row[here], column[here] - a] = 1
        out += block @ block.T
    return out


def _link_block(num: int, den: int):
    """Function for one pair of blocks of a gathering: each row's links, and a spanning forest."""
    def linked(key, table):
        hub, i, j = (k.as_py() for k in key)
        doc, size, part = (table.column(c).to_numpy() for c in ("doc", "size", "block"))
        order = np.argsort(doc)
        doc, size, part = doc[order], size[order], part[order]
        lists = {c: [table.column(c)[int(k)].values.to_numpy() for k in order] for c in ("hubs", "columns")}
        lists["grams"] = [np.frombuffer(table.column("grams")[int(k)].as_py(), np.int64) for k in order]
        n = len(doc)
        pairs = np.triu(np.ones((n, n), bool), 1)
        if i != j:
            pairs &= part[:, None] != part[None, :]
        low, high = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
        pairs &= den * low >= num * high
        if pairs.any():                # of the gatherings where a pair meets, the smallest counts it
            here = overlap_counts([c[h == hub] for h, c in zip(lists["hubs"], lists["columns"])])
            pairs &= here > 0
        if pairs.any():
            before = overlap_counts([c[h < hub] for h, c in zip(lists["hubs"], lists["columns"])])
            pairs &= before == 0
        if pairs.any():
            common = overlap_counts(lists["grams"])
            pairs &= den * common >= num * (size[:, None] + size[None, :] - common)
        left, right = np.nonzero(pairs)
        links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
        root = list(range(n))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        forest = []
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((doc[a], doc[b], 0))
        rows = forest + [(doc[k], doc[k], links[k]) for k in np.flatnonzero(links)]
        return pa.table({c: pa.array([int(r[k]) for r in rows], pa.int64()) for k, c in enumerate(("a", "b", "links"))})

    def run(key, table):
        out = linked(key, table)
        release()
        return out

    return run


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                 share: int = 230, bucket_grams: int = 1_500_000, chunk_grams: int = 600_000, slot_rows: int = 50_000, block_rows: int = 512,
                 block_grams: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) of every row.

    Two documents link when den * |A and B| >= num * |A or B|.  ``class_id``:
    smallest id with the same set; ``component_id``: smallest id reachable by
    links; ``n_links``: linked classes with another set.  ``share`` and the
    sizes of buckets, chunks and blocks set the shape of the work, never
    results.
    """
    texts, work = keyed_texts(docs, id_col, text_col), (n, num, den, share, bucket_grams, chunk_grams, slot_rows, block_rows, block_grams)
    named = places(texts)
    if named is None:
        return _join(texts, *work)
    # An id of several texts: every text is joined by itself, under its place.
    found = _join(placed(texts, named, name="place").select(F.col("place").alias("doc_id"), "text"), *work)
    for column in ("doc_id", "component_id", "class_id"):
        found = found.join(named.select(F.col("place").alias(column), F.col("doc_id").alias(f"_{column}")), column, "left")
    return found.select(F.col("_doc_id").alias("doc_id"), "n_shingles", F.col("_component_id").alias("component_id"), F.col("_class_id").alias("class_id"), "n_links")


def _join(texts: DataFrame, n: int, num: int, den: int, share: int, bucket_grams: int, chunk_grams: int, slot_rows: int, block_rows: int,
          block_grams: int) -> DataFrame:
    """``jaccard_join`` of ``texts(doc_id, text)`` whose ids stand for one text each."""
    known = texts.where("doc_id is not null")
    bounds = Bounds(num, den, share)
    sizes = keep(set_sizes(texts, n))
    total, rows = sizes.agg(F.sum(F.expr(bounds.prefix_sql)), F.count("*")).first()

    classes = (sizes.where("size > 0 and doc_id is not null").groupBy("size", "s1", "s2").agg(F.min("doc_id").alias("class_id")))
    shared = (_bucket_rows(known, n, bounds, 1 + (total or 0) // bucket_grams, chunk_grams)
              .groupBy("bucket").applyInArrow(_shared_of_bucket(1 + rows // slot_rows), "slot long, docs binary, counts binary")
              .groupBy("slot").applyInArrow(_sum_of_slot, "doc_id long, shared long"))
    live = (classes.withColumnRenamed("class_id", "doc_id").join(shared, "doc_id")
            .where(f"shared >= {bounds.least_sql}").select("doc_id"))
    # Texts without a possible partner stay where they are; only the others are dealt by their id.
    sets = keep(_packed_sets(known.join(if_few(live), "doc_id", "left_semi").dropDuplicates(["doc_id"]), n))

    entries = _block_columns(sets, bounds)
    often = entries.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = entries.join(often, "gram").selectExpr(
        "*", "count(*) over (partition by doc) as shared", "row_number() over (partition by doc order by df, gram) as place")
    # Columns that no other document has are first in the order and use up places.
    met = keep(ranked.where(f"shared >= {bounds.least_sql}")
               .where(f"place <= shared - {bounds.least_sql} + 1").select("doc", "size", "gram"))
    hubs = met.groupBy("gram").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).where("n > 1").select("gram", "hub")
    met = keep(met.join(hubs, "gram"))
    columns = met.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("hub", "gram"))).alias("met"))
    rows = columns.join(sets, "doc").select("doc", "size", "grams", F.col("met.hub").alias("hubs"), F.col("met.gram").alias("columns"))

    member = met.select("hub", "doc", "size").distinct()
    blocks = member.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_grams)).cast("int").alias("nb"))
    dealt = (member.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("hub", "doc", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    found = keep(dealt.join(rows, "doc")
                 .groupBy("hub", "i", "j").applyInArrow(_link_block(num, den), "a long, b long, links long"))
    linked = found.where("a = b").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("n_links"))
    reach = components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("class_id"), "component")
    named = classes.join(reach, "class_id", "left").join(linked, "class_id", "left")
    return (sizes.join(named, ["size", "s1", "s2"], "left")
            .select("doc_id", F.col("size").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")))

"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at both ends, A-Z lower-cased.
A key of ``min_chars`` code points or more, held by ``min_docs`` documents or
more, loses its lines everywhere but in the largest id that holds it.

Store.  ``LineStore`` is a folder of versions, each written once:

* ``refs``: exact references, one signed row per (key, document): +1 when the
  document comes, -1 when it goes.  A key's reference count is the sum.
* ``repeated``: the keys whose count is ``min_docs`` or more, with the count
  and the largest document.
* ``filters``: one cuckoo filter per shard of these keys.  A key enters its
  filter when its count reaches ``min_docs`` and leaves it when the count
  falls below, so a fingerprint is there once and can be taken out again.  A
  filter too full for its new keys is built anew from ``repeated``; more shards
  are made when one would hold over ``SHARD_KEYS`` keys.
* ``commits``: written last, with the figures of the version.  A version that
  lost its driver half way has none and is never read.

``insert`` and ``delete`` read the texts of their own documents only; the rest
comes from the references.  After a deletion the store answers as if the
documents had never come.

``deduplicate`` sends the keys of the documents past the filter of their shard
(salted, streamed: a task holds one filter at a time) and looks up only those
that pass in ``repeated``.  A filter never misses a key, and what passes it
wrongly is not in ``repeated``, so results are exact.

Skew: distinct (key, document) pairs are dealt by both, counts are partial per
task, and keys with over 1 / ``HOT_SHARE`` of all references, of which there
are at most ``HOT_SHARE``, are joined by broadcast, the others by shuffle.

Edge cases: a null or empty text is one empty line; rows of one id are one
document and all lose the same lines; a null id is one document, below all
others; repeated rows give repeated results; empty tables give empty results;
columns other than id and text are not read.  Keys are compared by 128 bits of
two hashes.
"""

from __future__ import annotations

import math
import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectriage.llm.common import U64, freeing, keyed_texts, mix
from vectriage.session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"
SHARD_KEYS = 500_000
MIN_SHARDS = 8
SALTS = 64
HOT_SHARE = 5_000
SLOTS = 4
KEY = ["k1", "k2"]


class Cuckoo:
    """Cuckoo filter of 16-bit fingerprints, four to a bucket; two buckets per key, either found from the other."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots                      # (buckets, SLOTS) of uint16, 0: empty

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        """Room for ``n`` keys at a load of at most 0.9."""
        return cls(np.zeros((1 << max(1, math.ceil(math.log2(max(n, 1) / (0.9 * SLOTS)))), SLOTS), np.uint16))

    @classmethod
    def of(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def holds(self, n: int) -> bool:
        return n <= 0.9 * self.slots.size

    def _marks(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = (k2.astype(U64) & U64(0xFFFF)).astype(np.uint16)
        return (mix(k1.astype(U64)) & U64(len(self.slots) - 1)).astype(np.int64), np.where(f == 0, np.uint16(1), f)

    def _other(self, bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(f.astype(U64)) & U64(len(self.slots) - 1)).astype(np.int64)

    def _settle(self, bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.slots[b] == 0
        fits = rank < free.sum(1)
        empty_first = np.argsort(~free[fits], axis=1, kind="stable")
        self.slots[b[fits], empty_first[np.arange(len(empty_first)), rank[fits]]] = f[order][fits]
        done = np.zeros(len(b), bool)
        done[order[fits]] = True
        return done

    def add(self, k1: np.ndarray, k2: np.ndarray, rounds: int = 500) -> bool:
        """Insert keys that are not in yet; False when some found no place (the filter is then of no use)."""
        bucket, f = self._marks(k1, k2)
        for turn in range(rounds):
            for _ in range(2):
                left = ~self._settle(bucket, f)
                bucket, f = bucket[left], f[left]
                if not len(f):
                    return True
                bucket = self._other(bucket, f)
            # One key of each full bucket takes the place of another, which goes on to its other bucket.
            _, first = np.unique(bucket, return_index=True)
            at, slot = bucket[first], (mix(f[first].astype(U64) + U64(turn)) & U64(SLOTS - 1)).astype(np.int64)
            victim = self.slots[at, slot].copy()
            self.slots[at, slot] = f[first]
            f[first], bucket[first] = victim, self._other(at, victim)
        return False

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out keys that are in."""
        bucket, f = self._marks(k1, k2)
        while len(f):
            here = self.slots[bucket] == f[:, None]
            bucket = np.where(here.any(1), bucket, self._other(bucket, f))
            here = self.slots[bucket] == f[:, None]
            if not here.any(1).all():
                raise ValueError("a key to take out is not in the filter")
            slot = here.argmax(1)
            _, first = np.unique(bucket * SLOTS + slot, return_index=True)
            self.slots[bucket[first], slot[first]] = 0
            rest = np.ones(len(f), bool)
            rest[first] = False
            bucket, f = bucket[rest], f[rest]

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        bucket, f = self._marks(k1, k2)
        return (self.slots[bucket] == f[:, None]).any(1) | (self.slots[self._other(bucket, f)] == f[:, None]).any(1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id) for every key of every row of ``docs(doc_id, text)``, once a row."""
    keys = F.filter(F.array_distinct(F.transform(_lines(), line_key)), lambda k: F.char_length(k) >= min_chars)
    return docs.select("doc_id", F.explode(keys).alias("key")).select(
        F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"), "doc_id")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("k2", "k1"), F.lit(shards)).cast("int").alias("shard")


class LineStore:
    """A folder of references, repeated keys and filters; ``version`` 0 is empty."""

    def __init__(self, spark: SparkSession, path: str, min_chars: int = 20, min_docs: int = 3):
        self.spark, self.path, self.min_chars, self.min_docs = spark, path.rstrip("/"), min_chars, min_docs
        self.version, self.shards = 0, MIN_SHARDS
        if self._exists("commits"):
            last = self.spark.read.parquet(f"{self.path}/commits").orderBy(F.desc("version")).first()
            self.version, self.shards = last["version"], last["shards"]

    def _exists(self, name: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _read(self, name: str, schema: str, versions: list[int] | None = None) -> DataFrame:
        """Rows of a table in the committed versions; of the newest one alone where not told otherwise."""
        found = [v for v in (versions if versions is not None else [self.version]) if v > 0]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/v{v}" for v in found))

    @property
    def log(self) -> DataFrame:
        return self._read("refs", "k1 long, k2 long, doc_id long, sign int", list(range(1, self.version + 1)))

    @property
    def refs(self) -> DataFrame:
        """(k1, k2, doc_id) of all documents in the store."""
        net = self.log.groupBy(*KEY, "doc_id").agg(F.sum("sign").alias("n"))
        return net.where("n > 0").drop("n")

    @property
    def repeated(self) -> DataFrame:
        return self._read("repeated", "k1 long, k2 long, refs long, top long")

    @property
    def filters(self) -> DataFrame:
        return self._read("filters", "shard int, n long, filter binary")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """Add documents; references that the store already has stay single."""
        new = line_keys(keyed_texts(docs, id_col, text_col), self.min_chars).distinct()
        if self.version:
            new = _without(new, self.refs)
        return self._commit(new.withColumn("sign", F.lit(1)))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineStore:
        """Take documents out again, all lines of the ids named."""
        gone = ids.select(F.col(id_col).cast("long").alias("gone")).distinct()
        return self._commit(self.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").withColumn("sign", F.lit(-1)))

    def _commit(self, change: DataFrame) -> LineStore:
        version, old = self.version + 1, self.repeated
        # A folder left by a version that never committed is overwritten.
        change.select(*KEY, "doc_id", "sign").write.mode("overwrite").parquet(f"{self.path}/refs/v{version}")
        old_shards, self.version = self.shards, version
        net = self.log.groupBy(*KEY, "doc_id").agg(F.sum("sign").alias("n")).where("n > 0")
        counts = net.groupBy(*KEY).agg(F.count("*").alias("refs"), F.max("doc_id").alias("top"))
        counts.where(F.col("refs") >= self.min_docs).write.mode("overwrite").parquet(f"{self.path}/repeated/v{version}")
        keys, refs = self.repeated.agg(F.count("*"), F.coalesce(F.sum("refs"), F.lit(0))).first()
        self.shards = max(old_shards, math.ceil(keys / SHARD_KEYS))
        before = None if self.shards != old_shards or version == 1 else self._read("filters", "shard int, n long, filter binary", [version - 1])
        _filters(old, self.repeated, before, self.shards).write.mode("overwrite").parquet(f"{self.path}/filters/v{version}")
        self.spark.range(1).select(F.lit(version).alias("version"), F.lit(self.shards).alias("shards"), F.lit(keys).alias("keys"),
                                   F.lit(refs).alias("refs")).write.mode("append").parquet(f"{self.path}/commits")
        return self


def _without(left: DataFrame, right: DataFrame) -> DataFrame:
    """References of ``left`` that are not in ``right``; null ids are equal."""
    right = right.toDF("r1", "r2", "r_id")
    return left.join(right, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & F.col("doc_id").eqNullSafe(F.col("r_id")), "left_anti")


def _filters(old: DataFrame, new: DataFrame, before: DataFrame | None, shards: int) -> DataFrame:
    """One filter per shard of ``new`` keys: that of ``before`` changed where it has the room, else a new one."""
    state = old.select(*KEY, F.lit(True).alias("was")).join(new.select(*KEY, F.lit(True).alias("now")), KEY, "full")
    keys = state.select(_shard(shards), *KEY, F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))

    def build(rows: pa.Table, data: bytes | None) -> pa.Table:
        k1, k2, was, now = (rows.column(c).to_numpy() for c in ("k1", "k2", "was", "now"))
        n = int(now.sum())
        fresh = data is None or not Cuckoo.of(data).holds(n)
        room = n
        while True:
            cuckoo = Cuckoo.sized(room) if fresh else Cuckoo.of(data)
            if not fresh:
                cuckoo.remove(k1[was & ~now], k2[was & ~now])
            come = now if fresh else now & ~was
            if cuckoo.add(k1[come], k2[come]):
                break
            fresh, room = True, 2 * max(room, 1)
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()] if rows.num_rows else [], pa.int32()), "n": pa.array([n] if rows.num_rows else [], pa.int64()),
                         "filter": pa.array([cuckoo.slots.tobytes()] if rows.num_rows else [], pa.binary())})

    schema = "shard int, n long, filter binary"
    if before is None:
        return keys.groupBy("shard").applyInArrow(lambda t: build(t, None), schema)

    def change(t: pa.Table, b: pa.Table) -> pa.Table:
        return build(t, b.column("filter")[0].as_py()) if b.num_rows else build(t, None)

    return keys.groupBy("shard").cogroup(before.groupBy("shard")).applyInArrow(change, schema)


def passing(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of ``keys(k1, k2, doc_id)`` that the filter of their shard lets through."""
    no = lambda t: F.lit(None).cast(t)
    rows = keys.select(_shard(shards), F.pmod(F.xxhash64("doc_id", "k1"), F.lit(SALTS)).cast("int").alias("salt"), *KEY, "doc_id", no("binary").alias("filter"))
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), no("long").alias("k1"), no("long").alias("k2"),
                            no("long").alias("doc_id"), "filter")
    dealt = rows.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

    def run(batches):
        shard, cuckoo = None, None
        for batch in batches:
            at = batch.column("shard").to_numpy()
            full = np.flatnonzero(batch.column("filter").is_valid().to_numpy(zero_copy_only=False))
            cuts = np.unique(np.r_[0, full, np.flatnonzero(np.diff(at)) + 1, len(at)])
            keep = np.zeros(len(at), bool)
            is_filter = set(full.tolist())
            k1, k2 = (batch.column(c).fill_null(0).to_numpy() for c in KEY)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo in is_filter:
                    shard, cuckoo = at[lo], Cuckoo.of(batch.column("filter")[lo].as_py())
                    lo += 1
                if lo < hi and cuckoo is not None and at[lo] == shard:      # a shard without a filter has no repeated key
                    keep[lo:hi] = cuckoo.contains(k1[lo:hi], k2[lo:hi])
            if keep.any():
                yield batch.filter(pa.array(keep)).select([*KEY, "doc_id"])

    return dealt.mapInArrow(freeing(run), "k1 long, k2 long, doc_id long")


def dropped_keys(store: LineStore, keys: DataFrame) -> DataFrame:
    """(doc_id, k1, k2) of the lines that documents lose, once each."""
    found = passing(keys, store.filters, store.shards)
    total = store.spark.read.parquet(f"{store.path}/commits").where(F.col("version") == store.version).select("refs").first()
    hot = F.col("refs") * HOT_SHARE > F.lit(total["refs"] if total else 0)
    table = store.repeated
    # At most HOT_SHARE keys can each have over 1 / HOT_SHARE of the references.
    often = F.broadcast(table.where(hot).select(*KEY, F.lit(True).alias("often"), F.col("top").alias("hot_top")))
    marked = found.join(often, KEY, "left")
    rest = marked.where("often is null").select(*KEY, "doc_id").join(table.where(~hot).select(*KEY, "top"), KEY)
    both = marked.where("often").select(*KEY, "doc_id", F.col("hot_top").alias("top")).unionByName(rest)
    return both.where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("top"))).select("doc_id", *KEY).distinct()


def deduplicate(store: LineStore, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of documents that are in the store."""
    texts = keyed_texts(docs, id_col, text_col)
    drops = dropped_keys(store, line_keys(texts, store.min_chars)).groupBy(F.col("doc_id").alias("drop_id")).agg(
        F.collect_list("k1").alias("d1"), F.collect_list("k2").alias("d2"))
    rows = texts.join(drops, texts["doc_id"].eqNullSafe(drops["drop_id"]), "left").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "d1", "d2")
    hit = F.col("d1").isNotNull()
    keys = F.transform(_lines(), line_key)
    rows = rows.select("doc_id", "text", F.size(_lines()).cast("long").alias("n_lines"), "d1", "d2", F.when(hit, F.transform(keys, lambda k: F.xxhash64(k))).alias("h1"),
                       F.when(hit, F.transform(keys, lambda k: F.xxhash64(F.lit("line"), k))).alias("h2"))

    def run(batches):
        for batch in batches:
            n, texts = [0] * batch.num_rows, batch.column("text").to_pylist()
            for i in np.flatnonzero(batch.column("d1").is_valid().to_numpy(zero_copy_only=False)).tolist():
                d1, d2, h1, h2 = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("d1", "d2", "h1", "h2"))
                gone = set(zip(d1.tolist(), d2.tolist()))
                lines = texts[i].split("\n")
                kept = [line for line, a, b in zip(lines, h1.tolist(), h2.tolist()) if (a, b) not in gone]
                n[i], texts[i] = len(lines) - len(kept), "\n".join(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), pa.array(n, pa.int64()), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return rows.mapInArrow(freeing(run), "doc_id long, n_lines long, n_dropped long, kept_text string")


def dedup_digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Insert documents into a new store and digest what each keeps; the store stays in the shared folder."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    store = LineStore(spark, path, min_chars, min_docs).insert(docs)
    return deduplicate(store, docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))

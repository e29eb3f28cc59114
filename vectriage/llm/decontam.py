"""Benchmark decontamination by templates.

Method: words are canonicalised into a template: numbers, names and units
become typed placeholders, every other word its lower-case letters and digits.
Windows of ``window`` template words of documents and benchmark items are
hash-joined.  The windows that a text and an item share on one diagonal (same
distance of places) make segments, and segments that follow one another in both,
at most the item's length apart in the text, make a passage: words put in or
left out only move the rest to another diagonal.  Of the slots of a passage whose
values differ all but one, or more than half, must answer each other one to one,
so a question asked with other numbers or names matches, also if two of them
coincide, a coincidence of placeholders does not; where they do not, its
diagonals, its exact words and, if all their slots answer, its beginnings are
taken alone.  A document is
contaminated by an item when a consistent passage covers at least ``cover`` of
its words.

A window has up to three names: that of its exact words without case and
punctuation, and, if it has slots and at least half of it are ordinary words,
that of its template, once with possible names as ordinary words and once as
names.  Windows with more
slots are thus compared by their exact words alone.  An item of fewer than
``window`` words is one window of its own length, and documents have windows of
the lengths that the benchmark needs.  Only document windows whose fingerprint
is set in a bit table of fixed size, made from the benchmark, go into the join;
a full table lets more through and changes no result.

Every character of a script without spaces (Chinese, Japanese, Thai, Lao,
Khmer, Burmese) is a word.

A word is a number if all its letters and digits are digits; a unit if it is
in ``UNITS`` and follows a number; a name if it starts with one capital and goes on
in small letters; first in the text or after one of ``.!?:`` a possible name.

Edge cases: null and empty texts and items match nothing, as do items without
letters and digits; an item of one word matches every document with that word; texts of
documents are compared one by one, so repeated rows get equal results; repeated items count once per item id, and an
id with several texts matches if one of them does; rows with a null id are
compared like others and come back as one row with the null id's matches;
other columns are not read; empty tables give no matches.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectriage.llm.common import BYTE_CODE, LOWER, U64, Roller, freeing, keep, keyed_texts, mix, packed, row_ranges, text_bytes, word_bounds

# Units of measure and money.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l ms s sec seconds min minutes h hr hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters "
    "litre litres percent dollar dollars cent cents euro euros degree degrees"
).split()
BITS = 1 << 23
NUMBER, UNIT, NAME = U64(1), U64(2), U64(3)

_LETTER, _DIGIT, _UPPER, _SMALL, _STOP = (np.zeros(256, bool) for _ in range(5))
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_SMALL[97:123] = _SMALL[128:] = True
_STOP[[*b".!?:"]] = True
_KEPT = _LETTER | _DIGIT


def _small_letters() -> np.ndarray:
    """Small letter of each character up to U+FFFF that has one of as many bytes."""
    out = np.arange(1 << 16)
    for c in range(128, 1 << 16):
        low = chr(c).lower()
        if len(low) == 1 and (c < 0x800) == (ord(low) < 0x800) and 127 < ord(low) < 1 << 16:
            out[c] = ord(low)
    return out


_SMALL_LETTERS = _small_letters()


def folded(b: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of whole texts with small letters for capitals."""
    out = LOWER[b]
    at = np.flatnonzero((b >= 0xC2) & (b < 0xE0))
    c = _SMALL_LETTERS[(b[at].astype(np.int64) & 31) << 6 | b[at + 1] & 63]
    out[at], out[at + 1] = 0xC0 | c >> 6, 0x80 | c & 63
    at = np.flatnonzero((b >= 0xE0) & (b < 0xF0))
    c = _SMALL_LETTERS[(b[at].astype(np.int64) & 15) << 12 | (b[at + 1].astype(np.int64) & 63) << 6 | b[at + 2] & 63]
    out[at], out[at + 1], out[at + 2] = 0xE0 | c >> 12, 0x80 | c >> 6 & 63, 0x80 | c & 63
    return out


def _unit_names() -> np.ndarray:
    out = []
    for u in UNITS:
        b = np.frombuffer(u.encode(), np.uint8)
        out.append(mix(Roller(BYTE_CODE[b]).of(np.array([0]), np.array([len(b)])))[0])
    return np.sort(np.array(out, U64))


def _split_spaceless(b, starts, ends, rel):
    """Words, and the first of each row, with the characters of scripts without spaces as words of their own."""
    after = np.append(b[1:], np.uint8(0))
    lone = (b >= 0xE3) & (b <= 0xE9) | (b == 0xEF) & (after >= 0xBC) & (after <= 0xBE) | (b == 0xF0) & (after >= 0xA0) & (after <= 0xB3)
    lone |= (b == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (b == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
    at = np.flatnonzero(lone)
    if not len(at):
        return starts, ends, np.searchsorted(starts, rel)
    past = at + np.where(b[at] == 0xF0, 4, 3)
    cut = np.unique(np.concatenate([starts, at, past[past < ends[np.searchsorted(starts, at, "right") - 1]]]))
    ends = np.minimum(np.append(cut[1:], len(b)), ends[np.searchsorted(starts, cut, "right") - 1])
    return cut, ends, np.searchsorted(cut, rel)


def templates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template codes, those with possible names as names, word names, first of each row + total); words without letters and digits are left out."""
    starts, ends, first = word_bounds(raw, offsets)
    b = raw[int(offsets[0]):int(offsets[-1])]
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64), first
    starts, ends, first = _split_spaceless(b, starts, ends, offsets - int(offsets[0]))

    def count(table):
        sums = np.zeros(len(b) + 1, np.int32)
        np.cumsum(table[b], out=sums[1:])
        return sums[ends] - sums[starts]

    name = mix(Roller(BYTE_CODE[folded(b)], _KEPT[b]).of(starts, ends))
    kept, digits, upper, small = count(_KEPT), count(_DIGIT), count(_UPPER), count(_SMALL)
    stop = _STOP[b[ends - 1]]
    begins = np.zeros(len(starts), bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    fresh = begins.copy()
    fresh[1:] |= stop[:-1]
    use = kept > 0
    number = (digits == kept) & use
    units = _unit_names()
    at = np.minimum(np.searchsorted(units, name), len(units) - 1)
    unit = units[at] == name
    unit[1:] &= number[:-1] & ~begins[1:]
    unit[:1] = False
    proper = (upper == 1) & (small > 0) & (small + upper == kept) & _UPPER[b[starts]]
    code, wide = (np.where(number, NUMBER, np.where(unit, UNIT, np.where(x, NAME, name | U64(8)))) for x in (proper & ~fresh, proper))
    before = np.concatenate([[0], np.cumsum(use)])
    return code[use], wide[use], name[use], before[first]


def windows(raw: np.ndarray, offsets: np.ndarray, sizes: list[int], own: bool = False):
    """(word names, first of each row + total) and (size, template codes or None, window names, first words) of windows that take part.

    With ``own`` a row has only windows of the largest size, or one of its own length.
    """
    code, wide, name, first = templates(raw, offsets)
    n = len(code)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)      # words to the end of the row
    length = np.repeat(np.diff(first), np.diff(first))
    out = []
    for kind, codes in (("exact", name | U64(8)), ("template", code), ("names", wide)):
        total, slots, other = np.zeros(n, U64), np.zeros(n, np.int16), np.zeros(n, bool)
        for k in range(max(sizes, default=0)):
            m = max(n - k, 0)
            total[:m] = mix(total[:m] + codes[k:] * U64(0xD6E8FEB86659FD93))
            slots[:m] += codes[k:] <= NAME
            other[:m] |= codes[k:] != code[k:]
            if k + 1 in sizes:
                fits = left > k
                if own:
                    fits &= np.minimum(length, max(sizes)) == k + 1
                if kind != "exact":
                    fits &= (slots > 0) & (slots * 2 <= k + 1)
                if kind == "names":
                    fits &= other
                at = np.flatnonzero(fits)
                out.append((k + 1, None if kind == "exact" else codes, total[at], at))
    return name, first, out


def _window_rows(texts: DataFrame, sizes: list[int], bits, key: str) -> DataFrame:
    """(name, key, text key, place, length, values) of windows, values null for exact words; with ``bits`` only those set in the table."""
    longest = max(sizes, default=0)

    def run(batches):
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, offsets = text_bytes(batch.column("text"))
                for a, b in row_ranges(offsets):
                    name, first, found = windows(raw, offsets[a:b + 1], sizes, own=bits is None)
                    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    for size, codes, total, at in found:
                        if table is not None:
                            bit = (total % U64(BITS)).astype(np.int64)
                            hit = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                            total, at = total[hit], at[hit]
                        if codes is None and bits is not None and size < longest:      # an item of few words is met once or not at all
                            once = np.unique(np.stack([rows[at].astype(U64), total]), axis=1, return_index=True)[1]
                            total, at = total[once], at[once]
                        row = rows[at]
                        keys, texts_of = (batch.column(c).slice(a, b - a).take(pa.array(row)) for c in ("doc_id", "text_key"))
                        # The slots' values of a window; ordinary words answer each other by the name of the window.
                        kept = None if codes is None else np.where(codes <= NAME, name, U64(0))
                        values = [None] * len(at) if codes is None else [packed(kept[i:i + size]) for i in at.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(total.view(np.int64)), keys, texts_of, pa.array(at - first[row], pa.int32()), pa.array(np.diff(first)[row], pa.int32()),
                             pa.array(values, pa.binary())], names=["name", key, f"{key}_text", "place", "length", "values"])

    # Texts of one id are told apart by their hash.
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    return texts.mapInArrow(freeing(run), f"name long, {key} long, {key}_text long, place int, length int, values binary")


def _bit_table(items: DataFrame) -> bytes:
    def run(batches):
        table = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            bit = (batch.column("name").to_numpy().view(U64) % U64(BITS)).astype(np.int64)
            np.bitwise_or.at(table, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["table"])

    out = np.zeros(BITS // 8, np.uint8)
    for r in items.select("name").coalesce(8).mapInArrow(freeing(run), "table binary").toLocalIterator():
        out |= np.frombuffer(r.table, np.uint8)
    return out.tobytes()


def answering(pairs: list[tuple[int, int]], strict: bool = False) -> bool:
    """Whether all but one, or more than half, of the pairs of differing slot values answer each other one to one; all if ``strict``."""
    there, back = {}, {}
    for (x, y), n in Counter(p for p in pairs if p[0] != p[1]).items():
        there.setdefault(x, []).append(n)
        back.setdefault(y, []).append(n)
    total = sum(map(sum, there.values()))
    # Of the answers to a value the commonest is right.
    clashes = total - min(sum(map(max, there.values())), sum(map(max, back.values())))
    return clashes == 0 if strict else clashes <= 1 or clashes * 2 < total


def segments(place: np.ndarray, item_place: np.ndarray, size: int):
    """(segment of each window, place, item place and words of each segment): windows on one diagonal without a gap."""
    order = np.lexsort((place, place - item_place))
    at, on = place[order], (place - item_place)[order]
    new = np.ones(len(at), bool)
    new[1:] = (on[1:] != on[:-1]) | (at[1:] > at[:-1] + size)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, item, words = at[first], (at - on)[first], at[last] + size - at[first]
    by_place = np.lexsort((item, start))
    rank = np.empty(len(first), np.int64)
    rank[by_place] = np.arange(len(first))
    of = np.empty(len(at), np.int64)
    of[order] = rank[np.cumsum(new) - 1]
    return of, start[by_place], item[by_place], words[by_place]


def chains(start: np.ndarray, item: np.ndarray, words: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(words covered, segment before or -1) of the best chain that ends with each segment; no word counts twice."""
    total, before, head = words.copy(), np.full(len(start), -1), start.copy()
    end, item_end = start + words, item + words
    reach = near + int(words.max())
    for t in range(1, len(start)):
        s = np.arange(np.searchsorted(start, start[t] - reach), t)
        s = s[(start[s] < start[t]) & (item[s] < item[t]) & (end[s] < end[t]) & (item_end[s] < item_end[t]) & (start[t] - end[s] <= near)]
        if len(s):
            gain = total[s] - np.maximum(0, np.maximum(end[s] - start[t], item_end[s] - item[t]))
            k = np.lexsort((head[s], gain))[-1]       # the shortest of equal ones
            if gain[k] > 0:
                total[t], before[t], head[t] = words[t] + gain[k], s[k], head[s[k]]
    return total, before


def passage(place: np.ndarray, item_place: np.ndarray, values: list, item_values: list, length: int, size: int, cover: float) -> tuple[float, bool]:
    """(cover, whether a slot's value differs) of the consistent passage that covers most of an item of ``length`` words."""
    exact = np.array([x is None or y is None for x, y in zip(values, item_values)])
    best, differs = 0, False
    if exact.any():
        best = int(chains(*segments(place[exact], item_place[exact], size)[1:], length)[0].max())
    if not exact.all():
        of, start, item, words = segments(place, item_place, size)
        slotted = np.flatnonzero(~exact)

        def slots(chosen: np.ndarray) -> list[tuple[int, int]]:
            """Slot values of the windows of these segments, one pair for each place."""
            out = {}
            for w in slotted[np.isin(of[slotted], chosen)].tolist():
                for k, pair in enumerate(zip(np.frombuffer(values[w], U64).tolist(), np.frombuffer(item_values[w], U64).tolist())):
                    if pair != (0, 0):
                        out[int(place[w]) + k] = pair
            return list(out.values())

        total, before = chains(start, item, words, length)
        tries = []
        for t in np.flatnonzero((total > best) & (total >= cover * length)).tolist():
            chosen, k = [], t
            while k >= 0:
                chosen.append(k)
                k = int(before[k])
            tries.append((int(total[t]), chosen, t not in before))
        diagonals, which = np.unique(start - item, return_inverse=True)
        alone = np.bincount(which, words).astype(int)
        tries += [(int(alone[d]), np.flatnonzero(which == d), True) for d in np.flatnonzero((alone > best) & (alone >= cover * length)).tolist()]
        for words_covered, chosen, whole in sorted(tries, key=lambda x: -x[0]):
            pairs = slots(chosen)
            if answering(pairs, strict=not whole):
                best, differs = words_covered, any(x != y for x, y in pairs)
                break
    return best / length, differs


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, cover: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cover, reparameterised): contaminated pairs of documents and items."""
    spark = docs.sparkSession
    items = keep(_window_rows(keyed_texts(benchmark, item_col, item_text_col), list(range(1, window + 1)), None, "item_id").distinct())
    bits = spark.sparkContext.broadcast(_bit_table(items))
    # At most ``window`` lengths.
    sizes = sorted(r[0] for r in items.select(F.least("length", F.lit(window))).distinct().collect())
    found = _window_rows(keyed_texts(docs, id_col, text_col).where(F.octet_length("text") > 0), sizes, bits, "doc_id")
    theirs = items.select("name", "item_id", "item_id_text", F.col("place").alias("item_place"), F.col("length").alias("item_length"), F.col("values").alias("item_values"))
    met = (found.join(theirs, "name").groupBy("doc_id", "doc_id_text", "item_id", "item_id_text", "item_length")
           .agg(F.collect_set(F.struct("place", "item_place", "values", "item_values")).alias("windows")))

    def run(batches):
        for batch in batches:
            covered, differs = [], []
            lists = batch.column("windows")
            bounds = lists.offsets.to_numpy()
            place, item_place, values, item_values = lists.flatten().flatten()
            place, item_place = (x.to_numpy().astype(np.int64) for x in (place, item_place))
            for a, b, length in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], batch.column("item_length").to_pylist()):
                got, other = passage(place[a:b], item_place[a:b], values.slice(a, b - a).to_pylist(), item_values.slice(a, b - a).to_pylist(),
                                     length, min(window, length), cover)
                covered.append(got)
                differs.append(other)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(covered, pa.float64()), pa.array(differs, pa.bool_())],
                                             names=["doc_id", "item_id", "cover", "reparameterised"])

    return (met.mapInArrow(freeing(run), "doc_id long, item_id long, cover double, reparameterised boolean").where(F.col("cover") >= cover)
            .groupBy("doc_id", "item_id").agg(F.max_by("reparameterised", "cover").alias("reparameterised"), F.max("cover").alias("cover")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, cover: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, item_ids, best_cover, reparameterised) of every row of ``docs``."""
    found = matches(docs, benchmark, window, cover, id_col, text_col, item_col, item_text_col)
    by_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("cover").alias("best_cover"),
                                         F.bool_or("reparameterised").alias("reparameterised"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return (ids.alias("d").join(by_doc.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left")
            .select("d.doc_id", F.col("m.item_ids").isNotNull().alias("contaminated"),
                    F.coalesce("m.item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("m.best_cover", F.lit(0.0)).alias("best_cover"),
                    F.coalesce("m.reparameterised", F.lit(False)).alias("reparameterised")))

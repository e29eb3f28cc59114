"""Personal data by fixed patterns and a linear-chain conditional random field.

Method: a CRF over word-shape features labels words as outside, beginning or
inside of an email address, IP address, card number or telephone number.  It
is trained here, by gradient ascent on the exact conditional likelihood, from
a small labelled table (``labelled_table``, ``rows`` of it, generated by rule).
Words without a digit, ``@`` or ``+`` can only be outside; this holds in
training too, so the best path splits exactly at such words and only the
stretches between them are decoded, by Viterbi over a numpy batch of stretches
at a time.  Spans that the patterns of the contract find always stay; the CRF
adds spans that overlap none of them.

Edge cases: a null or empty text has no spans; rows are independent, so
repeated rows give repeated results and an empty table an empty one; a null id
stays null; other columns are not read.  Whole texts are read; every pattern
takes time in proportion to the text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectriage.llm.common import freeing, keyed_texts, row_ranges, text_bytes, word_bounds

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES = 512
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,source:string>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Sentences of the labelled table; capitals stand for generated values, labelled ones in KINDS' names.
TEMPLATES = (
    "write to EMAIL for details", "mail EMAIL , or call PHONE", "my address is EMAIL .", "contact: EMAIL", "the PHONE line is open",
    "ring PHONE after NUM", "tel PHONE fax PHONE", "PHONE", "EMAIL", "IP", "CARD", "host IP answered in NUM ms", "from IP to IP",
    "ping IP , then IP again", "paid with CARD on DATE", "card CARD exp MONTH", "CARD was declined", "charge CARD or CARD", "order NUM of DATE",
    "version VERSION was out in YEAR", "the year YEAR", "at TIME on DATE", "costs PRICE or PRICE", "password=KEY", "token KEY here", "id \"KEY\"",
    "section VERSION of NUM", "rows NUM to NUM", "NUM + NUM = NUM", "a WORD9 and WORD9", "about NUM% of YEAR", "in YEAR , NUM people came",
    "KEY KEY", "EMAIL PHONE CARD", "IP EMAIL", "CARD IP", "see page NUM", "score NUM-NUM", "@handle said NUM", "room NUM at TIME",
)


class _Values:
    """Deterministic generator of example values."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.rng.integers(0, 10, n))

    def letters(self, n: int) -> str:
        return "".join(chr(97 + c) for c in self.rng.integers(0, 26, n))

    def pick(self, *options: str) -> str:
        return options[int(self.rng.integers(0, len(options)))]

    def make(self, kind: str) -> str:
        d, w, n = self.digits, self.letters, lambda a, b: int(self.rng.integers(a, b))
        dots = lambda: ".".join(str(n(1, 256)) for _ in range(4))
        return {
            "EMAIL": lambda: self.pick(f"{w(n(3, 8))}.{d(2)}@{w(5)}{d(1)}.{w(7)}.com", f"{w(n(3, 9))}@{w(6)}.org", f"{w(4)}_{w(5)}@{w(4)}-{w(3)}.net",
                                       f"{w(3)}+{w(3)}@{w(5)}.co", f"{w(5)}{d(2)}@{w(6)}.io"),
            "IP": dots,
            "CARD": lambda: self.pick("4" + d(15), "5" + d(15), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"3{d(3)} {d(6)} {d(5)}"),
            "PHONE": lambda: self.pick(f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}",
                                       f"+{d(11)}", f"+{d(2)}-{d(3)}-{d(4)}-{d(3)}"),
            "NUM": lambda: d(n(1, 7)), "YEAR": lambda: self.pick("19", "20") + d(2), "DATE": lambda: self.pick(f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}"),
            "MONTH": lambda: f"{d(2)}/{d(2)}", "TIME": lambda: f"{d(2)}:{d(2)}", "PRICE": lambda: self.pick(f"${d(2)}.{d(2)}", f"{d(3)},{d(2)}"),
            "VERSION": lambda: ".".join(d(n(1, 3)) for _ in range(n(2, 4))), "WORD9": lambda: w(n(2, 6)) + d(n(1, 4)),
            "KEY": lambda: "".join(self.pick(d(1), w(1), w(1).upper()) for _ in range(n(14, 40))),
        }[kind]()


def labelled_table(spark: SparkSession, rows: int = 400) -> DataFrame:
    """(row_id, words, labels): the small training table, made by rule."""
    made = []
    for i in range(rows):
        values, words, labels = _Values(i), [], []
        for part in TEMPLATES[i % len(TEMPLATES)].split(" "):
            m = re.search(r"[A-Z]{2,}9?", part)
            if not m:
                words.append(part)
                labels.append("O")
                continue
            value = values.make(m.group())
            kind = m.group().lower()
            own = (part[:m.start()] + value + part[m.end():]).split(" ")
            words += own
            labels += [f"{'I' if k else 'B'}-{kind}" if kind in KINDS else "O" for k in range(len(own))]
        made.append((i, words, labels))
    return spark.createDataFrame(made, "row_id long, words array<string>, labels array<string>")


def may_hold(word: str) -> bool:
    return any(c in "@+" or "0" <= c <= "9" for c in word)


def shape_of(word: str) -> str:
    return "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word[:80])


def shape_features(shape: str) -> list[int]:
    """Hashed word-shape features."""
    core = shape.strip(".,;:!?\"'[]<>")
    groups = [len(g) for g in re.findall("9+", core)]
    short = re.sub("a+", "a", re.sub("9+", "9", core))
    digits = sum(groups)
    names = [f"shape={short}", f"digits={min(digits, 20)}", f"groups={min(len(groups), 6)}", f"longest={min(max(groups, default=0), 17)}",
             f"first={core[:1]}", f"last={core[-1:]}", f"letters={'a' in core}", f"at={'@' in core[1:-1]}", f"dot_after_at={'.' in core.partition('@')[2]}",
             f"plain={core.isalnum()}", f"size={groups if len(groups) < 5 and 'a' not in core else 0}", "bias"]
    return sorted({zlib.crc32(n.encode()) % FEATURES for n in names})


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train_crf(table: DataFrame, steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> dict:
    """Weights of the CRF, fitted on the whole (small) table by Adam on exact gradients."""
    rows = table.orderBy("row_id").select("words", "labels").collect()
    n, longest, k = len(rows), max(len(r.words) for r in rows), len(LABELS)
    y = np.zeros((n, longest), np.int64)
    free, mask = np.zeros((n, longest), bool), np.zeros((n, longest), bool)
    for i, r in enumerate(rows):
        for t, (w, label) in enumerate(zip(r.words, r.labels)):
            mask[i, t], free[i, t], y[i, t] = True, may_hold(w), LABELS.index(label)
    x = np.zeros((int(free.sum()), FEATURES))         # rows in the order of free[...]
    shapes = [shape_features(shape_of(w)) for r in rows for w in r.words if may_hold(w)]
    for i, features in enumerate(shapes):
        x[i, features] = 1
    onehot = np.eye(k)[y] * mask[..., None]
    closed = np.where(free[..., None] | (np.arange(k) == 0), 0.0, -1e4)
    w = {"emit": np.zeros((FEATURES, k)), "step": np.zeros((k, k)), "first": np.zeros(k), "end": np.zeros(k)}
    mean, var = ({a: np.zeros_like(b) for a, b in w.items()} for _ in range(2))
    length = mask.sum(1)
    for step in range(1, steps + 1):
        e = closed.copy()
        e[free] += x @ w["emit"]
        fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fwd[:, 0] = w["first"] + e[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(mask[:, t, None], _logsum(fwd[:, t - 1, :, None] + w["step"], 1) + e[:, t], fwd[:, t - 1])
        z = _logsum(fwd[:, -1] + w["end"], 1)
        bwd[:, -1] = w["end"]
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(mask[:, t + 1, None], _logsum(w["step"] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), w["end"])
        single = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + w["step"] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        seen = np.einsum("ntp,ntq->pq", onehot[:, :-1], onehot[:, 1:])
        last = np.arange(n), length - 1
        grad = {"emit": x.T @ (onehot - single)[free], "step": seen - pair.sum((0, 1)),
                "first": (onehot[:, 0] - single[:, 0]).sum(0), "end": (onehot[last] - single[last]).sum(0)}
        for a in w:
            g = grad[a] / n - l2 * w[a]
            mean[a] = 0.9 * mean[a] + 0.1 * g
            var[a] = 0.99 * var[a] + 0.01 * g * g
            w[a] += rate * (mean[a] / (1 - 0.9 ** step)) / (np.sqrt(var[a] / (1 - 0.99 ** step)) + 1e-8)
    return w


def viterbi(emit: np.ndarray, length: np.ndarray, model: dict, at_start: np.ndarray, at_end: np.ndarray) -> np.ndarray:
    """Best labels of a batch of stretches (batch, time, label); beyond a stretch stands an outside word or the text's edge."""
    n, longest, k = emit.shape
    back = np.zeros((n, longest, k), np.int8)
    score = np.where(at_start[:, None], model["first"], model["step"][0]) + emit[:, 0]
    for t in range(1, longest):
        ways = score[:, :, None] + model["step"]
        back[:, t] = np.where((t < length)[:, None], ways.argmax(1), np.arange(k))
        score = np.where((t < length)[:, None], ways.max(1) + emit[:, t], score)
    best = (score + np.where(at_end[:, None], model["end"], model["step"][:, 0])).argmax(1)
    out = np.zeros((n, longest), np.int64)
    for t in range(longest - 1, -1, -1):
        out[:, t] = best
        best = back[np.arange(n), t, best]
    return out


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; leftmost, non-overlapping within a kind."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                last = m.end()
                out.append((start, 0, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Tagger:
    """Adds CRF spans for the texts of an Arrow column."""

    def __init__(self, model: dict, batch: int = 4096):
        self.model, self.batch, self.rows = model, batch, {}
        self.flag = np.zeros(256, bool)
        self.flag[[*b"0123456789@+"]] = True

    def emission(self, shape: str) -> np.ndarray:
        got = self.rows.get(shape)
        if got is None:
            if len(self.rows) > 50_000:
                self.rows.clear()
            got = self.rows[shape] = self.model["emit"][shape_features(shape)].sum(0)
        return got

    def stretches(self, raw: np.ndarray, offsets: np.ndarray) -> list:
        """(row, first word, [(start, end) bytes in the row], at start, at end) of maximal runs of words that may hold data."""
        starts, ends, first = word_bounds(raw, offsets)
        base = int(offsets[0])
        hit = np.flatnonzero(self.flag[raw[base:int(offsets[-1])]])
        words = np.unique(np.searchsorted(starts, hit, "right") - 1)
        if not len(words):
            return []
        rows = np.searchsorted(first, words, "right") - 1
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1] + 1) | (rows[1:] != rows[:-1])
        at = np.append(np.flatnonzero(new), len(words))
        out = []
        for a, b in zip(at[:-1], at[1:]):
            r, shift = int(rows[a]), int(offsets[rows[a]]) - base
            out.append((r, [(int(starts[w]) - shift, int(ends[w]) - shift) for w in words[a:b]],
                        words[a] == first[r], words[b - 1] == first[r + 1] - 1))
        return out

    def decode(self, found: list, texts: list) -> list[tuple[int, int, int, int]]:
        """(row, start byte, end byte, kind) of the labelled words of some stretches."""
        out = []
        found = sorted(found, key=lambda s: len(s[1]))
        for lo in range(0, len(found), self.batch):
            # long stretches make smaller batches
            part = found[lo:lo + self.batch]
            limit = max(1, 400_000 // len(part[-1][1]))
            for a in range(0, len(part), limit):
                some = part[a:a + limit]
                length = np.array([len(s[1]) for s in some])
                emit = np.zeros((len(some), length.max(), len(LABELS)))
                for i, (row, words, _, _) in enumerate(some):
                    for t, (s, e) in enumerate(words):
                        emit[i, t] = self.emission(shape_of(texts[row][s:e].decode()))
                best = viterbi(emit, length, self.model, np.array([s[2] for s in some]), np.array([s[3] for s in some]))
                for i, (row, words, _, _) in enumerate(some):
                    open_kind = None
                    for t, (s, e) in enumerate(words):
                        label = int(best[i, t])
                        kind = (label - 1) // 2 if label else None
                        if label and label % 2 == 0 and open_kind == kind:
                            out[-1] = (row, out[-1][1], e, kind)
                        elif label:
                            out.append((row, s, e, kind))
                        open_kind = kind
        return out


def _trimmed(text: bytes, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start:start + 1] in b".,;:!?\"'[]<>=":
        start += 1
    while start < end and text[end - 1:end] in b".,;:!?\"'[]<>=":
        end -= 1
    return start, end


def _spans_of(column, tagger: Tagger) -> list[list[dict]]:
    """Spans of every text of an Arrow column, in code points, by start and kind."""
    raw, offsets = text_bytes(column)
    spans = [[] for _ in range(len(column))]
    for a, b in row_ranges(offsets):
        found = tagger.stretches(raw, offsets[a:b + 1])
        texts = {r: raw[int(offsets[a + r]):int(offsets[a + r + 1])].tobytes() for r in {s[0] for s in found}}
        added: dict[int, list] = {}
        for r, s, e, kind in tagger.decode(found, texts):
            added.setdefault(r, []).append((*_trimmed(texts[r], s, e), kind))
        for r, own in texts.items():
            base = base_spans(own.decode())
            more, at, done = [], 0, 0
            reach = np.maximum.accumulate([e for _, _, e in base]) if base else np.zeros(0)
            starts = [s for s, _, _ in base]
            for s, e, kind in sorted(added.get(r, [])):
                s, done, at = done + len(own[at:s].decode()), done + len(own[at:e].decode()), e
                before = np.searchsorted(starts, done, "left") - 1      # base spans that start before this one ends
                if s < done and (before < 0 or reach[before] <= s):
                    more.append((s, kind, done))
            spans[a + r] = [{"kind": KINDS[k], "start": s, "end": e, "source": src} for s, k, e, src in
                            sorted([(*x, "base") for x in base] + [(*x, "crf") for x in more])]
    return spans


def _shared_model(spark: SparkSession, model: dict | None):
    return spark.sparkContext.broadcast(model or train_crf(labelled_table(spark)))


def find_pii(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): every row with its spans in code points, by start and kind; source: base or crf."""
    shared = _shared_model(docs.sparkSession, model)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source", pa.string())]))

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(_spans_of(batch.column("text"), tagger), kind_type)],
                                             names=["doc_id", "text", "spans"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(freeing(run), f"doc_id long, text string, spans {SPAN_TYPE}")


def span_list(spans, wanted=None):
    """``kind:start:end`` of the spans, comma-joined."""
    use = F.filter(spans, wanted) if wanted else spans
    return F.array_join(F.transform(use, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def pii_digest(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Counts of the fixed patterns, a digest of their spans, and all spans."""
    base = lambda x: x["source"] == "base"

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: base(x) & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return find_pii(docs, model).select(
        "doc_id", *map(count, KINDS),
        F.sha2(span_list(F.col("spans"), base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def redacted(text: str | None, spans: list[dict]) -> str | None:
    """Text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text or not spans:
        return text
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))):
        if s["start"] >= last:
            out += [text[last:s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["end"])
    return "".join(out) + text[last:]


def redact(docs: DataFrame, model: dict | None = None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with all spans of the text column redacted."""
    shared = _shared_model(docs.sparkSession, model)

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [redacted(t.as_py(), s) if s else t.as_py() for t, s in zip(batch.column(at), _spans_of(batch.column(at), tagger))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(freeing(run), docs.schema)

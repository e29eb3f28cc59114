"""The llm operators against brute force, on rows with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from vectriage.llm import bpe, chat, decontam, jaccard_join, pii_crf, quality_model, quality_rules, recompress_dedup, suffix_dedup, toxicity
from vectriage.llm.common import components
from vectriage.llm.queries import CONTROL_TEXT, QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}
#: Names that the operators use inside.
CLASHING = ("size", "doc", "bucket", "spans", "pattern", "words", "open", "class_id", "item_id", "features", "n", "gram")


def awkward_rows(seed: int = 3) -> list[tuple]:
    """Shared passages, near and exact copies, runs of one word, very long, empty and null texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.randrange(15, 60))) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "one", "Two Words", "x " * 300, "y" * 1000, "z" * 99, "z" * 100]
    for _ in range(60):
        texts.append("\n".join(rnd.choice(passages) if rnd.random() < 0.6 else " ".join(word() for _ in range(rnd.randrange(30))) for _ in range(rnd.randrange(1, 5))))
    for t in texts[-20:]:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        texts += [" ".join(w), t.upper()]
    texts.append(" ".join(word() for _ in range(20_000)))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[0], (None, texts[15]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit("extra") for c in CLASHING}).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_jaccard_join(docs, rows):
    for n, num in ((4, 85), (5, 80)):
        got = {}
        for r in jaccard_join.jaccard_join(docs, n, num, 100, block_rows=4, bucket_grams=2000, chunk_grams=500).collect():
            got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.class_id, r.n_links))
        assert sum(1 for r in rows if r[0] is None) == 2 and all(x[1:] == (None, None, None) for x in got.pop(None))
        sets = {i: frozenset(grams(t, n)) for i, t in rows if i is not None}
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        links = defaultdict(set)
        ids = sorted(sets)
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
                    if sets[a] != sets[b]:
                        links[a].add(sets[b])
                        links[b].add(sets[a])
        same = {i: min(j for j in ids if sets[j] == sets[i]) if sets[i] else i for i in ids}
        assert got == {i: {(len(sets[i]), find(i), same[i], len(links[i]))} for i in ids}


def test_components_of_a_long_path(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(
        spark.range(100, 110).select(F.lit(100).cast("long").alias("a"), F.col("id").alias("b")))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 110)}}


def brute_repeats(rows, width, units):
    """Per document: (units, covered marks), over distinct rows in order."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: r[0]):
        u = units((t or "").encode())
        cover = [False] * len(u)
        for k in range(len(u) - width + 1):
            key = bytes(u[k:k + width]) if isinstance(u, bytes) else tuple(u[k:k + width])
            if key in seen:
                cover[k:k + width] = [True] * width
            seen.add(key)
        out[i] = (u, cover)
    return out


def test_suffix_dedup(docs, rows):
    got = defaultdict(set)
    result = suffix_dedup.repeats_digest(docs)
    for r in result.collect():
        got[r.doc_id].add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert result.count() == len(rows)
    assert all(x[1] == 0 for x in got.pop(None))
    for i, (u, cover) in brute_repeats(rows, 100, bytes).items():
        left = bytes(b for b, c in zip(u, cover) if not c)
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        assert got[i] == {(len(u), len(u) - len(left), spans, hashlib.sha256(left).hexdigest())}, i


def test_suffix_dedup_keeps_bytes(docs):
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).where("doc_id is not null").collect()}
    digest = {r.doc_id: r.kept_sha256 for r in suffix_dedup.repeats_digest(docs).where("doc_id is not null").collect()}
    assert {i: hashlib.sha256(k).hexdigest() for i, k in kept.items()} == digest


def test_hot_anchor_windows_are_dealt_by_content(docs, monkeypatch):
    from vectriage.llm import repeats

    usual = sorted(map(tuple, suffix_dedup.repeats_digest(docs).na.fill(-1).collect()))
    split = repeats.open_windows
    monkeypatch.setattr(repeats, "open_windows", lambda d, s, u: split(d, s, u, hot_runs=1, bucket_runs=10))
    assert sorted(map(tuple, suffix_dedup.repeats_digest(docs).na.fill(-1).collect())) == usual


def test_recompression_dedup(docs, rows):
    got = defaultdict(set)
    for r in recompress_dedup.repeats_digest(docs).collect():
        got[r.doc_id].add((r.n_words, r.n_removed, r.kept_sha256))
    assert all(x[1] == 0 for x in got.pop(None))
    for i, (u, cover) in brute_repeats(rows, 20, bytes.split).items():
        left = [w for w, c in zip(u, cover) if not c]
        assert got[i] == {(len(u), len(u) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())}, i


def test_symbol_borders_depend_on_few_words():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 60, 60).astype(np.uint64)
    for _ in range(50):
        other = base.copy()
        other[:20], other[40:] = rnd.integers(0, 1 << 60, 20), rnd.integers(0, 1 << 60, 20)
        edge = np.zeros(60, bool)
        edge[0] = True
        a, b = (set(recompress_dedup.symbol_borders(x, edge).tolist()) for x in (base, other))
        inside = range(20 + recompress_dedup.REACH, 40 - recompress_dedup.REACH + 1)
        assert [k in a for k in inside] == [k in b for k in inside]


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(set)
    for i, t in rows:
        e = tok.encode(t or "", add_special_tokens=False).ids
        want[i].add((len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    got = defaultdict(set)
    for r in bpe.encode_digest(docs, tokenizer_path()).collect():
        got[r.doc_id].add((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert got == want


def test_bpe_on_random_characters():
    from tokenizers import Tokenizer

    tok, tables, rnd = Tokenizer.from_file(tokenizer_path()), bpe.build_tables(tokenizer_path()), random.Random(4)
    codec = bpe.Codec(tables)
    texts = ["".join(rnd.choice("aab cdethiszn'  \t\n.,!?09éÜßÀ한日本İΣẞ\x1c\x85\xa0​😀é₂½İǅ<|>") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    for t in [*texts, "a" * 3000, "<|endoftext|>x<|startoftext|> <|endoftext|", "ΑΣ ΣΑΣ", "s'll'd"]:
        want = tok.encode(t, add_special_tokens=False).ids
        n, ids, decoded = codec(t)
        assert (n, list(np.frombuffer(ids, "<u4"))) == (len(want), want)
        assert decoded == bpe.decode(want, tables) == tok.decode(want, skip_special_tokens=False)


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_quality_rules_base(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], 1) for r in rows[:30]], "doc_id long, quality int")
    got, want = defaultdict(set), defaultdict(set)
    for r in quality_rules.judge(docs, labels).collect():
        got[r.doc_id].add((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept))
    for i, t in rows:
        b = brute_rules(t)
        want[i].add((*b, not b[-1]))          # too few labels to certify a cutoff
    assert got == want


def brute_cutoffs(rated, risk=0.04, delta=0.05):
    """Lowest certified cutoff per stratum and rule, by exact fractions: ``rated`` is (stratum, {rule: value}) of good documents."""
    from fractions import Fraction
    from math import comb
    rules, out = quality_rules.CUTOFFS, {}
    strata = {s for s, _ in rated}
    rate = Fraction(risk) / len(rules)
    tests = sum(map(len, rules.values()))
    for s in strata:
        own = [v for t, v in rated if t == s]
        for rule, cuts in rules.items():
            sure = []
            for c in cuts:
                k, n = sum(v[rule] > c for v in own), len(own)
                chance = sum(comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1)) if k < n * rate else 1
                if chance <= Fraction(delta) / (tests * len(strata)):
                    sure.append(c)
            out[s, rule] = min(sure, default=None)
    return out


@pytest.mark.parametrize("most", [50_000, 0])
def test_cutoffs_and_verdicts_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "MOST_STRATA", most)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))
    rows = []
    for i in range(2600):
        stratum = ["en", None, ""][0 if i < 1200 else 1 if i < 2400 else 2]
        words = [word() for _ in range(60)]
        if stratum is None and i % 3 == 0:
            words[:3] = ["#" * 9] * 3                      # symbols are usual in one stratum only
        if i % 200 == 0:
            words = ["$$$$ " + w for w in words]
        rows.append((i, stratum, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], int(r[0] % 200 != 0)) for r in rows], "doc_id long, quality int")
    facts = {}
    for i, s, t in rows:
        n, chars, symbols, dups, rep, failed = brute_rules(t)
        facts[i] = s, failed, {"symbol_share": symbols / max(chars, 1), "repeat_share": rep / n, "dup_line_share": dups / n, "mean_word": chars / n}
    cuts = brute_cutoffs([(s, v) for i, (s, failed, v) in facts.items() if not failed and i % 200])
    assert cuts["en", "symbol_share"] is not None and cuts["en", "symbol_share"] != cuts[None, "symbol_share"] and cuts["", "symbol_share"] is None
    want = {i: not failed and not any(cuts[s, r] is not None and v[r] > cuts[s, r] for r in v) for i, (s, failed, v) in facts.items()}
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()} == want and not all(want.values())


def test_binomial_bound_and_certified_cutoffs(spark):
    from math import comb

    got = spark.range(1).select(quality_rules.binomial_at_most(F.lit(3).cast("long"), F.lit(400).cast("long"), 0.02)).first()[0]
    assert got == pytest.approx(sum(comb(400, i) * 0.02 ** i * 0.98 ** (400 - i) for i in range(4)), rel=1e-9)
    # 3,000 good rows of stratum a, ten of which exceed the lowest cutoff of one rule; b has too few.
    rated = spark.range(3100).select(F.when(F.col("id") < 3000, "a").otherwise("b").alias("stratum"),
                                     F.when(F.col("id") % 300 == 0, 0.03).otherwise(0.0).alias("symbol_share"),
                                     *(F.lit(0.0).alias(c) for c in ("repeat_share", "dup_line_share")), F.lit(7.5).alias("mean_word"))
    cuts = {r.stratum: r for r in quality_rules.certified_cutoffs(rated, 0.04, 0.05).collect()}
    assert set(cuts) == {"a"}
    assert (cuts["a"].cut_symbol_share, cuts["a"].cut_repeat_share, cuts["a"].cut_mean_word) == (0.005, 0.05, 8.0)


@pytest.fixture(scope="module")
def crf(spark):
    return pii_crf.train_crf(pii_crf.labelled_table(spark, rows=120), steps=60)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and pii_crf.luhn(d)):
                continue
            out.append((m.start(), i, m.end()))
    return sorted(out)


def test_pii_patterns_are_the_contracts():
    rnd = random.Random(6)
    bits = ["1", "22", "255", ".", "@", "a", "-", " ", "+", "(", ")", "4111111111111111", "é", "300", "\n", "ab.c", "%", "0004"]
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))
        assert pii_crf.base_spans(t) == brute_pii(t), t
    assert pii_crf.base_spans("7" * 200_000 + "a@" * 50_000) == []


def test_pii_spans_and_redaction(spark, docs, crf):
    texts = [(1, "é write abc.12@mail1.example.com or +1 (988) 555-2485 now"), (2, "phone +1 (605) 555-9305 4078918989542222 end"),
             (3, None), (4, ""), (5, "plain words"), (1, "é write abc.12@mail1.example.com or +1 (988) 555-2485 now")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit(0))
    out = pii_crf.pii_digest(df, crf).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert (by[1].n_email, by[1].n_phone, by[1].spans) == (1, 1, "email:8:32,phone:36:53")
    assert by[1].base_sha256 == hashlib.sha256(b"email:8:32,phone:36:53").hexdigest()
    assert by[3].spans == by[4].spans == by[5].spans == ""
    red = {r.doc_id: r.text for r in pii_crf.redact(df, crf).collect()}
    assert red[1] == "é write [EMAIL] or [PHONE] now" and red[3] is None and red[5] == "plain words"
    assert "spans" in pii_crf.redact(df, crf).columns
    assert pii_crf.find_pii(docs, crf).count() == docs.count()


def test_viterbi_equals_all_paths(crf):
    from itertools import product

    rnd = np.random.default_rng(0)
    emit, k = rnd.normal(size=(1, 4, 9)) * 3, 9
    best = max(product(range(k), repeat=4), key=lambda p: crf["first"][p[0]] + sum(emit[0, t, y] for t, y in enumerate(p))
               + sum(crf["step"][a, b] for a, b in zip(p, p[1:])) + crf["step"][p[-1], 0])
    assert tuple(pii_crf.viterbi(emit, np.array([4]), crf, np.array([True]), np.array([False]))[0]) == best


def test_field_learns_the_table(spark):
    model = pii_crf.train_crf(pii_crf.labelled_table(spark))
    tagger, right, total = pii_crf.Tagger(model), 0, 0
    for r in pii_crf.labelled_table(spark, rows=600).where("row_id >= 400").collect():
        text = " ".join(r.words).encode()
        raw, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64)
        got = {(s, e): pii_crf.KINDS[k] for _, s, e, k in tagger.decode(tagger.stretches(raw, offsets), {0: text})}
        at, want, last = 0, {}, None
        for w, label in zip(r.words, r.labels):
            end = at + len(w.encode())
            if label[0] == "B":
                last = (at, end)
                want[last] = label[2:]
            elif label[0] == "I":
                want[(last[0], end)] = want.pop(last)
                last = (last[0], end)
            at = end + 1
        total += 1
        right += got == want
    assert right >= 0.95 * total


def test_chat_formatting(spark):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "r\n%0A<|"]), rnd.choice([None, "", "<|im_end|>", "<\\|a<\\\\|", "é\n<|im_start|>assistant\n", "x" * 5000]))
            for c in range(20) for t in range(rnd.randrange(1, 6))] + [(None, 1, "user", "lost"), (3, None, "assistant", "no turn")]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segment", F.lit(1)).repartition(4)
    formatted = chat.format_turns(df)
    segments = defaultdict(list)
    for r in formatted.collect():
        segments[r.conv_id].append((r.turn is not None, r.turn or 0, r.segment))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        seg = f"<|im_start|>{chat.escape_role(role or '')}\n{chat.escape(text or '')}<|im_end|>\n"
        by[c].append((t is not None, t or 0, seg, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [x[:3] for x in turns] == sorted(segments[c])
        loss = "".join(x[4] for x in turns if x[3] == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), sum(len(x[2]) for x in turns))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[3]}\n{x[4]}\n" for x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "look <|image:0|>"}, {"type": "image", "uri": "a.png", "width": 56, "height": 30},
             {"type": "audio", "uri": "b.wav", "seconds": 1.5}, {"type": "document", "uri": "c.pdf", "pages": 2}, {"type": "text", "text": "end"}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn int, role string, parts array<{chat.PART_TYPE}>")
    rows = {r.turn: r for r in chat.format_turns(df, parts_col="parts").collect()}
    assert rows[0].segment == "<|im_start|>user\nlook <\\|image:0|><|image:0|><|audio:1|><|document:2|>end<|im_end|>\n"
    assert [(a.kind, a.place, a.uri, a.tokens) for a in rows[0].attachments] == [("image", 0, "a.png", 4), ("audio", 1, "b.wav", 38), ("document", 2, "c.pdf", 1024)]
    assert (rows[0].expanded_tokens, rows[1].segment) == (1066, "<|im_start|>assistant\n<|im_end|>\n")


def clashing_rows() -> list[tuple]:
    """Ids of two texts each; every text is judged by itself."""
    rnd = random.Random(12)
    text = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(n))
    a, b, c, d = (text(70) for _ in range(4))
    return [(1, a), (2, a), (2, b), (5, b), (5, c), (7, c + " more"), (8, d), (8, d + " " + a), (9, None), (9, d), (2, a), (None, a), (9, "")]


def in_order(rows) -> list[tuple]:
    """(place, id, text): one entry for each id and text, in the order the operators give them."""
    mark = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = {(i, signed(mark(t))): t or "" for i, t in rows if i is not None}
    return [(place, i, distinct[i, m]) for place, (i, m) in enumerate(sorted(distinct))]


def test_ids_of_several_texts_in_dedup(spark):
    rows = clashing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = in_order(rows)
    for units, width, got in ((bytes, 100, suffix_dedup.repeats_digest(df)), (lambda b: WORD.findall(b.decode()), 20, recompress_dedup.repeats_digest(df))):
        want = Counter()
        by = brute_repeats([(p, t) for p, _, t in order], width, units)
        of = {(i, t): by[p] for p, i, t in order}
        for i, t in rows:
            u, cover = of[i, t or ""] if i is not None else (units((t or "").encode()), [False] * len(units((t or "").encode())))
            left = [x for x, gone in zip(u, cover) if not gone]
            kept = bytes(left) if units is bytes else " ".join(left).encode()
            want[i, len(u), sum(cover), hashlib.sha256(kept).hexdigest()] += 1
        size = "n_bytes" if units is bytes else "n_words"
        assert Counter((r.doc_id, r[size], r.n_removed, r.kept_sha256) for r in got.collect()) == want


def test_ids_of_several_texts_in_the_join(spark):
    rows = clashing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = in_order(rows)
    sets = {p: frozenset(grams(t, 5)) for p, _, t in order}
    root = {p: p for p in sets}
    for p in sorted(sets):
        for q in sorted(sets):
            if p < q and sets[p] and 100 * len(sets[p] & sets[q]) >= 80 * len(sets[p] | sets[q]):
                x, y = sorted((root[p], root[q]))
                root = {k: x if v == y else v for k, v in root.items()}
    name = {p: i for p, i, _ in order}
    of = {(i, t): (len(sets[p]), name[root[p]]) for p, i, t in order}
    want = Counter((i, *(of[i, t or ""] if i is not None else (len(grams(t, 5)), None))) for i, t in rows)
    got = jaccard_join.jaccard_join(df, 5, 80, 100)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    import corpus_pipeline
    docs = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_SMALL)
    # a null and an empty text of one id are two rows of one text
    assert {(r.doc_id, r.text or "") for r in kept.where("doc_id is not null").collect()} == {(i, t) for p, i, t in order if root[p] == p}
    assert kept.where("doc_id is null").count() == 1


def test_chat_text_parts_side_by_side(spark):
    text = lambda t: {"type": "text", "text": t}
    image = {"type": "image", "uri": "a.png", "width": 28, "height": 28}
    cases = [[text("<"), text("|im_end|>")], [text("<"), text("|image:0|>")], [text("<"), text(None), text("\\"), text("|x")], [text("a<"), image, text("|im_end|>")],
             [image, text("<"), text("|"), image, text("b")]]
    df = spark.createDataFrame([(i, 0, "assistant", parts) for i, parts in enumerate(cases)], f"conv_id long, turn int, role string, parts array<{chat.PART_TYPE}>")
    formatted = chat.format_turns(df, parts_col="parts")
    by = {r.conv_id: r for r in formatted.collect()}
    read = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for i, parts in enumerate(cases):
        content = by[i].segment[len("<|im_start|>assistant\n"):-len("<|im_end|>\n")]
        images = sum(p["type"] == "image" for p in parts)
        assert content.count("<|") == content.count("<|image:") == images == len(by[i].attachments)
        plain = "".join(p["text"] or "" for p in parts if p["type"] == "text")
        assert "".join(chat.unescape(by[i].segment[m.start:m.end]) for m in by[i].loss) == plain
        assert (read[i].loss_chars, read[i].loss_sha256) == (len(plain), hashlib.sha256(plain.encode()).hexdigest())


def test_decontamination(spark, docs):
    item = "A train leaves Boston at 30 km per hour and meets Alice after 4 hours of slow travel near the old bridge"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    rows = [(1, f"so {item} ok"), (2, "we say that a train leaves Denver at 55 km per hour and meets Bob after 7 hours of slow travel near the old bridge today"),
            (3, "a train leaves Denver at 55 km per hour and meets Denver after 55 hours of slow travel near the old bridge"),
            (4, "a train leaves the old bridge"), (5, None), (6, ""), (1, f"so {item} ok"), (None, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    out = decontam.decontaminate(df, bench).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].contaminated for i in (1, 2, 3, 4, 5, 6, None)] == [True, True, False, False, False, False, False]
    assert (by[1].item_ids, by[1].reparameterised, by[2].reparameterised) == ([1], False, True)
    assert decontam.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_finds_the_planted_items(spark):
    docs, bench = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join(WORD.findall(t.lower()))
    items = [flat(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.select("doc_id", "text").collect() if any(i in flat(r.text) for i in items)}
    got = {r.doc_id for r in decontam.decontaminate(docs, bench).where("contaminated").collect()}
    assert want and got == want


def found_items(spark, items, texts):
    """Item ids found in each text."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: r.item_ids for r in decontam.decontaminate(df, bench).collect()}
    return [by[i] for i in range(len(texts))]


def test_decontamination_finds_items_dense_in_slots_and_short_ones(spark):
    items = ["Alice paid 30 dollars, Bob paid 20 dollars, Carol paid 10 dollars", "What is the capital of France?", "Xylograph",
             "小明有三个苹果他又买了五个一共有几个", "1 2 3 4 5 6 7 8 9 10", "How many legs have 3 cows?"]
    texts = [f"so {i} ok" for i in items] + [f"他说{items[3]}吗", "How many legs have 7 cows?", "What is the capital of Spain?", "what is the capital", "10 9 8 7 6 5 4 3 2 1"]
    assert found_items(spark, items, texts) == [[0], [1], [2], [3], [4], [5], [3], [5], [1], [], []]


def test_decontamination_unites_diagonals(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(30)]
    put = lambda t, *at: " ".join(w + " extra" * (k + 1 in at) for k, w in enumerate(t))
    item = " ".join(words)
    far = " ".join(words[:10]) + " far" * 100 + " " + " ".join(words[10:20])
    texts = [item, put(words, 10, 20), " ".join(words[:10] + words[11:20] + words[21:]), " ".join(words[20:] + words[10:20] + words[:10]), far,
             f"{put(words, 10, 20)} {put(words, 10, 20)}"]
    assert found_items(spark, [item], texts) == [[0], [0], [0], [], [], [0]]
    new = "x a train leaves Denver at 55 km per slow hour and then it meets our Bob after just 7 hours of travel near the old bridge today"
    old = "A train leaves Boston at 30 km per hour and then it meets our Alice after 4 hours of travel near the old bridge today"
    assert found_items(spark, [old], [new, new.replace("Bob", "Denver").replace("7", "55")]) == [[0], []]


def test_texts_of_one_id_are_not_put_together(spark):
    words = [f"w{chr(97 + k)}x" for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(words)), (1, "other words")], "item_id long, text string")
    df = spark.createDataFrame([(None, " ".join(words[:9])), (None, "so it is " + " ".join(words[9:18]))], "doc_id long, text string")
    assert decontam.decontaminate(df, bench).where("contaminated").count() == 0


def test_chains_against_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(1, 8)
        segs = sorted({(rnd.randrange(30), rnd.randrange(30), rnd.randrange(3, 9)) for _ in range(n)})
        start, item, words = (np.array(x) for x in zip(*segs))

        def fits(s, t):
            (a, b, m), (c, d, k) = segs[s], segs[t]
            return a < c and b < d and a + m < c + k and b + m < d + k and c - a - m <= 10

        def best(t):
            got = [best(s) - max(0, segs[s][0] + segs[s][2] - segs[t][0], segs[s][1] + segs[s][2] - segs[t][1]) for s in range(t) if fits(s, t)]
            return segs[t][2] + max([0, *got])

        assert decontam.chains(start, item, words, 10)[0].tolist() == [best(t) for t in range(len(segs))]


def test_decontamination_bears_coincident_values_and_other_spelling(spark):
    items = ["Alice has 3 apples. Bob eats 2 pears. Carol has many plums. Dave cooks soup.",
             "a red bus goes 30 km over the long hill and a blue bus goes for 30 hours over the same long hill",
             "the first box holds 5 nuts and the second box holds 6 nuts so how many nuts are there at all",
             "Él pagó la cuenta Ñandú después de la Ópera con ÁNIMO y sin prisa alguna"]
    texts = ["Eve has 5 apples. Frank eats 7 pears. Grace has many plums. Heidi cooks soup.",
             "a red bus goes 55 km over the long hill and a blue bus goes for 7 hours over the same long hill",
             "the first box holds 7 nuts and the second box holds 7 nuts so how many nuts are there at all",
             items[1].replace("30 hours", "31 hours"), items[0].upper(), items[0].lower().replace(".", ";"), items[3].upper(), items[3].lower(),
             "the hill and the box"]
    assert found_items(spark, items, texts) == [[0], [1], [2], [1], [0], [0], [3], [3], []]
    assert decontam.answering([(1, 7), (2, 7)]) and not decontam.answering([(1, 7), (2, 8), (3, 7), (4, 8)])


def test_folded_equals_lower():
    text = "ÀÉÑ ЖЯ ΑΩ ẠẾ ß 数 Ł ÿ Ÿ aZ 😀 İ"
    got = decontam.folded(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()
    assert got == "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text)


def test_quality_classifier_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in got if r.quality == 1]
    low = [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(low) <= 0.05 * len(low)


def test_quality_training_rows_are_bounded(spark, monkeypatch):
    sizes, fit = [], quality_model.fit_scorer
    monkeypatch.setattr(quality_model, "fit_scorer", lambda x, y: sizes.append(len(x)) or fit(x, y, steps=2))
    text = F.concat(F.lit("some words of row "), F.col("id").cast("string")).alias("text")
    same = spark.range(3000).select(F.when(F.col("id") < 1000, F.col("id")).when(F.col("id") < 2000, 7).alias("doc_id"), text)
    nulls = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), text)
    assert quality_model.classify(same, train_rows=3000).count() == 3000
    assert quality_model.classify(nulls, train_rows=50).count() == 500
    assert sizes == [1000, 50]


def test_votes_are_fitted():
    patterns = np.array([0, 1, 2, 4, 8])
    low, model = quality_model.fit_votes(patterns, np.array([5.0, 800, 100, 90, 60]))
    assert low[2] > 0.9 and low[4] > 0.9 and low[1] < 0.1 and 0 < model["share"] < 0.5


def test_quality_filter_keeps_whole_rows(docs, none):
    out = quality_model.accepted(docs)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert quality_model.accepted(none).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_toxicity(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        out = toxicity.score_toxicity(docs, some).collect()
        assert len(out) == docs.count() and {r.score for r in out} <= {0.0, 1.0}


def test_empty_tables(spark, none, crf):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    for df in (jaccard_join.jaccard_join(none), bpe.encode(none, tokenizer_path()), quality_model.classify(none), decontam.decontaminate(none, bench),
               chat.read_back(chat.format_turns(turns)), quality_rules.judge(none, labels), pii_crf.find_pii(none, crf), toxicity.score_toxicity(none, labels),
               suffix_dedup.remove_repeats(none), recompress_dedup.remove_repeats(none)):
        assert df.count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    item = bench.orderBy("item_id").first().text
    good = [r.text for r in quality_model.accepted(docs).orderBy("doc_id").limit(2).collect()]
    made = [(900_001, good[0] + " one two"), (900_002, "Some other text " + good[1]), (900_002, f"{good[1]} {item}"), (900_002, f"{good[1]} {item}"),
            (None, f"{good[0]} {item}"), (None, good[0])]
    more = spark.createDataFrame(made, "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(r.doc_id, r.text) for r in quality_model.accepted(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()]
    known = sorted({x for x in left if x[0] is not None})
    sets, parent = [grams(t, 5) for _, t in known], {i: i for i, _ in known}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(known)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and sets[a]:
                low, high = sorted((root(known[a][0]), root(known[b][0])))
                parent[high] = low
    left = [x for x in known if root(x[0]) == x[0]] + [x for x in left if x[0] is None]
    flat = lambda t: " ".join(WORD.findall((t or "").lower()))
    items = [flat(r.text) for r in bench.collect()]
    left = [x for x in left if not any(i in flat(x[1]) for i in items)]
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter(i for i, _ in left)


def test_pipeline_stages_on_awkward_ids(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"w{chr(97 + k)}x" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(1, "one text of its own here"), (1, "quite another text is this one"), (1, "quite another text is this one"),
                                (None, f"so {item}"), (None, "clean"), (2, f"{item} ok"), (2, "also clean")], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).where("doc_id = 1").count() == 2
    left = {tuple(r) for r in corpus_pipeline.decontaminated(spark, df, str(tmp_path)).distinct().collect()}
    assert left == {(1, "one text of its own here"), (1, "quite another text is this one"), (None, "clean"), (2, "also clean")}

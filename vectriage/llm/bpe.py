"""BPE encoding and decoding with a vocabulary file of the tokenizers library.

Method: the exact token sequence of a word is found by dynamic programming
over its prefixes.  A suffix automaton over all vocabulary entries reads the
word once and lists, for every prefix, the vocabulary tokens that end there;
of these the one whose predecessor (the last token of the remaining prefix)
is pair-compatible is the prefix's unique last token.  Following the
back-pointers from the end gives the ids.  Two tokens are compatible when
byte-pair merging of their joint text would not have merged across their
border earlier than it built either of them.

A task takes about a megabyte of texts at a time.  The distinct words among
them that it does not remember are encoded together, position by position in
numpy arrays; texts are then put together from their chunks.  A word of over
``LONG`` bytes goes through the same search by itself.

Supported files: kind BPE with end-of-word suffix, byte-level alphabet, no
unknown token (``word_bpe_49k.json``).  The tables depend on the vocabulary
alone, so their broadcast has a fixed size.

Edge cases: a null or empty text has no tokens and decodes to the empty text;
rows are independent, so repeated rows give repeated results and an empty
table an empty one; columns beyond the id and text are never read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vectriage.llm.common import freeing, keyed_texts, row_ranges, text_bytes

# The pre-tokenisation pattern and the byte alphabet of this kind of file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = r"[\t-\r \x85\xa0  -     　]+"
MEMORY = 100_000               # remembered words and chunks, each, before a range of texts adds its own
LONG = 1024
CELLS = 1 << 21                # positions of words encoded together
NONE = 1 << 30


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merged(symbols: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """Plain byte-pair merging, lowest merge first; used on vocabulary entries only."""
    while len(symbols) > 1:
        best = min((merges.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:])))
        if best[0] == 1 << 30:
            break
        pair, out, i = (symbols[best[1]], symbols[best[1] + 1]), [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                out.append(best[0])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def build_tables(path: str) -> dict:
    """Vocabulary, splits, merges and suffix automaton of a vocabulary file, as plain containers."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    vocab = model["vocab"]
    chars = byte_alphabet()
    code = {c: b for b, c in enumerate(chars)}
    text = [""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        text[i] = t
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # A symbol is a byte, or 256 + byte at the end of a word; ``base`` has its token.
    base = [vocab[c] for c in chars] + [vocab[c + suffix] for c in chars]
    first_rank = len(text) - len(model["merges"])
    merges, split = {}, {}
    for k, (a, b) in enumerate(model["merges"]):
        whole = vocab[a + b]
        if whole != first_rank + k:
            raise ValueError("ids must follow the order of the merges")
        merges[vocab[a], vocab[b]] = whole
        split[whole] = (vocab[a], vocab[b])

    def symbols(t: str) -> list[int]:
        end = t.endswith(suffix)
        own = [code[c] for c in (t[:-len(suffix)] if end else t)]
        if end:
            own[-1] += 256
        return own

    edges: list[dict[int, int]] = [{}]
    link, length, token_of = [-1], [0], [{}]
    for i, t in enumerate(text):
        own = symbols(t)
        if len(own) > 1 and merged([base[s] for s in own], merges) != [i]:
            continue                       # merging never yields this entry, so it is never a token of a text
        last, path_states = 0, []
        for s in own:                      # generalised suffix automaton: add the entry symbol by symbol
            if s in edges[last]:
                q = edges[last][s]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = _clone(edges, link, length, token_of, last, s, q)
                path_states.append(last)
                continue
            cur = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            token_of.append({})
            p = last
            while p != -1 and s not in edges[p]:
                edges[p][s] = cur
                p = link[p]
            if p != -1:
                q = edges[p][s]
                link[cur] = q if length[q] == length[p] + 1 else _clone(edges, link, length, token_of, p, s, q)
            last = cur
        token_of[last][len(own)] = i
    # The entries that end in a state, and the nearest suffix state that has any.
    up = [0] * len(edges)
    for state in sorted(range(1, len(edges)), key=length.__getitem__):
        parent = link[state]
        up[state] = parent if parent > 0 and token_of[parent] else (up[parent] if parent > 0 else 0)
    ends = [sorted(x.items(), reverse=True) for x in token_of]
    chains = [_suffix_tokens(state, ends, up) for state in range(len(edges))]
    if max(base) >= first_rank:
        raise ValueError("the tokens of single bytes must come before the merges")
    steps = sorted((state << 9 | x, q) for state, e in enumerate(edges) for x, q in e.items())
    pairs = sorted((x << 20 | y, whole) for (x, y), whole in merges.items())
    halves = np.full((len(text), 2), -1, np.int64)
    for whole, own in split.items():
        halves[whole] = own
    column = lambda rows, k: np.array([r[k] for r in rows], np.int64)
    return {"text": text, "special": special, "pattern": WORD_PATTERN, "spaces": SPACES,
            "step": column(steps, 0), "next": column(steps, 1), "link": np.array(link), "length": np.array(length),
            "chain_at": np.cumsum([0, *map(len, chains)]), "chain_size": np.array([n for c in chains for n, _ in c]),
            "chain_token": np.array([i for c in chains for _, i in c]), "pair": column(pairs, 0), "whole": column(pairs, 1), "halves": halves}


def _suffix_tokens(state: int, ends: list, up: list) -> list[tuple[int, int]]:
    """(size, token) of all tokens that end where a state does, longest first."""
    out = []
    while state:
        out += ends[state]
        state = up[state]
    return out


def _clone(edges, link, length, token_of, p, s, q) -> int:
    new = len(edges)
    edges.append(dict(edges[q]))
    link.append(link[q])
    length.append(length[p] + 1)
    token_of.append({n: t for n, t in token_of[q].items() if n <= length[new]})
    token_of[q] = {n: t for n, t in token_of[q].items() if n > length[new]}
    link[q] = new
    while p != -1 and edges[p].get(s) == q:
        edges[p][s] = new
        p = link[p]
    return new


def compatible(a: np.ndarray, b: np.ndarray, t: dict) -> np.ndarray:
    """Whether merging the joint text of each pair of tokens (a, b) ends in exactly these two.

    The two are taken apart, the one built later first; a merge across the border that comes before the pieces at hand
    were built would have come first."""
    a, b = a.copy(), b.copy()
    out = np.ones(len(a), bool)
    limit = np.full(len(a), NONE)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live], b[live]
        at = np.minimum(np.searchsorted(t["pair"], x << 20 | y), len(t["pair"]) - 1)
        across = (t["pair"][at] == x << 20 | y) & (t["whole"][at] < limit[live])
        out[live[across]] = False
        live, x, y = live[~across], x[~across], y[~across]
        left = x > y                           # a was built later: undo it first
        limit[live] = np.where(left, x, y + 1)
        a[live] = np.where(left, t["halves"][x, 1], x)
        b[live] = np.where(left, y, t["halves"][y, 0])
        live = live[(a[live] >= 0) & (b[live] >= 0)]      # a single byte: nothing left to take apart
    return out


def encode_words(words: list[bytes], t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, offsets), by last tokens of prefixes; words of similar length go together."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-size, kind="stable")
    owner, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(words):
        longest = int(size[order[lo]])
        hi = lo + 1 if longest > LONG else min(len(words), lo + max(1, CELLS // max(longest, 1)))
        part = [words[k] for k in order[lo:hi].tolist()]
        who, own = _long_word(part[0], t) if longest > LONG else _together(part, t)
        owner.append(order[lo:hi][who])
        ids.append(own)
        lo = hi
    owner, ids = np.concatenate(owner), np.concatenate(ids)
    by = np.argsort(owner, kind="stable")
    return ids[by].astype("<u4"), np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


def _together(words: list[bytes], t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word, id) in the order of the ids, of words in falling order of length: every step reads one more byte of all that have one."""
    size = np.array([len(w) for w in words], np.int64)
    n, longest = len(words), int(size[0]) if len(words) else 0
    symbols = np.zeros((n, longest), np.int64)
    symbols[np.arange(longest)[None, :] < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    symbols[np.flatnonzero(size), size[size > 0] - 1] += 256
    last, back = np.full((n, longest + 1), -1, np.int64), np.zeros((n, longest + 1), np.int64)
    state, have = np.zeros(n, np.int64), np.zeros(n, np.int64)
    step, follow, link, length = t["step"], t["next"], t["link"], t["length"]
    for i in range(longest):
        live = int(np.searchsorted(-size, -i, "left"))         # words of over i bytes
        s, cur, held = symbols[:live, i], state[:live], have[:live]
        todo = np.arange(live)
        while len(todo):                       # follow suffix links until the byte can be read
            key = cur[todo] << 9 | s[todo]
            at = np.minimum(np.searchsorted(step, key), len(step) - 1)
            hit = step[at] == key
            cur[todo[hit]] = follow[at[hit]]
            held[todo[hit]] += 1
            todo = todo[~hit]
            held[todo[cur[todo] == 0]] = 0
            todo = todo[cur[todo] != 0]
            cur[todo] = link[cur[todo]]
            held[todo] = length[cur[todo]]
        at, end = t["chain_at"][cur], t["chain_at"][cur + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):                       # tokens that end here, longest first
            n_bytes, token = t["chain_size"][at[todo]], t["chain_token"][at[todo]]
            fits = n_bytes <= held[todo]
            start = i + 1 - n_bytes
            before = last[todo, np.maximum(start, 0)]
            ask = np.flatnonzero(fits & (start > 0))
            fits[ask] = before[ask] >= 0
            ask = ask[fits[ask]]
            if len(ask):
                pair, of = np.unique(before[ask] << 20 | token[ask], return_inverse=True)
                fits[ask] = compatible(pair >> 20, pair & ((1 << 20) - 1), t)[of]
            done = todo[fits]
            last[done, i + 1], back[done, i + 1] = token[fits], start[fits]
            todo = todo[~fits]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
    found, place = [], size.copy()
    who = np.flatnonzero(place > 0)
    while len(who):                            # the last token of the whole word, then of what is before it
        found.append((who, last[who, place[who]]))
        place[who] = back[who, place[who]]
        who = who[place[who] > 0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, ids = (np.concatenate(x) for x in zip(*found[::-1]))
    return who, ids


def _long_word(word: bytes, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """As ``_together`` for one long word: the same search with one state, over plain dictionaries; answers on pairs are remembered."""
    if "steps" not in t:
        t["steps"] = dict(zip(t["step"].tolist(), t["next"].tolist()))
    steps, link, length, pairs = t["steps"], t["link"], t["length"], {}
    chain_at, chain_size, chain_token = t["chain_at"], t["chain_size"], t["chain_token"]
    n, chains = len(word), {}
    last, back = [-1] * (n + 1), [0] * (n + 1)
    state, have = 0, 0
    for i in range(n):
        s = word[i] + 256 if i == n - 1 else word[i]
        while state and (state << 9 | s) not in steps:
            state = int(link[state])
            have = int(length[state])
        if (state << 9 | s) in steps:
            state, have = steps[state << 9 | s], have + 1
        chain = chains.get(state)
        if chain is None:
            a, b = chain_at[state], chain_at[state + 1]
            chain = chains[state] = list(zip(chain_size[a:b].tolist(), chain_token[a:b].tolist()))
        for size, token in chain:
            j = i + 1 - size
            if size > have or j and last[j] < 0:
                continue
            if j:
                key = last[j] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = bool(compatible(np.array([last[j]]), np.array([token]), t)[0])
                if not fits:
                    continue
            last[i + 1], back[i + 1] = token, j
            break
    out, i = [], n
    while i:
        out.append(last[i])
        i = back[i]
    return np.zeros(len(out), np.int64), np.array(out[::-1], np.int64)


def lower_chars(text: str) -> str:
    """Lower case of each character by itself (no rule for a final sigma)."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class Codec:
    """Encoder and decoder over broadcast tables; its memory of words and chunks is bounded and changes no result."""

    def __init__(self, tables: dict):
        self.t = tables
        self.find = regex.compile(tables["pattern"]).findall
        self.space = regex.compile(tables["spaces"]).sub
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in tables["special"]) + ")") if tables["special"] else None
        self.names = {s: (np.array([i], "<u4").tobytes(), s) for s, i in tables["special"].items()}
        self.memory, self.words = {}, {}

    def learn(self, chunks: list[str]) -> None:
        """Remember (packed ids, decoded tokens joined by a space) of stretches without white space."""
        own = {c: [c] if c.isalpha() else self.find(c) for c in chunks}
        if len(self.words) > MEMORY:
            self.words.clear()
        todo = list({w for ws in own.values() for w in ws if w not in self.words})
        ids, at = encode_words([w.encode("utf-8") for w in todo], self.t)
        packed, names, at = ids.tobytes(), [self.t["text"][i] for i in ids.tolist()], at.tolist()
        for w, lo, hi in zip(todo, at, at[1:]):
            self.words[w] = packed[4 * lo:4 * hi], " ".join(names[lo:hi])
        for c, ws in own.items():
            parts = [self.words[w] for w in ws]
            self.memory[c] = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
        for w in todo:
            if len(w) > 64:
                del self.words[w]

    def chunks(self, part: str) -> list[str]:
        """Normalised text without white space; no pre-token crosses a border."""
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
        part = lower_chars(part)
        if any(c in part for c in "\x1c\x1d\x1e\x1f"):     # str.split() takes these for spaces, the library doesn't
            return [c for c in self.space(" ", part).split(" ") if c]
        return part.split()

    def pieces(self, text: str) -> list:
        """The chunks of a text in order; special tokens as they are remembered."""
        if not self.special or "<|" not in text:
            return self.chunks(text)
        out = []
        for part in self.special.split(text):
            out += [self.names[part]] if part in self.names else self.chunks(part)
        return out

    def many(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """(count, packed ids, decoded text) of each text."""
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        lists, seen = [self.pieces(t) for t in texts], set()
        for own in lists:
            seen.update(own)
        new = [c for c in seen if type(c) is str and c not in memory]
        self.learn(new)
        out = []
        for own in lists:
            found = [c if type(c) is tuple else memory[c] for c in own]
            ids = b"".join([x[0] for x in found])
            out.append((len(ids) // 4, ids, " ".join([x[1] for x in found if x[0]])))
        for c in new:
            if len(c) > 64:
                del memory[c]
        return out

    def __call__(self, text: str) -> tuple[int, bytes, str]:
        return self.many([text])[0]


def decode(ids: np.ndarray, tables: dict) -> str:
    """Text of ids: the file names no decoder, so tokens are joined by a space."""
    names = {i: s for s, i in tables["special"].items()}
    return " ".join(names[i] if i in names else tables["text"][i] for i in map(int, ids))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary of little-endian uint32, decoded) of every row of ``docs``."""
    return _run(docs, path, id_col, text_col, digest=False)


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests, made where the ids are."""
    return _run(docs, path, id_col, text_col, digest=True)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(build_tables(path))

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_ranges(offsets):
                counts, left, right = [], [], []
                for n, ids, decoded in codec.many([t or "" for t in batch.column("text")[lo:hi].to_pylist()]):
                    counts.append(n)
                    left.append(hashlib.sha256(ids).hexdigest() if digest else ids)
                    right.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest() if digest else decoded)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(counts, pa.int64()),
                     pa.array(left, pa.string() if digest else pa.binary()), pa.array(right, pa.string())],
                    names=["doc_id", "n_tokens", "a", "b"])

    kind = "string" if digest else "binary"
    out = keyed_texts(docs, id_col, text_col).mapInArrow(freeing(run), f"doc_id long, n_tokens long, a {kind}, b string")
    return out.toDF("doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]))

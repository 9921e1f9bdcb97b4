"""Byte-pair encoding by a pair occurrence index.

A block's distinct words lie in one flat symbol array with links to the next and previous symbol.
Every adjacent pair that has a merge rank is listed with all its positions. Ranks that are active
are taken from a heap in ascending order; all occurrences of the rank's pair are merged at once, and
the pairs this makes are added to their lists. A merge always outranks the merges that make its
parts (checked when the vocabulary is read), so a pair made later never has to come first.

Normalisation (NFC, lower case), splitting and special tokens follow the vocabulary's tokenizer
file. Texts with code points that this Python's tables do not know are split by the library's own
normaliser, as its tables may be newer. Decoding joins the tokens' texts by a space, as a tokenizer
without decoder does.

Edge cases: null or empty text has no ids and decodes to the empty text; special tokens in a text
are single ids; words of any length are one array slice; repeated rows give repeated results; result
columns win over ``keep`` columns of the same name, other columns are not read.
Memory: one Arrow batch, its distinct words, and a word cache of fixed size.
"""

import heapq
import json
import re
import unicodedata
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHE_CHARS = 30_000_000


def byte_chars() -> list:
    """Printable stand-in for each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Vocabulary:
    """Ids, texts and merges of a tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        end = spec["model"]["end_of_word_suffix"] or ""
        self.text = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.width = max(self.text) + 1
        left, right, made = [], [], []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            left.append(vocab[a]), right.append(vocab[b]), made.append(vocab[a + b])
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (left, right, made))
        rank = np.full(self.width, -1)
        rank[self.made] = np.arange(len(made))
        if (np.maximum(rank[self.left], rank[self.right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before one that makes its parts")
        code = self.left * self.width + self.right
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]
        self.to_byte = {c: b for b, c in enumerate(chars)}

    def ranks(self, a, b):
        """Rank of each pair, -1 where there is none."""
        code = a * self.width + b
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[k] == code, self.order[k], -1)


def encode_words(words: list, v: Vocabulary) -> list:
    """Ids (arrays) of byte-string words, none empty."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(words), np.uint8)
    sym = v.inner[data]
    sym[ends - 1] = v.last[data[ends - 1]]
    n = len(sym)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[ends - 1] = -1
    prv[ends - size] = -1
    index: dict = {}
    heap: list = []

    def add(pos):
        """List positions whose pair (sym[p], sym[nxt[p]]) has a rank."""
        r = v.ranks(sym[pos], sym[nxt[pos]])
        keep = r >= 0
        r, pos = r[keep], pos[keep]
        if not len(r):
            return
        if len(r) > 1:
            o = np.argsort(r, kind="stable")
            r, pos = r[o], pos[o]
        cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)] if len(r) > 1 else [0, 1]
        for s, e in zip(cuts, cuts[1:]):
            k = int(r[s])
            if k in index:
                index[k].append(pos[s:e])
            else:
                index[k] = [pos[s:e]]
                heapq.heappush(heap, k)

    add(np.flatnonzero(nxt >= 0))
    while heap:
        k = heapq.heappop(heap)
        a, b, made = v.left[k], v.right[k], v.made[k]
        got = index.pop(k)
        p = np.unique(np.concatenate(got)) if len(got) > 1 else got[0]
        p = p[(sym[p] == a) & (nxt[p] >= 0)]
        p = p[sym[nxt[p]] == b]
        if a == b and len(p) > 1:  # runs of one symbol: leftmost first, without overlap
            taken, used = [], -1
            for x in np.sort(p).tolist():
                if x != used:
                    taken.append(x)
                    used = nxt[x]
            p = np.array(taken)
        if not len(p):
            continue
        q = nxt[p]
        after = nxt[q]
        sym[p], sym[q], nxt[p] = made, -1, after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        new = np.concatenate([before[before >= 0], p[has]])
        if len(new):
            add(new)
    alive = sym >= 0
    count = np.add.reduceat(alive.astype(np.int64), ends - size)
    return np.split(sym[alive].astype("<u4"), np.cumsum(count)[:-1])


class Splitter:
    """Text to a list of words (bytes) and special ids (int)."""

    def __init__(self, path: str, v: Vocabulary):
        self.path, self.v, self.library = path, v, None
        self.special = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None
        runs, start = [], None
        for c in range(0x10001):
            known = c <= 0xFFFF and unicodedata.category(chr(c)) != "Cn"
            if known and start is None:
                start = c
            elif not known and start is not None:
                runs.append(f"\\u{start:04x}-\\u{c - 1:04x}")
                start = None
        # characters worth a closer look: unassigned, or beyond the 16-bit plane, whose ranges would make the test slow
        self.odd = re.compile("[^" + "".join(runs) + "]")

    def unknown(self, text: str) -> bool:
        """Whether the text holds a code point that this Python's tables do not know."""
        return self.odd.search(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(self.odd.findall(text)))

    def words(self, text: str) -> list:
        if text.isascii():
            return [w.encode() for w in WORD.findall(text.lower())]
        if self.unknown(text):
            if self.library is None:
                from tokenizers import Tokenizer
                self.library = Tokenizer.from_file(self.path)
            t = self.library.normalizer.normalize_str(text)
            back = self.v.to_byte
            return [bytes(back[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(t)]
        t = unicodedata.normalize("NFC", text)
        t = "".join(c.lower() for c in t) if "Σ" in t else t.lower()  # no final sigma in a lower case by character
        return [w.encode() for w in WORD.findall(t)]

    def __call__(self, text: str) -> list:
        if not text:
            return []
        if self.special is None or "<|" not in text:
            return self.words(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [self.v.special[part]] if k % 2 else self.words(part)
        return out


def encoded(docs: DataFrame, tokenizer: str, text_col="text", keep=("doc_id",), digests=False) -> DataFrame:
    """``keep`` columns, n_tokens, and ids with the decoded text, or their SHA-256 digests."""
    results = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("n_tokens", "ids", "decoded")
    keep = [c for c in keep if c not in results]

    def work(batches):
        v = Vocabulary(tokenizer)
        split = Splitter(tokenizer, v)
        cache: dict = {}
        held = 0
        for i, t in v.text.items():
            if t in v.special:
                cache[i] = (np.array([i], "<u4").tobytes(), t)
        special = dict(cache)
        for b in batches:
            texts = [split(t or "") for t in b.column(text_col).to_pylist()]
            if held > CACHE_CHARS:
                cache, held = dict(special), 0
            new = list({w for t in texts for w in t if w not in cache})
            if new:
                for w, ids in zip(new, encode_words(new, v)):
                    cache[w] = (ids.tobytes(), " ".join(map(v.text.__getitem__, ids.tolist())))
                    held += len(w)
            ids, text = [], []
            for t in texts:
                got = [cache[w] for w in t]
                ids.append(b"".join([x[0] for x in got]))
                text.append(" ".join([x[1] for x in got]))
            cols = [b.column(c) for c in keep] + [pa.array([len(x) // 4 for x in ids], pa.int64())]
            if digests:
                cols += [pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(x.encode()).hexdigest() for x in text])]
            else:
                cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["n_tokens long"]
    fields += ["ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>", "decoded string"]
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(work, ", ".join(fields))

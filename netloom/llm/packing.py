"""Hierarchical multi-length packing.

A document's tokens (its ids and an end id) give full windows of ``TIERS[0]`` tokens first; the rest
is routed to the smallest context-size tier that holds it. Tiers are packed from long to short: a
rest opens a window of its tier, and its gap is filled from shorter tiers, with the longest rest
that fits whole, else with a cut from the longest shorter one. Full windows of every tier are powers
of two, so they need no padding; the one window a block may leave unfilled is cut into powers of
two. Windows are dealt to step groups of equal token counts, long tiers first, which powers of two
fill exactly.

Blocks are Arrow batches, so nothing is shuffled, memory is one batch, and a lost task repeats its
blocks alone. Sequence ids are (partition, running number).

Ids are those of the byte-level vocabulary in ``byte_bpe_50k.json``; they are computed with the rank
form of the same vocabulary, which gives equal ids for every code point and special token (tested
against the tokenizers library) about five times faster.

Edge cases: null or empty text is the end id alone; a null id stays null; repeated rows are packed
one by one; a text of any length is cut over windows; an empty table gives no rows.
"""

import base64
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (1024, 512, 256, 128, 64)
STEP_TOKENS, END = 16 * 1024, 0
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, step_id long")


def encoder(path: str):
    """text -> list of ids; ``path`` is the vocabulary's rank file."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda t: enc.encode(t, allowed_special="all") if "<|endoftext|>" in t else enc.encode_ordinary(t)


def pack(lengths, tiers=TIERS):
    """Pieces (doc, start, length, window, offset) of a block and the windows' lengths."""
    top, pieces, windows = tiers[0], [], []
    rests = {t: [] for t in tiers}  # tier -> sorted (length, doc, start)

    def tier_of(n):
        return next(t for t in reversed(tiers) if n <= t)

    for doc, n in enumerate(lengths):
        full = n // top
        for k in range(full):
            pieces.append((doc, k * top, top, len(windows), 0))
            windows.append(top)
        if n % top:
            rests[tier_of(n % top)].append((n % top, doc, full * top))
    for r in rests.values():
        r.sort()

    def take(gap, below):
        """The longest rest of the shorter tiers that fits, else a cut from the longest of all."""
        for t in below:
            r = rests[t]
            k = bisect_right(r, (gap, float("inf"), 0))
            if k:
                return r.pop(k - 1)
        for t in below:
            if rests[t]:
                n, doc, start = rests[t].pop()
                insort(rests[tier_of(n - gap)], (n - gap, doc, start + gap))
                return gap, doc, start
        return None

    for level, t in enumerate(tiers):
        while rests[t]:
            window, at = len(windows), 0
            piece = rests[t].pop()
            while piece:
                pieces.append((piece[1], piece[2], piece[0], window, at))
                at += piece[0]
                piece = take(t - at, tiers[level:]) if at < t else None
            windows.append(at)
    # windows that stayed short are cut into powers of two
    short = {w for w, n in enumerate(windows) if n & (n - 1)}
    if short:
        kept = [p for p in pieces if p[3] not in short]
        for w in sorted(short):
            mine = sorted((p for p in pieces if p[3] == w), key=lambda p: p[4])
            left, size, k, used = windows[w], 0, -1, 0
            for doc, start, n, _, _ in mine:
                while n:
                    if used == size:
                        size = 1 << (left.bit_length() - 1)
                        left -= size
                        if k < 0:
                            k, windows[w] = w, size
                        else:
                            k = len(windows)
                            windows.append(size)
                        used = 0
                    m = min(n, size - used)
                    kept.append((doc, start, m, k, used))
                    doc, start, n, used = doc, start + m, n - m, used + m
        pieces = kept
    return pieces, windows


def steps(windows, step_tokens=STEP_TOKENS):
    """Step number of each window: longest first, every step but the last holds exactly ``step_tokens``."""
    n = np.asarray(windows)
    order = np.argsort(-n, kind="stable")
    out = np.empty(len(n), np.int64)
    out[order] = (np.cumsum(n[order]) - n[order]) // step_tokens
    return out


def packed(docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text", tiers=TIERS, keep_ids=False) -> DataFrame:
    """One row per piece of ``docs`` (``SCHEMA``; with ``keep_ids`` also the piece's ids)."""

    def work(batches):
        encode, base, group = encoder(vocabulary), TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() << 33
        for b in batches:
            ids = [np.array(encode(t or "") + [END], "<u4").tobytes() for t in b.column(text_col).to_pylist()]
            if not ids:
                continue
            pieces, windows = pack([len(x) // 4 for x in ids], tiers)
            step = steps(windows)
            doc, start, length, window, offset = map(np.array, zip(*pieces))
            cut = [memoryview(ids[d])[4 * s:4 * (s + n)] for d, s, n in zip(doc, start, length)]
            cols = [b.column(id_col).cast(pa.int64()).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([len(ids[d]) // 4 for d in doc], pa.int64()),
                    pa.array(base + window, pa.int64()), pa.array(offset, pa.int64()), pa.array(np.asarray(windows)[window], pa.int64()),
                    pa.array(group + step[window], pa.int64())]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32())))
                names = [*names, "ids"]
            base, group = base + len(windows), group + int(step.max()) + 1
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(work, SCHEMA + (", ids array<int>" if keep_ids else ""))

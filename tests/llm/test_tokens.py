import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from netloom.llm import bpe, packing
from tests.llm.helpers import DOCS, TEXTS, docs

BYTE, RANKS, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


@given(st.lists(st.one_of(st.integers(1, 3000), st.sampled_from([1, 64, 512, 1023, 1024, 1025, 9999])), max_size=80))
@settings(max_examples=150, deadline=None)
def test_packing_places_every_token_once_without_padding(lengths):
    pieces, windows = packing.pack(lengths)
    assert all(0 < n <= 1024 and n & (n - 1) == 0 for n in windows)
    at_window, at_doc = {}, {}
    for doc, start, n, w, offset in pieces:
        at_window.setdefault(w, []).append((offset, n))
        at_doc.setdefault(doc, []).append((start, n))
    for groups, sizes in ((at_window, dict(enumerate(windows))), (at_doc, dict(enumerate(lengths)))):
        assert groups.keys() == sizes.keys()
        for k, g in groups.items():
            end = 0
            for s, n in sorted(g):
                assert s == end and n > 0
                end += n
            assert end == sizes[k]
    if windows:
        step = packing.steps(windows)
        loads = np.bincount(step, windows)
        assert (loads[:-1] == packing.STEP_TOKENS).all() and loads[-1] <= packing.STEP_TOKENS


def test_short_rests_fill_the_gaps_of_long_windows():
    pieces, windows = packing.pack([700, 300, 24, 1024])
    assert sorted(windows) == [1024, 1024] and len(pieces) == 4


def test_packed_rows_hold_the_library_s_ids(spark):
    got = packing.packed(docs(spark, "length", "offset"), RANKS, keep_ids=True).collect()
    t = Tokenizer.from_file(BYTE)
    want = sorted((d[0] if d[0] is not None else -1, np.array([*t.encode(d[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d in DOCS)
    by = {}
    for r in got:
        ids = np.array(r.ids, "<u4").tobytes()
        assert len(r.ids) == r.length and zlib.crc32(ids) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for g in by.values():
        end = 0
        for o, n, total in sorted(g):
            assert o == end
            end += n
        assert end == total
    assert sum(r.length for r in got) == sum(len(x[1]) // 4 for x in want)
    single = [r for r in got if r.length == r.doc_tokens and r.doc_id == 7]
    assert not single or np.array(single[0].ids, "<u4").tobytes() in [x[1] for x in want]
    assert packing.packed(docs(spark, rows=[]), RANKS).count() == 0


def test_rank_form_equals_the_tokenizer_file():
    enc, t = packing.encoder(RANKS), Tokenizer.from_file(BYTE)
    texts = [x or "" for x in TEXTS] + [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    assert [enc(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(WORD)
    got = bpe.encoded(docs(spark, "ids", "n_tokens"), WORD, keep=("doc_id", "text", "n_tokens", "ids")).collect()
    for r in got:
        e = t.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids and r.n_tokens == len(e.ids) and r.decoded == t.decode(e.ids, skip_special_tokens=False)
    assert len(got) == len(DOCS)
    d = bpe.encoded(docs(spark), WORD, digests=True).where("doc_id = 1").first()
    assert d.ids_sha256 == hashlib.sha256(b"").hexdigest() == d.decoded_sha256
    assert bpe.encoded(docs(spark, rows=[]), WORD).count() == 0


def test_bpe_equals_the_library_for_every_code_point():
    t, v = Tokenizer.from_file(WORD), bpe.Vocabulary(WORD)
    split = bpe.Splitter(WORD, v)
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 11 == 0)]
    words = [split(x) for x in texts]
    flat = list({w for x in words for w in x})
    ids = dict(zip(flat, bpe.encode_words(flat, v)))
    bad = [x for x, w, e in zip(texts, words, t.encode_batch(texts, add_special_tokens=False)) if [int(i) for y in w for i in ids[y]] != e.ids]
    assert not bad


@given(st.lists(st.text("abinthe", min_size=1, max_size=30), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_runs_and_overlaps_merge_leftmost_first(words):
    t, v = Tokenizer.from_file(WORD), bpe.Vocabulary(WORD)
    assert [x.tolist() for x in bpe.encode_words([w.encode() for w in words], v)] == [t.encode(w, add_special_tokens=False).ids for w in words]

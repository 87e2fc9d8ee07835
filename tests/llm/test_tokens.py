"""Tokenisation, packing and token files."""

import random
import zlib
from collections import defaultdict

import edge
import numpy as np
import pytest
from tokenizers import Tokenizer

from cellgrid.llm import bpe, packing, token_files
from cellgrid.llm.tokens import Encoder, tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(4)
    parts = list("aB é\n '.,1😀\t") + ["<|endoftext|>", "'s", " th", "\x02", "<|startoftext|>", "\x1c"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    letters = ["".join(rng.choice("etaoin shrdlu") for _ in range(300)) for _ in range(60)]
    return [r[1] for r in edge.rows()] + odd + letters + ["e" * 3000 + "th" * 900, "A" * 700]


@pytest.mark.parametrize("path,kind", [(WORDS, Encoder), (BYTES, Encoder), (BYTES, bpe.SpeculativeEncoder)])
def test_ids_equal_the_library(path, kind):
    library, own = Tokenizer.from_file(path), kind(path)
    texts = odd_texts()
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_decoding_equals_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.SpeculativeEncoder(BYTES)
    rng = np.random.default_rng(2)
    for _ in range(200):
        ids = rng.integers(0, 50257, 20).astype(np.uint32)
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_encode_table(docs, no_docs):
    got = bpe.encode(docs, BYTES).collect()
    want = [(r[0], r[1] or "") for r in edge.rows()]
    assert sorted((r.id or 0, r.decoded) for r in got) == sorted((i or 0, t) for i, t in want)
    assert bpe.digest(no_docs, BYTES).count() == 0


def test_differencing_is_nearly_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 513, 3000)
    window = packing.differencing(sizes, 300)
    sums = np.bincount(window, sizes, 300)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 8


def test_windows_rise_when_capacity_is_exceeded():
    sizes = np.array([60, 60, 60])
    window, offset = packing.pack_group(sizes, 100)
    assert sorted(window.tolist()) == [0, 1, 2] and not offset.any()


def test_packed_pieces(docs, no_docs):
    rows = packing.with_crc(packing.pack(docs, WORDS)).collect()
    library = Tokenizer.from_file(WORDS)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        assert len(r.tokens) == 4 * r.length and zlib.crc32(r.tokens) == r.ids_crc32
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(
        len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in edge.rows()
    )
    whole = {}
    for r in sorted((r for r in rows if r.id == 12), key=lambda r: r.start):
        whole[r.start] = np.frombuffer(r.tokens, "<u4").tolist()
    text = next(r[1] for r in edge.rows() if r[0] == 12)
    assert sum(whole.values(), []) == library.encode(text, add_special_tokens=False).ids + [1]
    assert packing.pack(no_docs, WORDS).count() == 0


def test_levels_round_trip():
    rng = np.random.default_rng(5)
    for size in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 70000, size).astype(np.uint32)
        ids[::7] = 3
        if size:
            ids[0] = 2**32 - 1
        levels = token_files.write_levels(ids)
        assert (token_files.read_levels(levels) == ids).all()
        assert all(token_files.read_at(levels, i) == ids[i] for i in range(0, size, 13))


def test_token_file(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    path = token_files.fresh_path(spark)
    token_files.write(docs, path, BYTES)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(BYTES)
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == len(edge.rows())
    texts = defaultdict(list)
    for r in edge.rows():
        texts[r[0]].append(library.encode(r[1] or "", add_special_tokens=False).ids + [0])
    at = 0
    for r in got:
        assert r.start == at and np.frombuffer(r.tokens, "<u4").tolist() in texts[r.id] and r.n_tokens == len(r.tokens) // 4
        at += r.n_tokens
    path = token_files.fresh_path(spark)
    token_files.write(no_docs, path, BYTES)
    assert token_files.read(spark, path).count() == 0

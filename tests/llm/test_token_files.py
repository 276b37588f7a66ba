"""Token files: ids, places and masks against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tablefold.llm import token_files as T

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows():
    out = [(7 * i % 101, f"Étion dans, l'été {i}'s  çouelle\n\tun x{i} don't") for i in range(60)]
    return out + [(None, "null id"), (None, None), (5, ""), (5, "same id"), (5, "same id"), (900, "long " * 30_000), (901, "<|endoftext|> a b"), (902, "a b c\x1cd\x85e Σ ΑΣ ΑΣ. é ́"),
                  (903, "日本 \U0001F600 ½ ² x" * 50), (-4, " \t\n ")]


def wanted(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCABULARY)
    return sorted(((i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows), key=str)


def test_round_trip(make):
    got = T.round_trip(make(rows()), VOCABULARY).collect()
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=str) == wanted(rows())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens > 0
        at += r.n_tokens
    ids = [r.doc_id if r.doc_id is not None else -10**9 for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_empty_table(make):
    assert T.round_trip(make([]), VOCABULARY).collect() == []


def test_pieces_equal_whole_texts(monkeypatch):
    assert T.drops_space(VOCABULARY) and not T.drops_space(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(T, "CACHE", 20)
    monkeypatch.setattr(T, "BLOCK_BYTES", 300)
    texts = [t or "" for _, t in rows()] + ["É, Î. A\u0130. b.c, d.. e., ß. Ω. it's, 'RE. x", "<|ENDOFTEXT|> A", "A\u030A I\u0307. \u212A"]
    whole, pieces = T.Encoder(VOCABULARY, False), T.Encoder(VOCABULARY, True)
    for _ in range(2):
        assert [x.tolist() for x in pieces(pa.array(texts))] == [x.tolist() for x in whole(pa.array(texts))]


def test_sequences_and_masks(tmp_path):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 40_000, n).astype(np.uint32) for n in (3, 0, 70, 8, 1, 200, 16)]
    w = T.Writer(str(tmp_path / "files"), "x", np.uint16, length=8, batch=4)
    for i, d in enumerate(docs):
        w.add(i, d)
    path, places, n, tokens = w.close()
    flat = np.concatenate(docs)
    assert (n, tokens) == (len(docs), len(flat))
    f = T.TokenFile(path)
    assert len(f) == -(-len(flat) // 8)
    for i in range(len(f)):
        ids, mask = f.sequence(i)
        part = flat[8 * i:8 * i + 8]
        assert len(ids) == 8 and ids[:len(part)].tolist() == part.tolist() and mask.to_pylist() == [True] * len(part) + [False] * (8 - len(part))
        assert not ids.flags.owndata                       # a view of the mapped file
    at = 0
    for d in docs:
        assert np.concatenate([*f.run(at, len(d)), np.zeros(0, np.uint16)]).tolist() == d.tolist()
        at += len(d)


@pytest.mark.parametrize("n", [0, 8, 32])
def test_file_without_padding(tmp_path, n):
    w = T.Writer(str(tmp_path / "f"), "x", np.uint32, length=8, batch=4)
    w.add(1, np.arange(n, dtype=np.uint32))
    path, *_ = w.close()
    assert len(T.TokenFile(path)) == n // 8

import json
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tideline.llm.harmonic import Packer, WordEncoder, drops_space, pack
from tideline.llm.token_prefix import PrefixCounter, count_tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [*"ab e.,!?\n  \t中文字🙂́ñß\"'()[]{}0123456789ÀİIıΣς\x1c\x85\xa0　\x00ǅ½²Ⅷ▁�", "'s", "'T", "<|endoftext|>", "<s>", "</s>", "THE", "the", "ing."]


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    c = PrefixCounter(PIECES)
    for t in texts + odd_texts(1500):
        assert c.count(t) == len(sp.encode(t)), t


def test_every_prefix_and_truncation_equals_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    c = PrefixCounter(PIECES)
    for t in [t[:200] for t in texts[:15]] + odd_texts(100):
        want = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert list(c.prefix_counts(t)) == want
        assert c.fit(t, 7) == max(i for i, n in enumerate(want) if n <= 7)


def test_count_tokens_of_odd_rows(odd_docs, no_docs):
    got = count_tokens(odd_docs, PIECES, 4096, tables=True, budgets=(3, 50)).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert (by[4].n_bytes, by[4].n_tokens, by[4].over_limit, by[4].prefix_tokens) == (0, 0, False, [0])
    assert by[7].over_limit and by[7].prefix_tokens[-1] == by[7].n_tokens
    assert by[1].prefix_tokens[by[1].fits[1]] <= 50
    assert count_tokens(no_docs, PIECES, 4096).count() == 0


def test_word_encoder_equals_the_library(texts):
    from tokenizers import Tokenizer

    tok, w = Tokenizer.from_file(WORDS), WordEncoder(WORDS, cached=300)
    for t in texts[:60] + odd_texts(1500):
        assert list(np.frombuffer(w.encode(t), "<u4")) == tok.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, tokens):
    """Every id lies in one piece, sequences have no gaps and fit, and little is empty."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == tokens.keys()
    for d, pieces in by_doc.items():
        ids, at = tokens[d], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return sum(map(len, tokens.values())) / (2048 * len(by_seq))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert check_packing(pack(docs, WORDS, 1, with_ids=False).collect(), tokens) > 0.98


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = pack(odd_docs, WORDS, 1).collect()
    assert all(len(r.ids) == r.length for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.length, r.ids) for r in by[4]] == [(1, [1])]
    assert len([r for r in rows if r.doc_id == 9]) == 2 and len([r for r in by[None] if r.start == 0]) == 2
    assert pack(no_docs, WORDS, 1).count() == 0


def test_classes_fill_their_bins():
    p = Packer(2048, 64, 0)
    rng = random.Random(4)
    for n in [rng.randint(1, 9000) for _ in range(3000)] + list(range(1, 2100)):
        pieces = p.cut(n)
        assert sum(pieces) == n and all(0 < x <= 2048 for x in pieces)
        for x in pieces:
            placed = p.place(x, x)
            if placed:
                assert sum(q for q, _, _ in placed) > 2048 - 70


def test_other_vocabularies_are_encoded_whole(texts):
    """A file whose model keeps white space, or does not lower case, has no runs of its own."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, w = Tokenizer.from_file(path), WordEncoder(path)
    assert not w.by_run and WordEncoder(WORDS).by_run
    for t in texts[:40] + odd_texts(200):
        assert w.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    spec = json.loads(Tokenizer.from_file(WORDS).to_str())
    assert drops_space(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"post_processor": {"type": "x"}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}]}}):
        assert not drops_space(spec | change)


def test_models_that_normalise_are_rejected():
    class Folding:
        def encode(self, text, out_type=None):
            return [c if c != " " else "▁" for c in " " + unicodedata.normalize("NFKC", text)]

    class NoPrefix:
        def encode(self, text, out_type=None):
            return [c if c != " " else "▁" for c in text]

    for model in (Folding(), NoPrefix()):
        with pytest.raises(ValueError, match="normalises"):
            PrefixCounter._check(model)

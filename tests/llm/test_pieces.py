import random
import struct
from pathlib import Path

import numpy as np
import pytest

from impulsar.llm.pieces import DEFAULT_MODEL, PieceModel, _fields, count_chunk, count_part, encode_chunk, encode_part, read_model
from impulsar.llm.sentencepiece_codec import Decoder, Encoder, decode, encode
from impulsar.llm.token_counts import Counter, count_tokens

from .tables import documents, empty, frame

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not Path(DEFAULT_MODEL).exists(), reason="no tokenizer files")


def texts():
    rng = random.Random(5)
    fixed = ["", " ", "  a  b ", "a\tb\nc", "ﬁ x", "İ", " " * 90 + "x", "a▁b", "\x00a", "日本語 テスト", "x" * 5000, " " * 40, "😀😀 a😀", "word.\nNext,word", "ſK"]
    noise = ["".join(rng.choice("the in er  \n.,aeiou1é▁ÜB-") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    return fixed + noise + ["".join(rng.choice("abcdefghij") for _ in range(3000))]


def unigram(data):
    """The model as a unigram model with small whole scores, which 32-bit sums hold exactly and which tie often."""
    model, out = PieceModel(data), b""
    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])
    for i, (piece, kind) in enumerate(zip(model.pieces, model.types, strict=True)):
        body = b"\x0a" + size(len(piece.encode())) + piece.encode() + b"\x15" + struct.pack("<f", -(i * 7919 % 23) - 1.0 if kind == 1 else 0.0) + (b"\x18" + bytes([kind]) if kind != 1 else b"")
        out += b"\x0a" + size(len(body)) + body
    for number, value in _fields(data):
        if number in (2, 3):
            value = value.replace(b"\x18\x02 ", b"\x18\x01 ", 1) if number == 2 else value
            out += bytes([number << 3 | 2]) + size(len(value)) + value
    return out


@pytest.mark.parametrize("make", [lambda d: d, unigram])
def test_like_the_tokenizer(make):
    data = make(read_model())
    truth, model = sentencepiece.SentencePieceProcessor(model_proto=data), PieceModel(data)
    encoder, decoder, counter = Encoder(model), Decoder(model), Counter(model)
    for text in texts():
        ids = truth.encode(text)
        assert encoder.encode(text).tolist() == ids, text
        assert counter.count(text) == len(ids), text
        assert decoder.decode(np.array(ids, dtype="<i4")) == truth.decode(ids), text


def test_streaming_equals_whole():
    model = PieceModel(read_model())
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("thinerandou") for _ in range(rng.randint(1, 100)))
        assert encode_part(model, text) == encode_chunk(model, text)
        assert count_part(model, text) == count_chunk(model, text) == len(encode_chunk(model, text))


def test_operators(spark):
    rows = documents()
    docs = frame(spark, rows)
    encoded = encode(docs)
    back = decode(encoded.select("doc_id", "ids", "source"))
    assert sorted((r["text"] for r in back.collect())) == sorted((t or "") for _, t, _ in rows)
    truth = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    counts = count_tokens(docs).collect()
    assert sorted(r["n_tokens"] for r in counts) == sorted(len(truth.encode(t or "")) for _, t, _ in rows)
    assert encode(empty(spark)).count() == count_tokens(empty(spark)).count() == 0

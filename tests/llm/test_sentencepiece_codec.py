import struct

import pytest
import sentencepiece
from llm_cases import EDGES, table

from ticketlens.llm import sentencepiece_codec as S

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", "a", " lead", "two  spaces ", "a" * 300, "===---===", "<s> </s> <unk> <0x0A>", "\n\n\t", "日本語😀", "Mixed Ünïcode, words."]


def _number(field, value):
    out, value = [], (value << 0)
    key = field << 3
    for part in (key, value):
        while part > 127:
            out.append(part & 127 | 128)
            part >>= 7
        out.append(part)
    return bytes(out)


def _bytes(field, data):
    size, out = len(data), []
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes([field << 3 | 2, *out, size]) + data


def unigram_model():
    """A small unigram model with byte fallback, written as a protobuf."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    words = ["▁", "▁the", "▁cat", "c", "a", "t", "s", "at", "th", "e", "h", "▁s", "▁sat", "he"]
    pieces += [(w, -1.5 - 0.7 * k, 1) for k, w in enumerate(words)]
    body = b"".join(_bytes(1, _bytes(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + _number(3, t)) for p, s, t in pieces)
    trainer = _number(3, 1) + _number(4, len(pieces)) + _number(35, 1)
    normaliser = _bytes(1, b"identity") + _number(3, 1) + _number(4, 0) + _number(5, 1)
    return body + _bytes(2, trainer) + _bytes(3, normaliser)


@pytest.mark.parametrize("data", [open(MODEL, "rb").read(), unigram_model()], ids=["bpe", "unigram"])
def test_parity_with_the_original_library(data):
    tokenizer, original = S.build_tokenizer(S.parse_model(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in [*TEXTS, "the cats sat at the hat", "theses"]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == original.encode(text)
        assert tokenizer.decode(ids, skip_special_tokens=False) == text == original.decode(ids)


def test_exact_round_trip_of_a_table(spark):
    rows = EDGES + [(100 + k, t) for k, t in enumerate(TEXTS)]
    got = S.encode(table(spark, rows, clashing=True), MODEL).collect()
    assert len(got) == len(rows) and all(r.parity and r.n_tokens == len(r.token_ids) for r in got)
    assert sorted((r.doc_id or -1, r.decoded) for r in got) == sorted((i or -1, t or "") for i, t in rows)
    assert all((r.n_tokens == 0) == (r.decoded == "") for r in got)
    assert S.encode(table(spark, []), MODEL).count() == 0


@pytest.mark.parametrize("data", [open(MODEL, "rb").read(), unigram_model()], ids=["bpe", "unigram"])
def test_codec_equals_the_library_alone(data):
    codec = S.Codec(data)
    texts = [*TEXTS, "▁marker ▁", "  ", "the cats sat"]
    ids, back, same = codec.run(texts, 2)
    library = [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids == library and all(same)
    assert back == codec.tokenizer.decode_batch(library, skip_special_tokens=False)
    # Bytes that are no text on their own.
    lone = [i for i, (_, _, kind) in enumerate(S.parse_model(data).pieces) if kind == S.BYTE][0xC3:0xC5]
    assert codec.decode(lone) == codec.tokenizer.decode(lone, skip_special_tokens=False)


def test_own_ids_are_returned_where_the_libraries_differ():
    codec = S.Codec(unigram_model())
    codec.original = type("Other", (), {"encode": lambda self, texts, num_threads: [[1] for _ in texts]})()
    ids, _, same = codec.run(["the cat"], 1)
    assert ids[0] != [1] and same == [False]


def test_models_of_other_markers_are_refused():
    # Field 24 of the trainer: markers behind words; field 5 of the normaliser: plain spaces.
    for extra in (_bytes(2, _number(24, 1)), _bytes(3, _number(5, 0))):
        with pytest.raises(ValueError, match="not supported"):
            S.parse_model(extra)

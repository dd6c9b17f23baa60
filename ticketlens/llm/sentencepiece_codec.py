"""SentencePiece models on the tokenizers library: built from the model's protobuf, encoded in multithreaded batches."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
BATCH_CHARS = 1_000_000
THREADS = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested messages and 4 or 8 byte values stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = 4 if wire == 5 else 8
            if wire == 2:
                size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    collapse_spaces: bool


def parse_model(data: bytes) -> PieceModel:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            parts = dict(_fields(value))
            score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
            pieces.append((parts[1].decode("utf-8"), score, parts.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if trainer.get(24, 0) or not normaliser.get(5, 1):
        raise ValueError("models with markers behind words or with plain spaces are not supported")
    return PieceModel(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""),
                      bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """Every cut of a piece into two pieces, best score first; cuts of one piece from the left."""
    known = {piece for piece, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted(((-score, place, piece) for place, (piece, score, kind) in enumerate(model.pieces)
                     if kind in (NORMAL, USER_DEFINED) and len(piece) > 1))
    return [(piece[:cut], piece[cut:]) for _, _, piece in ranked for cut in range(1, len(piece))
            if piece[:cut] in known and piece[cut:] in known]


def build_tokenizer(model: PieceModel):
    """A tokenizers.Tokenizer that encodes as the model does.

    Normaliser: the compiled character map, folded spaces where the model asks
    for them, the leading marker, and the marker in place of spaces. A text is
    encoded as a whole, so that pieces may reach over any of its places.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        inner = models.Unigram([(piece, score) for piece, score, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        inner = models.BPE({piece: i for i, (piece, _, _) in enumerate(model.pieces)}, _merges(model),
                           unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True,
                           byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of kind {model.kind} have no pieces to rebuild")
    tokenizer = Tokenizer(inner)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if model.kind == UNIGRAM:
        # Control and byte pieces never stand for their own letters: a text that spells one is cut after its first letter.
        reserved = [piece for piece, _, kind in model.pieces if kind not in (NORMAL, USER_DEFINED) and len(piece) > 1]
        cuts = "|".join(f"{re.escape(piece[0])}(?={re.escape(piece[1:])})" for piece in reserved)
        if cuts:
            tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(cuts), "isolated")
    tokenizer.decoder = decoders.Sequence([
        decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(),
        *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """The tokenizer of a model, and the original library to compare with."""

    def __init__(self, data: bytes):
        import sentencepiece
        from tokenizers import normalizers

        model = parse_model(data)
        self.tokenizer = build_tokenizer(model)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.letters = [bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(SPACE, " ").encode() for piece, _, kind in model.pieces]
        self.prefix = model.dummy_prefix
        # A normaliser of markers alone is two built-in string functions; the library takes a third of its time for it.
        self.plain = not model.charsmap and not model.collapse_spaces
        self.inner = build_tokenizer(model)
        if self.plain:
            self.inner.normalizer = normalizers.Sequence([])

    def marked(self, text: str) -> str:
        """The text as the inner tokenizer takes it: with its markers, if they are all that the normaliser does."""
        if not self.plain or not text:
            return text
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, encoded in one multithreaded batch."""
        return [e.ids for e in self.inner.encode_batch_fast(list(map(self.marked, texts)), add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: pieces and byte pieces in a row, markers as spaces, without the leading one."""
        try:
            text = b"".join(map(self.letters.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # bytes that are no text have the library's own replacement
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def run(self, texts: list[str], threads: int) -> tuple[list[list[int]], list[str], list[bool]]:
        """Ids and decoded text of each text, and whether the original library gives the same ids."""
        own = self.encode(texts)
        same = [mine == theirs for mine, theirs in zip(own, self.original.encode(texts, num_threads=threads))]
        return own, list(map(self.decode, own)), same


_BUILT: dict[bytes, Codec] = {}


def _ready(data: bytes, threads: int) -> Codec:
    """The codec of this worker, built once per model."""
    key = hashlib.sha256(data).digest()
    if key not in _BUILT:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _BUILT[key] = Codec(data)
    return _BUILT[key]


def _portions(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with at most ``most`` characters, or of one longer text."""
    start = held = 0
    for place, text in enumerate(texts):
        if place > start and held + len(text) > most:
            yield start, place
            start, held = place, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text", threads: int = THREADS) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``token_ids``, ``decoded`` and ``parity``.

    The model file is read once on the driver and sent along (its size is
    fixed by the vocabulary). Batches are encoded by several threads and
    decoded again. The ids are those of the rebuilt tokenizer; ``parity`` says
    for every text whether the original library, given the whole text, has the
    same ones. Null texts count as empty: no tokens, decoded empty.
    Characters that have no piece become byte pieces, so that decoding gives
    the text back, except that the marker itself comes back as a space.
    """
    with open(model_path, "rb") as file:
        data = file.read()
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
        T.StructField("parity", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _ready(data, threads)
        for batch in batches:
            # A part of a batch at a time, so that a batch of long texts is never held several times over.
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = part.column(1).to_pylist()
                for start, end in _portions(texts, BATCH_CHARS):
                    ids, decoded, same = codec.run(texts[start:end], threads)
                    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(bounds[-1]))
                    yield pa.record_batch([
                        part.column(0).slice(start, end - start), pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
                        pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=schema.fieldNames())

    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)

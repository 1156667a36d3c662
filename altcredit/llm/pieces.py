"""Vocabulary of a SentencePiece model, and where a text can be cut without changing its pieces.

The model's bytes go to the tasks (half a megabyte; ``MODEL_BYTES`` is the limit). Models must
write white space as the usual mark and keep it, with a dummy mark before the text, and not
rewrite characters; ``Vocabulary`` checks that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from altcredit.llm import kernels as K

MARK = "▁"
MODEL_BYTES = 64 << 20
#: normalizer_spec { add_dummy_prefix: false }
NO_DUMMY_PREFIX = bytes([0x1A, 2, 0x18, 0])


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read()
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{path} has {len(model)} bytes, more than the {MODEL_BYTES} that go to each task")
    return model


def _fields(message: bytes):
    """Number and value of each field of a serialised message, in order."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            value = number()
        else:
            size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


def is_bpe(model: bytes) -> bool:
    """Whether trainer_spec { model_type } says BPE; the last value counts, none means unigram."""
    kinds = [kind for n, spec in _fields(model) if n == 2 for m, kind in _fields(spec) if m == 3]
    return kinds[-1:] == [2]


class Vocabulary:
    """Pieces as bytes, with a space for the mark; byte pieces as their byte."""

    def __init__(self, model: bytes):
        import sentencepiece

        of = sentencepiece.SentencePieceProcessor(model_proto=model)
        if of.decode(of.encode(" a  b\u00e9e\u0301 ")) != " a  b\u00e9e\u0301 ":
            raise ValueError("the model rewrites characters or drops white space")
        # A later value of a field in a serialised message replaces the earlier one.
        of = self.library = sentencepiece.SentencePieceProcessor(model_proto=model + NO_DUMMY_PREFIX)
        self.bpe = is_bpe(model)
        size = of.get_piece_size()
        self.byte_id = np.full(256, -1, np.int32)
        self.bytes: list[bytes] = []
        normal = np.zeros(size, bool)
        for i in range(size):
            piece = of.id_to_piece(i)
            if of.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif of.is_unknown(i) or of.is_control(i):
                self.bytes.append(b"")
            else:
                normal[i] = True
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.normal = np.flatnonzero(normal)
        self.scores = np.array([of.get_score(i) for i in range(size)])
        self.joint = np.zeros((256, 256), bool)
        for i in self.normal.tolist():
            b = np.frombuffer(self.bytes[i], np.uint8)
            at = np.flatnonzero((b & 0xC0) != 0x80)[1:]
            self.joint[b[at - 1], b[at]] = True


def marked(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with spaces for marks and one space before each that isn't empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.replace_substring(column.fill_null("").cast(pa.large_utf8()), MARK, " ")
    space, nothing = pa.scalar(" ", pa.large_utf8()), pa.scalar("", pa.large_utf8())
    led = pc.binary_join_element_wise(space, column, nothing)
    return K.flat(pc.if_else(pc.equal(pc.binary_length(column), 0), column, led))


def segments(data: np.ndarray, offsets: np.ndarray, joint: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts cut wherever no piece holds the two characters, and the index of each text's first segment."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[1:-1] = ~joint[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
    cut[offsets] = True
    at = np.flatnonzero(cut)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    return K.texts(data, at, pa.large_binary()), np.searchsorted(at, offsets)

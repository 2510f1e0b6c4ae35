"""The public SentencePiece model: its pieces, and how texts split where no piece can cross."""

from __future__ import annotations

import re

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Pre-tokens: spaces lead a word, a line feed stands alone. No piece crosses from one to the next (checked
#: when a model is loaded).
_PRETOKENS = re.compile(r" *[^ \n]+| +|\n")


def load_proto(path: str | None = None):
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    n = proto.normalizer_spec
    if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only models that keep texts as they are and add a leading space are supported")
    for p in proto.pieces:
        if p.type in (NORMAL, USER_DEFINED) and ("\n" in p.piece or re.search(f"[^{SPACE}]{SPACE}", p.piece)):
            raise ValueError(f"the piece {p.piece!r} crosses pre-tokens")
    return proto


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a non-empty text, with the leading space the model adds; U+2581 counts as a space."""
    return _PRETOKENS.findall(" " + text.replace(SPACE, " "))

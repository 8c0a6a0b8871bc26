"""Token ids of texts, unit by unit, exactly as the tokenizers' own libraries give them for whole texts.

Both tokenizers here are local: no token reaches over a place where a space follows something that is neither white space
nor invisible. So a text is cut there, and each unit is encoded on its own, once for all its repeats in a block of texts.

Why this is exact. Byte-level BPE first cuts texts by a pattern in which spaces occur only as the first character of a
piece or in pieces of white space alone, and whose only look ahead is for white space at the end of a run; so a piece ends before such a
space, and no piece before or after depends on what is beyond. The piece model merges neighbours only to pieces of its
vocabulary, and none of these has a space after another character (piece_bpe() checks this and refuses others); it adds
one space in front of what it encodes, which is the very space a unit starts with. Characters that any version of Unicode counts as white space, and invisible ones next to them, are no places to cut, nor is the
sign that the piece model writes for a space, nor are spaces at a text's end. A special string without spaces lies in one unit, with the white space before it.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np

#: White space of every Unicode version, zero-width characters, and the sign for a space in piece models
NEVER = r"\s\u180e\u200b-\u200d\u2060\ufeff\u2581"
#: Units a library encodes at once: what it returns takes far more memory than ids
AT_ONCE = 4096
ODD = re.compile(rf"[{NEVER}] | \Z")
CUT = re.compile(rf"(?<=[^{NEVER}]) (?= *[^ ])")


def units(text: str) -> list[str]:
    """The units of a space and text, without the space that each starts with."""
    return CUT.split(text) if text[:1] == " " or ODD.search(text) else text.split(" ")


class Numbers(dict):
    """Numbers keys in the order they are asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encoded(encode, texts: list[str], front: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, how many each has)."""
    ids, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(texts), AT_ONCE):
        own = texts[i : i + AT_ONCE]
        lists = encode([front + t for t in own] if front else own)
        n.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(n[-1].sum())))
    return np.concatenate(ids), np.concatenate(n)


@cache
def byte_bpe(path: str, plain: bool = True):
    """A function from texts to lists of ids, without special tokens around them; special strings inside are plain text, or their tokens if not plain."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    own.encode_special_tokens = plain
    return lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def byte_bpe_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    # the byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary = Tokenizer.from_file(path).get_vocab()
    found = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        found[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return found


@cache
def piece_bpe(path: str):
    """A function from texts to lists of ids; the model adds a space in front."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(re.search("[^\u2581]\u2581", own.id_to_piece(i)) for i in range(own.get_piece_size())):
        raise ValueError(f"{path}: a piece holds a space after another character")
    return lambda texts: own.encode(texts, num_threads=1)


@cache
def piece_bpe_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a piece model."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]

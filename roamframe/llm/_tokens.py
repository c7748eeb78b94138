"""Byte-level BPE ids of whole texts.

A text goes through the encoder in one call.  Very long ones go in blocks, cut before a
single space between two words, where no pre-token of this tokenizer family crosses; the
encoder's pattern can't match very long runs of white space, so those are merged as the
one piece that the pattern makes of them.  The vocabulary file is a parameter and is read
where the work runs.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import public_tokenizers
import tiktoken

#: The characters with Unicode's White_Space property.
_WHITE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space of this length is a piece of its own; a block has at least BLOCK_LENGTH characters.
RUN_LENGTH, BLOCK_LENGTH = 2048, 1 << 18
_LONG_RUN = re.compile(f"[{_WHITE}]{{{RUN_LENGTH},}}")
_CUT = re.compile(f"[^{_WHITE}] (?=[^{_WHITE}])")
DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
# The added token of this vocabulary, which its file takes out of a text before anything else.
ADDED_TOKENS = {"<|endoftext|>": 50256}

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def _packed(ids: list[int]) -> bytes:
    return np.asarray(array("I", ids), dtype="<u4").tobytes()


def _blocks(text: str, start: int, end: int) -> Iterator[str]:
    while end - start > BLOCK_LENGTH and (cut := _CUT.search(text, start + BLOCK_LENGTH, end)):
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:end]


def encoder(vocabulary: str = DEFAULT_VOCABULARY, added: Mapping[str, int] = ADDED_TOKENS) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian unsigned 32-bit bytes.

    The strings in ``added`` are those ids wherever they stand in a text, as in the tokenizer's file by
    default; with none they are ordinary text.
    """
    if vocabulary not in _ENCODINGS:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[vocabulary] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoding = _ENCODINGS[vocabulary]

    def plain(text: str) -> bytes:
        if len(text) < RUN_LENGTH:
            return _packed(encoding.encode_ordinary(text))
        parts, start = [], 0
        for run in _LONG_RUN.finditer(text):
            # the last character of a run goes to what follows it
            end = run.end() - (run.end() < len(text))
            parts += [_packed(encoding.encode_ordinary(block)) for block in _blocks(text, start, run.start())]
            parts.append(_packed(encoding._encode_single_piece(text[run.start() : end])))
            start = end
        parts += [_packed(encoding.encode_ordinary(block)) for block in _blocks(text, start, len(text))]
        return b"".join(parts)

    if not added:
        return plain
    cuts = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")
    ids = {token: np.array([n], dtype="<u4").tobytes() for token, n in added.items()}
    known = tuple(added)

    def encode(text: str) -> bytes:
        if not any(token in text for token in known):
            return plain(text)
        return b"".join(ids[part] if part in ids else plain(part) for part in cuts.split(text))

    return encode

"""Byte-level BPE vocabularies inside tasks, and safe places to cut long texts.

A text may be cut before a space that stands between two letters: the splitting
pattern ends a match behind the first letter whatever came before it, and begins the
next one with the space, so the tokens of the two parts are those of the whole.
Strings of special tokens hold no spaces, so no cut goes through one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import regex

#: A letter before a space and a letter.
_SAFE = regex.compile(r"\p{L}(?= \p{L})")
#: Code points of a part of a long text, unless it has no safe place.
PART_CHARS = 65_536
#: UTF-8 bytes that one call encodes.
BATCH_BYTES = 1 << 20


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """text cut into parts of about `size` code points at safe places only."""
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size - 1)
        if not found:
            break
        parts.append(text[at : found.end()])
        at = found.end()
    parts.append(text[at:])
    return parts


def byte_batches(texts: list[str], most: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """(owner of each part, parts) in batches of `most` UTF-8 bytes or little more."""
    owners, parts, held = [], [], 0
    for owner, text in enumerate(texts):
        for part in safe_parts(text):
            owners.append(owner)
            parts.append(part)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= most:
                yield owners, parts
                owners, parts, held = [], [], 0
    if parts:
        yield owners, parts


@lru_cache(maxsize=4)
def rank_encoding(rank_file: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """A tiktoken encoding of a local rank file; each worker process loads it once."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)

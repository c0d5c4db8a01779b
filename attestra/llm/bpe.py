"""Byte-level BPE ids with a bounded cache of space-delimited pieces.

A single space between two non-space characters always begins a pre-token, so a text
falls apart there and the pieces' ids can be kept. Texts with other white space beside
a space are encoded whole. The vocabulary's ranks and the tokenizer file hold the same
vocabulary, so the ids are those of the tokenizer file; its added tokens, which it finds
in a text before all else, are cut out of the text first.
"""

from __future__ import annotations

import base64
import re

import numpy as np

#: Pieces kept per worker; the cache starts anew beyond.
CACHE_PIECES = 400_000


class _Pieces(dict):
    """piece -> little-endian unsigned 32-bit ids of " piece"; None where the piece cannot stand alone."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            found = None
        else:
            found = np.asarray(self.encode(" " + piece), dtype="<u4").tobytes()
        self[piece] = found
        return found


class ByteBpe:
    """Ids of byte_bpe_50k by path of its ranks file (tiktoken form)."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = _Pieces(self.encode)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; added tokens are read as plain text."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            if len(self.pieces) > CACHE_PIECES:
                self.pieces.clear()
            try:
                return np.asarray(self.encode(first), dtype="<u4").tobytes() + b"".join(map(self.pieces.__getitem__, rest))
            except TypeError:  # a piece that cannot stand alone
                pass
        return np.asarray(self.encode(text), dtype="<u4").tobytes()


    def ids_with_added(self, text: str, added: dict[str, int]) -> bytes:
        """ids(), with the added tokens that the text holds as one id each."""
        if not any(token in text for token in added):
            return self.ids(text)
        parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
        return b"".join(added[p].to_bytes(4, "little") if k % 2 else self.ids(p) for k, p in enumerate(parts))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def load(ranks_path: str, pattern: str) -> ByteBpe:
    """One encoder per worker."""
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _LOADED[ranks_path, pattern]


def default_vocabulary() -> dict[str, str]:
    import public_tokenizers as vocabularies

    return {"ranks_path": vocabularies.path("byte_bpe_50k.tiktoken"), "pattern": vocabularies.PATTERN}


def added_tokens() -> dict[str, int]:
    """Text and id of the tokenizer file's added tokens, which have no flags set (checked)."""
    import json

    import public_tokenizers as vocabularies

    with open(vocabularies.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that do not stand for their text alone")
    return {t["content"]: t["id"] for t in tokens}

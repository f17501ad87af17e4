"""Token ids of byte-level BPE vocabularies, as the tokenizers library gives them.

Texts are encoded by the same vocabulary's ranks and pattern, which takes a quarter of the
library's time; a text with a special token's string, or with white space that the pattern can't
cut, goes to the library.  Tests hold the ids of all whole texts of a table, and of odd
ones, equal to the library's.
"""

from __future__ import annotations

import base64
import os
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from ledgerloom.llm.common import worker_cache

#: Longest text whose ids are made as Python numbers; those of longer ones stay in a buffer.
LISTED_POINTS = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Files of one vocabulary: for the tokenizers library, and as ranks."""

    tokenizer_file: str
    rank_file: str


def default_vocabulary() -> Vocabulary:
    import public_tokenizers as public

    return Vocabulary(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"))


def library(vocabulary: Vocabulary):
    """The tokenizers library's tokenizer, one a worker, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache("tokenizers")
    if vocabulary.tokenizer_file not in cache:
        from tokenizers import Tokenizer

        cache[vocabulary.tokenizer_file] = Tokenizer.from_file(vocabulary.tokenizer_file)
    return cache[vocabulary.tokenizer_file]


def rank_encoder(vocabulary: Vocabulary):
    """Encoder of texts without special tokens over the vocabulary's ranks, to bytes; None
    for a text that it can't cut."""
    cache = worker_cache("ranks")
    if vocabulary.rank_file not in cache:
        import public_tokenizers as public
        import tiktoken

        with open(vocabulary.rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("units", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> bytes | None:
            try:
                if len(text) <= LISTED_POINTS:
                    return little_endian(encoding.encode_ordinary(text))
                return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except BaseException as e:
                # the pattern gives up on very long runs of white space
                if isinstance(e, ValueError) or type(e).__name__ == "PanicException":
                    return None
                raise

        cache[vocabulary.rank_file] = encode
    return cache[vocabulary.rank_file]


def special_strings(vocabulary: Vocabulary) -> tuple[str, ...]:
    """The added tokens that the vocabulary's file lists, longest first."""
    added = library(vocabulary).get_added_tokens_decoder().values()
    return tuple(sorted((t.content for t in added), key=lambda s: (-len(s), s)))


class IdEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the library gives them."""

    def __init__(self, vocabulary: Vocabulary):
        self.library, self.specials = library(vocabulary), special_strings(vocabulary)
        self.by_ranks = rank_encoder(vocabulary)

    def _by_library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [little_endian(x.ids) for x in found]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text."""
        out = [None if any(s in t for s in self.specials) else self.by_ranks(t) for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._by_library([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out


def little_endian(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def piece_bounds(length: int, capacity: int) -> Sequence[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole ones at the end, the rest first."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

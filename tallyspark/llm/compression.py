"""Compressed lengths under raw-content zstandard dictionaries, for texts cut into windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import zstandard

from tallyspark.llm.arrays import NUMBER, char_classes

PART_CHARS = 2**20  # of one text that is handled at once


_NOT_WORD = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1)
def _number_signs() -> frozenset[str]:
    r"""Numbers that ``\w`` holds beside the digits, such as the half and the circled one."""
    return frozenset(map(chr, np.flatnonzero(char_classes() == NUMBER))) - frozenset("0123456789")


def letters(text: str | None) -> str:
    """Lower-case words with one space between; empty without a letter."""
    found = _NOT_WORD.sub(" ", (text or "").lower())
    if not found.isascii() and not _number_signs().isdisjoint(found):
        found = " ".join("".join(" " if c in _number_signs() else c for c in found).split())
    return found.strip()


def parts(text: str) -> Iterator[str]:
    """The text in parts of about ``PART_CHARS``, cut between words."""
    at = 0
    while at < len(text):
        cut = _NOT_WORD.search(text, at + PART_CHARS)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Dictionary:
    """Compresses short windows with ``content`` before them, as if it had just been read."""

    def __init__(self, content: bytes, thorough: bool = False, min_match: int = 4, table_log: int = 17):
        quiet = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        how = zstandard.ZstdCompressionParameters.from_level(6, strategy=zstandard.STRATEGY_LAZY2 if thorough else zstandard.STRATEGY_GREEDY, min_match=min_match, window_log=18, hash_log=table_log, chain_log=table_log, search_log=6 if thorough else 4, target_length=64, **quiet)
        if content[:4] == b"\x37\xa4\x30\xec":  # would be read as a trained dictionary
            content = b" " + content
        held = zstandard.ZstdCompressionDict(content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        self._compress = zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress

    def sizes(self, parts: list[bytes]) -> list[int]:
        return [len(x) for x in map(self._compress, parts)]


def windows(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]

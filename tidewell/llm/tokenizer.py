"""Encoders of the public byte-level BPE vocabulary, kept per Python worker.

The ranks file and the JSON file hold one vocabulary; the ranks encoder is several times faster and gives the same
ids (tests compare them). Texts that its pattern engine gives up on (very long runs of one class) go to the other.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np

#: A run this long of characters without white space, or of white space, goes to the JSON encoder.
LONG_RUN = 20_000


@functools.lru_cache(maxsize=4)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


@functools.lru_cache(maxsize=4)
def _json(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _long_runs():
    import re

    return re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


def encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to ids as the tokenizer file's own encode(text, add_special_tokens=False) gives them. path: the JSON file;
    if a .tiktoken file of that name lies beside it, it serves the common case."""
    import os

    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    beside = path.removesuffix(".json") + ".tiktoken"

    def slow(text: str) -> np.ndarray:  # loaded where a text needs it, as it takes much of a worker's memory
        return np.array(_json(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if not os.path.exists(beside):
        return slow
    fast, long_run = _ranks(beside), _long_runs()

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not long_run.search(text):
            return fast.encode_to_numpy(text, allowed_special="all")
        return slow(text)

    return encode

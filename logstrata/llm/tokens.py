"""Token ids of texts by a byte-level vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: The end-of-text mark, the only special token of the vocabulary.
MARK = "<|endoftext|>"


@lru_cache(maxsize=2)
def _rank_encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@lru_cache(maxsize=2)
def _json_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids as the JSON vocabulary gives them, by its faster rank file.

    Both hold the same vocabulary, and a test compares them. A text with the
    special token is encoded by the JSON file itself, which knows it, and so is
    one that the pattern of the rank file gives up on, as it does on runs of
    white space near a million characters.
    """

    def __init__(self, json_path: str, rank_path: str):
        self.json_path, self.ranks = json_path, _rank_encoder(rank_path)

    def ids(self, text: str) -> np.ndarray:
        if MARK not in text:
            try:
                return self.ranks.encode_to_numpy(text)
            except Exception:  # tiktoken names no type for it
                pass
        found = _json_encoder(self.json_path).encode(text, add_special_tokens=False)
        return np.array(found.ids, np.uint32)

"""Token ids of texts in bulk."""

from __future__ import annotations

import base64
import re

import numpy as np

#: The split pattern of byte-level BPE vocabularies of this kind (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: ``tiktoken`` has no stack for runs of white space far longer than this.
_LONG_SPACE = re.compile(r"\s{10000}")


class Encoder:
    """Ids as ``tokenizers`` gives them for the tokenizer file ``path``.

    ``ranks`` may name a file with the same vocabulary as ranks.  Texts are then encoded by
    ``tiktoken``, which gives the same ids four times as fast; texts in which the string of a
    special token occurs, or a run of 10,000 white-space characters, still go through ``tokenizers``.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special) and not _LONG_SPACE.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One for each worker process and file."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]

"""Token ids of the public byte-level vocabulary, shared by packing and counting."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

JSON_NAME = "byte_bpe_50k.json"
RANKS_NAME = "byte_bpe_50k.tiktoken"
#: Characters for which both libraries are tested to split texts alike.
_OTHER = re.compile("[^\x00-ɏ]")


def default_path(name: str = JSON_NAME) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids by the ``tokenizers`` file ``path``. Special tokens' strings are ordinary text, or, with ``special``, the
    special ids that the file gives them.

    If the same vocabulary lies beside it as a rank file, texts of Latin characters go
    through that (the same ids, several times faster); all others go through the file itself, which is loaded
    when the first of them comes.
    """

    def __init__(self, path: str, special: bool = False):
        self.path, self.special, self._exact = path, special, None
        self.fast, self.apart = None, None
        if special:
            with open(path, encoding="utf-8") as f:
                added = [t["content"] for t in json.load(f).get("added_tokens") or []]
            self.apart = re.compile("|".join(map(re.escape, added))) if added else None
        ranks = path[: -len(".json")] + ".tiktoken" if path.endswith(".json") else ""
        if ranks and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=pairs, special_tokens={})

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._exact = Tokenizer.from_file(self.path)
            self._exact.encode_special_tokens = not self.special
        return self._exact

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of one whole text; null is empty."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and not _OTHER.search(text) and not (self.apart and self.apart.search(text)):
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = False) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, special)

"""Token ids of whole texts, by a public tokenizer file given by path."""

from __future__ import annotations

import json
import os

import numpy as np

#: The end-of-document id that every document gets after its own ids.
END_ID = 0

_open: dict[str, "Ids"] = {}


def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class Ids:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``.

    Byte-level BPE files whose merges stand in the order of their ids (which
    is checked on opening) are encoded by tiktoken from the same vocabulary,
    four times as fast and equal id by id. Any other file, and any text that
    holds a special token's string, goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            import public_tokenizers
            import tiktoken

            merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
            vocabulary, byte_of = model["vocab"], _byte_of()
            if [vocabulary[m] for m in merged] == list(range(256, 256 + len(merged))):
                ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
                self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of the text, none for null or empty."""
        if not text:
            return np.empty(0, "<u4")
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def ids_of(path: str) -> Ids:
    """One per worker and file."""
    if path not in _open:
        _open[path] = Ids(path)
    return _open[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

"""Token ids of a byte-level BPE vocabulary file, as the tokenizers library gives them."""

from __future__ import annotations

import json

import numpy as np

#: How a byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes to id, if ids rise in the order of the merges, so that ids can serve as ranks; else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    bytes_, special = byte_of(), {t["content"] for t in spec.get("added_tokens", ())}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in pairs]
    if None in ids or ids != sorted(ids) or any(c not in bytes_ for t in model["vocab"] if t not in special for c in t):
        return None
    return {bytes(bytes_[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Encoder:
    """Encodes texts with the ids of the tokenizers file at `path`.

    Where the file is a plain byte-level BPE the same merges run in tiktoken,
    four times as fast; texts that hold one of the file's special strings, and
    all texts of other files, go through tokenizers.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        ranks = _ranks(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids, without added special tokens."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

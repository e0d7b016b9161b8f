"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

A text of up to CHUNK characters is encoded at once.  A longer one is encoded
in chunks that overlap, with the offsets of all tokens.  Two chunks are spliced
at a place in their overlap where both have a token boundary and which is proven
stable: a single space between two letters or digits, in a vocabulary none of
whose entries goes over such a place, so that no merge could have crossed it.
If the overlap has none it is doubled, at last to the whole chunk, which then
grows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_of
from .common import map_arrow

CHUNK = 1 << 15
OVERLAP = 256


def _characters(text: str, places: list[int]) -> list[int]:
    """Places in UTF-8 bytes as places in characters."""
    if text.isascii():
        return places
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    character = np.concatenate([np.cumsum((data & 0xC0) != 0x80) - 1, [len(text)]])
    return character[places].tolist()


#: A letter or digit, or a broken character, before a space.
_OVER = re.compile(r"[^\W_] |\ufffd ")
_BYTES = byte_of()


def _plain(entry: str) -> str:
    """The text of an entry of a byte-level vocabulary; broken characters become U+FFFD."""
    return bytes(_BYTES[c] for c in entry if c in _BYTES).decode("utf-8", "replace")


class Counter:
    """Counts tokens with the library for the vocabulary file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.chunk, self.overlap = chunk, overlap
        self.batch: Callable[[list[str]], list[int]]
        self.starts: Callable[[str], list[int]]
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.starts = lambda text: _characters(text, [p.begin for p in model.encode(text, return_type="proto").pieces])
            vocabulary = [model.id_to_piece(i).replace("▁", " ") for i in range(model.vocab_size())]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self.batch = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
            self.starts = lambda text: [a for a, _ in model.encode(text, add_special_tokens=False).offsets]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            vocabulary = [*map(_plain, spec["model"]["vocab"]), *(t["content"] for t in spec.get("added_tokens", ()))]
        #: Whether no entry goes from a letter or digit over a space.
        self.provable = not any(_OVER.search(v) for v in vocabulary)

    @staticmethod
    def _stable(text: str, at: int) -> bool:
        return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1].isalnum() and text[at + 1].isalnum()

    def long(self, text: str) -> int:
        """Tokens of a text of any length."""
        if not self.provable or len(text) <= self.chunk:
            return self.batch([text])[0]
        count, begin, end = 0, 0, self.chunk
        left, cut = self.starts(text[:end]), 0  # tokens of text[begin:end]; those from `cut` on are not counted yet
        while end < len(text):
            overlap, place = self.overlap, None
            while place is None and overlap < end - cut:
                start = end - overlap
                to = min(len(text), start + self.chunk)
                right = [start + a for a in self.starts(text[start:to])]
                ours = {begin + a for a in left}
                for a in right[1:]:
                    at = a if text[a : a + 1] == " " else a - 1
                    if at > start and at + 1 < end and self._stable(text, at) and a in ours:
                        place = at
                        break
                overlap *= 2
            if place is None:
                end = min(len(text), end + self.chunk)
                left = self.starts(text[begin:end])
                continue
            count += sum(cut <= begin + a < place for a in left)
            begin, end, cut = start, to, place
            left = [a - start for a in right]
        return count + sum(cut <= begin + a for a in left)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        short = [k for k, t in enumerate(texts) if len(t) <= self.chunk or not self.provable]
        out = dict(zip(short, self.batch([texts[k] for k in short]), strict=True))
        return [out[k] if k in out else self.long(t) for k, t in enumerate(texts)]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", *, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, over_limit), one for each row of `docs`.

    A null text is empty and has 0 bytes and the library's count for it; ids
    may be null or repeated; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    made: dict = {}

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made["counter"] = Counter(tokenizer, chunk, overlap)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(made["counter"].count([t or "" for t in batch.column("text").to_pylist()]), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = map_arrow(source, piece, f"id {kind}, n_bytes long, n_tokens long", "text")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

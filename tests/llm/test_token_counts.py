import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kerbside.llm.token_counts import Counter, token_counts

FILES = ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("chunk,overlap", [(700, 8), (2000, 64)])
def test_spliced_counts_are_exact(name, chunk, overlap, sample):
    rng = random.Random(3)
    c, one = Counter(public_tokenizers.path(name), chunk, overlap), library(name)
    assert c.provable
    texts = [r.text for r in sample.collect()][:40]
    texts += ["".join(rng.choice("ab   \n.é😀中") for _ in range(3000)) for _ in range(6)] + ["x" * 5000, " " * 3000, "ab " * 2000, "a  b" * 900, "é" * 2500 + " ok " + "ñ" * 2500, "</s> <s> <|endoftext|> " * 300]
    assert c.count(texts) == [one(t) for t in texts]


def test_operator(docs, empty):
    one = library(FILES[0])
    rows = token_counts(docs, public_tokenizers.path(FILES[0]), limit=20).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len((d.text or "").encode()), one(d.text or ""), one(d.text or "") > 20) for d in docs.collect())
    assert token_counts(empty, public_tokenizers.path(FILES[0])).collect() == []

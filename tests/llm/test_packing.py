import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kerbside.llm.bpe import Encoder
from kerbside.llm.packing import cut, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def best_fit(lengths, capacity):
    """Best fit, longest first, one document at a time; ties to any sequence."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_fills_rooms_as_best_fit_does():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.randint(5, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        used: dict[int, list] = {}
        for n, slots in plan(histogram, capacity).items():
            assert [s[0] for s in slots] == [0, *[s[1] for s in slots[:-1]]] and slots[-1][1] == histogram[n]
            for a, b, first, each, offset in slots:
                for rank in range(a, b):
                    used.setdefault(first + (rank - a) // each, []).append((offset + (rank - a) % each * n, n))
        rooms = []
        for places in used.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= capacity
            rooms.append(capacity - at)
        assert sorted(rooms) == best_fit(lengths, capacity)


def test_cut():
    assert cut(5, 10) == [(0, 5)] and cut(10, 10) == [(0, 10)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_ids_are_those_of_the_library(library):
    rng = random.Random(2)
    encoder = Encoder(PATH)
    assert encoder.fast is not None
    texts = ["".join(rng.choice("aé 'sS1٣²\n\t  中😀.-_%<|endoftext|>") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["<|endoftext|>", "a<|endoftext|>b", " x", "it's  we'll", "x" * 5000, " " * 3000, "\r\n\x85\x0b"]
    for t in texts:
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, texts, library, capacity=1024):
    sequences = {}
    by_doc = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, a, n) for k, (a, n) in enumerate(cut(len(ids), capacity))]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got]
    return len(sequences)


def test_sample(sample, library):
    rows = pack(sample, PATH).collect()
    n = check(rows, [(r.doc_id, r.text) for r in sample.collect()], library)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1


def test_edge_cases(docs, empty, library):
    rows = pack(docs, PATH, capacity=64).collect()
    assert sum(r.start == 0 for r in rows) == docs.count()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert pack(empty, PATH).collect() == []

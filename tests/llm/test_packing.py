import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardstat.llm import packing
from boardstat.llm.queries import TOKENIZER
from boardstat.llm.tokens import encode_whole

from .fixtures import ODD_TEXTS, documents


def one_by_one(lengths, capacity):
    """Best fit of single pieces, longest first: the rooms left of the sequences."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_is_best_fit_of_single_pieces(lengths, capacity):
    plan = packing.best_fit(Counter(lengths), capacity)
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset in plan:
        for k in range(n):
            held[sequence + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
    for slots in held.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))]
    assert sorted(capacity - sum(n for _, n in s) for s in held.values()) == one_by_one(lengths, capacity)


def test_plan_size_does_not_grow_with_the_counts():
    small = packing.best_fit({n: 1000 for n in range(1, 2049)})
    large = packing.best_fit({n: 1_000_000_000 for n in range(1, 2049)})
    assert len(large) < 2 * len(small) < 100_000


def test_a_piece_that_does_not_fit_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit({3000: 1})


def check(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in held.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))]
        assert sum(n for _, n in slots) <= capacity
    return len(held)


def test_documents_as_placed_pieces(spark):
    docs = documents(spark)
    rows = packing.pack_documents(docs, TOKENIZER, with_ids=True).collect()
    check(rows, 2048)
    pieces = defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None:
            pieces[r["doc_id"]].append(r)
    for i, text in enumerate(ODD_TEXTS):
        ids = encode_whole(TOKENIZER, [text or ""])[0] + [0]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        copies = 2 if i == 1 else 1
        assert [r["start"] for r in mine] == [s for s in range(0, len(ids), 2048) for _ in range(copies)]
        for r in mine:
            part = ids[r["start"]:r["start"] + 2048]
            assert r["ids"] == part and r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())


def test_a_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 16)
    parts = spark.createDataFrame([(i, 30 if i % 3 else 7 + i % 11, i % 2) for i in range(500)], "k long, length long, n long")
    rows = packing.pack(parts, ["k"], 100).collect()
    assert sorted(r["k"] for r in rows) == list(range(500))
    lengths = [30 if i % 3 else 7 + i % 11 for i in range(500)]
    assert check(rows, 100) == len(one_by_one(lengths, 100))


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), TOKENIZER).collect() == []

import random

import pytest

from factloom.llm.packing import best_fit, carried, pack_documents
from factloom.llm.tokens import encoding, DEFAULT_VOCABULARY


def one_by_one(sizes, capacity):
    """Best fit, one item after another in order of falling size: what each container holds, which ties don't change."""
    boxes = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in boxes if capacity - sum(b) >= s]
        if fit:
            min(fit, key=lambda b: capacity - sum(b)).append(s)
        else:
            boxes.append([s])
    return sorted(map(sum, boxes))


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_rounds_over_ranges(spark, ranges):
    rnd = random.Random(ranges)
    for most in (50, 20):
        sizes = [rnd.choice([7, 7, 7, 12, rnd.randrange(1, most)]) for _ in range(250)]
        items = spark.createDataFrame([(i, 1, s) for i, s in enumerate(sizes)], "id long, piece int, size int")
        placed, opened = best_fit(items, 50, ranges)
        boxes = {}
        for r in placed.collect():
            boxes.setdefault(r.box, []).append(r.size)
        assert sorted(s for b in boxes.values() for s in b) == sorted(sizes)
        assert max(map(sum, boxes.values())) <= 50 and max(boxes) < opened
        best = one_by_one(sizes, 50)
        if ranges == 1:
            assert sorted(map(sum, boxes.values())) == best
        assert len(boxes) <= 1.03 * len(best) + 1


def test_carried_counts():
    assert carried({0: (1, 9), 1: (3, 5), 3: (9, 2)}, {0: (2, 8), 2: (5, 4)}) == [(1, 0, 2, 0, 2, 1), (3, 0, 9, 2, 5, 2)]


def test_documents_are_packed_whole(spark):
    rnd = random.Random(6)
    texts = [(i, " ".join(["word"] * rnd.choice([3, 3, 3, rnd.randrange(1, 90)]))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "word " * 170), (None, "word")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, size int")
    got = pack_documents(df, id="doc_id", text="text", capacity=64, ranges=1).collect()
    enc = encoding(DEFAULT_VOCABULARY)
    want = {i: len(enc.encode_ordinary(t)) for i, t in texts if t and i is not None}
    have, boxes = {}, {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
        boxes[r.container] = boxes.get(r.container, 0) + r.n_tokens
        assert r.n_tokens == r.token_to - r.token_from and r.is_split == (want[r.doc_id] > 64)
    assert have == want and max(boxes.values()) <= 64
    sizes = [s for n in want.values() for s in [64] * ((n - 1) // 64) + [n - (n - 1) // 64 * 64]]
    assert sorted(boxes.values()) == one_by_one(sizes, 64)
    assert pack_documents(spark.createDataFrame([], df.schema), id="doc_id", text="text").collect() == []

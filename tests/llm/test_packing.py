import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import EDGE, make_documents, prose

from sparrowdex.llm import common as C
from sparrowdex.llm import packing as P

PATH = C.tokenizer("word_bpe_49k.json")


def test_plans_hold_every_piece_once_and_never_too_much():
    rng = random.Random(0)
    for _ in range(300):
        capacity = rng.choice([10, 30, 100])
        lengths = dict(Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 60))))
        got = Counter()
        for n, held in P.plan(lengths, capacity):
            assert n > 0
            assert sum(size * each for size, each in held) <= capacity
            for size, each in held:
                got[size] += n * each
        assert got == Counter(lengths)


def fewest(sizes, capacity):
    """The least number of bins, by trying all ways."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b >= sizes[i]:
                rest = list(bins)
                rest.remove(b)
                go(i + 1, [*rest, b - sizes[i]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_the_reduction_costs_no_sequence():
    """After the reduction, the sets fixed and the best for the rest are as few as the best for all."""
    rng = random.Random(4)
    for _ in range(150):
        sizes = [rng.randint(2, 20) for _ in range(rng.randint(1, 9))]
        left = dict(Counter(sizes))
        fixed = P.reduce(left, 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)


def test_few_sequences():
    rng = np.random.default_rng(0)
    x = np.clip(rng.lognormal(6.8, 1, 50_000).astype(int), 1, 4096)
    lengths = {int(a): int(b) for a, b in zip(*np.unique(x, return_counts=True), strict=True)}
    assert sum(n for n, _ in P.plan(lengths)) <= 1.001 * -(-int(x.sum()) // 4096)


def pieces(rows, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out = []
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(i, p, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes())) for p, at in enumerate(range(0, len(ids), length))]
    return sorted(out, key=str)


def check(out, rows, length):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == pieces(rows, length)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= length


@pytest.mark.parametrize("length", [4096, 64])
def test_a_round_trip_of_edges(spark, edge, nothing, length):
    check(P.pack(edge, PATH, length).collect(), EDGE, length)
    assert P.pack(nothing, PATH, length).count() == 0


def test_a_hot_length(spark):
    rng = random.Random(2)
    rows = [(i, "one and the same" if i % 3 else prose(rng, rng.randint(1, 60)), "en", "src0") for i in range(600)]
    check(P.pack(make_documents(spark, rows), PATH, 64).collect(), rows, 64)


def test_a_pair_is_not_fixed_where_three_fit_beside_the_largest():
    sizes = [11, 10, 7, 3, 3, 3, 3]
    left = dict(Counter(sizes))
    fixed = P.reduce(left, 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20) == 2


def test_the_reduction_costs_no_sequence_in_larger_ones():
    """Sizes of which several together often fill what one leaves."""
    rng = random.Random(12)
    instances = [[50, 45, 45, 16, 16, 16, 10]]
    for _ in range(1500):
        few = [rng.choice([50, 45, 40, 34, 33, 25, 20, 17, 16, 15, 11, 10, rng.randint(1, 100)]) for _ in range(rng.randint(3, 6))]
        instances.append([rng.choice(few) for _ in range(rng.randint(6, 10))])
    for sizes in instances:
        left = dict(Counter(sizes))
        fixed = P.reduce(left, 100)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + (fewest(rest, 100) if rest else 0) == fewest(sizes, 100), sizes

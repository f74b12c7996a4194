import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from fixtures import frame, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pactline.llm import best_fit_packing as bp

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_and_sequences(llm_spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.choice([1, 30, 200, 900])), "en", "s", 1) for i in range(40)]
    rows += [(60, "see <|endoftext|> here", "en", "s", 1), (61, "x" * 5000, "en", "s", 1), *odd_rows()]
    tok = Tokenizer.from_file(FILE)
    want = []
    for i, x, *_ in rows:
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = bp.pack_documents(frame(llm_spark, rows), FILE).collect()
    assert sorted((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == sorted(want)
    held = defaultdict(list)
    for g in got:
        held[g.sequence_id].append((g.offset, g.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= -(-sum(w[3] for w in want) // 1024) + 2
    assert bp.pack_documents(frame(llm_spark, []), FILE).count() == 0


def fewest(items, cap):
    """The fewest bins, by search over all sets for the largest item."""
    items = tuple(sorted(items, reverse=True))
    best = {(): 0}

    def solve(rest):
        if rest not in best:
            head, tail = rest[0], rest[1:]
            low = len(rest)
            for n in range(len(tail) + 1):
                for c in combinations(range(len(tail)), n):
                    if head + sum(tail[k] for k in c) <= cap:
                        low = min(low, 1 + solve(tuple(x for k, x in enumerate(tail) if k not in c)))
            best[rest] = low
        return best[rest]

    return solve(items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=8))
def test_dominance_keeps_an_optimal_packing(items):
    counts = np.bincount(items, minlength=21) if items else np.zeros(21, int)
    fixed, rest = bp.dominance(counts)
    assert all(sum(lengths) <= 20 for lengths, _ in fixed)
    left = [n for n in range(21) for _ in range(rest[n])]
    assert sum(k for _, k in fixed) + fewest(left, 20) == fewest(items, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_covers_every_rank_once(items):
    counts = np.bincount(items, minlength=65) if items else np.zeros(65, int)
    place = {}
    for n, first, m, k, base, at in bp.plan(counts):
        for rank in range(m * k):
            key = (n, first + rank)
            assert key not in place
            place[key] = (base + rank // m, at + rank % m * n)
    used = defaultdict(list)
    for (n, _), (b, at) in place.items():
        used[b].append((at, n))
    assert sum(len(v) for v in used.values()) == len(items)
    for v in used.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 64

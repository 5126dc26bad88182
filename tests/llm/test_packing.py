import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideline.llm import packing, tokens


def spread(rows):
    """Contents of every sequence from plan rows."""
    bins = defaultdict(list)
    for length, lo, hi, base, offset in rows:
        for k in range(hi - lo):
            bins[base + k].append((offset, length))
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=0, max_size=120))
def test_plan_places_every_piece_once_without_gaps(lengths):
    bins = spread(packing.plan_bins(Counter(lengths), 64))
    assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
        assert sum(n > 64 // 3 for _, n in b) <= 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_plan_is_near_the_bound(lengths):
    bins = spread(packing.plan_bins(Counter(lengths), 64))
    assert len(bins) <= 11 / 9 * (-(-sum(lengths) // 64) + sum(n > 32 for n in lengths)) + 2


def test_plan_size_does_not_follow_the_counts():
    rng = random.Random(1)
    counts = {n: rng.randrange(1, 10**9) for n in range(1, 2049)}
    rows = packing.plan_bins(counts)
    assert len(rows) < 100_000
    assert sum(hi - lo for n, lo, hi, *_ in rows) == sum(counts.values())
    used = max(base + hi - lo for _, lo, hi, base, _ in rows)
    assert used <= 1.03 * sum(n * c for n, c in counts.items()) / 2048


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.plan_bins({0: 1})


def expected_pieces(rows, capacity):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p in range(-(-len(ids) // capacity)):
            part = ids[p * capacity : (p + 1) * capacity]
            out[(r[0], p, p * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    return out


@pytest.mark.parametrize("capacity", [2048, 50])
def test_pieces_and_places(edge, capacity):
    got = packing.pack_documents(edge, capacity).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected_pieces([tuple(r) for r in edge.collect()], capacity)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity


def test_empty_table(empty):
    assert packing.pack_documents(empty).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    rng = random.Random(2)
    signs = "abcSTMDrevl'''’ \t\n019²½ªµºÀÖ×ÞßáÿĀ<|.,!_-\x1c\x85\xa0\x00😀éİ"
    latin = [c for c in signs if ord(c) < 256]
    texts = ["".join(rng.choice(latin if k % 3 else signs) for _ in range(rng.randrange(40))) for k in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>", "'street it's they'll're ''s \"'s", "", None]
    encode = tokens.encoder(tokens.vocabulary())
    ids, bounds = encode.encode(texts)
    whole = encode.whole([t or "" for t in texts])
    assert all(ids[bounds[i] : bounds[i + 1]].tolist() == whole[i].tolist() for i in range(len(texts)))

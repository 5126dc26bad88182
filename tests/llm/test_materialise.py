from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideline.llm import materialise
from tideline.session import durable, scratch_path


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_slots_are_a_permutation(n, key):
    order = materialise.Feistel(n, key)
    slot = order.slot(np.arange(n))
    assert sorted(slot.tolist()) == list(range(n))
    assert (order.number(slot) == np.arange(n)).all()


def test_slots_mix_and_depend_on_the_key():
    a, b = (materialise.Feistel(10_000, k).slot(np.arange(10_000)) for k in (1, 2))
    assert (a != b).mean() > 0.99
    assert abs(np.corrcoef(np.arange(10_000), a)[0, 1]) < 0.05


@pytest.mark.parametrize(("length", "per_shard"), [(512, 16_384), (16, 100)])
def test_shards_hold_the_tokenizers_ids(spark, edge, length, per_shard):
    docs = durable(edge)
    folder = f"{scratch_path(spark)}/shards"
    manifest = durable(materialise.materialise(docs, folder, 7, length, per_shard)).orderBy("slot").collect()
    assert [r["slot"] for r in manifest] == list(range(len(manifest)))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for p in range(-(-len(ids) // length)):
            want[(r["doc_id"], p, tuple(ids[p * length : (p + 1) * length]))] += 1
    stored = list(materialise.read_slots(folder, 0, len(manifest), length, per_shard))
    got = Counter((r["doc_id"], r["piece"], tuple(s[: r["length"]].tolist())) for r, s in zip(manifest, stored, strict=True))
    assert got == want
    middle = len(manifest) // 2
    assert all((a == b).all() for a, b in zip(materialise.read_slots(folder, middle, middle + 5, length, per_shard), stored[middle : middle + 5], strict=True))
    # written again, everything is where it was
    again = durable(materialise.materialise(docs, folder, 7, length, per_shard)).orderBy("slot").collect()
    assert again == manifest


def test_order_by_spark(spark):
    rows = materialise.slot_order(spark, 1000, 3).collect()
    assert sorted(r["slot"] for r in rows) == list(range(1000))


def test_empty_table(spark, empty):
    docs = durable(empty)
    assert materialise.materialise(docs, f"{scratch_path(spark)}/shards").count() == 0

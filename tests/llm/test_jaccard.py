import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import components, jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def roots(sets, percent=75):
    """Smallest index that links reach, by comparing all pairs."""
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def expected(rows):
    sets = [shingles(r["text"]) for r in rows]
    group = defaultdict(list)
    for r, root in zip(rows, roots(sets), strict=True):
        group[root].append(r["doc_id"])
    out = Counter()
    for r, s, root in zip(rows, sets, roots(sets), strict=True):
        ids = [i for i in group[root] if i is not None]
        out[(r["doc_id"], len(s), (min(ids) if ids else None) if s else r["doc_id"])] += 1
    return out


@pytest.mark.parametrize(("part_keys", "heavy"), [(2_000_000, jaccard.HEAVY), (150, 8)])
def test_components_match_all_pairs(edge, part_keys, heavy):
    """Also with blocks in many parts, and with most keys taken as heavy."""
    got = jaccard.jaccard_components(edge, part_keys=part_keys, heavy=heavy)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == expected(edge.collect())


def test_one_of_each_component_stays(edge):
    rows = edge.collect()
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns
    sets = [shingles(r["text"]) for r in rows]
    members = defaultdict(list)
    for r, s, root in zip(rows, sets, roots(sets), strict=True):
        members[root if s else (r["doc_id"], r["text"])].append(r)
    got = kept.collect()
    assert len(got) == len(members)
    for own in members.values():
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert sum((r["doc_id"], r["text"]) in {(o["doc_id"], o["text"]) for o in own if o["doc_id"] == (min(ids) if ids else None)} for r in got) == 1


def test_empty_table(empty):
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.one_of_each(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 25), min_size=1, max_size=14), min_size=2, max_size=14, unique=True), st.sampled_from([50, 75, 90]), st.sampled_from([1, 3, 64]))
def test_trie_links_span_the_components(sets, percent, lot):
    made = jaccard.block_links([np.array(sorted(s), np.uint64) for s in sets], percent, lot)
    want = roots(sets, percent)
    for a, b in made:
        both = len(sets[a] & sets[b])
        assert 100 * both >= percent * len(sets[a] | sets[b])
    parent = list(range(len(sets)))
    for a, b in made:
        x, y = parent[a], parent[b]
        parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert [min(i for i, q in enumerate(parent) if q == p) for p in parent] == want


def test_a_block_of_thousands_of_near_copies():
    """Copies of one page that each differ from it in one word: every one replaces five shingles of 36."""
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**63, 36).astype(np.uint64)
    sets = []
    for _ in range(8000):
        own = base.copy()
        at = int(rng.integers(0, 32))
        own[at : at + 5] = rng.integers(1, 2**63, 5).astype(np.uint64)
        sets.append(np.unique(own))
    start = time.perf_counter()
    links = jaccard.block_links(sets, 75)
    assert time.perf_counter() - start < 4
    assert len(links) == 8000 - 32  # only copies that differ in the same word are near enough


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 60), min_size=1, max_size=50), min_size=2, max_size=12), st.sampled_from([50, 75, 90]))
def test_signatures_miss_no_pair(sets, percent):
    hashed = [np.sort(jaccard.mix(np.array(sorted(s), np.uint64))) for s in sets]
    found = jaccard.partners(np.array([len(s) for s in sets]), [jaccard.signature(h) for h in hashed], percent)
    for i, a in enumerate(sets):
        similar = any(100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets) if j != i)
        assert found[i] or not similar


def test_signatures_part_sets_that_share_a_passage():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.sort(np.concatenate([passage, rng.integers(0, 2**63, 200, dtype=np.uint64)])) for _ in range(50)]
    assert not jaccard.partners(np.full(50, 260), [jaccard.signature(s) for s in sets], 75).any()


def test_trie_shares_paths():
    trie = jaccard.Trie([np.array(s, np.uint64) for s in ([1, 2, 3], [1, 2, 4], [1, 2], [5])])
    assert sorted(trie.size.tolist()) == [1, 2, 3, 3]
    inner = [i for i, end in enumerate(trie.ends.tolist()) if end == 0]
    assert trie.hi[inner[0]] - trie.lo[inner[0]] == 3  # {1, 2} ends where the longer two go on


def test_star_contractions(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            if parent[a] != low or parent[b] != low:
                parent[a] = parent[b] = low
                changed = True
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == parent


def test_short_texts_and_their_hashes():
    texts = ["a b c d", "a b c d e", "ab c", "a bc", "a b c", "", "A  b\tc"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    sets = jaccard.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [len(s) for s in sets] == [1, 1, 1, 1, 1, 0, 1]
    assert sets[4][0] == sets[6][0] and len({int(s[0]) for s in sets if len(s)}) == 5


def test_clashing_columns_stay_as_they_are(spark):
    names = ["_row", "cls", "n", "root", "_in_text", "a.b"]
    texts = ["one two three four five six", "one two three four five six", "other words that stand alone here", None]
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], ["doc_id", "text", *names])
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.where("doc_id <> 1").collect()))

import hashlib
import random
import re
from collections import Counter

import xxhash

from tideline.llm import spotsigs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_signatures(text, bits=31):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    parts = [[]]
    for w in words:
        if w in spotsigs.ANCHORS:
            parts.append([w])
        else:
            parts[-1].append(w)
    out = set()
    for k, part in enumerate(parts[1:], 1):
        after = parts[k + 1][1 : 1 + spotsigs.CHAIN] if k + 1 < len(parts) else []
        out.add(" ".join((part[: spotsigs.CHAIN + 1] + after)[: spotsigs.CHAIN + 1]))
    for bare in [parts[0]] + [p[spotsigs.FAR :] for p in parts[1:]]:
        out |= {" ".join(bare[i : i + spotsigs.CHAIN + 1]) for i in range(len(bare))}
    return sorted({xxhash.xxh64_intdigest(s.encode(), 42) >> (64 - bits) for s in out})


def brute_print(text):
    sigs = brute_signatures(text)
    return f"{len(sigs)}:" + "".join(f"{h:08x}" for h in sigs[: spotsigs.KEPT])


def brute_likeness(a, b):
    a, b = brute_signatures(a), brute_signatures(b)
    if not a or not b:
        return float(a == b)
    low = sorted({*a[: spotsigs.KEPT], *b[: spotsigs.KEPT]})[: spotsigs.KEPT]
    both = {*a[: spotsigs.KEPT]} & {*b[: spotsigs.KEPT]} & {*low}
    return min(len(both) / len(low), min(len(a), len(b)) / max(len(a), len(b)))


def expected(rows):
    docs = {(r["doc_id"], r["text"] or "") for r in rows}
    assert len({d for d, _ in docs}) == len(docs), "the order of equal ids is the hash's"
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    copies = Counter((r["doc_id"], r["text"] or "") for r in rows)
    out = Counter()
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        out[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_print(text), brute_print(edited), round(brute_likeness(text, edited), 9), round(brute_likeness(text, after), 9))] += copies[doc_id, text]
    return out


def test_all_columns_match_brute_force(edge):
    docs = edge.where("doc_id IS NULL AND text LIKE 'one%' OR doc_id <> 13")
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in spotsigs.fingerprints(docs).collect())
    assert got == expected(docs.collect())


def test_equal_ids_are_all_there(edge):
    assert spotsigs.fingerprints(edge).count() == edge.count()
    assert spotsigs.near_counts(edge).count() == edge.count()


def test_rows_that_repeat_are_all_there(spark):
    docs = spark.createDataFrame([(1, "the old house"), (1, "the old house"), (None, "x"), (None, "x"), (2, "the new house")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_chars"]) for r in spotsigs.fingerprints(docs).collect())
    assert got == Counter({(1, 13): 2, (None, 1): 2, (2, 13): 1})


def test_one_document_follows_itself(spark):
    row = spotsigs.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0


def test_empty_table(empty):
    assert spotsigs.fingerprints(empty).count() == 0


def test_no_python_in_the_plan(edge):
    plan = spotsigs.fingerprints(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_are_shuffled_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = spotsigs.fingerprints(docs)
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the texts (read by both branches), what is told of them (twice), and what documents lend
    assert plan.count("ReusedExchange [text") == 1
    assert len(set(re.findall(r" Exchange hashpartitioning.*plan_id=(\d+)", plan))) == 4


def test_likeness_of_long_texts_is_exact(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join(words), " ".join(words[:1700] + [f"x{i}" for i in range(300)])]
    rows = spotsigs.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    own = [set(brute_signatures(t)) for t in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    for i, row in enumerate(rows):
        k = len(texts[i]) // 4
        edited = set(brute_signatures(texts[i][: len(texts[i]) - k] + texts[1 - i][:k]))
        assert abs(row["near_edited"] - jaccard(own[i], edited)) < 1e-12
        assert abs(row["near_next"] - jaccard(own[i], own[1 - i])) < 1e-12


def test_near_copies_anywhere_match_brute_force(spark, edge, small):
    docs = edge.select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    rows = sorted({(r["doc_id"], r["text"] or "") for r in docs.collect()}, key=str)
    sets = [frozenset(brute_signatures(t, 63)) for _, t in rows]
    copies = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = Counter()
    for i, (doc_id, _) in enumerate(rows):
        near = sum(1 for j, s in enumerate(sets) if j != i and (s == sets[i] or len(s & sets[i]) * 100 >= spotsigs.PERCENT * len(s | sets[i])))
        want[(doc_id, len(sets[i]), near)] += copies[rows[i]]
    got = spotsigs.near_counts(docs)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert Counter(tuple(r) for r in got.collect()) == want
    assert max(n for _, _, n in want) > 1

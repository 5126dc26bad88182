import hashlib
from collections import Counter, defaultdict

from tideline.llm import dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_groups_match_brute_force(edge):
    got = Counter(tuple(r) for r in dedup.mark_duplicates(edge).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == expected([tuple(r) for r in edge.collect()])


def test_a_full_filter_changes_nothing(edge):
    few = Counter(tuple(r) for r in dedup.mark_duplicates(edge, bits=8).collect())
    assert few == Counter(tuple(r) for r in dedup.mark_duplicates(edge).collect())


def test_filter_lets_single_rows_through(spark):
    keys = spark.range(2000).selectExpr("id AS doc_id", "sha2(cast(id % 1990 AS string), 256) AS k")
    tested = dedup.maybe_repeated(keys, "k", dedup.repeated_cells(keys, "k", 1 << 16), 1 << 16)
    maybe = {r["doc_id"] for r in tested.where("_maybe").collect()}
    assert {i for i in range(10)} | {1990 + i for i in range(10)} <= maybe
    assert len(maybe) < 100


def test_kept_rows_have_all_columns(edge):
    kept = dedup.drop_duplicates(edge)
    assert kept.columns == edge.columns
    rows = [tuple(r) for r in edge.collect()]
    best = {}
    for r in rows:
        key = (r[1] or "").translate(LOW)
        if key not in best or (r[0] is not None and (best[key] is None or r[0] > best[key])):
            best[key] = r[0]
    got = [((r["text"] or "").translate(LOW), r["doc_id"]) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(best.items(), key=repr)


def test_clashing_columns_stay_as_they_are(spark):
    names = ["_text_sha256", "_maybe", "_b0", "_bucket0", "_bitmap1", "_key", "_keep", "_row", "_in_text", "a.b"]
    df = spark.createDataFrame([(i, f"Text {i % 3}", *[f"{n}{i}" for n in names]) for i in range(7)], ["doc_id", "text", *names])
    kept = dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.where("doc_id >= 4").collect()))


def test_empty_table(empty):
    assert dedup.mark_duplicates(empty).count() == 0
    assert dedup.drop_duplicates(empty).count() == 0


def test_no_python_in_the_plan(edge):
    plan = dedup.mark_duplicates(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

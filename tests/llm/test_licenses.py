import random
import time
from collections import Counter

from tideline.llm import licenses
from tideline.llm.licenses import Automaton, words_of


def brute(text):
    words = words_of(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_matching_statistics():
    rng = random.Random(3)
    sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(6)]
    auto = Automaton(sequences)
    text = [rng.randrange(5) for _ in range(300)]
    state = length = 0
    for i, word in enumerate(text):
        state, length = auto.advance(state, length, word)
        fits = [n for n in range(0, 13) if n <= i + 1 and any(text[i + 1 - n : i + 1] == s[k : k + n] for s in sequences for k in range(len(s) - n + 1))]
        assert length == max(fits)
        if length:
            ends = {(s, k + length) for s, words in enumerate(sequences) for k in range(len(words) - length + 1) if words[k : k + length] == text[i + 1 - length : i + 1]}
            assert ends == auto.ends[state]


def test_base_columns(spark, edge):
    lines = ["Under the MIT license under the mit license", "apache license version 2", "Licensed under CC BY-NC 4.0.", "cc by", "mit license", "under the mité license", "x" * 50 + " CC-BY-NC cc by nc nc"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(more)
    rows = licenses.license_digest(licenses.license_scan(docs)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert got == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def labels(spark, text):
    return licenses.license_digest(licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()["labels"]


def test_notices_and_edits_of_them(spark):
    assert labels(spark, "This work is licensed under the GNU General Public License, version 3.") == "gpl-3"
    permission = licenses.TEMPLATES[1][1]
    assert labels(spark, "Foo bar. " + permission + " and more text") == "mit"
    words = permission.split(" ")
    edited = " ".join(words[:20] + ["surely"] + words[20:50] + ["not"] + words[52:])
    assert labels(spark, edited) == "mit"
    assert labels(spark, "permission is hereby given to read the license of this software") == ""
    assert labels(spark, "the of and is in to a by or the license version and is") == ""


def test_repeated_notices_give_spans_each(spark):
    text = " ".join(["Licensed under the Apache License, Version 2.0. foo bar baz"] * 500)
    row = licenses.license_digest(licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row["n_base"] == 500 and row["labels"] == "apache-2" and row["n_spans"] >= 1


def test_empty_table(empty):
    assert licenses.license_digest(licenses.license_scan(empty)).count() == 0


def test_a_long_anchor_behind_a_distant_short_one_is_found():
    assert (0, 1050, 1030) in licenses.chain([(0, 0, 1000), (10, 900, 20), (1020, 1020, 30)], 50)


def test_sister_licences_are_told_apart(spark):
    texts = {
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
        "Licensed under the Apache License, Version 1.1.": "apache-1.1",
        "Licensed under the Apache License, Version 2.0.": "apache-2",
        "This work is licensed under the GNU General Public License, version 1.": "gpl-1",
        "This work is licensed under the GNU General Public License.": "gpl",
        "This work is licensed under the GNU General Public License, version 7.": "",
        "Released under the BSD license.": "bsd",
        "Released under the MIT license.": "mit",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.license_digest(licenses.license_scan(docs)).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == list(texts.values())
    for label, text in licenses.TEMPLATES:
        assert label in labels(spark, "word " + text + " more").split(","), text


def brute_chains(anchors, gap):
    """The greatest number of covered words that any chain ending with each anchor has."""
    anchors = sorted(set(anchors))
    best = {}
    for d, t, n in anchors:
        options = [n]
        for (d0, t0, n0), b in best.items():
            if d0 < d and t0 < t and d - (d0 + n0) <= gap and d + n > d0 + n0 and t + n > t0 + n0:
                options.append(b + n - max(0, d0 + n0 - d, t0 + n0 - t))
        best[d, t, n] = max(options)
    return max(best.values(), default=0)


def test_best_chain_covers_as_much_as_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        anchors = [(rng.randrange(60), rng.randrange(60), rng.randint(1, 12)) for _ in range(rng.randint(1, 14))]
        assert max(c for _, _, c in licenses.chain(anchors, 10)) == brute_chains(anchors, 10)


def test_spans_do_not_overlap_and_a_long_text_takes_linear_time():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES, licenses.MIN_MATCH, licenses.MIN_COVERAGE, licenses.MAX_GAP)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in licenses.TEMPLATES for w in words_of(t)} | {w for p in licenses.PHRASES for w in p.split(" ")}))}
    notice = [vocabulary.get(w, -1) for w in words_of("Licensed under the Apache License, Version 2.0.")]

    def took(copies):
        runs = [(i * 20, notice) for i in range(copies)]
        start = time.perf_counter()
        _, spans = scanner.scan(runs)
        assert len(spans) >= copies / 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        return time.perf_counter() - start

    took(100)
    assert took(40_000) < 12 * max(took(8_000), 0.05)

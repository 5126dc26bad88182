"""The pipeline against its stages worked out by brute force, and the registered queries."""

import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from test_jaccard import roots, shingles

from tideline.llm import catalog
from tideline.session import durable

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_on_edge_rows(spark, edge):
    docs, kept = edge, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, ""))
        assert docs.columns == edge.columns, name
        kept[name] = docs.collect()
    start = edge.collect()
    known = kept["language_id"]
    assert all(re.search(r"[^\W\d_]", r["text"]) for r in known)
    best = {}
    for r in known:
        best.setdefault(r["text"].translate(LOW), set()).add(r["doc_id"])
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in best.items()}
    assert Counter((r["text"].translate(LOW), r["doc_id"]) for r in kept["exact_dedup"]) == Counter(top.items())
    rows = sorted(kept["exact_dedup"], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    first = {}
    for r, root in zip(rows, roots([shingles(r["text"]) for r in rows]), strict=True):
        first.setdefault(root, r["doc_id"])
    assert Counter(r["doc_id"] for r in kept["jaccard_join"]) == Counter(first.values())
    assert {r["doc_id"] for r in kept["source_mixing"]} <= {r["doc_id"] for r in kept["jaccard_join"]} <= {r["doc_id"] for r in start}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert pieces.where("piece = 0").count() == docs.count()


def test_language_stage_keeps_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert corpus_pipeline.language_id(spark, docs, small).count() == docs.where("text IS NOT NULL").count()


def test_empty_documents(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, ""))
        assert docs.count() == 0


def test_the_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES} == set(range(1, 14))
    assert set(catalog.QUERIES) <= set(names) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_every_query_gives_one_row_per_document(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name, plan in catalog.QUERIES.items():
        made = plan(spark, small)
        if "doc_id" not in made.columns:  # of other tables: tested with their operators
            continue
        ids = made.select("doc_id").distinct().count() if "length" in made.columns else made.count()
        assert ids == n, name

"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. Whole repeats of all its documents fill the target as far as they go; what
is left is a budget for a subset of its documents. The subset is chosen by *how many documents of each exact length*:
first the same share of every length, then long documents until the budget is small, then bounded-knapsack dynamic
programming over the remaining counts, which meets the budget exactly wherever some subset of these can. Small means at
least twice the longest document, so few and long documents are all left to the programme. Which documents of a
length are taken is settled by a seeded hash of doc_id. The fit sees counts by length only, never documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import SPACE, durable

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: The dynamic programme works on sums below twice this many words at least, and below four times the longest document.
WINDOW = 1 << 15
#: Where documents are long, sixteen of the longest are left to the programme if that is no more words than this.
ROOM = 1 << 21
CHUNKS = 256


def size_of(text: Column) -> Column:
    """Number of words (runs without white space) of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("bigint")


def fit_counts(counts: dict[int, int], budget: int, window: int = WINDOW) -> dict[int, int]:
    """How many documents of each length to take, of ``counts`` there are, to come as near to ``budget`` as can be found.

    Lengths are positive. The sum is exact where the documents left after the proportional part allow it. Where documents
    are long against ``window``, it grows with the longest, and the proportional part stops short of it.
    """
    total = sum(length * n for length, n in counts.items())
    if budget <= 0 or not total:
        return {}
    longest = max(counts)
    share = budget
    if 2 * longest > window:
        window = max(2 * longest, min(16 * longest, ROOM))
        share = max(0, budget - window)
    taken = {length: min(n, n * share // total) for length, n in counts.items()}
    rest = budget - sum(length * n for length, n in taken.items())
    for length in sorted(counts, reverse=True):
        if rest <= window:
            break
        more = min(counts[length] - taken[length], -(-(rest - window) // length), rest // length)
        taken[length] += more
        rest -= more * length
    if rest > window:
        # every document left is longer than the rest: one more of the shortest may come nearer
        left = min((length for length, n in counts.items() if taken[length] < n), default=None)
        if left is not None and left - rest < rest:
            taken[left] += 1
    if not 0 < rest <= window:
        return taken
    # reachable sums as the bits of an integer; a bounded count enters as powers of two
    limit = (1 << (2 * window + 1)) - 1
    sums, pieces = 1, []
    for length in sorted(counts):
        left = min(counts[length] - taken[length], 2 * window // length)
        part = 1
        while left > 0 and not sums >> rest & 1:
            use = min(part, left)
            grown = (sums | sums << (use * length)) & limit
            if grown != sums:
                pieces.append((length, use))
                sums = grown
            left -= use
            part *= 2
        if sums >> rest & 1:
            break
    near = (sums & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = sums >> rest
    over = (above & -above).bit_length() - 1
    if above and over < rest - near:
        near = rest + over
    for length, use, before in _backwards(pieces, 0, len(pieces), 1, (1 << (near + 1)) - 1):
        if not before >> near & 1:
            taken[length] += use
            near -= use * length
    return taken


def _backwards(pieces: list[tuple[int, int]], low: int, high: int, sums: int, limit: int) -> Iterator[tuple[int, int, int]]:
    """(length, number, reachable sums without it and those behind it) of pieces[low:high], the last one first.

    ``sums`` are those before pieces[low]. They are as wide as the window, which follows the longest document, so they are
    worked out again by halves: as many are held as the pieces can be halved, not one per piece.
    """
    if high - low == 1:
        yield *pieces[low], sums
    elif high > low:
        middle, later = (low + high) // 2, sums
        for length, use in pieces[low:middle]:
            later = (later | later << (use * length)) & limit
        yield from _backwards(pieces, middle, high, later, limit)
        yield from _backwards(pieces, low, middle, sums, limit)


def targets(totals: DataFrame) -> DataFrame:
    """(key, source, source_size) with ``target``: one row per source, which is all that this step handles.

    Sources by code point, null last, weigh 5, 2, 1, repeating. All words are shared by weight; a target stops at three
    times its source's size and the excess goes to the others by weight, until none is above.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (order % len(WEIGHTS) + 1).cast("int")))
    rows = rows.withColumn("most", (F.col("source_size") * MOST_REPEATS).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    # from the source that stops first: the level that all others would get if those before stop
    before = W.orderBy("ratio", "key").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = rows.withColumn("words", F.sum("source_size").over(everything).cast("double")).withColumn("weights", F.sum("weight").over(everything))
    level = (F.col("words") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("stops", F.col("ratio") < level)
    free = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    shared = F.col("words") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everything), F.lit(0.0))
    return rows.withColumn("target", F.when(F.col("stops"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * shared / free))).select("key", "source_size", "target")


def plan(sizes: DataFrame) -> DataFrame:
    """From (key, source, size, n) counts: (key, size, source_size, target, whole, extra) for each length of each source."""
    totals = sizes.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = sizes.select("key", "size", "n").join(targets(totals), "key")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = min(MOST_REPEATS, int(target / total + 1e-9)) if total else 0
        budget = 0 if whole == MOST_REPEATS else max(0, round(target - whole * total))
        taken = fit_counts({int(s): int(n) for s, n in zip(rows["size"], rows["n"], strict=True) if s > 0}, budget)
        return pd.DataFrame({"key": rows["key"], "size": rows["size"], "source_size": total, "target": target, "whole": whole, "extra": [taken.get(int(s), 0) for s in rows["size"]]})

    return wanted.groupBy("key").applyInPandas(fit, "key string, size bigint, source_size bigint, target double, whole int, extra bigint")


def mix(sized: DataFrame, counted: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """``sized`` (doc_id, source, size and any columns) with source_size, target and ``times``, how often the mix takes it.

    ``counted``: the same rows, narrow, to count from (default ``sized``; it is read twice). Rows that repeat are
    documents of their own. A document without words is taken as often as its source is repeated as a whole. Rows are
    ranked within hashed chunks of one length, so a length or source that many share is not one task.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("key")
    chunk = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(CHUNKS)).cast("int")
    counted = sized if counted is None else counted
    cells = durable(counted.select(key, "source", "size", chunk.alias("chunk")).groupBy("key", "source", "size", "chunk").agg(F.count("*").alias("n")))
    made = durable(plan(cells.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = cells.select("key", "size", "chunk", before.alias("before")).join(made, ["key", "size"])
    told = told.select(*[F.col(c).alias(f"_mix_{c}") for c in told.columns])
    columns = sized.columns
    rows = sized.withColumn("_mix_k", key).withColumn("_mix_c", chunk)
    rows = rows.join(told, (F.col("_mix_k") == F.col("_mix_key")) & (F.col("size") == F.col("_mix_size")) & (F.col("_mix_c") == F.col("_mix_chunk")))
    place = F.row_number().over(W.partitionBy("_mix_k", "size", "_mix_c").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id"))
    times = (F.col("_mix_whole") + F.when(place + F.col("_mix_before") <= F.col("_mix_extra"), 1).otherwise(0)).cast("int")
    return rows.select(*columns, F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), times.alias("times"))


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: ``taken`` counts the words with repeats."""
    sized = durable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size")))
    made = mix(sized, seed=seed)
    return made.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("bigint").alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    inner = [F.col(c).alias(f"_in_{c}") for c in docs.columns]
    sized = docs.select(*inner, "doc_id", "source", size_of(F.col("text").cast("string")).alias("size"))
    made = mix(sized, durable(sized.select("doc_id", "source", "size")), seed)
    again = made.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return again.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])

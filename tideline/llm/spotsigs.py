"""Document fingerprints by spot signatures (DataFrame functions only).

A spot is a common word (an anchor); its signature is the anchor with the chain of the next ``CHAIN`` content words,
where the next common word is passed over. A text is the set of its signatures. Where no anchor comes for long (lists,
texts in other languages) each word is an anchor, so that every text with a word has a signature.

The fingerprint is the number of signatures and the 31-bit hashes of all of them, in order. Nothing is cut: likenesses are
the exact Jaccard similarity of whole sets, for the edited text and for the next document alike.

Near copies anywhere (:func:`near_counts`): sets are partitioned by size so that only adjacent partitions can hold similar
ones, and meet by an inverted join on their rarest signatures. The lengths that remain behind a shared signature bound the
overlap; what is left is compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, durable, look_up

CHAIN = 2
#: Hashes that a fingerprint keeps; None is all. Likenesses never depend on it.
KEPT = None
#: Words between two anchors, or before the first, from this one on are anchors themselves.
FAR = 9
PERCENT = 75
#: What a document is known by: hashes of 64 bits of its doc_id with its text and of its text. They are columns of their
#: own: a struct's fields may be null once it is written and read, and a join then casts it and deals the texts out anew.
KEY = ("_a", "_b")

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have he in is it of on or that the this to was were which with "
    "als am auf aus bei das dem den der des die ein eine einen er es für im ist mit nicht oder sich sie und von war wie zu zum "
    "au aux avec ce dans de du elle en est et il la le les mais ne ou par pas pour que qui se sur un une "
    "al como con del el ella los las lo no para pero por son su y"
).split()


def _words(text: Column) -> Column:
    """Lower-case words with one space around each: runs of letters and digits."""
    return F.concat(F.lit(" "), F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))


def with_signatures(rows: DataFrame, text: str, out: str, bits: int = 31) -> DataFrame:
    """``rows`` with ``out``: the distinct signature hashes of the text, in order, of 31 bits, or up to 63 where signatures
    of a whole corpus are told apart.

    Null or no word: an empty array. Steps are columns of their own, since each is read more than once by the next.
    """
    mark = "\x01"
    anchors = "|".join(sorted(ANCHORS))
    col, rest = F.col, F.lit(1 << 30)
    # every anchor starts a part, and each part ends with a space: "anchor content content ... "
    rows = rows.withColumn("_parts", F.split(F.regexp_replace(_words(col(text)), rf" (?=(?:{anchors}) )", f" {mark}"), mark))
    rows = rows.withColumn("_spots", F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))))
    rows = rows.withColumn("_after", F.transform("_spots", lambda p: F.rtrim(F.substring_index(F.substring(p, F.instr(p, " ") + 1, rest), " ", CHAIN))))
    # a short chain goes on behind the next anchor
    rows = rows.withColumn("_zipped", F.arrays_zip(F.transform("_spots", lambda p: F.rtrim(F.substring_index(p, " ", CHAIN + 1))).alias("p"), F.slice("_after", F.lit(2), F.size("_after")).alias("n")))
    rows = rows.withColumn("_chains", F.transform("_zipped", lambda z: F.rtrim(F.substring_index(F.concat_ws(" ", z["p"], z["n"]), " ", CHAIN + 1))))
    # where no anchor comes for long, each word is one
    behind = F.transform("_spots", lambda p: F.substring(p, F.length(F.substring_index(p, " ", FAR)) + 2, rest))
    rows = rows.withColumn("_bare", F.filter(F.transform(F.concat(F.slice("_parts", 1, 1), behind), lambda t: F.trim(t)), lambda t: t != ""))
    rows = rows.withColumn("_runs", F.transform("_bare", lambda t: F.split(t, " ")))
    dense = F.flatten(F.transform("_runs", lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.concat_ws(" ", *[F.get(ws, i + k) for k in range(CHAIN + 1)]))))
    hashes = F.transform(F.concat(col("_chains"), dense), lambda s: F.shiftrightunsigned(F.xxhash64(s), 64 - bits).cast("int" if bits < 32 else "bigint"))
    rows = rows.withColumn(out, F.sort_array(F.array_distinct(hashes)))
    return rows.drop("_parts", "_spots", "_after", "_zipped", "_chains", "_bare", "_runs")


def fingerprint(signatures: str) -> Column:
    """A signature set as text: the size, a colon, and the hashes in hex. Equal texts have equal fingerprints."""
    kept = F.col(signatures) if KEPT is None else F.slice(signatures, 1, KEPT)
    return F.concat(F.size(signatures).cast("string"), F.lit(":"), F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), ""))


def with_likeness(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``rows`` with the Jaccard similarity, 0 to 1, of two signature sets.

    Two empty sets are alike, an empty and another are not.
    """
    rows = rows.withColumn("_both", F.size(F.array_intersect(a, b)))
    union = F.size(a) + F.size(b) - F.col("_both")
    return rows.withColumn(out, F.when(union == 0, F.lit(1.0)).otherwise(F.col("_both") / union)).drop("_both")


def with_next(ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id, _a, _b, n_chars, copies) with the ``_next_a``, ``_next_b`` of the row that follows by (doc_id, _a, _b); after the last comes the first.

    The rows are written in global order, one file per range; within a file they are linked by a window, and the last
    of a file with the first of the next, for which only one row per file is ordered as a whole.
    """
    order = [F.col("doc_id").asc_nulls_last(), *KEY]
    files = durable(ids.orderBy(*order)).withColumn("_file", F.col("_metadata.file_path"))
    here = W.partitionBy("_file").orderBy(*order)
    inside = files.withColumn("_next", F.lead(F.struct(*KEY)).over(here))
    first = files.groupBy("_file").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("_first"))
    by_file = W.orderBy("_first")
    whole = W.partitionBy()
    after = first.select("_file", F.coalesce(F.lead("_first").over(by_file), F.min("_first").over(whole)).alias("_after"))
    linked = inside.join(after, "_file")
    follow = F.coalesce(F.col("_next"), F.struct(*[F.col("_after")[k].alias(k) for k in KEY]))
    return linked.withColumn("_next", follow).select("doc_id", *KEY, "n_chars", "copies", *[F.col("_next")[k].alias(f"_next{k}") for k in KEY])


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, copies, edited, own, following): each text's edited form, its signatures and the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's. Documents are distinct (doc_id, text) pairs in this order; ``copies`` rows repeat each. Null texts are empty.
    A document is known by its ``KEY``.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_a", F.xxhash64("doc_id", "text")).withColumn("_b", F.xxhash64("text"))
    ids = rows.groupBy("doc_id", *KEY, F.char_length("text").cast("bigint").alias("n_chars")).agg(F.count("*").alias("copies"))
    links = durable(with_next(ids))
    back = links.select(*[F.col(f"_next{k}").alias(k) for k in KEY], *[F.col(k).alias(f"_to{k}") for k in KEY], F.floor(F.col("n_chars") / 4).cast("int").alias("_k"))
    told = durable(links.drop(*[f"_next{k}" for k in KEY]).join(back, [*KEY]))
    # the texts are shuffled once, with nothing but their keys; both what a document lends to the one before it (the
    # beginning of its text and all its signatures) and its own row come from there
    dealt = rows.drop("doc_id").repartition(*KEY).join(told, [*KEY]).dropDuplicates([*KEY])
    dealt = with_signatures(dealt, "text", "own")
    lent = dealt.select(*[F.col(f"_to{k}").alias(k) for k in KEY], F.substring(F.col("text"), F.lit(1), F.col("_k")).alias("_head"), F.col("own").alias("following"))
    made = dealt.join(lent, [*KEY])
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), keep), F.col("_head"))
    return made.select("doc_id", "n_chars", "copies", edited.alias("edited"), "own", "following")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, its edited text's, and their likeness and that with the next document's.

    Rows that repeat are one document in the order, and each of them gets its result.
    """
    made = edited_pairs(docs).withColumn("edited_sha256", F.sha2("edited", 256))
    made = with_signatures(made, "edited", "changed").drop("edited")
    made = with_likeness(with_likeness(made, "own", "changed", "near_edited"), "own", "following", "near_next")
    made = made.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return made.select("doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"), "near_edited", "near_next")


def _bounds() -> list[int]:
    """Least sizes of the partitions: a set of one has similar ones there or in the adjacent partitions only."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(out[-1] * 100 // PERCENT + 1)
    return out[:-1]


def near_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of different sets with a Jaccard similarity of at least ``PERCENT``, each pair once.

    ``sets``: (set_id, sigs), one row per distinct set; empty sets have no partner.
    """
    size = F.size("sigs")
    sets = sets.where(size > 0)
    post = sets.select("set_id", F.explode("sigs").alias("sig"))
    often = post.groupBy("sig").agg(F.count("*").alias("often"))
    ranked = post.join(often, "sig").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("keys"))
    n = F.size("keys")
    ranked = ranked.withColumn("n", n).withColumn("prefix", F.slice("keys", F.lit(1), n - F.floor((n * PERCENT + 99) / 100).cast("int") + 1))
    ranked = ranked.withColumn("part", F.size(F.filter(F.array(*[F.lit(b) for b in _bounds()]), lambda b: b <= F.col("n"))))
    keyed = durable(ranked.select("set_id", "n", "part", F.posexplode("prefix").alias("pos", "key")).select("set_id", "n", "part", "pos", F.col("key.sig").alias("sig")))
    low = keyed.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    high = keyed.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "sig", "part")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    # J >= p / 100 of sizes na, nb means an overlap of at least p (na + nb) / (100 + p)
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("na") * 100 >= F.col("nb") * PERCENT) & (rest * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT)
    pairs = low.join(high, ["sig", "part"]).where(ordered & fits).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("sigs").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(both * (100 + PERCENT) >= (F.size("sa") + F.size("sb")) * PERCENT).select("a", "b")


def near_counts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its number of signatures and of other documents at least ``PERCENT`` alike.

    Rows that repeat are one document. Texts of equal signature sets are one set from here on, known by a digest of 64 bits, so copies make no pairs.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_signatures(rows.withColumn("_h", F.xxhash64("text")), "text", "sigs", 63)
    rows = durable(rows.select("doc_id", "_h", F.xxhash64("sigs").alias("set_id"), "sigs"))
    ids = rows.groupBy("doc_id", "_h", "set_id", F.size("sigs").alias("n_signatures")).agg(F.count("*").alias("copies"))
    members = ids.groupBy("set_id").agg(F.count("*").alias("members"))
    sets = durable(rows.select("set_id", "sigs").dropDuplicates(["set_id"]))
    pairs = durable(near_pairs(sets))
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(members, F.col("b") == F.col("set_id")).groupBy("a").agg(F.sum("members").alias("others")).withColumnRenamed("a", "set_id")
    counted = members.join(near, "set_id", "left").select("set_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))
    # one row per set is looked up by many documents where copies are: only the narrow rows meet
    told = look_up(ids, counted, "set_id", "_h")
    told = told.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return told.select("doc_id", "n_signatures", "n_near")

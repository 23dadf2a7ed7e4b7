"""Document fingerprints: a Merkle tree of phrases, paragraphs and sections, in DataFrame functions only.

Paragraphs are lines, cut into phrases by their content; a section is eight paragraphs. A phrase's node is the
digest of its text, every node above is the digest of the nodes below it, up to the root. So equal roots mean
equal texts and only differing branches are searched for an edit. A published fingerprint is the root and the
smallest ``SAMPLE`` marks of the lowest level, so it is of bounded size, and likeness follows from two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = 8
#: Characters of a phrase; it also ends at the end of a sentence, so phrases meet again after an insertion.
PHRASE = r"(?s)[^.!?]{1,16}[.!?]*|[.!?]+"
#: Marks of phrases in a fingerprint; a text of fewer different phrases has all of them.
SAMPLE = 128
#: Hexadecimal digits of a mark.
MARK = 8
#: Rows that ``with_next`` wants in a bucket, and the most buckets it makes before crowded ones are cut again.
BUCKET_ROWS, MAX_BUCKETS = 256, 100_000


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def tree(text: Column) -> Column:
    """Struct of root, sections, paragraphs (digests) and sample (the smallest marks of different phrases, in order)."""
    digest = lambda x: F.md5(x.cast("binary"))
    leaves = F.transform(paragraphs(text), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), digest))
    above = lambda x: F.struct(
        F.transform(x, lambda nodes: digest(F.concat_ws("", nodes))).alias("paragraphs"),
        F.slice(F.sort_array(F.array_distinct(F.transform(F.flatten(x), lambda h: F.substring(h, 1, MARK)))), 1, SAMPLE).alias("sample"),
    )
    sections = lambda n: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(n) - 1) / SECTION).cast("int")),
        lambda i: digest(F.concat_ws("", F.slice(n, i * SECTION + 1, SECTION))),
    )
    return _with(_with(leaves, above), lambda g: _with(sections(g["paragraphs"]), lambda s: F.struct(
        F.sha2(F.concat_ws("", s).cast("binary"), 256).alias("root"),
        s.alias("sections"), g["paragraphs"].alias("paragraphs"), g["sample"].alias("sample"),
    )))


def as_text(node: Column) -> Column:
    """``root:sample``, at most 65 + 8 * ``SAMPLE`` characters."""
    return F.concat_ws(":", node["root"], F.array_join(node["sample"], ""))


def from_text(fingerprint: Column) -> Column:
    """Struct of root and sample of a published fingerprint, for ``likeness``."""
    parts = F.split(fingerprint, ":")
    return F.struct(parts[0].alias("root"), F.regexp_extract_all(parts[1], F.lit(f"[0-9a-f]{{{MARK}}}"), F.lit(0)).alias("sample"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else the share of phrases that two texts have in common, below 1.

    With J the share of marks in both samples among the smallest ``SAMPLE`` of their union it is 2J / (1 + J): exact
    for texts whose union has no more marks, else an estimate. Texts without phrases have nothing in common.
    """
    smallest = F.slice(F.sort_array(F.array_union(a["sample"], b["sample"])), 1, SAMPLE)
    share = _with(smallest, lambda u: _with(
        F.size(F.array_intersect(F.array_intersect(u, a["sample"]), b["sample"])),
        lambda common: F.when(F.size(u) > 0, 2.0 * common / (F.size(u) + common)).otherwise(0.0),
    ))
    return F.when(a["root"] == b["root"], 1.0).otherwise(F.least(share, F.lit(0.999999)))


def changed(a: Column, b: Column) -> Column:
    """Positions of paragraphs that differ, looked for only below sections that differ."""
    branches = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(a["sections"]), F.size(b["sections"])) - 1),
        lambda s: ~F.get(a["sections"], s).eqNullSafe(F.get(b["sections"], s)),
    )
    inside = F.flatten(F.transform(branches, lambda s: F.sequence(s * SECTION, s * SECTION + SECTION - 1)))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(
        F.filter(inside, lambda p: ~F.get(a["paragraphs"], p).eqNullSafe(F.get(b["paragraphs"], p)))
    )


def _bucketed(docs: DataFrame) -> DataFrame:
    """With ``_bucket``, which grows with doc_id and, in one id, falls with ``_tie``; null ids have the lowest.

    Buckets are even steps of the id, or, where these are uneven, quantiles whose crowded buckets are cut again: by
    even steps of their ids, or of the tie where there is one id only. Only counts and quantiles reach the driver.
    """
    rows, filled, low, high = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = max(BUCKET_ROWS, rows // MAX_BUCKETS + 1)
    base = F.lit(-1).cast("long")
    if filled:
        step = max(1, (high - low + 1) * wanted // filled, (high - low) // MAX_BUCKETS + 1)
        even = F.floor(F.col("doc_id").cast("double") / float(step))
        base = F.coalesce(even, F.lit(low // step - 2).cast("long"))
    if docs.groupBy(base).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] <= 16 * wanted:
        return docs.withColumn("_bucket", base)
    if filled:
        parts = min(1000, max(1, filled // wanted))
        found = [int(q) for q in docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)]
        # an id met twice has a bucket of its own
        bounds = sorted({*found, *(a + 1 for a, b in zip(found, found[1:], strict=False) if a == b)})
        limits = F.array(*map(F.lit, bounds)).cast("array<long>")
        base = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(limits, lambda b: b <= F.col("doc_id")))).cast("long")
    cut = docs.withColumn("_base", base)
    # at most 2,002 rows
    sizes = cut.groupBy("_base").agg(
        F.min("doc_id").cast("double").alias("_low"), F.max("doc_id").cast("double").alias("_high"),
        F.ceil(F.count(F.lit(1)) / wanted).alias("_parts"),
    )
    along = F.when(F.col("_high") > F.col("_low"), (F.col("doc_id").cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low"))) \
        .otherwise(0.5 - F.col("_tie").cast("double") / 2.0**64)
    inside = F.greatest(F.lit(0), F.least(F.col("_parts") - 1, F.floor(along * F.col("_parts"))))
    return cut.join(F.broadcast(sizes), "_base").select(*docs.columns, (F.col("_base") * (1 << 40) + inside).alias("_bucket"))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in descending doc_id, after the last the first.

    Null ids come last; equal ids stand in the order of a text hash, and one id with many texts is many buckets. A
    text travels once: to its bucket, and the first of a bucket also to the bucket before it. Rows that repeat both
    id and text stay together.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = _bucketed(docs.withColumn("_tie", F.xxhash64("text")))
    # the complement falls with the id; a bucket holds null ids only, or none
    first = F.struct(F.bitwise_not("doc_id").alias("i"), F.col("_tie").alias("t"))
    heads = cut.groupBy("_bucket").agg(F.min(first).alias("_head"))
    order = Window.orderBy(F.col("_bucket"))  # one row a bucket
    last = F.max("_bucket").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    low = F.min("_bucket").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("_bucket", "_head", F.when(F.col("_bucket") == last, low).otherwise(F.lead("_bucket").over(order)).alias("_guest_of"))
    placed = (
        cut.join(F.broadcast(heads), "_bucket")  # bounded by the number of buckets
        .withColumn("_place", F.explode(F.when(
            first.eqNullSafe(F.col("_head")),
            F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.col("_guest_of").alias("b"), F.lit(1).alias("g"))),
        ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g"))))))
        .select("doc_id", "text", "_tie", F.col("_place.b").alias("_b"), F.col("_place.g").alias("_g"))
        .repartition("_b")
        .withColumn("_tree", tree(F.col("text")))
    )
    along = Window.partitionBy("_b").orderBy("_g", F.col("doc_id").desc_nulls_last(), "_tie")
    return (
        placed.select("doc_id", "text", "_tree", "_g", F.lead("text").over(along).alias("next_text"), F.lead("_tree").over(along).alias("_next_tree"))
        .where("_g = 0").drop("_g")
    )


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every whole text; null texts are empty, repeated rows stay, other columns are not read."""
    return documents.select(key, as_text(tree(F.coalesce(text, F.lit("")))).alias("fingerprint"))

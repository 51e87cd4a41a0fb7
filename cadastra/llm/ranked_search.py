"""Ranked lexical search: term buckets of postings, joined with the items' terms.

A task turns each block of documents into postings, one row for a term: a bucket of the block's documents
that hold the term, with its count and the document's length. Buckets of a block stay together, so that a
common term is spread over all blocks and all matches of a document meet in one task: scores are summed
where they arise, each block hands on its best of every item only, and the ranking reads those.

All numbers but a term's weight are 64-bit integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, durable, release, renamed, shuffle_width

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 1_024  # documents
BROADCAST = 200_000  # pairs of an item and a term, some 20 MB, up to which tasks get them by broadcast
LONG = 1 << 22  # bytes of a text from which its terms are counted one by one

_term = re.compile(rb"[0-9a-z\x80-\xff]+")  # the same in lower-cased UTF-8


def counted(text: bytes | None) -> Counter:
    """Occurrences of each term of a whole text in UTF-8; null has none."""
    if not text:
        return Counter()
    low = text.lower()  # A-Z only, as bytes know no other letters
    return Counter(_term.findall(low)) if len(low) < LONG else Counter(m.group() for m in _term.finditer(low))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text column."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))


def postings(documents: DataFrame, terms: set[str] | None, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """(block, term, docs, place, tf, n): the documents of a block that hold a term, their ids, places in the block, counts and lengths.

    The row of a null term lists all documents of the block that have terms at all. ``terms`` are the terms
    wanted, all if null. A block is a run of at most ``block`` rows of a partition as it is read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(None if terms is None else frozenset(t.encode() for t in terms))
    source = renamed(documents, [id_column, text_column])
    kind = source.schema[f"in_{id_column}"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, number, wanted = TaskContext.get().partitionId(), 0, shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                rows = batch.slice(lo, block)
                ids, texts = rows.column(0), rows.column(1).cast(pa.binary())
                buckets: dict[bytes | None, tuple[list, list, list]] = {None: ([], [], [])}
                for place, text in enumerate(texts):
                    found = counted(text.as_py())
                    if not found:
                        continue
                    n = found.total()
                    for term, times in ((None, n), *((t, found[t]) for t in (found.keys() if wanted is None else found.keys() & wanted))):
                        bucket = buckets.get(term)
                        if bucket is None:
                            bucket = buckets[term] = ([], [], [])
                        bucket[0].append(place)
                        bucket[1].append(times)
                        bucket[2].append(n)
                count = len(buckets)
                places = [b[0] for b in buckets.values()]
                yield {
                    "block": [(part << 32) + number] * count, "term": [t if t is None else t.decode("utf-8", "replace") for t in buckets], "docs": [ids.take(pa.array(p, pa.int32())).to_pylist() for p in places],
                    "place": places, "tf": [b[1] for b in buckets.values()], "n": [b[2] for b in buckets.values()],
                }
                number += 1

    return arrow_rows(source, make, f"block long, term string, docs array<{kind}>, place array<int>, tf array<long>, n array<long>")


def search(documents: DataFrame, items: DataFrame, k: int = 50, k1: int = 1000, b: int = 50, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", broadcast: int = BROADCAST, block: int = BLOCK) -> DataFrame:
    """(item, rank, doc id, score): the ``k`` documents of the highest score above 0 of each item, ties by the smaller id.

    A term weighs w = floor(1000 ln((2N+2)/(2df+1))) of N documents with terms, df of which hold it. With n
    terms of L in all, m = 100 - b + (b n N) div L; the score sums w (1000000000 tf div (``k1`` tf + 20 m)) over
    the item's distinct terms.

    Rows of one item id are one item, null ids too; items without terms return nothing. Each document row
    is ranked by itself, if ids repeat or are null too (null first); null and empty texts match nothing.
    Texts count whole, of any length; one of many millions of terms holds its distinct terms in memory.
    An empty table on either side gives an empty result; other columns are ignored.

    Items with up to ``broadcast`` terms in all are broadcast to the tasks; others meet all terms' postings in
    a shuffle by term, and their matches in another by block.
    """
    spark = documents.sparkSession
    wanted = renamed(items, [item_column, item_text]).select(F.col(f"in_{item_column}").alias("item"), F.explode(terms_of(F.col(f"in_{item_text}"))).alias("term")).distinct()
    wanted = durable(wanted)
    few = wanted.limit(broadcast + 1).count() <= broadcast
    terms = {r[0] for r in wanted.select("term").distinct().collect()} if few else None
    buckets = durable(postings(documents, terms, id_column, text_column, block))
    lengths = buckets.where("term IS NULL").select(F.size("place").alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    total, length = (int(v or 0) for v in lengths.agg(F.sum("d"), F.sum("l")).first())
    held = buckets.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("place")).cast("long").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    known = durable(wanted.join(held, "term").select("item", "term", weight.alias("w")).where("w > 0"))
    ask = F.struct("item", "w")
    asked = F.broadcast(known.groupBy("term").agg(F.collect_list(ask).alias("asked"))) if few else known.select("term", F.array(ask).alias("asked"))
    # all buckets of a block in one partition, in which its documents' matches are summed without a further exchange
    met = buckets.where("term IS NOT NULL").repartition(shuffle_width(spark), "block").join(asked, "term").select("block", "asked", F.explode(F.arrays_zip("docs", "place", "tf", "n")).alias("p"))
    m = f"({100 - b}L + ({b}L * p.n * {total}L) div {max(length, 1)}L)"
    each = met.select("block", "p.place", F.col("p.docs").alias("doc"), F.expr(f"(1000000000L * p.tf) div ({k1}L * p.tf + 20L * {m})").alias("part"), F.explode("asked").alias("a"))
    scored = each.groupBy("block", "place", "doc", F.col("a.item").alias("item")).agg(F.sum(F.col("a.w") * F.col("part")).alias("score")).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    out = durable(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "doc", "score"))
    release(wanted, buckets, known)
    return out.select(F.col("item").alias(item_column), "rank", F.col("doc").alias(id_column), "score")

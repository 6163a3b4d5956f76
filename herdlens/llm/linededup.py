"""Line deduplication with DataFrame functions only.

Hashes of line keys are range-partitioned, with a secondary sort by document and position; a running first value
streams through each hash's rows and marks those outside the first document. The result is a compressed keep bitmap
for each document (64 lines a word; a word whose lines all stay is left out), not text; texts are joined only to apply
it.

A hash with more lines than half a partition's fair share is dealt over sub-ranges by document, as many as it has such
shares; the first documents of its sub-ranges are then reduced to one by a map-side minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, discard, stored

MIN_CHARS = 10
#: Lines that one task takes on whatever the number of partitions is.
FEW = 64
_LAST = (1 << 63) - 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _identified(docs: DataFrame) -> DataFrame:
    """dd_doc: doc_id, null as the largest; dd_row: tells texts apart that share a doc_id."""
    return docs.withColumn("dd_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("dd_row", F.xxhash64(F.coalesce("text", F.lit(""))))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """dd_doc, dd_row, dd_words map<int, bigint>, dd_dropped: documents that lose lines. Bit i of word w: line 64 w + i stays.

    Words that are not in the map have all bits set. Keys of at least min_chars code points that stand in two documents
    or more stay in the smallest doc_id only.
    """
    line = F.col("line")
    lines = (
        _identified(docs.select("doc_id", "text"))
        .select("dd_doc", "dd_row", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .where(F.char_length(line) >= min_chars)
        .withColumn("key", line_key(line))
        .where(F.char_length("key") >= min_chars)
        .select("dd_doc", "dd_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    lines = stored(lines, "lines")
    # half of what a partition has on average; at most twice as many hashes as partitions have more than that
    fair = max(FEW, lines.count() // (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > fair).select("h1", "h2", F.ceil(F.col("n") / fair).cast("int").alias("parts"))
    sub = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("dd_doc"), F.col("parts")) + 1).otherwise(0).cast("int")
    by_range = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("sub", sub).drop("parts").repartitionByRange("h1", "h2", "sub").sortWithinPartitions("h1", "h2", "sub", "dd_doc", "pos")
    first = F.first("dd_doc").over(Window.partitionBy("h1", "h2", "sub").orderBy("dd_doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = stored(by_range.withColumn("first", first).where((F.col("sub") > 0) | (F.col("dd_doc") != F.col("first"))), "marked-lines")
    discard(lines)
    of_hot = marked.where("sub > 0").groupBy("h1", "h2").agg(F.min("first").alias("true_first"))
    gone = marked.join(F.broadcast(of_hot), ["h1", "h2"], "left").where(F.col("dd_doc") != F.coalesce("true_first", "first"))
    words = gone.groupBy("dd_doc", "dd_row", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("dd_doc", "dd_row").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))))).alias("dd_words"), F.sum(F.bit_count("bits")).cast("long").alias("dd_dropped")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped, keep_bitmap and kept_text.

    keep_bitmap: map of word to 64 bits, as keep_bitmaps gives it; an empty map where all lines stay. Null or empty text
    is one empty line. Rows of one doc_id are one document: they never cost each other lines. Documents without doc_id
    count as one, the largest. Columns of docs with these names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "keep_bitmap", "kept_text", "dd_doc", "dd_row", "dd_words", "dd_dropped")
    lines = split_lines(F.col("text"))
    kept = F.expr("filter(split(coalesce(text, ''), '\\n'), (x, i) -> getbit(coalesce(dd_words[i div 64], -1L), i % 64) = 1)")
    return (
        _identified(docs)
        .join(keep_bitmaps(docs, min_chars), ["dd_doc", "dd_row"], "left")
        .select(
            *docs.columns,
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce("dd_dropped", F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce("dd_words", F.expr("cast(map() as map<int, bigint>)")).alias("keep_bitmap"),
            F.when(F.col("dd_words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        )
    )


ORACLE_SQL = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
k as (select *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
f as (select key, min(doc_id) first from k where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) > 1),
m as (select k.*, coalesce(k.doc_id <> f.first, false) gone from k left join f using (key))
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from m group by doc_id
"""

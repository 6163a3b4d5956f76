"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by weight, at most `max_repeat` times its own; what it can't take goes to the
others by weight. A document's expected copies are its source's target over its source's size, at most `max_repeat`.
Documents stand in a fixed order within their source; the prefix sums of expected copies, shifted by one random offset
per source, cross integer boundaries, and a document is emitted once for each boundary that it crosses. The order goes
by size, so the words taken miss the target by about one document's size.

The prefix sum is distributed: documents fall in buckets (source, size class, hash of doc_id), which are counted
with map-side aggregation; only bucket counts are summed along a source, so a source or a size that holds a third of
all rows is spread over many tasks. The largest class of a source says how many parts the hash makes: with twice the
rows it makes twice as many, so buckets don't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Parts of a size class of a source: so many at least, doubled until none has more rows than this on average.
LEAST_SUBS, BUCKET_ROWS = 32, 1 << 16
SEED = 20240


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """Eight classes an octave, by integer arithmetic: bit length, then the three bits after the leading one."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 4, F.lit(0))
    return (bits * 8 + F.floor(size / F.pow(F.lit(2.0), shift)).cast("int") % 8).cast("int")


def _leading_bits(text: Column) -> Column:
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """mix_* columns: the source's key (null apart from any string, and last), size, size class, hash."""
    return (
        docs.withColumn("mix_null", F.col("source").isNull().cast("int"))
        .withColumn("mix_source", F.coalesce("source", F.lit("")))
        .withColumn("mix_size", n_words(F.col("text")))
        .withColumn("mix_class", _size_class(F.col("mix_size")))
        .withColumn("mix_hash", _leading_bits(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))
    )


def parts(most: int, rows: int = BUCKET_ROWS) -> int:
    """How many parts a hash makes of classes of `most` rows at most."""
    n = LEAST_SUBS
    while n * rows < most:
        n *= 2
    return n


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """mix_null, mix_source, source_size, target: one row per source. sizes: mix_null, mix_source, mix_size.

    Weights go round the sources by code point, null last. With caps c = max_repeat * size, targets are
    min(c, level * weight) with one level for all: sources in order of c / weight are capped until the level that the
    rest share stays below the next c / weight: the largest of the levels that fit. There resharing by weight ends.
    The level is one number of all sources, so their sums (a row a source) meet in one task: meant for up to millions
    of sources, whatever the number of documents.
    """
    per = sizes.groupBy("mix_null", "mix_source").agg(F.sum("mix_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("mix_null", "mix_source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = Window.orderBy(F.col("cap") / F.col("weight"), "mix_null", "mix_source")
    before, after, everything = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.col("total") - F.col("capped")) / F.col("open")
    per = (
        per.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("level", F.when(F.col("cap") / F.col("weight") >= level, level))
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("mix_null", "mix_source", "source_size", target.alias("target"))


def _offset(seed: int) -> Column:
    """The source's random offset in [0, 1): 32 bits of an MD5 of seed and source."""
    return _leading_bits(F.concat(F.lit(f"{seed}:"), F.col("mix_null").cast("string"), F.lit(":"), F.col("mix_source"))).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, rows: int = BUCKET_ROWS, seed: int = SEED, keep=None) -> DataFrame:
    """docs with size, source_size, target and copies (0 to max_repeat): how often each row is to be emitted.

    docs: doc_id, text, source and any others; `keep` names the columns that stay (all). Null text has size 0, null
    source is a source, null doc_ids come first in the order, spread by their texts, repeated rows are documents of their own, sources
    without words have target 0 and give no copies, and an empty table gives an empty one. Columns named mix_*, size,
    source_size, target or copies are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies", *[c for c in docs.columns if c.startswith("mix_")])
    keep = docs.columns if keep is None else list(keep)
    bucket = ["mix_null", "mix_source", "mix_class", "mix_sub"]
    narrow = stored(_keyed(docs.select("doc_id", "source", "text")).select(*bucket[:3], "mix_size", "mix_hash"), "mix-sizes")
    most = narrow.groupBy(*bucket[:3]).count().agg(F.max("count")).first()[0] or 0
    sub = (F.col("mix_hash") % parts(most, rows)).cast("int").alias("mix_sub")
    counts = stored(narrow.withColumn("mix_sub", sub).groupBy(*bucket).agg(F.count("*").alias("n"), F.sum("mix_size").alias("mix_size")), "mix-counts")
    discard(narrow)
    along = Window.partitionBy("mix_null", "mix_source").orderBy("mix_class", "mix_sub").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .join(targets(counts, weights, max_repeat), ["mix_null", "mix_source"])
        .select(*bucket, "before", "source_size", "target", _offset(seed).alias("offset"))
    )
    plan = stored(plan, "mix-plan")
    in_bucket = Window.partitionBy(*bucket).orderBy("mix_size", "mix_id", "mix_text")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(rank * F.col("rate") + F.col("offset"))
    return (
        _keyed(docs)
        .withColumn("mix_sub", sub)
        .select(*keep, *bucket, "mix_size", F.col("doc_id").alias("mix_id"), F.xxhash64("text").alias("mix_text"))
        .withColumn("mix_row", F.row_number().over(in_bucket))
        .join(plan, bucket, "left")  # every bucket is there; an inner join would test its keys on the texts again
        .withColumn("rate", F.least(rate, F.lit(float(max_repeat))))
        .withColumn("rank", F.col("before") + F.col("mix_row"))
        .withColumn("copies", (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("int"))
        .select(*keep, F.col("mix_size").alias("size"), "source_size", "target", "copies")
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is to be emitted. Columns of any name go along unchanged."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    taken = mix(rows, keep=["row"], **how).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select("row.*")


ORACLE_SQL = f"""
with d as (
  select doc_id, source, (source is null)::int sn, coalesce(source, '') s,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size from documents),
b as (select *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) % 8 cls, ('0x' || substr(md5(doc_id::varchar), 1, 8))::ubigint h from d),
parts as (select ({LEAST_SUBS} * greatest(1, pow(2, ceil(log2(max(n) / {float(LEAST_SUBS * BUCKET_ROWS)})))))::ubigint parts from (select count(*) n from b group by sn, s, cls)),
per as (select sn, s, sum(size)::bigint source_size, [5, 2, 1][1 + (row_number() over (order by sn, s) - 1) % 3] w from b group by sn, s),
lev as (select *, {MAX_REPEAT} * source_size cap, (sum(source_size) over ())::bigint total from per),
lev2 as (select *, coalesce(sum(cap) over (order by cap / w, sn, s rows between unbounded preceding and 1 preceding), 0)::bigint capped,
    (sum(w) over (order by cap / w, sn, s rows between current row and unbounded following))::bigint opn from lev),
lev3 as (select *, max(case when cap / w >= (total - capped) / opn then (total - capped) / opn end) over () level from lev2),
t as (select sn, s, source_size, least(cap::double, coalesce(level * w, cap::double)) target,
    ('0x' || substr(md5('{SEED}:' || sn || ':' || s), 1, 8))::ubigint::double / 4294967296.0 u from lev3),
r as (select b.*, t.source_size, t.target, t.u, row_number() over (partition by b.sn, b.s order by cls, h % (select parts from parts), size, doc_id) rank,
    least(case when t.source_size > 0 then t.target / t.source_size else 0 end, {float(MAX_REPEAT)}) rate
  from b join t on b.sn = t.sn and b.s = t.s)
select doc_id, size::bigint size, source_size, target,
  (size * (floor(rank * rate + u) - floor((rank - 1) * rate + u)))::bigint taken from r
"""

"""MinHash near-deduplication with sequential Bayesian verification.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit key of the shingle set and a
   MinHash signature. Each different set is one node from here on, whatever the doc_ids of its documents are.
2. Signatures are cut into bands; nodes that share a band's key are in one bucket. A bucket's members are compared
   with one of them (a star, not all pairs): the one whose buckets hold the most nodes, mostly the text that the others
   were copied from.
3. A candidate's signatures are compared batch by batch. With m of n values equal, the posterior of the similarity
   (uniform prior) is a Beta distribution; the pair goes when the chance of reaching the threshold falls below `miss`.
4. Survivors are verified on their full shingle sets, and links joined into components. A star is dealt over tasks in
   parts; a task holds its centre's set and reads the members one after the other.
5. In a bucket whose other members are then in different components, those outside its largest component are the
   rest. While the rest of some bucket is larger than a block, further stars take their centres out of it.
6. What is left is compared in blocks, the rest against all: first signatures alone (half a kilobyte a member), then,
   only for members with a likely partner, the full sets in smaller blocks, likeliest pairs first and without those
   that a link found there has joined. Tasks return members and links that join components, never pairs. Each pair is
   decided in the first bucket that it shares, unless it is joined already.

With 32 bands of 4 values, a pair at similarity 0.8 shares no bucket with a chance of 5e-8.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, stored_ids
from .components import connected_components
from .textarrays import NOT_BLANK, blocks, mix64, shingles, text_buffers, words

WORDS = 5
SIMILARITY = (80, 100)
BANDS, ROWS = 32, 4
BATCH = 32
MISS = 1e-6
#: Members of a star that one task takes on.
STAR = 128
#: Members of a bucket that stand on one side of a block of signatures, and of a block of sets.
BLOCK, SET_BLOCK = 512, 128
#: Rounds of further stars; whatever they leave goes through blocks.
MORE_STARS = 8
#: Pairs whose signatures are compared at a time.
PAIRS = 1 << 17
#: A plan switch that leaves results alone: up to so many ids are sent to every executor (a set of 8-byte keys); beyond
#: it, texts are shuffled to them.
BROADCAST_IDS = 1_000_000

_A = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, values) uint32: for each hash function the minimum over a text's shingles. Every text has one at least."""
    out = np.empty((len(bounds) - 1, len(_A)), np.uint32)
    work = np.empty_like(sets)
    for j in range(len(_A)):
        np.multiply(sets, _A[j], out=work)
        np.add(work, _B[j], out=work)
        out[:, j] = np.minimum.reduceat(work, bounds[:-1]) >> np.uint64(32)
    return out


@lru_cache
def least_equal(threshold: float, miss: float, values: int = BANDS * ROWS, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(n, m) after each batch: with fewer than m of n values equal, P(similarity >= threshold) < miss.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, values + 1, batch):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, i=None, j=None) -> np.ndarray:
    """Which pairs of signature rows (a[i], b[j]) survive the sequential test; without i and j, the rows side by side."""
    i, j = (np.arange(len(a)) if x is None else x for x in (i, j))
    alive, equal, at = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, m in least_equal(threshold, miss):
        equal = equal + (a[:, at:n][i[alive]] == b[:, at:n][j[alive]]).sum(1)
        stay = equal >= m
        alive, equal, at = alive[stay], equal[stay], n
    out = np.zeros(len(i), bool)
    out[alive] = True
    return out


def _sets(texts: pa.Array, k: int):
    """Blocks of (first text, shingle hashes, bounds)."""
    data, offsets = text_buffers(texts)
    for a, b in blocks(offsets):
        hashes, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1], NOT_BLANK)
        yield a, *shingles(hashes, bounds, k)


def _keys(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set; 0 for empty ones."""
    k1, k2 = (np.zeros(len(bounds) - 1, np.uint64) for _ in "12")
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        k1[full] = np.add.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
        k2[full] = np.bitwise_xor.reduceat(mix64(sets + np.uint64(0x14057B7EF767814F)), bounds[:-1][full])
    return k1.view(np.int64), k2.view(np.int64)


def _linked(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether two sorted sets reach the similarity."""
    if min(len(x), len(y)) * share[1] < max(len(x), len(y)) * share[0]:
        return False
    at = np.searchsorted(x, y)
    same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return share[1] * same >= share[0] * (len(x) + len(y) - same)


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            for at, sets, bounds in _sets(batch.column("text"), k):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                k1, k2 = _keys(sets, bounds)
                sigs = [None] * len(n)
                if len(full):
                    for i, sig in zip(full, signatures(sets, np.append(bounds[full], bounds[-1]))):
                        sigs[i] = sig.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("nd_doc").slice(at, len(n)), pa.array(n), pa.array(k1), pa.array(k2), pa.array(sigs, pa.binary())], ["nd_doc", "n_shingles", "k1", "k2", "sig"])

    return run


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            sig = _matrix(batch.column("sig")).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(mix64(np.arange(7, 7 + BANDS, dtype=np.uint64)), sig.shape[:2])
            for j in range(ROWS):
                keys = mix64(keys ^ sig[:, :, j])
            slots = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.repeat(np.arange(len(sig)), BANDS))), pa.array(keys.reshape(-1).view(np.int64)), pa.array(slots)], ["node", "band", "slot"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def _prune(threshold: float, miss: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                stay = plausible(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), threshold, miss)
                yield batch.select(["a", "b"]).filter(pa.array(stay))

    return run


def _verify(k: int, share: tuple[int, int]):
    """Rows come sorted by (a, part, role, node): a centre (role 0), then its members. Only the centre's set is kept."""

    def run(batches):
        star, centre, last = None, None, None
        for batch in batches:
            a, part, role, node, k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "part", "role", "node", "k1", "k2"))
            found = []
            for at, sets, bounds in _sets(batch.column("text"), k):
                own1, own2 = _keys(sets, bounds)
                for i in range(len(bounds) - 1):
                    r = at + i
                    if own1[i] != k1[r] or own2[i] != k2[r]:
                        continue  # another text under the same doc_id
                    mine, this = (a[r], part[r]), sets[bounds[i] : bounds[i + 1]]
                    if role[r] == 0:
                        star, centre, last = mine, this.copy(), None
                    elif mine == star and node[r] != last:
                        last = node[r]
                        if _linked(centre, this, share):
                            found.append(r)
            yield batch.select(["a", "node"]).take(pa.array(found, pa.int64())).rename_columns(["a", "b"])

    return run


def _shingled(k: int):
    """Texts as the bytes of their sorted shingle hashes, with the set's key."""

    def run(batches):
        for batch in batches:
            for at, sets, bounds in _sets(batch.column("text"), k):
                k1, k2 = _keys(sets, bounds)
                raw = [sets[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("nd_doc").slice(at, len(raw)), pa.array(k1), pa.array(k2), pa.array(raw, pa.binary())], ["doc", "k1", "k2", "shingles"])

    return run


SCREENED = ["band", "i", "j", "p", "q", "side", "slot", "node", "component"]


def _screen(threshold: float, miss: float):
    """Members with a likely partner, from rows sorted by (band, i, j, side): signatures alone.

    Blocks are handled together, about PAIRS pairs at a time; the last block of a batch waits for its other rows.
    """

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            keys = np.stack([table.column(c).to_numpy() for c in ("band", "i", "j")])
            ends = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, table.num_rows)
            whole = int(ends[-2]) if len(ends) > 1 else 0
            if whole:
                yield from screened(table.slice(0, whole), ends[:-1])
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield from screened(rest, np.array([rest.num_rows]))

    def screened(table, ends):
        sig = _matrix(table.column("sig"))
        node, component, side, outside, slot = (table.column(c).to_numpy() for c in ("node", "component", "side", "outside", "slot"))
        starts = np.concatenate([[0], ends[:-1]])
        middles = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
        todo, n = [], 0
        for a, m, b in zip(starts.tolist(), middles.tolist(), ends.tolist()):
            if a == m or m == b:
                continue
            step = max(1, PAIRS // (b - m))
            for lo in range(a, m, step):
                hi = min(m, lo + step)
                todo.append((lo, hi, a, m, b))
                n += (hi - lo) * (b - m)
                if n >= PAIRS:
                    yield from compared(table, sig, node, component, outside, slot, todo)
                    todo, n = [], 0
        if todo:
            yield from compared(table, sig, node, component, outside, slot, todo)

    def compared(table, sig, node, component, outside, slot, todo):
        x = np.concatenate([np.repeat(np.arange(lo, hi), b - m) for lo, hi, _, m, b in todo])
        y = np.concatenate([np.tile(np.arange(m, b), hi - lo) for lo, hi, _, m, b in todo])
        at = np.repeat(np.arange(len(todo)), [(hi - lo) * (b - m) for lo, hi, _, m, b in todo])
        # two members outside the largest component meet on either side: once is enough
        open_ = np.flatnonzero((component[x] != component[y]) & (~outside[y] | (node[x] < node[y])))
        open_ = open_[plausible(sig, sig, threshold, miss, x[open_], y[open_])]
        x, y, at = x[open_], y[open_], at[open_]
        if len(x):
            same = (sig[x] == sig[y]).reshape(-1, BANDS, ROWS).all(2)
            first = same.argmax(1) >= slot[x]  # no earlier bucket holds both
            x, y, at = x[first], y[first], at[first]
        if not len(x):
            return
        left, right = np.array([t[2] for t in todo])[at], np.array([t[3] for t in todo])[at]
        p, q = (x - left) // SET_BLOCK, (y - right) // SET_BLOCK
        rows = np.unique(np.concatenate([np.stack([x, p, q], 1), np.stack([y, p, q], 1)]), axis=0)
        out = table.take(pa.array(rows[:, 0]))
        columns = {c: out.column(c) for c in ("band", "i", "j", "side", "slot", "node", "component")} | {"p": pa.array(rows[:, 1].astype(np.int32)), "q": pa.array(rows[:, 2].astype(np.int32))}
        yield from pa.table([columns[c] for c in SCREENED], SCREENED).to_batches()

    return run


def _blockwise(share: tuple[int, int], miss: float):
    """The links of one pair of blocks that join components: a forest, so at most one a member."""
    threshold = share[0] / share[1]

    def run(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["side", "node"])
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x, y = (np.frombuffer(b"".join(p.sig), np.uint32).reshape(-1, BANDS * ROWS) for p in (left, right))
        cx, cy = left.component.to_numpy(), right.component.to_numpy()
        likely = []
        for i in range(len(x)):
            other = np.flatnonzero(cy != cx[i])
            if len(other):
                other = other[plausible(x, y, threshold, miss, np.full(len(other), i), other)]
                likely += [(-int(n), i, int(j)) for n, j in zip((y[other] == x[i]).sum(1), other)]
        joined: dict[int, int] = {}

        def root(c):
            while c in joined:
                c = joined[c]
            return c

        sets = [[np.frombuffer(r, np.uint64) for r in p.shingles] for p in (left, right)]
        nodes = left.node.to_numpy(), right.node.to_numpy()
        found = []
        for _, i, j in sorted(likely):
            a, b = root(int(cx[i])), root(int(cy[j]))
            if a != b and _linked(sets[0][i], sets[1][j], share):
                joined[max(a, b)] = min(a, b)
                found.append((nodes[0][i], nodes[1][j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """nd_doc, text of those documents. ids: nd_doc, distinct; few enough are broadcast, more are joined by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "nd_doc", "left_semi")


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, share, miss: float) -> DataFrame:
    """The pairs (centre a, member b) that are linked: sequential test on signatures, then the full sets."""
    sig = lambda x: sets.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
    likely = stored(pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(share[0] / share[1], miss), "a long, b long"), "likely")
    sizes = stored_ids(likely.groupBy("a").agg(F.count("*").alias("n")), "star-sizes")
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).cast("int")
    members = likely.join(sizes, "a").select("a", part.alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"))
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / STAR).cast("int") - 1))
    seats = members.union(sizes.select("a", parts.alias("part"), F.lit(0), F.col("a")))
    seats = stored_ids(seats.join(sets.select("node", "doc", "k1", "k2"), "node"), "seats")
    ids = stored_ids(seats.select(F.col("doc").alias("nd_doc")).distinct(), "star-docs")
    placed = seats.join(_texts_of(ids, docs), F.col("doc") == F.col("nd_doc")).select("a", "part", "role", "node", "k1", "k2", "text")
    links = stored(placed.repartition("a", "part").sortWithinPartitions("a", "part", "role", "node").mapInArrow(_verify(k, share), "a long, b long"), "links")
    discard(likely, sizes, seats, ids)
    return links


def _left_over(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets that hold several components, and the buckets' sizes.

    band, slot, node, component, n, n_outside, outside: whether the member is outside the bucket's largest component.
    """
    known = stored_ids(members.select("band", "slot", "node").join(labels, "node", "left").select("band", "slot", "node", F.coalesce("component", "node").alias("component")), "left")
    tallies = known.groupBy("band", "component").agg(F.count("*").alias("m"))
    tallies = tallies.groupBy("band").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    tallies = stored_ids(tallies.select("band", "n", (F.col("n") - F.col("most.m")).alias("n_outside"), F.col("most.component").alias("largest")), "open")
    left = stored_ids(known.join(tallies, "band").select("band", "slot", "node", "component", "n", "n_outside", (F.col("component") != F.col("largest")).alias("outside")), "left-open")
    discard(known)
    return left, tallies


def _by_blocks(left: DataFrame, sets: DataFrame, docs: DataFrame, k: int, share, miss: float) -> DataFrame:
    """Links between what is outside a bucket's largest component and all of the bucket."""
    n_i, n_j = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_outside", "n"))
    own_i, own_j = F.pmod(F.xxhash64("node"), n_i).cast("int"), F.pmod(F.xxhash64(F.lit(1), F.col("node")), n_j).cast("int")
    signed = left.join(sets.select("node", "sig"), "node")
    columns = ["band", "i", "j", "side", "slot", "node", "component", "outside", "sig"]
    as_left = signed.where("outside").withColumns({"i": own_i, "side": F.lit(0)}).withColumn("j", F.explode(F.sequence(F.lit(0), n_j - 1)))
    as_right = signed.withColumns({"j": own_j, "side": F.lit(1)}).withColumn("i", F.explode(F.sequence(F.lit(0), n_i - 1)))
    dealt = as_left.select(*columns).union(as_right.select(*columns)).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side")
    types = "band long, i int, j int, p int, q int, side int, slot int, node long, component long"
    likely = stored(dealt.mapInArrow(_screen(share[0] / share[1], miss), types), "screened")
    named = likely.join(sets.select("node", "doc", "k1", "k2", "sig"), "node")
    ids = stored_ids(likely.select("node").distinct().join(sets.select("node", "doc"), "node").select(F.col("doc").alias("nd_doc")).distinct(), "left-docs")
    shingled = _texts_of(ids, docs).mapInArrow(_shingled(k), "doc long, k1 long, k2 long, shingles binary")
    links = stored(named.join(shingled, ["doc", "k1", "k2"]).groupBy("band", "i", "j", "p", "q").applyInPandas(_blockwise(share, miss), "a long, b long"), "left-links")
    discard(likely, ids)
    return links


def near_duplicates(docs: DataFrame, k: int = WORDS, share: tuple[int, int] = SIMILARITY, miss: float = MISS) -> DataFrame:
    """nd_doc, n_shingles, component: one row per row of docs (doc_id, text), links at Jaccard >= share[0] / share[1].

    component: the smallest doc_id reachable. Documents without words have no shingles and are linked with nothing. Of
    rows that share a doc_id, each row's own set links it. Rows without doc_id come back with null and unlinked.
    Columns but doc_id and text play no part; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("nd_doc"), "text")
    sketches = stored(docs.mapInArrow(_sketch(k), "nd_doc long, n_shingles long, k1 long, k2 long, sig binary"), "sketches")
    whole = sketches.where("n_shingles > 0 and nd_doc is not null")
    sets = whole.groupBy("k1", "k2").agg(F.min("nd_doc").alias("doc"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id())
    sets = stored(sets, "sets")
    bands = stored(sets.select("node", "sig").mapInArrow(_bands, "node long, band long, slot int"), "bands")
    sizes = stored_ids(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    members = stored(bands.join(sizes, "band"), "members")
    discard(bands)
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    centres = stored_ids(members.join(company, "node").groupBy("band").agg(F.min(F.struct(-F.col("company"), F.col("node"))).getField("node").alias("centre")), "centres")
    seated = stored_ids(members.join(centres, "band").where("node <> centre"), "seated")
    discard(members, sizes, centres)
    stars = stored_ids(seated.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = _links(stars, sets, docs, k, share, miss)
    labels = connected_components(links)

    # what the stars left: buckets with other members in different components
    left, open_ = _left_over(seated.where("n > 2"), labels)
    for turn in range(MORE_STARS):
        if open_.where(F.col("n_outside") > BLOCK).isEmpty():
            break
        large = left.where(F.col("n_outside") > BLOCK)
        order = F.struct(F.xxhash64(F.lit(turn), F.col("node")).alias("h"), F.col("node"), F.col("component"))
        centres = stored_ids(large.where("outside").groupBy("band").agg(F.min(order).alias("c")).select("band", F.col("c.node").alias("centre"), F.col("c.component").alias("own")), "more-centres")
        stars = stored_ids(large.join(centres, "band").where("component <> own").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "more-stars")
        found = _links(stars, sets, docs, k, share, miss)
        if found.isEmpty():
            break
        links = stored_ids(links.union(found), "all-links")
        labels = connected_components(links)
        left, open_ = _left_over(left, labels)
    if not open_.isEmpty():
        labels = connected_components(links.union(_by_blocks(left, sets, docs, k, share, miss)))
    discard(seated, stars)
    # the smallest doc_id of each component, then of each set, then of each document of the set
    smallest = stored_ids(labels.join(sets.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("smallest")), "smallest")
    linked = labels.join(smallest, "component").select("node", "smallest")
    named = stored_ids(sets.select("k1", "k2", "doc", "node").join(linked, "node", "left").select("k1", "k2", F.coalesce("smallest", "doc").alias("component")), "named")
    discard(sets)
    return whole.join(named, ["k1", "k2"]).select("nd_doc", "n_shingles", "component").union(
        sketches.where("n_shingles = 0 or nd_doc is null").select("nd_doc", "n_shingles", F.col("nd_doc").alias("component"))
    )


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: the smallest doc_id. Documents without words or doc_id all stay.

    Of rows that share a doc_id, all stay if one of their texts does.
    """
    keep = near_duplicates(docs, **how).where("nd_doc = component").select(F.col("nd_doc").alias("doc_id")).distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


ORACLE_SQL = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by doc_id),
i as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r(v, m) as (select doc_id, doc_id from d union select u.b, r.m from r join u on u.a = r.v)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, min(r.m)::bigint component_id, d.doc_id = min(r.m) kept
from d left join n using (doc_id) join r on r.v = d.doc_id group by d.doc_id, n.n
"""

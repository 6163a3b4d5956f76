"""N-best segmentation over a SentencePiece vocabulary.

The lattice of a text has a node between characters and an edge for each piece that stands there; a character without
a piece of its own has an edge of its byte pieces. Forward Viterbi gives each node the best score from the start,
which is an exact heuristic for an A* search from the end back to the start: paths leave the queue best first, so the
N-th to arrive is the N-th best, and what is first in the queue then has the score of the next.

Scores are the model's own, as whole millionths, so sums are exact in any order and ties are real. A byte edge costs
ten more than the lowest score of a piece of one character. (A BPE model's scores are the ranks of its merges, negated.)

No piece crosses certain pairs of characters (those that stand side by side in no piece). Texts are cut there, and
each different part is searched once while it is remembered. The N best of a text combine those of its parts; only the
N parts whose second best costs least can differ from their best in them. So the best is returned as ids, and each other
one as its few replacements in the best; segmentation() gives its ids.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from bisect import insort
from functools import lru_cache
from heapq import nsmallest
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
N_BEST = 4
#: Parts that a worker keeps, over all its tasks; at the limit it forgets those not used since the last time. Twice as
#: many, of so many bytes each, are in its memory at most; longer ones count by their length.
CACHE_PARTS, PART_BYTES = 300_000, 340
#: An output batch ends at either.
OUT_ROWS, OUT_BYTES = 256, 1 << 23
#: The loss of what can't be segmented in a second way.
NEVER = 1 << 60
#: Beyond the score of any text: pieces for long runs of blanks cost a billion each.
UNREACHED = 1 << 100
_LAST = itemgetter(0)
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def _size(text: str, ids: bytes) -> int:
    """Bytes that an entry takes, about: no less than an ordinary one."""
    return max(PART_BYTES, 300 + 2 * len(text) + len(ids))


def _raw(*ids: int) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Lattice:
    """pieces: piece -> (id, score); byte_ids: id of each byte; byte_score: score of a byte piece."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int], byte_score: int):
        self.pieces, self.byte_ids, self.byte_score = pieces, byte_ids, byte_score
        self.inner = {a + b for p in pieces for a, b in zip(p, p[1:])}
        self.single = {p for p in pieces if len(p) == 1}
        # finds all pieces that stand in a text in one pass over it
        self.finder = ahocorasick.Automaton()
        for piece, (number, score) in pieces.items():
            self.finder.add_word(piece, (len(piece), score, _raw(number)))
        self.finder.make_automaton()

    @classmethod
    def load(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(_BYTE.fullmatch(piece)[1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = (i, round(1e6 * model.get_score(i)))
        lowest = min((score for piece, (_, score) in pieces.items() if len(piece) == 1), default=0)
        return cls(pieces, byte_ids, lowest - 10_000_000)

    def edges(self, part: str) -> list[tuple[int, tuple[int, int, bytes]]]:
        """(last character, (characters, score, ids)) of all edges, by where they end."""
        edges = list(self.finder.iter(part))
        if not self.single.issuperset(part):
            for i, c in enumerate(part):
                if c not in self.single:
                    edges.append((i, (1, self.byte_score, _raw(*(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))))))
            edges.sort(key=_LAST)
        return edges

    def forward(self, part: str):
        """The edges, and each node's best score from the start."""
        edges = self.edges(part)
        best = [-UNREACHED] * (len(part) + 1)
        best[0] = 0
        for last, edge in edges:
            total = best[last + 1 - edge[0]] + edge[1]
            if total > best[last + 1]:
                best[last + 1] = total
        return edges, best

    def first(self, part: str) -> tuple[int, bytes, int]:
        """(score, ids, loss) of the best segmentation, and how much less the second scores (NEVER: there is none).

        The A* search up to the arrival of its first path. With an exact heuristic it goes straight on along that path,
        and of the paths that wait only the best total matters: that of the second. It leaves the first at some node by
        the node's second best edge, so the forward pass keeps how much that one scores, too.
        """
        n = len(part) + 1
        best, second, back = [-UNREACHED] * n, [-UNREACHED] * n, [None] * n
        best[0] = 0
        for last, edge in self.edges(part):
            last += 1
            total = best[last - edge[0]] + edge[1]
            known = best[last]
            if total > known:
                second[last], best[last], back[last] = known, total, edge
            elif total > second[last]:
                second[last] = total
                if total == known and edge[2] < back[last][2]:
                    back[last] = edge
            elif total == known and edge[2] < back[last][2]:
                back[last] = edge
        node, path, loss = n - 1, [], UNREACHED
        while node:
            edge, less = back[node], best[node] - second[node]
            if less < loss:
                loss = less
            node -= edge[0]
            path.append(edge[2])
        path.reverse()
        return best[-1], b"".join(path), loss if loss < UNREACHED >> 1 else NEVER

    def n_best(self, part: str, n: int) -> list[tuple[int, bytes]]:
        """(score, ids) of the n best segmentations, or all if fewer; the best of equal ones as first() has it, others as
        the search meets them.

        What waits in the queue has its exact total, and no two entries lead to one segmentation. So only as many need to
        wait as are still wanted, and paths are links to what they go on from: memory grows with the part's length.
        """
        edges, best = self.forward(part)
        begin, at = [0] * (len(part) + 2), 0
        for node in range(len(part) + 2):
            while at < len(edges) and edges[at][0] + 1 < node:
                at += 1
            begin[node] = at
        queue, out, turn = [(-best[-1], 0, None, len(part), 0)], [], 0
        while queue and len(out) < n:
            total, _, path, node, behind = queue.pop(0)
            while node:
                # of the edges that end here, one goes on with this total; the others wait
                onward = None
                for k in range(begin[node], begin[node + 1]):
                    edge = edges[k][1]
                    i = node - edge[0]
                    cost = behind - edge[1]
                    to = cost - best[i]
                    if onward is None:
                        onward = to, edge, i, cost
                        continue
                    if to < onward[0] or (to == onward[0] and edge[2] < onward[1][2]):
                        (to, edge, i, cost), onward = onward, (to, edge, i, cost)
                    turn += 1
                    if len(queue) < n - len(out) - 1 or (queue and to < queue[-1][0]):
                        insort(queue, (to, turn, (edge[2], path), i, cost))
                        del queue[n - len(out) - 1 :]
                _, edge, node, behind = onward
                path = edge[2], path
            ids = []
            while path is not None:
                ids.append(path[0])
                path = path[1]
            out.append((-total, b"".join(ids)))
        return out

    def cut(self, text: str) -> list[str]:
        """Parts between which no piece can reach. Words of letters alone stay as they are: they seldom can be cut."""
        if text[1:].isalpha():
            return [text]
        out, start = [], 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in self.inner:
                out.append(text[start:k])
                start = k
        out.append(text[start:])
        return out


class Segmenter:
    """Segments texts and remembers units and parts, in about as many bytes as `cache` ordinary ones take, however long
    they are."""

    def __init__(self, lattice: Lattice, n: int = N_BEST, cache: int = CACHE_PARTS):
        self.lattice, self.n, self.limit = lattice, n, cache * PART_BYTES
        self.units, self.old, self.parts, self.seconds = {}, {}, {}, {}
        self.units_size = self.parts_size = self.seconds_size = 0
        self.decoder, self.lossy = Decoder(lattice), set()

    def _part(self, part: str):
        """(score, ids, loss of the second best)"""
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = self.lattice.first(part)
            self.parts_size += _size(part, found[1])
        return found

    def _unit(self, unit: str):
        """As _part, of what stands between two spaces, with the space in front: its loss is the least of its parts'."""
        if unit[1:].isalpha():
            return self.lattice.first(unit)
        found = [self._part(p) for p in self.lattice.cut(unit)]
        if len(found) == 1:
            return found[0]
        scores, ids, losses = zip(*found)
        return sum(scores), b"".join(ids), min(losses)

    def _look_up(self, units: list[str]) -> list:
        """Units without a space in front have it understood."""
        found = list(map(self.units.get, units))
        if None in found:
            if self.units_size > self.limit:
                self.old, self.units, self.units_size, self.lossy = self.units, {}, 0, {u for u in self.lossy if u in self.units}
            if self.parts_size > self.limit:
                self.parts, self.parts_size = {}, 0
            known, old, first, piece = self.units, self.old, self.lattice.first, self.decoder.raw.__getitem__
            for i in [i for i, f in enumerate(found) if f is None]:
                u = units[i]
                f = known.get(u)
                if f is None:
                    f = old.get(u)
                    if f is None:
                        if u.isalpha():
                            f, want = first(SPACE + u), b" " + u.encode("utf-8", "surrogatepass")
                        else:
                            whole = u if u[:1] == SPACE else SPACE + u
                            f, want = self._unit(whole), whole.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                        if b"".join(map(piece, memoryview(f[1]).cast("I"))) != want:
                            self.lossy.add(u)
                    known[u] = f
                    self.units_size += PART_BYTES if len(u) < 16 else _size(u, f[1])
                found[i] = f
        return found

    def __call__(self, text: str) -> tuple[bytes, list[tuple[int, list[tuple[int, int, bytes]]]], bool]:
        """The ids of the best segmentation; for each of the n best, best first: score, replacements in the best; whether
        the best decodes to the text.

        A replacement: the first piece that goes, how many go, the ids that come. In order of place; the best has none.
        A text's bytes are those of its units one after the other, so it decodes if they do, each tried once.
        """
        if not text:
            return b"", [(0, [])], True
        if SPACE in text or "  " in text or text[-1] == " " or text[0] == " ":
            # a run of spaces stays together with the word after it
            units = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
        else:
            units = text.split(" ")
        scores, ids, losses = zip(*self._look_up(units))
        score, losses = sum(scores), np.array(losses, np.int64)
        # only the units whose second best costs least can differ from their best
        if self.n > 1 and len(losses) > self.n:
            cheap = np.flatnonzero(losses <= np.partition(losses, self.n - 2)[self.n - 2])
        else:
            cheap = np.arange(len(losses))
        combined, chosen = [(0, ())], sorted(cheap.tolist(), key=losses.__getitem__)[: self.n - 1]
        for i in chosen:
            if losses[i] < NEVER:
                other = self._alternatives(units[i] if units[i][:1] == SPACE else SPACE + units[i])
                combined = nsmallest(self.n, ((c + loss, (*made, (i, raw)) if raw != ids[i] else made) for c, made in combined for loss, raw in other))
        place = {i: sum(map(len, ids[:i])) // 4 for i in chosen} if len(combined) > 1 else {}
        best = [(score - loss, [(place[i], len(ids[i]) // 4, raw) for i, raw in sorted(made)]) for loss, made in combined]
        return b"".join(ids), best, SPACE not in text and self.lossy.isdisjoint(units)

    def _alternatives(self, unit: str) -> list[tuple[int, bytes]]:
        """(loss, ids) of the unit's n best."""
        found = self.seconds.get(unit)
        if found is None:
            if self.seconds_size > self.limit // 10:
                self.seconds, self.seconds_size = {}, 0
            parts = self.lattice.cut(unit)
            best = [self._part(p) for p in parts]
            # again only the parts whose second best costs least
            chosen = [i for i in nsmallest(self.n - 1, range(len(parts)), key=lambda i: best[i][2]) if best[i][2] < NEVER]
            combined = [(0, ())]
            for i in chosen:
                other = self.lattice.n_best(parts[i], self.n)
                combined = nsmallest(self.n, ((loss + other[0][0] - s, (*made, (i, raw)) if raw != best[i][1] else made) for loss, made in combined for s, raw in other), key=_LAST)
            found = []
            for loss, made in combined:
                ids = [b[1] for b in best]
                for i, raw in made:
                    ids[i] = raw
                found.append((loss, b"".join(ids)))
            self.seconds[unit] = found
            self.seconds_size += sum(_size(unit, raw) for _, raw in found)
        return found


class Decoder:
    """Text of ids: pieces joined, bytes put together, the space in front dropped."""

    def __init__(self, lattice: Lattice):
        self.raw: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, (i, _) in lattice.pieces.items()} | {i: bytes([b]) for b, i in enumerate(lattice.byte_ids)}

    def bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I")))

    def __call__(self, ids: bytes) -> str:
        text = self.bytes(ids).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), values)


def _ids(rows: list[bytes]) -> pa.Array:
    """array<int> of each row's ids."""
    return _lists(pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32)), [len(x) // 4 for x in rows])


def _replacements(rows: list[list[list[tuple[int, int, bytes]]]]) -> pa.Array:
    """array<array<struct<at, n, ids>>> of each row's replacements."""
    each = [made for row in rows for made in row]
    flat = [x for made in each for x in made]
    structs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), _ids([x[2] for x in flat])], ["at", "n", "ids"])
    return _lists(_lists(structs, list(map(len, each))), list(map(len, rows)))


ENCODED = "n_pieces long, ids_crc32 long, scores array<double>, round_trip boolean, ids array<int>, others array<array<struct<at: int, n: int, ids: array<int>>>>"


@lru_cache(maxsize=1)
def _segmenter(path: str, n: int, cache: int) -> Segmenter:
    return Segmenter(Lattice.load(path), n, cache)


def _encode(path: str, n: int, cache: int):
    def run(batches):
        segmenter = _segmenter(path, n, cache)
        gc.disable()  # nothing here has cycles, and looking for them takes a sixth of the time
        try:
            yield from encoded(segmenter, batches)
        finally:
            gc.enable()

    def encoded(segmenter, batches):
        for batch in batches:
            begin, size, rows = 0, 0, []
            for at, text in enumerate(chain.from_iterable(batch.column("text").slice(k, 256).to_pylist() for k in range(0, batch.num_rows, 256))):
                ids, best, same = segmenter(text or "")
                rows.append((len(ids) // 4, zlib.crc32(ids), [score / 1e6 for score, _ in best], same, ids, [made for _, made in best[1:]]))
                size += len(ids)
                if len(rows) == OUT_ROWS or size > OUT_BYTES or at + 1 == batch.num_rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(rows)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.bool_()), _ids(cols[4]), _replacements(cols[5])],
                        [batch.schema.names[0], "n_pieces", "ids_crc32", "scores", "round_trip", "ids", "others"],
                    )
                    begin, size, rows = at + 1, 0, []

    return run


def encode(docs: DataFrame, model: str, n: int = N_BEST, id_column: str = "doc_id", cache: int = CACHE_PARTS) -> DataFrame:
    """id, n_pieces, ids_crc32, scores, round_trip, ids, others: a row for each of docs.

    ids: piece ids of the best segmentation; ids_crc32: of them as little-endian unsigned 32-bit integers; others: for
    each further one of the n best what it replaces in ids (at: first piece from 0, n: pieces that go, ids that come);
    scores: of all of them. round_trip: whether decoding the best gives the text back. A text that holds U+2581 is read
    as if that were a space, so it doesn't. Null and empty texts have no pieces, score 0 and one segmentation. Texts
    with fewer than n segmentations have shorter arrays. Repeated rows get equal results, an empty table none; columns
    but the id and text play no part.
    """
    return docs.select(id_column, "text").mapInArrow(_encode(model, n, cache), f"`{id_column}` {dict(docs.dtypes)[id_column]}, {ENCODED}")


def segmentation(which: int = 0) -> Column:
    """The ids of one segmentation, of columns ids and others; null where a row hasn't so many."""
    if which == 0:
        return F.col("ids")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ids"))
    between = lambda done, to: F.slice("ids", done["at"] + 1, to - done["at"])
    step = lambda done, x: F.struct((x["at"] + x["n"]).alias("at"), F.concat(done["ids"], between(done, x["at"]), x["ids"]).alias("ids"))
    return F.aggregate(F.get("others", F.lit(which - 1)), start, step, lambda done: F.concat(done["ids"], between(done, F.size("ids"))))


def _decode(path: str):
    def run(batches):
        decoder = Decoder(Lattice.load(path))
        for batch in batches:
            texts = [None if x is None else decoder(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])

    return run


def decode(encoded: DataFrame, model: str, id_column: str = "doc_id", which: int = 0) -> DataFrame:
    """id and text of each row's ids of one segmentation, the best if `which` is 0.

    Null ids and segmentations that a row hasn't give null, no ids the empty text.
    """
    kind = dict(encoded.dtypes)[id_column]
    return encoded.select(id_column, segmentation(which).alias("ids")).mapInArrow(_decode(model), f"`{id_column}` {kind}, text string")

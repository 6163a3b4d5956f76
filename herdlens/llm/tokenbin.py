"""Token ids in binary files of independent zstandard frames.

File format (all numbers little-endian):
  one zstandard frame a document, with a content checksum: its token ids as unsigned 32-bit integers
  a skippable frame (magic 0x184D2A5E) that holds the seek table: for each document its doc_id (int64), the frame's
  compressed and decompressed sizes (uint32 each) and the crc32 of the decompressed bytes (uint32)
  and, last in it, the number of documents (uint64) and the magic 0x8F92EAB1 (uint32)

A reader takes the table from the file's end and decompresses only the frames that it is asked for. Standard zstandard
tools read the frames and skip the table.

Files hold ascending ranges of (doc_id, crc32, size), so even one doc_id with very many rows is spread over files.
Documents are encoded once, where they are read; their frames, not their texts, are shuffled to the file that they
belong to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_path, stored

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ENTRY = np.dtype([("doc_id", "<i8"), ("packed", "<u4"), ("size", "<u4"), ("crc32", "<u4")])
_ENTRY = struct.Struct("<qIII")
END_ID = 1
LEVEL = 3
#: Words whose ids a worker keeps; at the limit it forgets those not used since the last time.
CACHE_WORDS = 200_000
#: Bytes of texts whose equal pieces are told apart at once, about; new words that the model gets at once; pieces
#: whose ids are put in order at once.
GROUP_BYTES, PLAIN_WORDS, BLOCK_PIECES = 8 << 20, 256, 1 << 18
#: Frames' bytes a file holds, about.
FILE_BYTES = 128 << 20
#: Documents that a reading task takes from a file at a time, and files whose sizes are summed in one step.
READ_DOCS, SUM_FILES = 1024, 1024


#: Letters up to U+00FF, which normal form C leaves alone, then ASCII punctuation but the apostrophe of contractions.
_PLAIN = "\\A(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)\\z"


def _splits_words(tokenizer) -> bool:
    """Whether a tokenizer does what WordEncoder takes for granted, by the steps that its file names."""
    import json

    steps = json.loads(tokenizer.to_str())
    listed = lambda step, key: (step or {}).get(key, [step])
    normal, split = listed(steps["normalizer"], "normalizers"), listed(steps["pre_tokenizer"], "pretokenizers")
    return (
        [(n or {}).get("type") for n in normal] == ["NFC", "Replace", "Lowercase"]
        and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": "\\s+"}, " ")
        and [(p or {}).get("type") for p in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and (split[0]["behavior"], split[0]["invert"], split[1]["add_prefix_space"], split[1]["use_regex"]) == ("Removed", True, False, False)
        and steps["post_processor"] is None
        and steps["truncation"] is None
        and bool(steps["model"].get("end_of_word_suffix"))
    )


class WordEncoder:
    """Ids of whole texts, encoding each different word once while it is remembered.

    For lower-casing byte-level tokenizers that drop white space, split letters from punctuation and mark the ends of
    words: texts are cut at spaces and line feeds, which no token crosses, and equal pieces are told apart in Arrow.
    Plain words go to the tokenizer's model many at once, their letters and their punctuation each; all other pieces,
    and texts that hold a special token's string, go through all of it. With a tokenizer whose file describes other
    steps, every text goes through all of it.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = _splits_words(self.tokenizer)
        self.limit, self.new, self.old = cache, {"": b""}, {}
        if self.by_words:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of one kind of characters each."""
        out = []
        for at in range(0, len(words), PLAIN_WORDS):
            some = words[at : at + PLAIN_WORDS]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            # a model without a piece for some byte leaves out ends
            out += map(raw.__getitem__, map(slice, [0, *ends], ends)) if len(ends) == len(some) else self._encode(some)
        return out

    def _ids(self, pieces: pa.Array, encode) -> list[bytes]:
        """Ids of different pieces: remembered ones, else by encode."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {"": b""}
        pieces = pieces.to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.new.get, pieces)]
        unknown = [i for i, x in enumerate(ids) if x is None]
        for i in unknown:
            ids[i] = self.old.get(pieces[i])
        rest = [i for i in unknown if ids[i] is None]
        for i, x in zip(rest, encode([pieces[i] for i in rest])):
            ids[i] = x
        self.new.update((pieces[i], ids[i]) for i in unknown)
        return ids

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces without spaces, one piece's after the other's, and their numbers."""
        split = pc.extract_regex(pieces, _PLAIN)
        letters, marks = (pc.fill_null(pc.struct_field(split, [k]), "") for k in (0, 1))
        letters, marks = pc.utf8_lower(letters).dictionary_encode(), marks.dictionary_encode()
        other = np.flatnonzero(split.is_null().to_numpy(zero_copy_only=False))
        known = self._ids(letters.dictionary, self._encode_plain), self._ids(marks.dictionary, self._encode_plain), self._ids(pieces.take(pa.array(other)), self._encode)
        first, second = letters.indices.to_numpy().copy(), marks.indices.to_numpy() + len(known[0])
        first[other] = len(known[0]) + len(known[1]) + np.arange(len(other))  # the second of these has no ids
        parts = [x for ids in known for x in ids]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        both = np.stack([first, second], 1).ravel()
        return _in_order(np.frombuffer(b"".join(parts), "<u4"), sizes, both), sizes[both].reshape(-1, 2).sum(1)

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """Each text's ids, as the bytes of little-endian unsigned 32-bit integers. Null texts count as empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not self.by_words:
            yield from (self._encode([text.as_py()])[0] for text in texts)
            return
        whole = np.zeros(len(texts), bool)
        for special in self.specials:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        pieces = cut.flatten().dictionary_encode()
        ids, sizes = self._pieces(pieces.dictionary)
        which = pieces.indices.to_numpy()
        raw = _in_order(ids, sizes, which).tobytes()
        ends = (np.concatenate([[0], np.cumsum(sizes[which])])[cut.offsets.to_numpy()] * 4).tolist()
        for i, text in enumerate(texts):
            yield self._encode([text.as_py()])[0] if whole[i] else raw[ends[i] : ends[i + 1]]


def _in_order(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of successive runs of ids, of those sizes, the ones of which, one after the other."""
    starts, out = np.cumsum(sizes) - sizes, [ids[:0]]
    for at in range(0, len(which), BLOCK_PIECES):
        block = which[at : at + BLOCK_PIECES]
        n = sizes[block]
        ends = np.cumsum(n)
        out.append(ids[np.repeat(starts[block] + n - ends, n) + np.arange(ends[-1])])
    return np.concatenate(out)


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    """A worker's own, with the words that it remembers, for all of its tasks."""
    return WordEncoder(path)


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of successive texts that have about GROUP_BYTES together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = [*(np.flatnonzero(np.diff(size // GROUP_BYTES)) + 1).tolist(), len(size)]
    return ((a, b - a) for a, b in zip([0, *ends], ends) if b > a)


def _encode(path: str, end_id: int, level: int):
    def run(batches):
        import os

        import zstandard

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, packer, end = _encoder(path), zstandard.ZstdCompressor(level=level, write_checksum=True), struct.pack("<I", end_id)
        for batch in batches:
            texts = batch.column("text")
            for at, n in _groups(texts):
                raw = [x + end for x in encoder(texts.slice(at, n))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n),
                        pa.array([len(x) for x in raw], pa.int64()),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array([packer.compress(x) for x in raw], pa.binary()),
                    ],
                    ["doc_id", "size", "crc32", "frame"],
                )

    return run


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_file(uri: str, rows) -> int:
    """Writes one file from (doc_id, size, crc32, frame) in order and returns the bytes written.

    The file gets its name when it is whole, so a task that dies leaves none and one that is run again replaces it.
    """
    import uuid

    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    table, n, total = bytearray(), 0, 0
    with fs.open_output_stream(part, compression=None) as out:
        for doc_id, size, crc, frame in rows:
            out.write(frame)
            total += len(frame)
            table += _ENTRY.pack(doc_id, len(frame), size, crc)
            n += 1
        body = bytes(table) + struct.pack("<QI", n, SEEKABLE)
        out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
    fs.move(part, path)
    return total + len(body) + 8


def read_table(uri: str) -> np.ndarray:
    """The seek table of a file, with `at`: where each frame begins."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        end = f.size()
        f.seek(end - 12)
        n, magic = struct.unpack("<QI", f.read(12))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        f.seek(end - 12 - n * ENTRY.itemsize)
        table = np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)
    return table


def read_ids(uri: str, which: np.ndarray, table: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of the documents at those places of the file; no other frame is read or decompressed."""
    import zstandard

    table = read_table(uri) if table is None else table
    at = np.concatenate([[0], np.cumsum(table["packed"].astype(np.int64))])
    unpack = zstandard.ZstdDecompressor()
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        for i in which:
            f.seek(int(at[i]))
            raw = unpack.decompress(f.read(int(table["packed"][i])), max_output_size=int(table["size"][i]))
            if len(raw) != table["size"][i] or zlib.crc32(raw) != table["crc32"][i]:
                raise ValueError(f"frame {i} of {uri} is damaged")
            yield int(table["doc_id"][i]), np.frombuffer(raw, "<u4")


def _write(folder: str):
    def run(batches):
        """Each task writes the file of its range. The file's frames are never all in memory, its seek table is."""
        from pyspark import TaskContext

        file, n, ids = TaskContext.get().partitionId(), 0, 0

        def rows():
            nonlocal n, ids
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "size", "crc32", "frame"))):
                    n, ids = n + 1, ids + row[1] // 4
                    yield row

        source = rows()
        first = next(source, None)
        if first is not None:
            uri = f"{folder}/{file:08d}.ids"
            size = write_file(uri, chain([first], source))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, uri, n, ids, size)], ["file", "uri", "n_docs", "n_ids", "bytes"])

    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs' (doc_id, text) token ids and returns one row a file: file, uri, n_docs, n_ids, bytes.

    Null and empty texts have the end id alone. Null doc_ids are written as the smallest 64-bit integer. Rows of one
    doc_id all are written, in the order of their ids' crc32 and size. There are as many files as file_bytes asks for
    (of small tables up to 64, of 1 MB at least), each a range by a sample of rows. An empty table gives no files.
    Without a folder, files are in the session's part of the shared folder and go with it.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    frames = stored(docs.mapInArrow(_encode(tokenizer, end_id, level), "doc_id long, size long, crc32 long, frame binary"), "frames")
    total = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    n_files = max(1, -(-total // file_bytes), min(64, total >> 20))
    # equal rows may be in any order; their row numbers let ranges part them
    numbered = frames.withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(n_files, "doc_id", "crc32", "size", "row").sortWithinPartitions("doc_id", "crc32", "size")
    files = stored(ordered.mapInArrow(_write(folder), "file long, uri string, n_docs long, n_ids long, bytes long"), "files")
    discard(frames)
    return files


def _read(batches):
    for batch in batches:
        for uri, start, n in zip(*(batch.column(c).to_pylist() for c in ("uri", "start", "n_docs"))):
            rows, at = [], start
            for doc_id, ids in read_ids(uri, np.arange(n)):
                rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                at += len(ids)
                if len(rows) == READ_DOCS:
                    yield _digests(rows)
                    rows = []
            if rows:
                yield _digests(rows)


def _digests(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files. files: what write_ids returned.

    A task reads whole files, their seek tables once. Offsets are running sums in two steps: of groups of SUM_FILES
    files, then within each.
    """
    group = F.floor(F.col("file") / SUM_FILES)
    before = lambda window: F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = files.withColumn("group", group)
    sums = grouped.groupBy("group").agg(F.sum("n_ids").alias("n_ids")).select("group", before(Window.orderBy("group")).alias("base"))
    start = F.col("base") + before(Window.partitionBy("group").orderBy("file"))
    placed = stored(grouped.join(sums, "group").select("file", "uri", "n_docs", start.alias("start")), "file-starts")
    spread = max(1, min(placed.count(), 1 << 20))
    return placed.repartition(spread).select("uri", "start", "n_docs").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")

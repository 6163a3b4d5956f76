import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from herdlens.llm import tokenbin as B
from herdlens.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["Don't", "naïve,", "ÀÉÎ!", "ß", "İx", "ﬁ", "é ́", "12a", "<|endoftext|>", "a.b", "x y", "...", "µ", "Σας"])), max_size=6), st.sampled_from([" ", "\n", "  ", "\t"]))
def test_words_of_a_text_have_the_tokens_of_the_text(parts, blank):
    encoder = test_words_of_a_text_have_the_tokens_of_the_text.__dict__.setdefault("encoder", B.WordEncoder(PATH, 50))
    text = blank.join(parts)
    want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert next(encoder([text])) == want


def test_files_round_trip(spark, data, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    files = B.write_ids(docs, PATH, f"file://{tmp_path}/ids", file_bytes=1 << 16)
    got = sorted(B.read_digests(files).collect())
    start = 0
    rows = sorted(docs.select("doc_id", "text").collect())
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, B.END_ID], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    # one document only, and a standard reader on the whole file
    uri = files.orderBy("file").first().uri
    table = B.read_table(uri)
    (doc_id, ids), = B.read_ids(uri, np.array([len(table) // 2]))
    assert doc_id == rows[len(table) // 2][0] and len(ids) * 4 == table["size"][len(table) // 2]
    path = uri.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[int(table["packed"][0]) // 2] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017 - zstandard's own error, or ours
        list(B.read_ids(uri, np.array([0])))
    if len(table) > 1:
        assert len(list(B.read_ids(uri, np.array([1])))) == 1


def test_files_follow_their_size_and_one_id_is_spread(spark, tmp_path):
    docs = spark.createDataFrame([(5, f"text {i % 9} of one id " * 20) for i in range(600)] + [(1, "a"), (9, "z")], "doc_id long, text string")
    folders = [f"file://{tmp_path}/{i}" for i in "ab"]
    files = [B.write_ids(docs, PATH, f, file_bytes=1 << 10) for f in folders]
    n = files[0].agg({"bytes": "sum", "n_docs": "sum", "n_docs": "max"}).first()
    assert files[0].count() > 20 and n["max(n_docs)"] < 120
    one, two = (sorted(map(tuple, B.read_digests(f).collect()), key=lambda r: r[1]) for f in files)
    assert one == two and [r[0] for r in one] == [1, *[5] * 600, 9]
    assert [r[1] for r in one] == np.concatenate([[0], np.cumsum([r[2] for r in one])])[:-1].tolist()


def test_other_tokenizers_go_through_the_library(tokenizer):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    other, encoder = Tokenizer.from_file(path), B.WordEncoder(path)
    assert B._splits_words(tokenizer) and not encoder.by_words
    texts = ["Don't  Stop\n now", "", "ÀÉ naïve 123"]
    assert list(encoder(texts)) == [np.array(other.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def _whole(tokenizer, texts):
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_each_word_is_encoded_once_whatever_its_case_and_punctuation(tokenizer, monkeypatch):
    encoder, seen = B.WordEncoder(PATH), []
    plain = encoder._encode_plain
    monkeypatch.setattr(encoder, "_encode_plain", lambda words: seen.extend(words) or plain(words))
    texts = ["Word, word; WORD", "word.\nÀÉ àé!", None, "", "don't word"] * 300
    for kind in (pa.string(), pa.large_string()):
        assert list(encoder(pa.array(texts, kind))) == _whole(tokenizer, texts[:5]) * 300
    assert sorted(seen) == sorted(["word", "àé", ",", ";", ".", "!"])


def test_a_worker_keeps_its_encoder_from_task_to_task(monkeypatch):
    made, init = [], B.WordEncoder.__init__
    monkeypatch.setattr(B.WordEncoder, "__init__", lambda self, *args: made.append(args) or init(self, *args))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", None]})
    one, two = ([b for b in B._encode(PATH, 1, 3)(iter([batch]))] for _ in range(2))
    assert one == two and len(made) <= 1


def test_all_plain_letters_and_marks(tokenizer):
    letters = [chr(i) for i in range(0xC0, 0x100)] + list("azAZ")
    texts = [f"{c} {c}{c} x{c}{d}" for c in letters for d in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~×÷ªº5"]
    texts += ["a</w>b </w> x</w>", "a\0b", "a ́b", "H̱", "İ ẖ", "a b c\x85d"]
    assert list(B.WordEncoder(PATH)(texts)) == _whole(tokenizer, texts)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_groups_blocks_and_forgotten_words_change_nothing(tokenizer, monkeypatch, size):
    monkeypatch.setattr(B, "GROUP_BYTES", size)
    monkeypatch.setattr(B, "PLAIN_WORDS", size)
    monkeypatch.setattr(B, "BLOCK_PIECES", size)
    texts = pa.array([None if i % 11 == 3 else " ".join(f"W{'abcdefg'[k % 7] * (k % 5)}{'.' * (k % 3)} {k}" for k in range(i % 13)) + "<|endoftext|>" * (i % 17 == 4) for i in range(120)])
    encoder = B.WordEncoder(PATH, 5)
    groups = list(B._groups(texts))
    assert sum(n for _, n in groups) == 120 and [a for a, _ in groups] == np.cumsum([0, *(n for _, n in groups)])[:-1].tolist()
    assert [x for at, n in groups for x in encoder(texts.slice(at, n))] == _whole(tokenizer, texts.to_pylist())
    assert list(B._groups(texts.slice(0, 0))) == [] and list(encoder(texts.slice(0, 0))) == []
    assert len(encoder.new) + len(encoder.old) < 200


def test_awkward_rows(awkward, empty, nulls):
    got = B.read_digests(B.write_ids(awkward, PATH)).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[-(1 << 63)].start == 0 and by[8].n_tokens > 60_000
    assert sorted(r.start for r in got) == np.concatenate([[0], np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])])[:-1].tolist()
    assert B.read_digests(B.write_ids(empty, PATH)).count() == 0 and B.read_digests(B.write_ids(nulls, PATH)).count() == 2

import re

import corpus_pipeline as C
from test_linededup import brute as lines_of
from test_neardup import brute as groups_of

from herdlens.llm import nbest
from herdlens.llm.common import stored
from herdlens.llm.queries import vocabulary


def test_stages_one_by_one(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    out = {}
    for name, stage in C.STAGES:
        before, docs = docs, stored(stage(spark, docs, f"{data}/sf0.001"), "t")
        out[name] = docs
        if name != C.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        rows, was = docs.collect(), before.collect()
        if name == "language ID":
            assert {r.lang for r in rows} <= {"de", "en", "es", "fr"}
            assert {r.doc_id for r in was if re.search(r"[^\W\d_]{20}", r.text or "")} <= {r.doc_id for r in rows}
        elif name == "line dedup":
            assert sorted((r.doc_id, r.text) for r in rows) == [(i, t) for i, _, _, t in lines_of([(r.doc_id, r.text) for r in was]) if t.strip(" \t\n\x0b\f\r")]
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "MinHash near-dedup":
            want = {i for i, (_, c) in groups_of([(r.doc_id, r.text) for r in was], 5).items() if i == c}
            assert {r.doc_id for r in rows} == want
        elif name == "mixing sources":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in was} and max(sum(1 for x in rows if x.doc_id == r.doc_id) for r in rows) <= 3
        else:
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in was) and all(r.round_trip for r in rows)
            back = nbest.decode(docs, vocabulary("piece_bpe_32k.model"))
            assert sorted(map(tuple, back.collect())) == sorted((r.doc_id, r.text) for r in was)
    whole = C.run(spark, f"{data}/sf0.001")
    assert sorted((r.doc_id, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.ids_crc32) for r in rows)


def test_emptied_documents_go(spark):
    docs = spark.createDataFrame([(1, "one line that repeats", "en", "a", 21), (2, "one line that repeats\n ", "en", "a", 23), (3, "own words here", "en", "a", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in C.drop_repeated_lines(spark, docs, "").collect()) == [(1, "one line that repeats"), (3, "own words here")]


def test_awkward_rows_go_through(spark, awkward, empty, nulls):
    for table, least in ((awkward, 1), (empty, 0), (nulls, 0)):
        docs = table.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in C.STAGES:
            docs = stored(stage(spark, docs, ""), "t")
        assert docs.count() >= least


def test_last_stage_returns_ids(spark, awkward):
    rows = C.encode_pieces(spark, awkward.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
    assert len(rows) == awkward.count() and all(len(r.scores) == len(r.others) + 1 and len(r.ids) == r.n_pieces for r in rows)

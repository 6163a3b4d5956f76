import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.llm import nbest as S
from herdlens.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return S.Lattice.load(PATH)


def brute(lattice, part):
    found = []

    def go(i, score, ids):
        if i == len(part):
            found.append((score, ids))
            return
        single = False
        for j in range(i + 1, len(part) + 1):
            piece = lattice.pieces.get(part[i:j])
            if piece:
                go(j, score + piece[1], (*ids, piece[0]))
                single = single or j == i + 1
        if not single:
            raw = part[i].encode()
            go(i + 1, score + lattice.byte_score, (*ids, *(lattice.byte_ids[b] for b in raw)))

    go(0, 0, ())
    return sorted(((score, S._raw(*ids)) for score, ids in found), reverse=True)


def whole(found):
    """(score, ids) of each segmentation that a Segmenter returned."""
    ids, out = found[0], []
    for score, made in found[1]:
        raw, at = b"", 0
        for place, n, new in made:
            raw += ids[4 * at : 4 * place] + new
            at = place + n
        out.append((score, raw + ids[4 * at :]))
    return out


@pytest.mark.parametrize("n", [1, 2, 4])
def test_n_best_of_texts_like_brute_force(lattice, n):
    rng, segment, decode = random.Random(n), S.Segmenter(lattice, n, cache=40), S.Decoder(lattice)
    for _ in range(200):
        text = "".join(rng.choice("the  on,.\nañx☃") for _ in range(rng.randint(1, 11)))
        want, got = brute(lattice, S.SPACE + text.replace(" ", S.SPACE)), whole(segment(text))
        assert [s for s, _ in got] == [s for s, _ in want[:n]]
        assert set(got) <= set(want) and len(set(got)) == len(got)
        assert all(decode(ids) == text for _, ids in got)


def test_second_best_loss(lattice):
    rng = random.Random(9)
    for _ in range(300):
        part = S.SPACE + "".join(rng.choice("thenorxé☃") for _ in range(rng.randint(1, 9)))
        want = brute(lattice, part)
        score, ids, loss = lattice.first(part)
        assert score == want[0][0] and (score, ids) in want and lattice.n_best(part, 1) == [(score, ids)]
        assert loss == (want[0][0] - want[1][0] if len(want) > 1 else S.NEVER)
        assert [s for s, _ in lattice.n_best(part, 6)] == [s for s, _ in want[:6]]


def test_scores_are_the_models_own(lattice):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for piece in ("▁the", "er", "▁", "z"):
        i, score = lattice.pieces[piece]
        assert model.id_to_piece(i) == piece and score == round(1e6 * model.get_score(i))
    assert lattice.byte_score < min(s for p, (_, s) in lattice.pieces.items() if len(p) == 1)


def test_encode_and_decode(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    out = S.encode(docs, PATH)
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
    back = S.decode(out, PATH).join(docs.withColumnRenamed("text", "was"), "doc_id")
    assert back.where("text <> was").count() == 0
    assert out.where("size(scores) > 1 and scores[0] < scores[1]").count() == 0


def test_awkward_rows(spark, awkward, empty, nulls):
    got = S.encode(awkward, PATH)
    rows = got.collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == awkward.count() and all(r.round_trip for r in rows)
    assert by[3].n_pieces == by[4].n_pieces == 0 and by[3].scores == [0.0] and by[8].n_pieces > 60_000
    odd = spark.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in S.encode(odd, PATH).collect()} == {1: False, 2: True}
    assert S.encode(empty, PATH).count() == 0 and S.encode(nulls, PATH).count() == 2


def test_query_returns_ids_of_all_segmentations(spark, data):
    import zlib

    from herdlens.llm.queries import op5_nbest_pieces

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()}
    out = op5_nbest_pieces(spark, f"{data}/sf0.001")
    out = out.withColumn("all", F.array(*[S.segmentation(k) for k in range(S.N_BEST)]))
    rows, segment = out.collect(), S.Segmenter(S.Lattice.load(PATH))
    assert len(rows) == len(texts) and max(len(r.others) for r in rows) == S.N_BEST - 1
    for r in rows:
        raw = [np.array(x, "<u4").tobytes() for x in r.all if x is not None]
        assert raw == [x for _, x in whole(segment(texts[r.doc_id]))] and len(set(raw)) == len(raw)
        assert len(r.scores) == len(raw) == len(r.others) + 1 and len(r.ids) == r.n_pieces and zlib.crc32(raw[0]) == r.ids_crc32
    for which in range(S.N_BEST):
        back = {r.doc_id: r.text for r in S.decode(out, PATH, which=which).collect()}
        assert all(back[r.doc_id] == (texts[r.doc_id].replace(S.SPACE, " ") if which <= len(r.others) else None) for r in rows)


def test_small_batches(spark, awkward, monkeypatch):
    want = sorted(map(repr, S.encode(awkward, PATH).collect()))
    schema = S.encode(awkward, PATH).schema
    monkeypatch.setattr(S, "OUT_BYTES", 8)
    batches = awkward.select("doc_id", "text").coalesce(1).toArrow().to_batches()
    got = spark.createDataFrame([r for b in S._encode(PATH, S.N_BEST, 50)(batches) for r in zip(*b.to_pydict().values())], schema)
    assert sorted(map(repr, got.collect())) == want


def test_long_unbroken_text_takes_memory_by_its_length(lattice):
    """200,000 letters, digits, blanks or one letter, without a space that cuts them."""
    import resource

    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(200_000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT", "aZ09+/=", "a", " ")]
    for text in texts:
        segment = S.Segmenter(lattice, 4)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        ids, best, same = segment(text)
        assert same and len(best) == 4 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000, text[:9]
        assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True) and S.Decoder(lattice)(ids) == text
        assert len({raw for _, raw in whole((ids, best, same))}) == 4


def test_cache_is_bounded_in_bytes(lattice):
    rng, segment = random.Random(6), S.Segmenter(lattice, 2, cache=200)
    for i in range(60):
        segment("".join(rng.choice("abc019") for _ in range(2000)) + f" x{i}")
        held = sum(S._size(u, f[1]) for d in (segment.units, segment.old, segment.parts) for u, f in d.items())
        assert held <= 3 * (200 * S.PART_BYTES + 2 * 60_000)

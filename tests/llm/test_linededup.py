import random

from herdlens.llm import linededup as D


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate({i: i + 32 for i in range(65, 91)})


def brute(docs, least=10):
    first, held = {}, {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, i), i)
                held.setdefault(k, set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(held[key(x)]) > 1 and first[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in D.dedup_lines(df).collect())


def test_like_brute_force(spark):
    rng = random.Random(4)
    pool = [f"{' ' * (i % 3)}common line number {i}{chr(9) * (i % 2)}" for i in range(30)] + ["ÉCOLE école Éa", "école École éA", "short", "", "exactly10!", "exactly 9"]
    docs = [(i * 3, "\n".join(rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 200])))) for i in range(40)]
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_a_line_in_most_documents(spark):
    docs = [(i, f"the line that everybody has\nown line of number {i}\nthe line that everybody has") for i in range(9000)]
    got = result(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute(docs)


def test_awkward_rows(awkward, empty, nulls):
    got = D.dedup_lines(awkward)
    assert set(awkward.columns) <= set(got.columns) and len(got.columns) == len(set(got.columns))
    by = {r.doc_id: r for r in got.collect()}
    assert (by[3].n_lines, by[3].n_dropped, by[3].kept_text) == (1, 0, "") and by[2].kept_text == "other" and by[1].n_dropped == 0
    assert got.count() == awkward.count() and D.dedup_lines(empty).count() == 0 and D.dedup_lines(nulls).count() == 2


def test_bitmaps_tell_which_lines_stay(spark):
    docs = [(0, "a line that is shared"), (1, "\n".join(["a line that is shared" if i in (0, 63, 64, 130) else f"own line {i}, long enough" for i in range(200)]))]
    by = {r.doc_id: r.keep_bitmap for r in D.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    stays = lambda words, i: words.get(i // 64, -1) >> (i % 64) & 1
    assert by[0] == {} and sorted(by[1]) == [0, 1, 2] and [i for i in range(200) if not stays(by[1], i)] == [0, 63, 64, 130]


def test_rows_of_one_id_are_one_document(spark):
    docs = [(5, "a line that is shared"), (5, "other\na line that is shared"), (4, "nothing of that"), (7, "a line that is shared\nx")]
    got = result(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == [(4, 1, 0, "nothing of that"), (5, 1, 0, "a line that is shared"), (5, 2, 0, "other\na line that is shared"), (7, 2, 1, "x")]


def test_no_python_in_the_plan(spark, awkward):
    plan = D.dedup_lines(awkward)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

import random
import re

import pyarrow as pa
import pytest

from herdlens.llm import licenses as L
from herdlens.llm import textarrays as T


def test_optional_and_replaceable_regions():
    a = L.Automaton('Licensed <<beginOptional>>freely <<beginOptional>>and gladly<<endOptional>><<endOptional>> by <<var;name="who";original="X";match=".{1,3}">> under <<var;name="v";original="2";match="(1|2)">> terms')
    h = lambda s: [L.word_hash(w) for w in L.text_words(s)]
    assert a.longest(h("licensed by me under 1 terms more")) == 6
    assert a.longest(h("LICENSED freely, and gladly by a b c under 2 terms")) == 11
    assert a.longest(h("licensed freely by you under 2 terms")) == 7
    for wrong in ("licensed by under 1 terms", "licensed by a b c d under 1 terms", "licensed by me under 3 terms", "licensed and gladly by me under 1 terms", "licensed by me beneath 1 terms", ""):
        assert a.longest(h(wrong)) == 0, wrong


@pytest.mark.parametrize("bad", ["<<beginOptional>>x", "x<<endOptional>>", 'x <<var;match="a+b">>', "<<what>>", '<<var;match=".+">> x', "<<beginOptional>>x<<endOptional>>"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        L.Automaton(bad)


def parsed(template):
    """The template as nested lists: words, ('opt', [...]), ('any', least, most or None), ('one', words)."""
    stack, at = [[]], 0
    for m in [*re.finditer(r"<<(.*?)>>", template), None]:
        stack[-1] += L.text_words(template[at : m.start() if m else len(template)])
        if not m:
            return stack[0]
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        else:
            match = re.search('match="(.*?)"', m[1])[1]
            bounds = re.findall(r"\d+", match) if match.startswith(".{") else None
            stack[-1].append(("any", 1, None) if match == ".+" else ("any", int(bounds[0]), int(bounds[1])) if bounds else ("one", match[1:-1].split("|")))


def runs(parts, words, i, open_=()):
    """Every way to match parts from word i on: (end, unbounded regions as (first word, end))."""
    if not parts:
        yield i, open_
        return
    head, rest = parts[0], parts[1:]
    if isinstance(head, str):
        if i < len(words) and words[i] == head:
            yield from runs(rest, words, i + 1, open_)
    elif head[0] == "one":
        if i < len(words) and words[i] in head[1]:
            yield from runs(rest, words, i + 1, open_)
    elif head[0] == "opt":
        yield from runs(rest, words, i, open_)
        yield from runs([*head[1], *rest], words, i, open_)
    else:
        for n in range(head[1], (len(words) - i if head[2] is None else min(head[2], len(words) - i)) + 1):
            yield from runs(rest, words, i + n, (*open_, (i, i + n)) if head[2] is None else open_)


def backtracked(template, words):
    """The longest span, by trying everything. No unbounded region may go on over a place where a span was accepted."""
    left, found = set(runs(parsed(template), words, 0)), 0
    while left := {(e, o) for e, o in left if e > found and not any(a < found < b for a, b in o)} if found else left:
        found = min(e for e, _ in left)
    return found


TEMPLATES = [
    'a b <<var;match=".+">> c',
    'a <<beginOptional>>b <<beginOptional>>c<<endOptional>> a<<endOptional>> <<var;match=".{1,2}">> b <<beginOptional>>a <<var;match=".+">> c<<endOptional>>',
    'a <<var;match="(b|c)">> <<beginOptional>><<var;match=".+">><<endOptional>> a <<beginOptional>>b<<endOptional>>',
    'b <<var;match=".+">> a <<var;match=".+">> c <<beginOptional>>c b<<endOptional>>',
    'c <<beginOptional>><<var;match=".{0,2}">><<endOptional>> a <<beginOptional>>b <<var;match=".+">> b<<endOptional>> <<beginOptional>>c<<endOptional>>',
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_automata_like_backtracking(template):
    rng, a = random.Random(template), L.Automaton(template)
    some = 0
    for _ in range(3000):
        words = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        want = backtracked(template, words)
        assert a.longest(words) == a.longest([L.word_hash(w) for w in words]) == want, words
        some += want > 0
    assert some > 50


def test_labels_and_spans_of_texts_like_backtracking(spark):
    rng = random.Random(5)
    templates = {f"t{i}": t for i, t in enumerate(TEMPLATES)}
    texts = [" ".join(rng.choice(["a", "B", "c,", "d"]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(docs, phrases={"a b": "ab"}, templates=templates).collect():
        words = L.text_words(texts[r.doc_id])
        want = [(i, t, n) for t, x in templates.items() for i in range(len(words)) if (n := backtracked(x, words[i:]))]
        assert sorted((s.first_word, s.label, s.n_words) for s in r.spans if s.template) == sorted(want)


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_holders_of_any_length(n):
    holder = " ".join(f"holder{i}" for i in range(n))
    for label in ("mit", "bsd", "isc"):
        template = L.TEMPLATES[label]
        text = re.sub(r'<<var;.*?original="(.*?)";match="(.*?)">>', lambda m: holder if m[2] == ".+" else m[1], template)
        words = L.text_words(re.sub(r"<<.*?>>", " ", text))
        assert L.Automaton(template).longest(words) == len(words) > n
        # mandatory wording that is missing or wrong
        assert not L.Automaton(template).longest(words[:-1]) and not L.Automaton(template).longest([*words[:30], "x", *words[30:]])
    assert L.Automaton(L.TEMPLATES["copyright-notice"]).longest(["copyright", *(["x"] * min(n, 60)), "all", "rights", "reserved"]) == min(n, 60) + 4


def test_one_license_does_not_run_on_into_the_next():
    text = re.sub(r"<<.*?>>", " ", re.sub(r'<<var;.*?original="(.*?)";.*?>>', r"\1", L.TEMPLATES["isc"]))
    words = L.text_words(text)
    assert L.Automaton(L.TEMPLATES["isc"]).longest([*words, "and", *words]) == len(words)


def test_hashes_alone_do_not_count():
    scanner = L.Scanner({"cc by": "x"}, {"t": "a b"})
    assert scanner.confirmed(["cc", "be"], "x", False, 0, 2) == 0 and scanner.confirmed(["z", "cc", "by"], "x", False, 1, 2) == 2
    assert scanner.confirmed(["a", "c"], "t", True, 0, 2) == 0 and scanner.confirmed(["a", "b"], "t", True, 0, 2) == 2


def test_every_template_accepts_its_own_original_wording():
    for label, template in L.TEMPLATES.items():
        text = re.sub(r'<<var;.*?original="(.*?)";.*?>>', r"\1", template)
        text = re.sub(r"<<.*?>>", " ", text)
        words = L.text_words(text)
        assert L.Automaton(template).longest([L.word_hash(w) for w in words]) == len(words), label


def brute(text):
    words = L.text_words(text or "")
    found = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(found)


def test_words_and_phrases_like_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in L.scan(docs, templates={}).collect():
        assert (r.n_words, sorted((s.first_word, s.label) for s in r.spans)) == brute(texts[r.doc_id])


def test_blocks_do_not_matter():
    texts = pa.array(["cc by", "", "by cc", "x CC-BY y", None, "cc"])
    data, offsets = T.text_buffers(texts)
    scanner = L.Scanner(L.PHRASES, L.TEMPLATES)
    h, b = T.words(data[offsets[0] : offsets[-1]], offsets, T.ALNUM)
    assert [(t, s) for t, _, template, s, _ in scanner.scan(h, b) if not template] == [(0, 0), (3, 1)]
    assert list(b[1:] - b[:-1]) == [2, 0, 2, 4, 0, 1]


def test_awkward_rows(awkward, empty, nulls):
    got = {(r.doc_id, r.n_words, len(r.spans)) for r in L.scan(awkward).collect()}
    assert {(3, 0, 0), (4, 0, 0), (5, 0, 0), (8, 60_000, 0), (10, 6, 2)} <= got
    assert L.scan(awkward).count() == awkward.count() and L.scan(empty).count() == 0 and L.scan(nulls).count() == 2

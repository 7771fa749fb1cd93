"""Trained operators: held-out accuracy and defined results for odd texts."""

import pickle
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from coordframe.llm import common, html_extract, language, quality_fm, queries, toxicity

ODD = [None, "", " \n\t", "x" * 50_000, "a b c d e f", "éß漢字 \U0001f600", "word " * 30_000]


def held(doc_id, modulus, part):
    return zlib.crc32(str(doc_id).encode()) % modulus == part


@pytest.fixture(scope="module")
def sample():
    import duckdb

    base = "/root/testdata/sf0.01"
    return duckdb.sql(
        f"select d.doc_id, d.text, d.lang, l.toxic, l.quality from '{base}/documents.parquet' d left join '{base}/labels.parquet' l using (doc_id) order by 1"
    ).fetchall()


def test_string_kernel_tolerates_gaps():
    assert toxicity.kernel("idiot", "idiot") == pytest.approx(1)
    assert toxicity.kernel("idiot", "idxiot") > 0.4 > toxicity.kernel("idiot", "table")
    assert toxicity.kernel("moron", "mo-ron") > 0.4
    assert toxicity.kernel("ab", "zz") == 0
    assert "idiot" in toxicity.strings_of("you i d i o t there")
    assert {"moron"} == toxicity.strings_of("...Moron!!")


def test_folded_model_equals_the_kernel_sum():
    marks = ["idiot", "moron", "table"]
    basis = toxicity._Landmarks(marks)
    w = np.arange(1.0, basis.half.shape[1] + 1)
    model = basis.fold(w, 0.0)
    strings = ["idiot", "idxiot", "moronic", "chair", "a", "über"]
    k = np.array([[toxicity.kernel(s, m) for m in marks] for s in strings])
    want = np.maximum(0, k @ basis.half @ w)
    np.testing.assert_allclose(model.margins(strings), want, atol=1e-5)
    np.testing.assert_allclose(basis.embed(strings), k @ basis.half, atol=1e-9)


def test_toxicity_held_out(sample):
    rows = [(i, t, y) for i, t, _, y, _ in sample if y is not None and t]
    model = toxicity.train([(t, y) for i, t, y in rows if not held(i, 5, 0)])
    test = [(t, y) for i, t, y in rows if held(i, 5, 0)]
    bags = [sorted(toxicity.strings_of(t)) for t, _ in test]
    p = model.probability(np.array([model.margins(b).max() if b else 0.0 for b in bags]))
    y = np.array([y for _, y in test])
    assert ((p >= 0.5) == y).mean() > 0.9


def test_toxicity_of_phrases(spark):
    """Ordinary words that are toxic together; and words parted or spelled out over any white space."""
    rng = np.random.default_rng(8)
    words = [a + b for a in "ka lo mi ten ra su ver ni".split() for b in "do pel ist an cho gra be un".split()] + ["eat", "your", "shoes"] * 3

    def text(*planted):
        out = rng.choice(words, 60).tolist()
        for p in planted:
            out.insert(int(rng.integers(len(out))), p)
        return " ".join(out)

    model = toxicity.train([(text("eat your shoes"), 1) for _ in range(200)] + [(text("shoes your"), 0) for _ in range(200)])
    test = [text("eat your shoes") for _ in range(30)] + [text("Eat,  your\nshoes!") for _ in range(30)] + [text("shoes your") for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(test)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.with_toxicity(df, model).collect()}
    assert np.mean([got[k] == (k < 60 or "eat your shoes" in test[k]) for k in got]) > 0.9
    assert {"idiot"} <= toxicity.strings_of("you i  d\ni o\t t there")


def test_phrase_margins_against_brute_force():
    marks = ["idiot", "eat\x01your", "table\x01top\x01idiot"]
    basis = toxicity._Landmarks(marks)
    model = basis.fold(np.array([1.0, 0.6, -0.3]), 0.0)
    texts = ["an id iot at a table top", "eat your - eat your table", "x", "", "y" * 100 + " id iot", "top " * 9000 + "eat your idiot"]
    seqs = [toxicity.words_of(t) for t in texts]
    best, which = model.with_phrases(seqs, np.zeros(len(seqs)))
    for k, w in enumerate(seqs):
        names = sorted({"\x01".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)})
        want = max(model.margins(names), default=0.0)
        assert best[k] == pytest.approx(want, abs=1e-5) and (want == 0 or which[k] in names)


def test_remembered_strings(spark, monkeypatch):
    """Scores don't depend on what a worker remembers."""
    model = toxicity.train([("you moron", 1), ("a nice day", 0)] * 20)
    df = spark.createDataFrame([(k, f"word{k} you mo-ron{k % 3} day{k % 7}") for k in range(600)], "doc_id long, text string").coalesce(1)
    want = toxicity.with_toxicity(df, model).collect()
    monkeypatch.setattr(toxicity, "CACHE", 50)
    assert toxicity.with_toxicity(df, model).collect() == want


def test_toxicity_of_long_texts_in_pieces(spark, monkeypatch):
    """What is held follows neither from a text's length nor from how many long ones come together, and cuts lose nothing."""
    model = toxicity.train([("you moron", 1), ("a nice day", 0)] * 20)
    score = toxicity.scorer(model).func
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(15_000)) for _ in range(40)]
    texts += [" ".join(texts[:20]), None, ""]
    tracemalloc.start()
    got = next(iter(score(iter([pa.array(texts)])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(texts) and peak < 60e6
    odd = ["a nice day " * 3 + "m o r o n " * 2 + "ab - ? ! yo u " * 4, "a b c d e f g h " * 4, "x" * 90 + " a  b\n\nc dd  --- e", " \n moron " * 5, "day - - - you - - - moron"]
    odd += [" ".join("".join(rng.choice(list("abÄ-. \n\t"), rng.integers(1, 4))) for _ in range(60)) for _ in range(40)]
    want = next(iter(score(iter([pa.array(odd)])))).to_pylist()
    monkeypatch.setattr(toxicity, "PIECE", 10)
    monkeypatch.setitem(score.__globals__, "PIECE", 10)
    assert max(len(list(toxicity.pieces(t))) for t in odd) > 5
    for t in odd:
        parts = list(toxicity.pieces(t))
        assert "".join(parts) == t
        assert set().union(*map(toxicity.strings_of, parts)) == toxicity.strings_of(t)
        assert [w for p in parts for w in toxicity.words_of(p)] == toxicity.words_of(t)
    assert next(iter(score(iter([pa.array(odd)])))).to_pylist() == want


def test_toxicity_of_many_characters(monkeypatch):
    """A model's size follows its landmarks, not the cube of their characters, and its scores stay the same."""
    rng = np.random.default_rng(9)
    words = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 4000, rng.integers(1, 4)))) for _ in range(3000)]
    bad = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 4000, 3))) for _ in range(5)]

    def text(y):
        out = [words[int(k)] for k in np.minimum(rng.pareto(0.5, 60), 2999)]
        return " ".join([*out, bad[rng.integers(5)], *out[:9]] if y else out)

    sample = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(450)]
    model = toxicity.train(sample)
    assert len(model.alphabet) > 130 and len(pickle.dumps(model)) < 5e6
    test = [(text(k % 2), k % 2) for k in range(60)]
    p = [model.probability(model.margins(toxicity.words_of(t))).max() >= 0.5 for t, _ in test]
    assert np.mean([a == bool(y) for a, (_, y) in zip(p, test, strict=True)]) > 0.9
    monkeypatch.setattr(toxicity, "DENSE", 1 << 40)
    marks = words[:60] + bad
    whole = toxicity._Landmarks(marks)
    monkeypatch.setattr(toxicity, "DENSE", 0)
    few = toxicity._Landmarks(marks)
    strings = words[:90] + ["a", "", *bad] + [w[::-1] + "x" for w in words[:40]]
    np.testing.assert_array_equal(few.embed(strings), whole.embed(strings))
    w = rng.normal(size=few.half.shape[1])
    got = few.fold(w, 0.0)
    monkeypatch.setattr(toxicity, "DENSE", 1 << 40)
    want = whole.fold(w, 0.0)
    assert isinstance(got.table, toxicity._Sparse) and isinstance(want.table, np.ndarray)
    np.testing.assert_array_equal(got.margins(strings), want.margins(strings))
    assert want.margins(strings).max() > 0


def test_workers_give_memory_back(monkeypatch):
    """After its last rows, a task releases what is free; the rows are those of the function itself."""
    done = []
    monkeypatch.setitem(common.released.__globals__, "release", lambda: done.append(1))
    rows = common.released(lambda batches: (b * 2 for b in batches))(iter([1, 2]))
    assert (next(rows), list(done), list(rows), done) == (2, [], [4], [1])
    monkeypatch.undo()
    common.release()


def test_toxicity_without_classes():
    model = toxicity.train([("fine words", 0), ("more words", 0)])
    assert model.probability(model.margins(["fine"])).max() < 0.5


def test_odd_texts(spark):
    docs = spark.createDataFrame([(k, t, "other") for k, t in enumerate(ODD)], "doc_id long, text string, score string")
    model = toxicity.train([("you moron", 1), ("a nice day", 0)] * 20)
    got = toxicity.with_toxicity(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    lang = language.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)
    got = {r["doc_id"]: r["language"] for r in language.with_language(docs, lang).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3
    assert all(0 <= g["score"] <= 1 for g in got.values())
    fm = quality_fm.train([("plain words here", 1), ("bad!! BAD!! ###", 0)] * 20, epochs=2)
    got = quality_fm.with_quality(docs.select("doc_id", "text"), fm).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    empty = docs.where("false").select("doc_id", "text")
    assert toxicity.with_toxicity(empty, model).count() == language.with_language(empty, lang).count() == quality_fm.with_quality(empty, fm).count() == 0


def test_columns_of_the_same_name_are_replaced(spark):
    """Every other column stays, in its place or name; null and repeated ids decide nothing."""
    rows = [(None, "you moron there", "<p>x</p>", "s", "l", "r"), (1, "a nice day", None, "s", "l", "r"), (1, "a nice day", None, "s", "l", "r"), (2, None, "", "s", "l", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, html string, score string, language string, other string")
    tox = toxicity.train([("you moron", 1), ("a nice day", 0)] * 20)
    fm = quality_fm.train([("plain words here", 1), ("bad!! BAD!! ###", 0)] * 20, epochs=2)
    lang = language.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)
    for made, name, kind in (
        (toxicity.with_toxicity(docs, tox), "score", "double"),
        (quality_fm.with_quality(docs, fm), "score", "double"),
        (language.with_language(docs, lang), "language", "struct<lang_pred:string,score:double>"),
        (html_extract.with_main_text(docs), "text", "string"),
    ):
        assert sorted(made.columns) == sorted(docs.columns) and dict(made.dtypes)[name] == kind
        got = made.collect()
        assert len(got) == 4 and [r["other"] for r in got] == ["r"] * 4 and got[1][name] == got[2][name]


def test_language_held_out(sample):
    rows = [(i, t, lang) for i, t, lang, _, _ in sample if t and lang]
    model = language.train([(t, lang) for i, t, lang in rows if not held(i, 4, 2)])
    test = [(t, lang) for i, t, lang in rows if held(i, 4, 2)]
    assert np.mean([model.predict(t)[0] == lang for t, lang in test]) > 0.95
    assert (model.weights == 0).mean() > 0.2  # the penalties leave weights at zero
    assert model.temperature > 0


def test_leader_against_a_plain_loop():
    """Follow-the-regularised-leader coordinate by coordinate, as in its published form."""
    sample = [("ab ba", "x"), ("cd dc", "y"), ("ab cd", "x"), ("dc dd", "y"), ("aa bb", "x"), ("cc dd", "y"), ("ba ab", "x"), ("zz cd", "y")]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.5
    made = language.train(sample, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=5)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(sample))
    used = order[len(sample) // 5 :]
    rows = [(*made.features(sample[i][0]), made.languages.index(sample[i][1])) for i in used]
    z, n = {}, {}

    def weight(j, c):
        a, b = z.get((j, c), 0.0), n.get((j, c), 0.0)
        p1, p2 = (l1, l2) if j < language.BUCKETS else (0.0, 0.0)
        return 0.0 if abs(a) <= p1 else (np.sign(a) * p1 - a) / ((beta + b**0.5) / alpha + p2)

    for _ in range(2):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            present = [*zip(at.tolist(), x.tolist(), strict=True), (language.BUCKETS, 0.3)]
            s = np.array([sum(weight(j, c) * v for j, v in present) for c in range(2)])
            p = np.exp(s) / np.exp(s).sum()
            steps = [(j, c, v * (p[c] - (c == y)), weight(j, c)) for j, v in present for c in range(2)]
            for j, c, g, w in steps:
                b = n.get((j, c), 0.0)
                z[j, c] = z.get((j, c), 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / alpha * w
                n[j, c] = b + g * g
    for j in {j for j, _ in z if j < language.BUCKETS}:
        np.testing.assert_allclose(made.weights[j], [weight(j, 0), weight(j, 1)], atol=1e-9)
    assert np.count_nonzero(made.weights) <= len(z)


def test_factorisation_identity():
    model = quality_fm.train([("plain words here", 1), ("bad!! BAD!! ###", 0)] * 5, epochs=1)
    first, at, x = quality_fm.features(["some plain words", "", None])
    scores = model.scores(["some plain words", "", None])
    for k, (a, b) in enumerate(zip(first, [*first[1:], len(at)], strict=True)):
        v, z = model.factors[at[a:b]], x[a:b]
        pairs = sum(v[i] @ v[j] * z[i] * z[j] for i in range(b - a) for j in range(i))
        want = 1 / (1 + np.exp(-(model.bias + z @ model.linear[at[a:b]] + pairs)))
        assert scores[k] == pytest.approx(want, abs=1e-9)
    assert scores[1] == scores[2]


def test_quality_held_out(sample):
    rows = [(i, t, y) for i, t, _, _, y in sample if y is not None and t]
    model = quality_fm.train([(t, y) for i, t, y in rows if not held(i, 5, 0)])
    test = [(t, y) for i, t, y in rows if held(i, 5, 0)]
    p = model.scores([t for t, _ in test])
    assert ((p >= 0.3) == np.array([y for _, y in test])).mean() > 0.95


def test_quality_learns_in_runs(monkeypatch):
    """The model is that of all texts in one look, with much less memory."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdef,.#"), rng.integers(1, 9)))
    sample = [(" ".join(word() for _ in range(n)), n % 2) for n in rng.integers(0, 400, 300)]
    made, peak = [], []
    for run in (7, quality_fm.RUN, len(sample)):
        monkeypatch.setattr(quality_fm, "RUN", run)
        made.append(quality_fm.train(sample, epochs=1))
        tracemalloc.start()
        quality_fm.train(sample, epochs=0)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    for got in made[:2]:
        assert got.bias == made[2].bias
        np.testing.assert_array_equal(got.linear, made[2].linear)
        np.testing.assert_array_equal(got.factors, made[2].factors)
    assert peak[0] < 0.8 * peak[2]


def test_blocks():
    page = "<html><head><title>x</title></head><body><nav><a href=/>a</a></nav><div>one<br>two <b>&amp; three</b><p>four<p>five</div><script>if (a < b) '</p>'</script><!-- <p>no</p> --></body>"
    assert [b.text for b in html_extract.blocks(page)] == ["a", "one two & three", "four", "five"]
    assert html_extract.blocks("a < b & c > d")[0].text == "a < b & c > d"
    assert html_extract.blocks("<p title='unclosed>text") is not None
    assert [b.text for b in html_extract.blocks("<script>never ends")] == []


def test_viterbi_is_the_best_path():
    from itertools import product

    field = html_extract.default_model()
    feats = [html_extract.features(html_extract.blocks(p)) for p, _ in html_extract.labelled_pages(5, seed=8)]
    for f in feats:
        f = f[:9]
        e = field.scores(f)
        best = max(product((0, 1), repeat=len(f)), key=lambda y: sum(e[i, c] for i, c in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert field.viterbi(f) == list(best)


def test_generated_pages_held_out():
    field = html_extract.default_model()
    right = [field.viterbi(html_extract.features(html_extract.blocks(p))) == y for p, y in html_extract.labelled_pages(200, seed=77)]
    assert np.mean(right) > 0.9


#: Pages written by hand, not by the generator that the field is trained on, with their main text.
HAND_PAGES = [
    (
        """<!doctype html><html><head><title>River levels</title><style>p{color:red}</style></head><body>
<div id="top"><a href="/">Home</a> <a href="/weather">Weather</a> <a href="/sport">Sport</a></div>
<div class="wrap"><h1>River levels fall after a dry spring</h1>
<p>The water board measured the lowest level in eleven years on Monday, &amp; officials asked farms along the upper valley to pump less.</p>
<p>Rainfall since February has been less than half of what is usual, according to the station at the bridge, which has kept records since 1931.</p>
<blockquote>We can still fill the reservoir if May brings rain, said the engineer in charge.</blockquote>
<p>A decision on limits for gardens is expected next week.</p></div>
<div id="disqus_thread"><p>Great article, thanks!</p><p>First</p></div>
<div class="foot"><p>&copy; 2021 Valley Paper. All rights reserved.</p></div></body></html>""",
        ["River levels fall after a dry spring","The water board measured the lowest level in eleven years on Monday, & officials asked farms along the upper valley to pump less.","Rainfall since February has been less than half of what is usual, according to the station at the bridge, which has kept records since 1931.","We can still fill the reservoir if May brings rain, said the engineer in charge.","A decision on limits for gardens is expected next week."],
    ),
    (
        """<html><body><nav><ul><li><a href="#">Start</a><li><a href="#">Recipes</a><li><a href="#">About</a></ul></nav>
<main><article><h2>Lentil soup</h2><p>Wash two cups of lentils and let them drain while the onions turn soft in a little oil over a low flame.<p>Add the lentils, a carrot cut small, and a litre of water; simmer for forty minutes without a lid.<ul><li>two cups of brown lentils<li>one onion and one carrot</ul></article></main>
<aside><h3>Popular</h3><a href="/x">Ten quick salads</a></aside>
<div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<script>var a = "<p>not text</p>";</script></body></html>""",
        ["Lentil soup","Wash two cups of lentils and let them drain while the onions turn soft in a little oil over a low flame.","Add the lentils, a carrot cut small, and a litre of water; simmer for forty minutes without a lid.","two cups of brown lentils","one onion and one carrot"],
    ),
    (
        """<html><body><header><h1><a href="/">The Walker</a></h1></header><div class="sidebar"><p>Subscribe to our newsletter</p><form><input name=q><label>Search</label></form></div>
<section class="post-body"><h1>Three days on the ridge</h1><p>We left the hut before sunrise and reached the first saddle when the fog had just lifted from the lake below us.</p><p>The path is marked well, but the iron ladder near the summit was loose, and we told the warden in the evening.</p></section>
<section class="comments"><h3>Comments</h3><p>I was there last year and loved it.</p></section><footer><p>Imprint</p></footer></body></html>""",
        ["Three days on the ridge","We left the hut before sunrise and reached the first saddle when the fog had just lifted from the lake below us.","The path is marked well, but the iron ladder near the summit was loose, and we told the warden in the evening."],
    ),
]


def test_pages_written_by_hand():
    field = html_extract.default_model()
    for page, want in HAND_PAGES:
        assert html_extract.extract(page, field).split("\n\n") == want


def test_unclosed_tags_cost_one_look():
    import time

    began = time.perf_counter()
    for page in ('<a "' * 100_000, "<a 'x" * 100_000, "<a " * 200_000, "<!-- " * 100_000):
        html_extract.blocks(page)
    assert time.perf_counter() - began < 10
    assert [b.text for b in html_extract.blocks("<p>one</p> 5 < 6 and <b")] == ["one", "5 < 6 and <b"]


def test_pages(spark, sf_dir):
    import re

    got = {r["page_id"]: r for r in queries.op6_html(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    import html

    right = 0
    for p in pages:
        inner = p["html"][p["html"].index("<article>") + 9 : p["html"].index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        right += "\n\n".join(x for x in parts if x) == got[p["page_id"]]["text"]
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])
    assert right / len(pages) > 0.95


def test_odd_pages(spark):
    pages = spark.createDataFrame([(0, None), (1, ""), (2, "<p>"), (3, "<div>" * 3000 + "deep"), (4, "<" * 500), (5, '<a "' * 500)], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.with_main_text(pages).collect()}
    assert got[0] == got[1] == got[2] == "" and len(got) == 6

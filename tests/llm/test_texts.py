"""Main text, personal data and toxicity."""

import html
import random
import re
import time
import zlib

import numpy as np
import pytest

from chronoloom.llm import htmltext, pii, toxicity

# main text


def test_held_out_pages():
    model = htmltext.default_model()
    total = wrong = 0
    for blocks, labels in htmltext.labelled_pages(300, 777):
        total += len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(blocks), labels))
    assert wrong < 0.015 * total


def test_viterbi_finds_the_best_labels():
    model = htmltext.default_model()
    for blocks, _ in htmltext.labelled_pages(12, 5):
        blocks = blocks[:8]
        units = [[sum(model.weight.get(n, (0, 0))[y] for n in fs) for y in (0, 1)] for fs in htmltext.features(blocks)]
        score = lambda ys: sum(u[y] for u, y in zip(units, ys)) + sum(model.pair[a][b] for a, b in zip(ys, ys[1:]))  # noqa: E731, B023
        best = max(score([(k >> t) & 1 for t in range(len(blocks))]) for k in range(2 ** len(blocks)))
        assert abs(score(model.decode(blocks)) - best) < 1e-9


def test_gradient_is_that_of_the_likelihood():
    """By finite differences, at weights that are not zero; and the likelihood by all labellings of short pages."""
    pages = [(b[:6], y[:6]) for b, y in htmltext.labelled_pages(4, 8)]
    names, objective = htmltext.likelihood(pages, 0.01)
    r = np.random.default_rng(2)
    theta = r.normal(size=2 * len(names) + 4) * 0.3
    value, grad = objective(theta)
    for k in [*r.choice(len(theta) - 4, 40), *range(len(theta) - 4, len(theta))]:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        assert abs((objective(theta + step)[0] - objective(theta - step)[0]) / 2e-5 - grad[k]) < 1e-7
    w, pair = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
    total = blocks = 0
    for b, y in pages:
        units = [[sum(w[names[f], c] for f in fs) for c in (0, 1)] for fs in htmltext.features(b)]
        score = lambda ys: sum(u[c] for u, c in zip(units, ys)) + sum(pair[p][q] for p, q in zip(ys, ys[1:]))  # noqa: E731, B023
        total += score(y) - np.logaddexp.reduce([score([(k >> t) & 1 for t in range(len(b))]) for k in range(2 ** len(b))])
        blocks += len(b)
    assert abs(total / blocks - 0.005 * (theta @ theta) - value) < 1e-9


def test_deep_pages_take_time_in_proportion():
    """A mark counts once in a chain, however often it is there, and again after its last holder has closed."""
    m = htmltext.default_model()
    page = "<div class='post'>x <div class=\"post nav\">y</div> <div class=nav>z</div></section>w</div>v"
    got = [(t, sorted(f for f in fs if f[0] in "<.")) for (t, _, _), fs in zip(htmltext.leaf_blocks(page), htmltext.features(htmltext.leaf_blocks(page)))]
    assert got == [("x", [".post", "<div>"]), ("y", [".nav", ".post", "<div>"]), ("z", [".nav", ".post", "<div>"]), ("w", [".post", "<div>"]), ("v", [])]
    for deep in ("<div>x" * 60_000, "<div>" * 30_000 + "</b></i></ul>" * 30_000 + "x"):
        start = time.process_time()
        m.decode(htmltext.leaf_blocks(deep))
        assert time.process_time() - start < 20  # hours, if each block looked at all its ancestors


def test_pages_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_texts(df).collect()}
    for p in df.collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", s.replace("<br>", " "))).split()) for s in re.split("</?p>|</?h1>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[p.page_id] == (want, len(want))


def test_odd_pages(spark):
    m = htmltext.default_model()
    assert m.main_text("") == "" and m.main_text("   ") == ""
    assert m.main_text("<p>A story that someone wrote, in full.</p><!-- no end <p>x</p>") == "A story that someone wrote, in full."
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>First\n  part, it is&nbsp;here.<p>Second &lt;part&gt; of it.</article><div class='comments'><p>Nice one!</p></div><footer>&copy; x</footer>"
    assert m.main_text(page) == "T & U\nFirst part, it is here.\nSecond <part> of it."
    for bad in ['<a "' * 20_000, "<" * 50_000, "<!-- " * 20_000 + ">", "<script>" * 20_000, "<p" * 9]:
        m.main_text(bad)
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "y"), (2, None, "", "y"), (None, "v", page, "z")], "page_id long, url string, html string, text string")
    rows = sorted(map(tuple, htmltext.main_texts(df).collect()), key=repr)
    assert [r[:2] for r in rows] == [(1, "u"), (2, None), (2, None), (None, "v")] and [r[3] for r in rows[:3]] == [0, 0, 0]
    assert htmltext.main_texts(df.limit(0)).count() == 0


# personal data


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    count = lambda s: sum("0" <= c <= "9" for c in s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= count(m[0]) <= 19 and pii.luhn(pii._digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= count(m[0]) <= 15]
    return sorted(out)


def test_detectors_equal_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choices(["a", "1", "25", "0", ".", ".", "@", "+", " ", "-", "(", "é", "4111111111111111", "300", "٣"], k=r.randint(0, 25)))
        assert pii.detect(t) == brute(t), t


@pytest.mark.parametrize("text, want", [
    ("mail john [at] example [dot] com now", "email:5:32"), ("john at example dot com", "email:0:23"), ("a.b (at) c-d (dot) co (dot) uk", "email:0:30"),
    ("call plus one seven four three five five five three eight two four ok", "phone:5:66"), ("jоhn@exаmple.com", "email:0:16"), ("ｊｏｅ＠ｓｉｔｅ．ｃｏｍ", "email:0:12"),
    ("host one nine two dot one six eight dot one dot five", "ip:5:52"), ("4111 1111 1111 one one one one", "card:0:30"), ("+１ (743) 555-3824", "phone:0:17"),
    ("jo​hn@ex.com", "email:0:12"), ("look at example.com please", ""), ("one two three", ""), ("double five", ""), ("meet at noon. dot.", ""), ("a­b@c.de", "email:0:8"),
])
def test_disguises(text, want):
    base = pii.detect(text)
    assert pii.written(pii.disguised(text, base)) == want


@pytest.mark.parametrize("text, want", [
    ("mail jane.doe at example.com now", "email:5:28"), ("call +1 743 555 382 four today", "phone:5:24"), ("card 4111 1111 1111 111 one", "card:5:27"),
    ("plus one (743) 555-3824", "phone:0:23"), ("sign-up at example.com, 2.0 at example.com", ""), ("j2 at a-b.example.com", "email:0:21"),
])
def test_disguises_without_other_triggers(text, want):
    assert pii.written(pii.disguised(text, pii.detect(text))) == want


def test_disguises_do_not_depend_on_other_text():
    """A look-alike in a line of its own changes no find."""
    r = random.Random(4)
    parts = ["jo.e", "b", " at ", "[at]", " dot ", "(dot)", "five", "one ", " two", "+1", "743 ", "555 382 ", "ｊ", "\u200b", ".com", "@", "-", " ", "plus ", "double ", "4111 1111 1111 111 "]
    found = 0
    for _ in range(20_000):
        t = "".join(r.choices(parts, k=r.randint(0, 14)))
        spans = pii.disguised(t, pii.detect(t))
        assert pii.disguised(f"{t}\n\u2010", pii.detect(t)) == spans, t
        assert all(0 <= a < b <= len(t) for a, _, b in spans), t
        found += len(spans)
    assert found > 1000


def test_plain_texts_stay_plain():
    for t in ["", "nothing here", "é" * 100, "he is at one. two dots", "v1.2.3", "12:30"]:
        assert pii.disguised(t, pii.detect(t)) == []


def test_redact():
    t = "x bob@a.de y +1 (743) 555-3824 z"
    assert pii.redact(t, pii.detect(t)) == "x [EMAIL] y [PHONE] z"
    assert pii.redact("abcdef", [(0, 1, 4), (2, 0, 5)]) == "[IP]f"


def test_long_runs_take_linear_time():
    for t in ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 100_000, "(at) " + " " * 100_000 + "x", "one " * 50_000]:
        pii.disguised(t, pii.detect(t))


def test_personal_data(docs, texts, empty):
    rows = sorted(map(tuple, pii.personal_data(docs).collect()), key=repr)
    assert len(rows) == len(texts)
    by_id = {r[0]: r for r in rows}
    assert by_id[18][1:5] == (1, 1, 1, 1) and by_id[1][1:5] == (0, 0, 0, 0) and by_id[1][5] == by_id[2][5]
    assert by_id[18][6].startswith("email:5:20,phone:21:38,card:40:59,ip:61:69")
    out = pii.redacted(docs)
    assert out.schema == docs.schema and {r.doc_id: r.text for r in out.collect()}[18] == "mail [EMAIL] [PHONE], [CARD], [IP]"
    assert pii.personal_data(empty).count() == 0 and pii.redacted(empty).count() == 0


# toxicity


def corpus(n, seed):
    r = random.Random(seed)
    docs = []
    for k in range(n):
        w = [f"w{r.randint(0, 300)}" for _ in range(r.randint(20, 200))]
        bad = k % 8 == 0
        if bad:
            for _ in range(max(2, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(["scumbag", "moronic", "vilewort", "vilest"])
        docs.append((k, " ".join(w), int(bad)))
    return docs


def test_learns_from_positive_and_unlabelled(spark):
    rows = corpus(1500, 1)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    # half of the toxic rows and some others are labelled; labels of the held-out fold are wrong on purpose
    labels = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows if i % 2 == 0 or i % 3 == 0]
    got = {r.doc_id: r for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) > 0.95 * len(held)
    assert sum(p for p, y in held if y) > 0.8 * sum(y for _, y in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_known_negatives_change_nothing(spark):
    """Only confirmed positives are learned from."""
    rows = corpus(600, 2)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    bad = [(i, 1) for i, _, y in rows if y]
    good = [(i, 0) for i, _, y in rows if not y and i % 3 == 0] + [(10**6 + k, 0) for k in range(50)]
    one, two = (toxicity.fit(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (bad, bad + good))
    assert (one[0] == two[0]).all() and one[1] == two[1]


@pytest.mark.parametrize("prior, clamped", [(0.3, False), (0.9, True)])
def test_gradient_of_the_risk(prior, clamped):
    """By finite differences: of the whole risk, or of minus its negative part where that is below zero."""
    r = np.random.default_rng(3)
    zp, zu = r.normal(size=7) + (3 if clamped else 0), r.normal(size=9) - (4 if clamped else 0)

    def negative(p, u):
        return np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()

    assert (negative(zp, zu) < 0) == clamped

    def value(p, u):
        return -negative(p, u) if clamped else toxicity.risk(p, u, prior)[0]

    whole, gp, gu = toxicity.risk(zp, zu, prior)
    assert np.isclose(whole, prior * np.logaddexp(0, -zp).mean() + max(0, negative(zp, zu)))
    eps = 1e-6
    for got, z, of in ((gp, zp, lambda x: value(x, zu)), (gu, zu, lambda x: value(zp, x))):
        for k in range(len(z)):
            step = np.eye(len(z))[k] * eps
            assert np.isclose(got[k], (of(z + step) - of(z - step)) / 2 / eps, atol=1e-8)


def test_prior_and_calibration_from_unseen_logits():
    """Logits of two normal classes: the prior is found, and so are the log-odds."""
    r = np.random.default_rng(4)
    prior, n = 0.2, 20_000
    zp = r.normal(2, 1, 4000)
    zu = np.where(r.random(n) < prior, r.normal(2, 1, n), r.normal(-2, 1, n))
    assert abs(toxicity.class_prior(zp, zu) - prior) < 0.02
    slope, offset = toxicity.calibration(zp, zu, prior)
    assert 2 < slope < 4.5  # 4 less what the penalty takes
    assert abs(-offset / slope - np.log((1 - prior) / prior) / 4) < 0.1  # where the classes are equally likely


def test_scores_equal_the_dense_product():
    r = np.random.default_rng(5)
    weights, bias = r.normal(size=1 << toxicity.BITS) * 0.1, -0.3
    texts = ["", "Some WORDS, and some words again", "x" * 3000 + " été", "a b c " * 500]
    got = toxicity.score_texts(texts, weights, bias, {})
    for t, s in zip(texts, got):
        dense = np.zeros(1 << toxicity.BITS)
        k, v = toxicity.text_vector(t)
        dense[k] = v
        assert np.isclose(s, 1 / (1 + np.exp(-(dense @ weights + bias))), atol=1e-6)


def test_risk_does_not_go_below_zero():
    """With as few rows as features the plain estimate would run to minus infinity; the weights stay bounded."""
    texts = [f"a{k} b{k} common" for k in range(30)]
    v = [toxicity.text_vector(t) for t in texts]
    weights, bias = toxicity.train(v[:8], v, 0.3, steps=400)
    assert np.isfinite(weights).all() and np.abs(weights).max() < 100


def test_awkward_inputs(docs, texts, empty, spark):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    got = toxicity.toxicity(docs, none)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(texts)
    odd = spark.createDataFrame([(None, 1, 1), (7, None, 1), (7, 0, 0), (10, 1, None), (999, 0, 1), (11, 1, 0)], schema)
    rows = toxicity.toxicity(docs, odd).collect()
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity(empty, odd).count() == 0
    scored = toxicity.score(docs, np.zeros(1 << toxicity.BITS), 0.0, ("__s", "__p"))
    assert scored.columns == [*docs.columns, "__s", "__p"]

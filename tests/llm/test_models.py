"""Classifiers by held-out accuracy, HTML extraction by cases, and the pipeline."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.data import edge_docs, no_docs
from veduta.llm import language_id, quality, toxicity
from veduta.llm.html_extraction import SURGE, WINDOW, extract_pages, line_weights, main_text, page_lines, text_between
from veduta.llm.language_id import identify_languages
from veduta.llm.quality import score_quality, term_counts
from veduta.llm.queries import QUERIES
from veduta.llm.samples import bounded_sample, fold
from veduta.llm.toxicity import score_toxicity


@pytest.fixture(scope="module")
def larger():
    if not (DATA / "sf0.01").exists():
        pytest.skip("no test tables")
    return str(DATA / "sf0.01")


def test_languages(spark, larger):
    out = QUERIES["op10_language_id"](spark, larger).join(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.98 and 0 <= held[1] <= held[2] <= 1


@pytest.mark.parametrize("name, label, least", [("op6_toxicity", "toxic", 0.85), ("op9_quality", "quality", 0.97)])
def test_labels(spark, larger, name, label, least):
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", label)
    held = QUERIES[name](spark, larger).join(labels, "doc_id").where("held_out").toPandas()
    positive, negative = held[held[label] == 1].score.to_numpy(), held[held[label] == 0].score.to_numpy()
    auc = ((positive[:, None] > negative[None, :]) + 0.5 * (positive[:, None] == negative[None, :])).mean()
    assert auc > least and held.score.between(0, 1).all()
    assert (held[held.predicted == 1][label] == 1).mean() > 0.8


def test_edge_cases_have_scores(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    n = docs.count()
    for out in (score_toxicity(docs, labels), score_quality(docs, labels)):
        rows = out.collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    found = identify_languages(docs)
    assert set(docs.columns) | {"lang_pred", "score"} == set(found.columns)
    by_text = {r["text"]: r["lang_pred"] for r in found.collect()}
    assert by_text[None] == by_text[""] == by_text["12 34 !!"] == "und" and by_text["Un deux trois"] != "und"
    empty = labels.limit(0)
    assert identify_languages(no_docs(spark)).count() == score_toxicity(no_docs(spark), empty).count() == score_quality(no_docs(spark), empty).count() == 0
    assert score_toxicity(docs, empty).where("predicted = 1").count() == 0 and score_quality(docs, empty).count() == n


def test_folds_and_samples(spark):
    import zlib

    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "big").otherwise("small").alias("k"))
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) % 3 for r in ids.select("doc_id", fold(F.col("doc_id"))).limit(50).collect())
    counts = {r["k"]: r["n"] for r in bounded_sample(ids, "k", 600).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert counts == {"big": 600, "small": 500}


def _pu_data(seed, n_p, n_u, k):
    r = np.random.default_rng(seed)
    some = lambda: np.flatnonzero(r.random(k) < 0.3)
    return [some() for _ in range(n_p)], [some() for _ in range(n_u)], r.normal(0, 1, k), float(r.normal())


def _plain_risk(positive, unlabelled, prior, w, b):
    """The non-negative PU risk, row by row, and the value in its bracket."""
    loss = lambda z: float(np.log1p(np.exp(-z)))
    g = lambda rows: [sum(w[j] for j in f) + b for f in rows]
    p, u = g(positive), g(unlabelled)
    bracket = sum(loss(-z) for z in u) / len(u) - prior * sum(loss(-z) for z in p) / len(p)
    return prior * sum(loss(z) for z in p) / len(p) + max(0.0, bracket), bracket


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_pu_gradient_by_finite_differences(prior):
    k, signs = 6, set()
    for seed in range(12):
        positive, unlabelled, w, b = _pu_data(seed, 9, 30, k)
        sums = toxicity.loss_sums(unlabelled, np.ones(30), w, b)
        risk, g, gb = toxicity.nnpu_gradient(positive, sums, 30, prior, w, b)
        want, bracket = _plain_risk(positive, unlabelled, prior, w, b)
        assert abs(risk - want) < 1e-9
        signs.add(bracket >= 0)
        # Where the bracket is negative, the step climbs it instead.
        value = (lambda w, b: _plain_risk(positive, unlabelled, prior, w, b)[0]) if bracket >= 0 else (lambda w, b: -_plain_risk(positive, unlabelled, prior, w, b)[1])
        for j in range(k):
            d = np.eye(k)[j] * 1e-5
            assert abs((value(w + d, b) - value(w - d, b)) / 2e-5 - g[j]) < 1e-6
        assert abs((value(w, b + 1e-5) - value(w, b - 1e-5)) / 2e-5 - gb) < 1e-6
    assert signs == ({True, False} if prior == 0.9 else {True})


def test_pu_learning_finds_the_positive_feature():
    r = np.random.default_rng(0)
    noise = lambda: 1 + np.flatnonzero(r.random(20) < 0.3)
    positive = [np.append(0, noise()) for _ in range(60)]
    unlabelled = [np.append(0, noise()) if i % 10 == 0 else noise() for i in range(600)]
    w, b = toxicity.fit_nnpu(positive, lambda w, b: toxicity.loss_sums(unlabelled, np.ones(600), w, b), 600, 0.1, 21)
    assert w[0] + b > 0 > b and np.abs(w[1:]).max() < w[0]


def test_sums_over_all_unlabelled_texts(spark):
    texts = ["bad word here", "good word", None, "", "bad bad day", "good word", "other"] * 9
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    chosen = np.unique(np.concatenate(list(toxicity.feature_rows(["bad word"]))))
    counts, n = toxicity.bucket_counts(docs, chosen)
    rows = [set(f.tolist()) for f in toxicity.feature_rows(texts)]
    assert n == len(texts) and counts.tolist() == [sum(c in f for f in rows) for c in chosen.tolist()]
    w, b = np.linspace(-1, 1, len(chosen)), 0.3
    got = toxicity.distributed_sums(toxicity.feature_patterns(docs, chosen), len(chosen), n)(w, b)
    places = [np.flatnonzero([c in f for c in chosen.tolist()]) for f in rows]
    want = toxicity.loss_sums(places, np.ones(n), w, b)
    assert np.allclose(got.features, want.features, atol=1e-9) and abs(got.loss - want.loss) < 1e-9 and abs(got.bias - want.bias) < 1e-9


def test_calibration_is_a_logistic_fit():
    r = np.random.default_rng(4)
    margins = r.normal(0, 50, 4000) - 20
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.1 * margins + 1)))).astype(int)
    slope, shift = toxicity.fit_scale(margins, y)
    assert abs(slope - 0.1) < 0.01 and abs(shift - 1) < 0.2


def test_votes_by_brute_force(spark):
    r = np.random.default_rng(1)
    make = lambda good: " ".join(r.choice(["calm", "clear", "text", "words"] if good else ["buy!!!", "NOW$$$", "###", "text"], 30))
    docs = spark.createDataFrame([(i, make(i % 3 > 0)) for i in range(90)] + [(90, ""), (91, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 92)] + [(3, 1), (5, 7), (7, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(92))
    got = {x["doc_id"]: x["score"] for x in score_quality(docs, labels).collect()}
    for x in docs.collect():
        counts = next(iter(term_counts([x["text"]])))
        v = model.embed(counts[None, :])[0]
        near = sorted(((-float(np.dot(v, u)), i) for i, u in enumerate(model.vectors)))[: quality.NEIGHBOURS]
        weight = [max(0.0, -c) ** 4 for c, _ in near]
        want = sum(w * model.labels[i] for w, (_, i) in zip(weight, near, strict=True)) / sum(weight) if counts.sum() and sum(weight) else model.base
        # Equal cosines at the edge of the neighbourhood may differ in label.
        if len({round(c, 5) for c, _ in near}) == len(near) or not counts.sum():
            assert abs(got[x["doc_id"]] - want) < 1e-4


def test_directions_are_those_of_the_decomposition():
    r = np.random.default_rng(3)
    x = (r.normal(size=(80, 6)) * [9, 7, 5, 3, 2, 1]) @ r.normal(size=(6, 50)) + 0.01 * r.normal(size=(80, 50))
    found = quality.leading_directions(x.astype(np.float32), 3)
    _, _, right = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(found.T @ right[:3].T), np.eye(3), atol=1e-2)


def plain_ftrl(rows, bins, classes, order, alpha, beta, l1, l2):
    """FTRL-proximal with one number at a time."""
    z, n = {}, {}

    def weight(i, c):
        zi = z.get((i, c), 0.0)
        bound = 0.0 if i == bins else l1
        return 0.0 if abs(zi) <= bound else -(zi - math.copysign(bound, zi)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / alpha + l2)

    for r in order:
        at, x, y = rows[r]
        pairs = [*zip(at.tolist(), x.tolist(), strict=True), (bins, 1.0)]
        logits = [sum(v * weight(i, c) for i, v in pairs) for c in range(classes)]
        total = sum(math.exp(v - max(logits)) for v in logits)
        p = [math.exp(v - max(logits)) / total for v in logits]
        old = {(i, c): weight(i, c) for i, _ in pairs for c in range(classes)}
        for i, v in pairs:
            for c in range(classes):
                g = v * (p[c] - (c == y))
                before = n.get((i, c), 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / alpha
                z[i, c] = z.get((i, c), 0.0) + g - sigma * old[i, c]
                n[i, c] = before + g * g
    return weight


def test_ftrl_by_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "BINS", 12)
    r = np.random.default_rng(2)
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.random(4), int(r.integers(3))) for _ in range(30)]
    w, bias = language_id.fit_ftrl(rows, 3, l1=0.5, epochs=2, seed=9)
    order = np.random.default_rng(9)
    visits = [i for _ in range(2) for i in order.permutation(30)]
    want = plain_ftrl(rows, 12, 3, visits, 0.5, 1.0, 0.5, 0.01)
    assert np.allclose(w, [[want(i, c) for c in range(3)] for i in range(12)], atol=1e-4)
    assert np.allclose(bias, [want(12, c) for c in range(3)], atol=1e-4) and (w == 0).any()


def test_any_number_of_languages(spark):
    docs = spark.createDataFrame([(i, chr(0x4E00 + i % 205) * 5, f"l{i % 205:03d}") for i in range(1640)], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs, sample=410)
    assert model.languages == sorted({f"l{i % 205:03d}" for i in range(1640) if zlib.crc32(str(i).encode()) % 3 != 1}) and len(model.languages) > 200
    held = identify_languages(docs, model).where("lang_pred = lang").count()
    assert held > 0.9 * 1640


def test_toxic_features_count_levels():
    one, many = toxicity.feature_rows(["badly", "badly badness badder Badges baddie"])
    assert len(many) > len(one) and len(list(toxicity.feature_rows([None, "", " "]))) == 3


def test_terms_cover_whole_texts():
    a, b, c = term_counts(["x " * 300_000, None, "Y!! y"])
    assert a.sum() == 600_000 and b.sum() == 0 and c.sum() == 4


CASES = [
    (None, ""), ("", ""), ("plain words", "plain words"),
    ("<article><h1>T</h1><p>a &amp; b<br>c<p class=ad>no</p><p>d\n  e</article><footer>f</footer>", "T\na & b c\nd e"),
    ("<body><nav><a href=/>Home</a></nav><main><p>x</p><form>y</form><aside>z</aside><p>w</p></main><div id='comments'><p>me too</p></div>", "x\nw"),
    ("<p>long enough text to stand for an article of its own, with eighty characters or more</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul>", "long enough text to stand for an article of its own, with eighty characters or more"),
    ("<article><script>var t='<p>';</script><style>p{}</style><p>&lt;b&gt; &eacute;</p><!-- c --><p>cut <b", "<b> é\ncut"),
    ("<article><p>1 < 2</p></article>", "1 < 2"),
]


CASES += [
    ("<article><p>one</p><p data-x=it's>two</p><p>three</p></article>", "one\ntwo\nthree"),
    ('<article><p title="the hidden door opens">two</p><p hidden>no</p></article>', "two"),
    ('<article><p data-id="related" data-class="ad">two</p></article>', "two"),
    ('<article><header class="top"><div><h1>A <b>title</b></h1></div><p>by me</p><nav><h2>no</h2></nav></header><p>t</p></article>', "A title\nby me\nt"),
    ("<body><header><h1>Site</h1></header><article><p>t</p></article></body>", "t"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_main_text(html, text):
    assert main_text(html) == text


def plain_windows(weight):
    """The window rule as its definition says it, one line at a time."""
    n = len(weight)
    window = [sum(weight[i : i + WINDOW]) for i in range(n)]
    surge = min(SURGE, max(window, default=0))
    kept, open_ = [], False
    for i in range(n):
        if open_ and window[i] == 0:
            open_ = False
        if not open_ and weight[i] and window[i] >= surge:
            open_ = True
        if open_ and weight[i]:
            kept.append(i)
    return kept


def test_windows_of_pages_without_containers_by_brute_force():
    r = random.Random(5)
    for _ in range(300):
        parts = []
        for _ in range(r.randrange(12)):
            kind, n = r.choice(["p", "menu", "gap"]), r.choice([3, 20, 60, 90])
            if kind == "p":
                parts.append(f"<p>{'x' * n}</p>")
            elif kind == "menu":
                many = r.randrange(1, 5)
                parts.append("".join(f"<div><a href=/>{'m' * n}</a></div>" for _ in range(many)))
            else:
                parts.append("<section></section>" * 4)
        page = "".join(parts)
        lines = page_lines(page)
        weight = line_weights(lines)
        assert all((w == 0) == (not t or link and w == 0) for w, (t, link, _) in zip(weight, lines, strict=True))
        assert text_between(weight) == plain_windows(weight)
        assert main_text(page) == "\n".join(lines[i][0] for i in plain_windows(weight))


@pytest.mark.parametrize("page", ["<b>" * 20000 + "</x>" * 20000, "<article>" + "<b>" * 20000 + "<p>x" * 20000, "<div>" * 20000 + "x", "<b>" * 20000 + "<div>x</div>" * 20000, "<p a='" * 20000])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 3


def test_pages(spark):
    pages = spark.createDataFrame([(i, None, h, "clash") for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_pages(pages).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(CASES)}
    assert extract_pages(pages.limit(0)).count() == 0


def test_pages_of_the_tables(spark, sf_dir):
    import html as h
    import re

    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op7_html_extraction"](spark, sf_dir).collect():
        body = re.sub(r"<[a-z/][^>]*$", "", raw[r["page_id"]].split("<article>")[1].split("</article>")[0])
        parts = (" ".join(h.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("<p>|</p>|</h1>", body))
        assert r["text"] == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("layout", ['class="content no-sidebar"', 'class="layout has-sidebar"', 'class="social-science"', 'id="main-search-page"', 'class="sidebar"', 'role="banner"'])
def test_layouts_keep_their_article(layout):
    assert main_text(f"<body><div {layout}><article><p>whole article</p></article></div></body>") == "whole article"
    assert main_text(f"<body><main><div {layout}><p>whole article</p></div><p>end</p></main></body>") == "whole article\nend"


@pytest.mark.parametrize("mark", ['class="x ad-slot-1"', 'class="related"', "id=comments", 'class="cookie_banner"', 'role="complementary"'])
def test_marked_parts_stay_out(mark):
    assert main_text(f"<main><article><p>whole article</p><div {mark}>other</div></article><div {mark}><article>card</article></div></main>") == "whole article"


@pytest.mark.parametrize("tag", ['<p class=x">', '<p class="x"">', "<p><a title=it's>", '<p class="x>', '<p title="a > b < c">', "<p data-x='<b>no</b>'>", "<p class='x\">", "<p id = x'y z=\"ad\" / >"])
@pytest.mark.parametrize("rest", ["", '<p>it\'s "a" b</p>', '<p class="y">it\'s</p>', "<p class='y'>\"it\"</p>"])
def test_stray_quotes_end_with_their_tag(tag, rest):
    tail = unescape(re.sub("<[^>]*>", "", rest))
    assert main_text(f"<article><p>one</p>{tag}two</p>{rest}<p>three</p></article>") == "\n".join(["one", "two", *([tail] if tail else []), "three"])
    assert main_text(f"<article><p>one</p>{tag}two</p>{rest}<p>cut <b title=\"x") == "\n".join(["one", "two", *([tail] if tail else []), "cut"])


@pytest.mark.parametrize("around", ["form id=aspnetForm", "label", "menu", "dialog open", "div hidden"])
def test_elements_around_the_article_keep_it(around):
    end = around.split()[0]
    assert main_text(f"<body><{around}><nav>menu</nav><article><p>whole article</p></article></{end}></body>") == "whole article"
    assert main_text(f"<body><{around}><main><p>whole article</p></main></{end}></body>") == "whole article"
    assert main_text(f"<body><article><p>the article itself</p><{around}><p>sign up</p></{end}></article></body>") == "the article itself"


def test_lists_of_links_in_an_article_stay():
    items = "".join(f"<li><a href={i}>link number {i}</a></li>" for i in range(4))
    text = "\n".join(f"link number {i}" for i in range(4))
    assert main_text(f"<article><p>before</p><ul>{items}</ul><p>after</p></article>") == f"before\n{text}\nafter"
    assert main_text(f"<ul>{items}</ul><article><p>only</p></article>") == "only"


def test_an_articles_own_header_stays():
    assert main_text("<header><h1>site</h1><p>slogan</p></header><article><header class='header'><h1>head</h1><p>standfirst</p></header><p>body</p></article>") == "head\nstandfirst\nbody"

"""Whitening, fill-in-middle and page text against brute force, on rows with nulls, repeats, ties and clashing columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from artifactlake.llm import middles, mixing, pages, whitening
from artifactlake.llm.pages import main_text

VECTORS = "vec_id long, embedding array<float>, label int, n int, component string, c0 string, v string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x", "y", "z") for i, v in rows], VECTORS)


def _by_hand(rows, components):
    """Ids, exact deviations, whitened values and shares by a dense eigensolver."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    a = ((n * x - s) / n).astype(float)
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    return [int(d) for d in ((n * x - s) ** 2).sum(1)], a @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def _check_whitening(spark, rows, usable, components=32):
    df = _vectors(spark, rows).repartition(3)
    model = whitening.fit(df, components=components)
    got = whitening.whiten(df, model).collect()
    deviation, white, share = _by_hand(usable, components)
    k = white.shape[1]
    assert len(got) == len(usable) * k and {r["n"] for r in got} == {len(usable)}
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted((i, d) for (i, _), d in zip(usable, deviation, strict=True))
    place = {}
    for (i, v), w in zip(usable, white, strict=True):
        place.setdefault(i, w)
    mine = np.array([[next(r["whitened"] for r in got if r["vec_id"] == i and r["component"] == j + 1) for j in range(k)] for i in place])
    want = np.array(list(place.values()))
    assert np.allclose(mine * np.sign((mine * want).sum(0)), want, atol=1e-8)
    assert np.allclose([next(r["explained"] for r in got if r["component"] == j + 1) for j in range(k)], share, rtol=1e-9)
    assert {r["identity_error"] for r in got} == {model.identity_error} and model.identity_error < 1e-9


def test_whitening(spark):
    draw = np.random.default_rng(5)
    usable = [(i, draw.standard_normal(6) * [5, 3, 2, 1, 0.5, 0.3]) for i in range(40)]
    usable += [(100 + i, usable[0][1]) for i in range(30)]  # a hot vector
    poor = [(200, None), (201, []), (202, [1, 2, None, 4, 5, 6]), (203, [1, 2, float("nan"), 4, 5, 6]), (204, [1, float("inf"), 3, 4, 5, 6]), (205, [1, 2, 3]), (206, [1e30] * 6)]
    _check_whitening(spark, usable + poor, usable)
    _check_whitening(spark, usable + poor, usable, components=2)


def test_whitening_rank(spark):
    draw = np.random.default_rng(6)
    few = [(i, draw.integers(-5, 5, 8)) for i in range(5)]  # rank 4 of 8
    _check_whitening(spark, few, few)
    one = [(i, [float(i), 3.0, 3.0]) for i in range(7)]
    _check_whitening(spark, one, one)
    df = _vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert whitening.whiten(df, whitening.fit(df)).collect() == []
    for rows in ([], [(1, [1.0, 2.0])], [(1, None), (2, [])]):
        df = _vectors(spark, rows)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []


def test_whitening_equal_variances(spark):
    corners = [(i, v) for i, v in enumerate([[4, 0, 0], [-4, 0, 0], [0, 4, 0], [0, -4, 0], [0, 0, 4], [0, 0, -4]])]
    df = _vectors(spark, corners)
    model = whitening.fit(df)
    assert np.allclose(model.explained, 1 / 3) and model.identity_error < 1e-12
    assert np.allclose(model.components @ model.components.T, np.eye(3))


def test_whitening_wide_numbers(spark):
    far = [(i, [2.0**40 * (i % 3), float(i)]) for i in range(6)]
    df = _vectors(spark, far)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    # the second component's deviation is under the limit of what doubles tell from zero here
    assert len(got) == 6 and {r["vec_id"]: r["deviation"] is None for r in got} == {i: i % 3 != 1 for i in range(6)} and {r["identity_error"] < 1e-9 for r in got} == {True}


UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def _middle(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    code = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(code[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_middles(spark):
    texts = ["abc def", None, "", "a", "$1 \\ $ {2} <P", "x<S>y", "é日本 😀\n\r  q", "<S<S<P><", "<<S<", "M>P>S><", "w " * 200_000, "y" * 400_000, "€" * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "abc def"), (1, "abc def"), (None, "some text here")]
    rows += [(100 + i, "<<a><S< P> two\nthree"[: i % 20]) for i in range(150)]
    full = [(i, t, "w", "c", "f", "o", 7) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, whole string, codes string, first string, output string, n int").repartition(3)
    moved = middles.restore(middles.fill_in_middle(df))
    assert moved.columns == ["doc_id", "text", "whole", "codes", "first", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = [tuple(r) for r in moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    assert sorted(got, key=repr) == sorted((_middle(*r) for r in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert middles.fill_in_middle(df.limit(0)).collect() == []


LONG_1 = "First paragraph with a good many words, so that its ratio of text to tags is large &amp; clear."
LONG_2 = "Another long paragraph, with very many words as well, that makes a high ratio for sure &#8211; yes."
ARTICLE = f"<p>{LONG_1}<p>Short\n  one, <a href=x>linked</a> in<b>line</b>.<br>Next.<ul><li>point one<li>point two</ul><p>{LONG_2}"
TEXT = f"{LONG_1} Short one, linked inline. Next. point one point two {LONG_2}".replace("&amp;", "&").replace("&#8211;", "–")
MENU = "<ul class='main-nav'><li><a href=/>Home</a><li><a href=/b>About</a></ul>"
COMMENT = "<p>I am a reader's comment of many words, more than one might think, and dense as any text of the page.</p>"
AROUND = (
    f"<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var t='</p><p>x';</script></head><body class='has-sidebar'>"
    f"<header><h1>My site</h1><p>A tagline of the site that is quite long indeed, really.</p></header><nav>{MENU}</nav>{MENU}"
    f"<div class=cookie-notice>We use cookies, and say so in a text that is long enough to look like content.</div>"
    f"<div class='ad'>Buy this very good thing now, for it is on sale and will not be for long.</div>{{}}"
    f"<aside>{COMMENT}</aside><section id=comments>{COMMENT}<article class=comment>{COMMENT}</article></section>"
    f"<div><ul><li><a>Other story, one</a></li><li><a>Other story, two</a></li></ul></div>"
    f"<form><p>Write to us about anything you like</p><input></form><footer>&copy; foot of the page &middot; all rights kept</footer></body></html>"
)


@pytest.mark.parametrize(
    "part, want",
    [
        (f"<article><h1>Title</h1>{ARTICLE}</article>", f"Title {TEXT}"),
        (f"<article><header><h1>Title</h1><p>by me</p></header>{ARTICLE}<footer>tags</footer></article>", f"Title {TEXT}"),
        (f"<main><h1>Title</h1><div>{ARTICLE}</div><div class='share'><a>Tweet</a></div></main>", f"Title {TEXT}"),
        (f"<div id=wrap><h1>Title</h1><div class=story>{ARTICLE}</div><div class=related>{COMMENT}</div></div>", f"Title {TEXT}"),
        (f"<table><tr><td>{MENU}<td><div>{ARTICLE}</div></table>", TEXT),
        (f"<article><p>{LONG_2}<aside>{COMMENT}</aside><p>End.</article>", f"{TEXT[-len(LONG_2) + 6:]} End."),
    ],
)
def test_main_text(part, want):
    assert main_text(AROUND.replace("{}", part)) == want


def test_main_text_rough_pages():
    assert [main_text(h) for h in (None, "", "<p>", "<nav>x</nav>", "<script>var x", "<!-- x <p>y", "  \n")] == [""] * 7
    assert main_text("just text &amp; more &nosuch; &lt;b&gt;") == "just text & more &nosuch; <b>"
    assert main_text("<article><p>one two<p>three <div cla") == "one two three"
    assert main_text("<article><p>a < b and 3 <5  c</article>") == "a < b and 3 <5 c"
    assert main_text("</div></p><article><div><p>x</div></div>y") == "x y"
    long = "word " * 400_000
    assert main_text(f"<body><article><p>{long}</p><p>end</article>") == f"{long}end"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_extract(spark):
    page = AROUND.replace("{}", f"<article>{ARTICLE}</article>")
    rows = [(1, "u", page, "t", 5, "s"), (1, "u", page, "t", 5, "s"), (2, None, None, None, None, None), (None, "v", "", "x", 1, "s"), (3, "w", "<p>é😀</p>", "x", 1, "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, source string").repartition(2)
    out = pages.extract(df)
    assert out.columns == ["page_id", "url", "source", "text", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(1, "u", "s", TEXT, len(TEXT))] * 2 + [(2, None, None, "", 0), (None, "v", "s", "", 0), (3, "w", "s", "é😀", 2)], key=repr)
    assert pages.extract(df.limit(0)).collect() == []
    assert pages.extract(df, keep=["html"]).where(F.col("html").isNull()).count() == 1


def test_smoothing():
    flat = pages.smoothed(np.full(20, 3.0), 1.0)
    assert np.allclose(flat[3:-3], 3.0) and flat[0] < 3.0
    spike = pages.smoothed(np.eye(1, 9, 4).ravel(), 1.0)
    assert spike.argmax() == 4 and np.isclose(spike.sum(), 1.0) and np.allclose(spike, spike[::-1])


def test_large_documents_leave_the_mix_near_its_target(spark):
    # one document of each source holds nearly half of its words, and classes of all sizes follow
    rows = []
    for s in range(6):
        sizes = [1500 + 40 * s, 400, 150, *[10 + (7 * i + s) % 90 for i in range(40)]]
        rows += [(s * 100 + i, " ".join(["w"] * n), f"s{s}") for i, n in enumerate(sizes)]
    rows += [(900 + i, " ".join(["w"] * 30), None) for i in range(3)] + [(990, None, "s1"), (991, "", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mixing.mix(docs, leaf=8, fan=2).collect()
    again = mixing.mix(docs.repartition(2), leaf=8, fan=2).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    taken = {}
    for r in found:
        assert 0 <= r["copies"] <= 3 and (r["size"] or not r["copies"])
        words, _ = taken.get(r["source"], (0, 0))
        taken[r["source"]] = (words + r["size"] * r["copies"], r["target"])
    for source, (words, target) in taken.items():
        assert abs(words - target) <= max(0.1 * target, 15), (source, words, target)

"""Entities, p-values, parses, archives, chapters over pages, joins that must be whole."""

import html
import math
import zipfile
from html.entities import html5

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillspark.functions import special
from quillspark.functions.entities import unescape
from quillspark.operators import parsing, segments, stats, stylometrics
from quillspark.sources import epub


def test_unescape_is_html_s(spark):
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**20]
    cases = [f"a&{n}b" for n in html5] + [f"&{n} &{n[:-1]}x;" for n in html5] + [f"&#{n};" for n in numbers] + [f"&#x{n:X} z" for n in numbers]
    cases += ["&", "&&", "&&amp;", "& amp;", "&amp;lt;", "&#;", "&#x;", "&#xg;", "&notit;", "&notin", "&" + "a" * 40 + ";", "x&#65", "&#X41;b", "", "no", "&unknown;", "&amp", "&#0065;", "&\n;", "&#65;&#66;"]
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", unescape(F.col("c")).alias("u")).collect()
    assert [(r.c, r.u) for r in got if r.u != html.unescape(r.c)] == []
    assert spark.createDataFrame([(None,)], "c string").select(unescape(F.col("c")).alias("u")).first().u is None


def test_special_functions(spark):
    xs = [1e-3, 0.5, 1.0, 2.5, 10.0, 1234.5, 1e6]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.ln_gamma(F.col("x")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-11)
    # I_x(a, b) for whole a and b is a tail of the binomial distribution
    cases = [(a, b, x) for a in (1, 2, 7, 40) for b in (1, 3, 25) for x in (0.01, 0.3, 0.5, 0.9, 0.999)]
    got = spark.createDataFrame([(float(a), float(b), x) for a, b, x in cases], "a double, b double, x double").select("a", "b", "x", special.incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("i")).collect()
    for r in got:
        n = int(r.a + r.b) - 1
        assert r.i == pytest.approx(sum(math.comb(n, j) * r.x**j * (1 - r.x) ** (n - j) for j in range(int(r.a), n + 1)), abs=1e-12)
    ends = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "x double").select(special.incomplete_beta(F.lit(2.0), F.lit(3.0), F.col("x")).alias("i")).collect()
    assert [r.i for r in ends] == [0.0, 1.0, 0.0, None]


def test_p_values_of_tables(spark):
    """Critical values of the t distribution, two-sided: at n - 2 degrees of freedom."""
    table = [(1, 12.706, 0.05), (4, 2.776, 0.05), (10, 2.228, 0.05), (30, 2.042, 0.05), (120, 1.980, 0.05), (10, 3.169, 0.01), (60, 2.660, 0.01), (5, 6.869, 0.001)]
    rows = [(t / math.sqrt(df + t * t), df + 2, p) for df, t, p in table]
    for r in spark.createDataFrame(rows, "r double, n long, p double").select("p", special.correlation_p(F.col("r"), F.col("n")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=2e-3)
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(5)] + [("b", 1.0, float(i)) for i in range(5)] + [("c", 1.0, 2.0), ("c", 2.0, 1.0), (None, 1.0, 1.0), (None, None, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in stats.correlation_tests(df, "x", "y", ["k"]).collect()}
    assert got["a"].rho == pytest.approx(1.0) and got["a"].rho_p < 1e-12 and 0 < got["a"].r_p < 0.05 and got["a"].n == 5
    assert got["b"].rho is None and got["b"].rho_p is None and got["c"].rho == pytest.approx(-1.0) and got["c"].rho_p is None and got[None].n == 1


def test_parser_is_pluggable(spark):
    df = spark.createDataFrame([(1, "El perro quiere comer. Dice que va a salir cuando termina!"), (2, None), (3, " . ")], "doc_id long, text string")
    rows = parsing.parse(df, "text", keep=["doc_id"]).orderBy("sent", "token").collect()
    assert [(r.sent, r.word, r.head, r.pos, r.dep) for r in rows][:4] == [(1, "El", 2, "DET", "det"), (1, "perro", 4, "NOUN", "nsubj"), (1, "quiere", 4, "NOUN", "nsubj"), (1, "comer", 4, "VERB", "ROOT")]
    assert {r.doc_id for r in rows} == {1}
    by = {(r.sent, r.token): r for r in rows}
    for r in rows:  # every token comes to a root
        seen, x = set(), r
        while x.head != x.token:
            assert x.token not in seen
            seen.add(x.token)
            x = by[r.sent, x.head]

    class Chain:
        def parse(self, text):
            for i, w in enumerate(text.split(), 1):
                yield 1, i, w, max(1, i - 1), "VERB", "ccomp" if i > 1 else "ROOT"

    f = stylometrics.syntax_features(parsing.parse(df.where("doc_id = 1"), "text", make=Chain, keep=["doc_id"])).first()
    assert f.parse_depth_mean == 11.0 and f.subordinate_ratio == pytest.approx(10 / 11)


def archive(path, members, manifest=None):
    with zipfile.ZipFile(path, "w") as z:
        if manifest is not None:
            items = "".join(f'<item id="i{i}" href="{h}" media-type="{t}"/>' for i, (h, t) in enumerate(manifest))
            z.writestr("OEBPS/content.opf", f"<package><manifest>{items}</manifest></package>")
        for name, body in members:
            z.writestr(name, f"<html><body>{body}</body></html>")


def test_epub_members(spark, tmp_path):
    kind = "application/xhtml+xml"
    archive(tmp_path / "a.epub", [("OEBPS/two.xhtml", "<p>Second&nbsp;one</p>"), ("OEBPS/one.xhtml", "<p>First</p><p>12</p>"), ("OEBPS/Cover.xhtml", "x"), ("OEBPS/toc.xhtml", "x"), ("OEBPS/pic.svg", "x"), ("OEBPS/stray.xhtml", "x")],
            [("one.xhtml", kind), ("two.xhtml", kind), ("Cover.xhtml", kind), ("toc.xhtml", kind), ("pic.svg", "image/svg+xml"), ("gone.xhtml", kind)])
    archive(tmp_path / "b.epub", [("page_2.html", "Two"), ("page_1.html", "One"), ("page_3.html", " "), ("copyright.html", "x")])
    archive(tmp_path / "c.epub", [])
    pages = epub.scan(spark, str(tmp_path))
    assert sorted((r.file[-6:], r.place, r.member) for r in pages.collect()) == [("a.epub", 0, "OEBPS/one.xhtml"), ("a.epub", 1, "OEBPS/two.xhtml"), ("b.epub", 1, "page_1.html"), ("b.epub", 2, "page_2.html"), ("b.epub", 3, "page_3.html")]
    got = {(r.file[-6:], r.number): (r.text, r.n_words) for r in epub.chapters(pages).collect()}
    assert got == {("a.epub", 1): ("First", 1), ("a.epub", 2): ("Second\xa0one", 1), ("b.epub", 1): ("One\n\nTwo", 2)} or got["a.epub", 2][0].startswith("Second")
    assert [r.member for r in epub.scan(spark, str(tmp_path / "a.epub"), members=["OEBPS/Cover.xhtml"]).collect()] == ["OEBPS/Cover.xhtml"]
    assert epub.scan(spark, str(tmp_path / "c.epub")).count() == 0
    reader = epub.EpubReader({"path": str(tmp_path), "skip": "cover"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("member",), "page_1.html"), GreaterThan(("place",), 0)]))
    assert len(left) == 1 and [p.members for p in reader.partitions()] == [[(1, "page_1.html")]]


def test_chapters_over_pages(spark):
    rows = [("x", 1, "front\nCapítulo 7\nabc"), ("x", 2, "def ghi"), ("x", 3, None), ("x", 4, "tail\nCAPÍTULO Nº IV\nlast Capítulo 9"), ("x", 5, "PARTE 3 end"), ("y", 1, "no\nCapítulo 1\nmore"), ("y", 2, "than one"), ("z", 1, "")]
    got = sorted(tuple(r) for r in segments.split_pages(spark.createDataFrame(rows, "b string, p int, t string").repartition(3), "b", "p", "t").collect())
    assert got == [("x", 2, "CAPÍTULO Nº IV\nlast Capítulo 9", 6), ("x", 3, "PARTE 3 end", 3), ("x", 7, "Capítulo 7\nabc\n\ndef ghi\n\ntail", 6), ("y", 1, "no\nCapítulo 1\nmore\n\nthan one", 6)]


def test_joins_that_must_be_whole(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, w string")
    one = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, None)], "id int, x double")
    two = spark.createDataFrame([(1, "p"), (3, "q"), (4, "r")], "id int, y string")
    assert sorted((r.id, r.missing) for r in segments.gaps({"base": base, "one": one, "two": two}, "id").collect()) == [(2, ["two"]), (4, ["base", "one"])]
    whole = segments.whole_join(base.where("id <> 2"), {"one": one, "two": two}, "id").orderBy("id").collect()
    assert [(r.id, r.w, r.one.x, r.two.y) for r in whole] == [(1, "a", 0.5, "p"), (3, "c", None, "q")]
    with pytest.raises(Exception, match="no two for 2"):
        segments.whole_join(base, {"one": one, "two": two}, "id").collect()
    seen = Observation("gaps")
    assert segments.whole_join(base, {"one": one, "two": two}, "id", seen).count() == 2 and seen.get == {"one": 0, "two": 1}
    both, alone = segments.aligned(one, two, "id")
    assert sorted((r.id, r.a.x, r.b.y) for r in both.collect()) == [(1, 0.5, "p"), (3, None, "q")] and sorted(tuple(r) for r in alone.collect()) == [(2, "a"), (4, "b")]
    with pytest.raises(ValueError, match="both sides"):
        segments.aligned(one.where("id = 2"), two, "id")


def test_profiles_against_rows(spark):
    from quillspark.operators import audit

    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")], "who string, what string")
    profiles = spark.createDataFrame([("a", 3, [("x", 2), ("y", 1)]), ("b", 2, [("z", 1), ("q", 1)]), ("d", 1, [("v", 1)])], "author string, total long, works array<struct<work: string, n: long>>")
    got = sorted((tuple(r) for r in audit.profile_issues(profiles, rows, "who", "what").collect()), key=repr)
    assert got == [("b", "total mismatch", None, 2, 1), ("b", "work mismatch", "q", 1, None), ("c", "missing profile", None, None, 1), ("d", "unexpected profile", None, 1, None)]


def test_progress_of_result_files(spark):
    from quillspark.operators import audit

    files = [None, "", "{", "{}", '{"chapters": null}', '{"chapters": [1, {"a": 2}]}', '{"chapters": 3}', "[]"]
    n, done = audit.progress(F.col("f"), 2)
    got = spark.createDataFrame([(f,) for f in files], "f string").select(n.alias("n"), done.alias("done")).collect()
    assert [r.n for r in got] == [0, -1, -1, 0, 0, 2, 0, 0] and [r.done for r in got] == [r.n >= 2 for r in got]

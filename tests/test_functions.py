"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vectors as V


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(f(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<html><body><h3>1</h3><p>Primer párrafo<br/>con salto.</p><p class="centrado">* * *</p><p>Segundo párrafo.</p><p class="x derecha">(-2)</p><p>(*Nota edición epub: no) x</p></body></html>', "Primer párrafo\ncon salto.\n\nSegundo párrafo."),
        ("<p>Texto suelto</p>", "Texto suelto"),
        ("<body><p>a &amp; b</p>\n\n\n<div> c </div></body>", "a & b\n\nc"),
    ],
)
def test_html_to_text(spark, html, text):
    assert one(spark, X.html_to_text, html) == text


def test_html_parts(spark):
    assert one(spark, X.html_epigraph, "<body><h2>T</h2><p>Linea uno<br/>Linea  dos</p></body>") == "Linea uno\nLinea dos"
    assert one(spark, X.html_epigraph, "<p>none</p>") == ""
    assert one(spark, X.extract_sequence, "<body><p>73-1-2-116-3</p>\n<p>1 and 2</p>\n<div>84-4-71</div></body>") == [73, 1, 2, 116, 3, 84, 4, 71]
    assert one(spark, X.html_main_text, "<nav>x</nav><script>y</script><h1>A</h1><p>b  c</p><!-- d -->") == "A\n\nb c"


def test_sections(spark):
    ranges = [(1, 36, "first"), (37, 56, "second"), (57, 155, "third")]
    got = [one(spark, lambda c: X.section_of(c, ranges), n) for n in (1, 37, 155, 0)]
    assert got == ["first", "second", "third", None]


def test_normalized_output(spark):
    f = X.normalize_output
    assert one(spark, f, "<think>plan</think>\n\nTexto final.") == "Texto final."
    assert one(spark, f, "Thinking Process:\n1. one and two\n\nTexto final que quiero.") == "Texto final que quiero."
    assert one(spark, f, "Texto final.\n\n**Nota:** cambié cosas.") == "Texto final."
    assert one(spark, f, "```text\nA\nB\n```") == "A\nB"
    assert one(spark, X.suffix_marker, "Texto.\n\nExplanation: so") == "Explanation:"
    assert one(spark, X.strip_suffix, "\n\nNote: all there is") == "Note: all there is"
    assert one(spark, X.forbidden_markers, "### Respuesta:\nNota: algo") == ["###", "Respuesta:", "Nota:", "# "]


def test_editorial_lines(spark):
    text = "\nÍndice\n12\nCAPÍTULO UNO\nCapítulo 3\nISBN 978-84-376-0457-2\nEditorial Sur, 1963\n© 1963\nTexto. Página 12 queda.\n"
    assert one(spark, X.strip_editorial, text) == "Texto. Página 12 queda."
    assert one(spark, lambda c: X.editorial_kind(c), "ISBN 978-84-376-0457-2") == "ISBN"


def test_small_text_functions(spark):
    assert one(spark, X.excerpt, "a  b\n" + "c" * 300) == "a b " + "c" * 273 + "..."
    assert one(spark, X.leak_flag, "  Chain of  thought: x") is True and one(spark, X.leak_flag, "So: x") is False
    assert one(spark, X.title_guess, "\n\nEl título\nx") == "El título"
    assert one(spark, X.sentences, "Uno. Dos… ¿Tres? fin") == ["Uno.", "Dos…", "¿Tres?", "fin"]
    assert one(spark, X.sentences, "") == [""]
    assert one(spark, X.words, "¡Niño, ÉL 3x äb!") == ["niño", "él", "x", "b"]
    assert one(spark, X.token_set, "Niño äb 3x niño_1") == ["3x", "niño", "niño_1", "äb"]
    assert one(spark, lambda c: X.split_by_marker(c, r"Capítulo [0-9]+"), "antes Capítulo 1 a Capítulo 2 b") == ["Capítulo 1 a ", "Capítulo 2 b"]
    assert one(spark, X.encoding_suspect, "aÃ±o") is True
    assert one(spark, X.hygiene, "a \nb") == Row(trailing=1, no_final_newline=True)
    assert one(spark, X.valid_run_id, "run-1.2_x") is True and one(spark, X.valid_run_id, "../x") is False
    assert one(spark, X.slug, "git@host.org:owner/name.git") == "owner/name"
    assert one(spark, lambda c: X.embedded_json(c, "layout"), 'var layout = {"a": 1};') == '{"a": 1}'


def test_windows(spark):
    def bounds(n, low, high):
        return [tuple(w) for w in one(spark, lambda c: X.windows(c, low, high), n)]

    def loop(n, low, high):
        out, start = [], 0
        while start + low <= n:
            end = n if n - start <= high else start + high
            out.append((start, end))
            start = end
        return out

    assert bounds(9, 4, 5) == [(0, 5), (5, 9)]
    for n in (0, 3, 4, 5, 8, 9, 10, 14, 15, 23):
        assert bounds(n, 4, 5) == loop(n, 4, 5)
    slide = lambda n: [tuple(w) for w in one(spark, lambda c: X.sliding_windows(c, 4, 2), n)]
    assert slide(3) == [(0, 3)] and slide(4) == [(0, 4)] and slide(7) == [(0, 4), (2, 6), (4, 7)]


def test_vectors(spark):
    assert one(spark, V.euclidean, [0.0, 3.0], [4.0, 0.0]) == 5.0
    assert one(spark, V.cosine, [1.0, 0.0], [0.0, 0.0]) is None
    assert one(spark, V.unit, [0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.rms_distance, [1.0, 1.0], [9.0, 9.0], [3.559026, 3.559026]) == pytest.approx(2.247806, abs=1e-5)
    assert one(spark, V.angle, [1.0, 0.0], [0.0, 1.0]) == pytest.approx(1.5707963)
    assert [one(spark, V.clamp_score, x) for x in (2.5, 3.5, 0.2, 11.0)] == [2, 4, 1, 10]
    with pytest.raises(Exception, match="no value for b"):
        spark.sql("select map('a', 1.0D) as m").select(V.from_map(F.col("m"), ["a", "b"])).collect()

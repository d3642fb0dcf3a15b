from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import language
from quillspark.llm.base import rid, table


def slow(text):
    """n-grams one by one."""
    s = language.symbols(text)
    out = Counter()
    for n in range(1, language.ORDERS + 1):
        for i in range(len(s) - n + 1):
            g = [0] * (language.ORDERS - n) + [int(x) for x in s[i : i + n]]
            if g[-1] != 32 or n > 1:
                out[sum(x << (21 * (language.ORDERS - 1 - j)) for j, x in enumerate(g))] += 1
    return out


def test_counts_equal_plain_counts():
    for text in ("Añb c'd", "", "12 !!", "ab ab abc", "текст文字 x"):
        k, n = language.count([text])
        assert dict(zip(k.tolist(), n.tolist(), strict=True)) == {g: c for g, c in slow(text).items()}, text


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    text = "lorem ipsum dolor " * 400
    whole = {int(k): int(n) for k, n in zip(*language.count([text]), strict=True)}
    monkeypatch.setattr(language, "_PIECE", 500)
    parts = {int(k): int(n) for k, n in zip(*language.count([text]), strict=True)}
    near = sum(abs(whole.get(k, 0) - parts.get(k, 0)) for k in {*whole, *parts})
    assert near <= 0.02 * sum(whole.values())


def test_pieces_count_as_the_whole(monkeypatch):
    texts = ["Lorem, ipsum  dolor 12 " * 40, "", "ab\u0301c", "\u0301", "x" * 1000, " . " * 500 + "é"]
    whole = [dict(zip(*map(list, language.count([t])), strict=True)) for t in texts]
    together = dict(zip(*map(list, language.count(texts)), strict=True))
    assert together == dict(sum((Counter(w) for w in whole), Counter()))
    for piece in (1, 2, 3, 7, 500):
        monkeypatch.setattr(language, "_PIECE", piece)
        assert [dict(zip(*map(list, language.count([t])), strict=True)) for t in texts] == whole
        assert dict(zip(*map(list, language.count(texts)), strict=True)) == together


def test_marks_alone_are_no_letters(spark, edge):
    docs = spark.createDataFrame([(1, "\u0301", "en"), (2, "12 \u0301 ?", "en"), (3, "a\u0301", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, edge).collect()} == {1: "und", 2: "und", 3: "en"}


def test_held_out_accuracy_and_distance(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = table(spark, sf, "documents")
    held = rid("doc_id") % 5 == 0
    got = language.identify(docs, docs.where(~held), passed={"held": held, "lang": F.col("lang")}).collect()
    right = [r.lang == r.lang_pred for r in got if r.held]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    ranks = {}
    for r in language.profiles(docs.where(~held)).collect():
        ranks.setdefault(r.lang, {})[r.gram] = r.rank
    for d in docs.limit(20).collect():
        mine = sorted(slow(d.text).items(), key=lambda x: (-x[1], x[0]))[: language.TOP]
        far = {k: sum(abs(p[g] - i) if g in p else language.TOP for i, (g, _) in enumerate(mine)) for k, p in ranks.items()}
        assert next(r.lang_pred for r in got if r.doc_id == d.doc_id) == min(sorted(far), key=far.get)


def test_edge_rows(edge, nothing):
    got = {r.doc_id: r for r in language.identify(edge, edge).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[1].lang_pred == "en"
    assert language.identify(nothing, edge).count() == 0
    assert {r.lang_pred for r in language.identify(edge, nothing).collect()} == {"und"}

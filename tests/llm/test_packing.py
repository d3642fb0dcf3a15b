import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quillspark.llm import packing
from quillspark.llm.base import table


def whole(pieces):
    docs = {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append(r)
    return docs


def check(pieces, capacity=packing.CAPACITY):
    filled = {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length and r.length > 0
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    for rows in filled.values():
        at = 0
        for offset, n, total in sorted(rows):
            assert offset == at
            at += n
        assert at == total <= capacity and (at == capacity or at & (at - 1) == 0)  # no padding


def test_round_trip(spark, sf, vocabulary):
    docs = table(spark, sf, "documents").limit(150)  # a test's own input
    pieces = packing.pack(docs, vocabulary, group_tokens=20_000).collect()
    check(pieces)
    exact = Tokenizer.from_file(vocabulary)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = whole(pieces)
    assert got.keys() == texts.keys()
    for i, rows in got.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == list(np.cumsum([0, *[r.length for r in rows]]))[:-1]
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
        assert ids.tolist() == [*exact.encode(texts[i], add_special_tokens=False).ids, 1]
        assert {r.doc_tokens for r in rows} == {len(ids)}


def test_all_ids_are_the_librarys(spark, vocabulary):
    exact = Tokenizer.from_file(vocabulary)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    pieces = packing.pack(docs, vocabulary).collect()
    check(pieces)
    got = whole(pieces)
    for r in docs.collect():
        rows = sorted(got.pop(r.doc_id), key=lambda x: x.start)
        assert b"".join(x.ids for x in rows) == np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert not got


def test_words_are_remembered_within_bounds(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "_CACHE", 40)
    t = packing.WordCachedTokenizer(vocabulary)
    for i in range(30):
        text = " ".join(f"word{j} other{j % 3}, \0 a\0b" for j in range(i * 9, i * 9 + 30))
        assert t(text).tolist() == t.full.encode(text, add_special_tokens=False).ids
    assert len(t.seen) <= 40 + 70


def test_tokenizer_equals_the_library(vocabulary):
    t = packing.WordCachedTokenizer(vocabulary)
    for text in ("It's they're 12³ ½ don''t", "naïve Œuvre ŠČ İstanbul ΣΑΣ ς", "a\x1cb c\x85d e f", "<|endoftext|> <|startoftext|>x", "aaaa aaaaaaa __ ..,, 文字 كتاب é́ é", "x" * 300, "", " \n", "end.of? a.b,c e.́ x's. 'S. ;́ a\0b \0 c\0. İ\0 ²a a² é.\0", "Don't!? he'll... A.B.C. 3.5,7;8 i̇. \u037e a\u037e"):
        assert t(text).tolist() == t.full.encode(text, add_special_tokens=False).ids, text


def test_lowest_cost_sequence_takes_the_next_document():
    lengths = [600, 500, 400, 300, 200, 100, 2040, 4096, 3, 1]
    pieces = packing.assign(lengths, 1024, 1.0, 1 / 1024)
    for d, n in enumerate(lengths):
        mine = sorted((s, k) for x, s, k, _, _ in pieces if x == d)
        assert mine[0][0] == 0 and sum(k for _, k in mine) == n and all(a + b == c for (a, b), (c, _) in zip(mine, mine[1:], strict=False))
    pair = packing.assign([512, 512, 256, 256, 256, 256], 1024, 1.0, 1 / 64)
    by = {}
    for d, _, k, q, _ in pair:
        by.setdefault(q, []).append(k)
    assert sorted(map(sorted, by.values())) == [[256, 256, 512], [256, 256, 512]]


def test_capacities_need_no_padding():
    for n in (0, 1, 2047, 2048, 2049, 10_000):
        assert sum(packing.capacities(n, 2048)) == n


def test_edge_rows(edge, nothing, vocabulary):
    pieces = packing.pack(edge, vocabulary).collect()
    check(pieces)
    empty = [r for r in pieces if r.doc_id in (3, 4, 5)]
    assert len(empty) == 3 and all(np.frombuffer(r.ids, "<u4").tolist() == [1] for r in empty)
    assert sum(r.length for r in pieces if r.doc_id == 1) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 1)
    assert any(r.doc_id is None for r in pieces)
    assert packing.pack(nothing, vocabulary).count() == 0


def test_special_tokens_are_the_librarys_plain_call(spark, vocabulary):
    exact, t = Tokenizer.from_file(vocabulary), packing.WordCachedTokenizer(vocabulary)
    texts = ["a <|startoftext|> b", "<|endoftext|>", "x<|endoftext|>y. z", "<|EndOfText|> a", "<|endoftext|><|endoftext|>", "plain, words", "< | endoftext|>", "é <|startoftext|>\n\tWord"]
    ids, bounds = t.many(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == exact.encode(text, add_special_tokens=False).ids == t(text).tolist()
    assert 49406 in t(texts[0]) and 49406 not in t(texts[3])
    got = whole(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary).collect())
    for i, text in enumerate(texts):
        rows = sorted(got[i], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist() == [*exact.encode(text, add_special_tokens=False).ids, 1]

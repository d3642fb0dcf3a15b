import random

import duckdb

from quillspark.llm import decontamination as dc
from quillspark.llm.base import table


def brute(text, items, window=10):
    w = dc.words((text or "").encode())
    hit, names = set(), set()
    for name, t in items:
        iw = dc.words((t or "").encode())
        for i in range(max(1, len(iw) - window + 1)) if iw else ():
            g = iw[i : i + window]
            for at in range(len(w) - len(g) + 1):
                if w[at : at + len(g)] == g:
                    hit.update(range(at, at + len(g)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_search_equals_naive_search():
    rng = random.Random(5)
    for _ in range(300):
        text = bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 80)))
        patterns = list({bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))})
        expected = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
        assert sorted(dc.WuManber(patterns).find(text)) == expected


def rows(df):
    hit = dc.hit_words()
    return sorted(((r.doc_id, r.n_words, r.n, list(r.item_ids)) for r in df.select("*", hit.alias("n")).collect()), key=str)


def test_equals_brute_force_in_one_block_and_many(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    expected = sorted(((r.doc_id, *brute(r.text, pairs)) for r in docs.collect()), key=str)
    assert rows(dc.find_overlaps(docs, items)) == expected and any(n for _, _, n, _ in expected)
    assert rows(dc.find_overlaps(docs, items, block_bytes=2000)) == expected


def test_edge_rows(edge, nothing, benchmark):
    pairs = [(r.item_id, r.text) for r in benchmark.collect()]
    expected = sorted(((r.doc_id, *brute(r.text, pairs)) for r in edge.collect()), key=str)
    assert rows(dc.find_overlaps(edge, benchmark)) == expected
    assert dc.find_overlaps(nothing, benchmark).count() == 0
    assert all(r[2] == 0 for r in rows(dc.find_overlaps(edge, benchmark.where("false"))))
    kept = dc.drop_contaminated(edge, benchmark)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(e[0] or -1 for e in expected if not e[2])


def test_blocks_drop_the_same_documents(spark, edge, benchmark):
    one, many = (sorted(str(r) for r in dc.drop_contaminated(edge, benchmark, block_bytes=n).collect()) for n in (dc.BLOCK_BYTES, 20))
    assert one == many and len(one) < edge.count()
    assert rows(dc.find_overlaps(edge, benchmark, block_bytes=20)) == rows(dc.find_overlaps(edge, benchmark))


def test_query_equals_sql(spark, sf):
    from quillspark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.op4_wu_manber_decontamination(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.OP4_SQL).fetchall())

import struct
import zlib

import numpy as np

from quillspark.llm import media
from quillspark.llm.base import table


def texture(seed, n=80):
    rng = np.random.default_rng(seed)
    return np.clip(128 + 60 * media._box(media._box(rng.normal(0, 3, (n, n)), 1), 1), 0, 255)


def png(grey):
    rows = b"".join(b"\0" + bytes(r) for r in grey.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_finds_crops_and_edits(spark):
    rows = [(i, media.write_pgm(texture(i))) for i in range(30)]
    rng = np.random.default_rng(9)
    base = texture(0)
    copies = {100: base[9:, 5:], 101: np.clip(base * 0.8 + 20, 0, 255), 102: np.rot90(base), 103: np.clip(base + rng.normal(0, 2, base.shape), 0, 255)}
    rows += [(i, media.write_pgm(np.rint(x))) for i, x in copies.items()] + [(104, png(np.rint(base))), (105, rows[3][1])]
    rows += [(200, None), (201, b""), (202, b"junk"), (203, b"junk"), (204, b"P5\n3 3\n255\n123456789")]
    df = spark.createDataFrame(rows, "id long, image binary").repartition(3)
    got = {r.id: r for r in media.find_copies(df, id_col="id", image_col="image").collect()}
    assert {got[i].class_id for i in (*copies, 104)} == {0} and got[105].class_id == 3
    assert all(got[i].class_id == i for i in range(30))
    assert got[200].class_id == got[201].class_id == 200 and got[202].class_id == got[203].class_id == 202 and got[204].n_points == 0
    assert media.find_copies(df.where("false"), id_col="id", image_col="image").count() == 0


def turned(x, degrees):
    h, w = x.shape
    t = np.deg2rad(degrees)
    y, z = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    ys = ((y - cy) * np.cos(t) + (z - cx) * np.sin(t) + cy).clip(0, h - 1.001)
    xs = (-(y - cy) * np.sin(t) + (z - cx) * np.cos(t) + cx).clip(0, w - 1.001)
    i, j = ys.astype(int), xs.astype(int)
    a, b = ys - i, xs - j
    return (x[i, j] * (1 - b) + x[i, j + 1] * b) * (1 - a) + (x[i + 1, j] * (1 - b) + x[i + 1, j + 1] * b) * a


EDITS = {
    "crop": lambda x: x[9:, 5:],
    "half": lambda x: x[:, :54],
    "noise": lambda x: np.clip(x + np.random.default_rng(2).normal(0, 4, x.shape), 0, 255),
    "blur": lambda x: media._box(x, 1),
    "brightness": lambda x: np.clip(x * 0.8 + 20, 0, 255),
    "turn 15": lambda x: turned(x, 15),
    "turn 90": np.rot90,
    "scale 0.75": lambda x: media._resize(x, 0.75),
    "scale 1.33": lambda x: media._resize(x, 1.33),
}


def test_recall_by_edit_against_all_pairs(spark):
    """Every pair of 30 pictures and their copies, verified one by one, against what the tables find."""
    kept = list(range(30))
    pictures = {i: texture(i) for i in kept}
    for k, edit in enumerate(EDITS.values(), 1):
        pictures |= {1000 * k + i: np.rint(edit(pictures[i])) for i in kept}
    read = {i: media.features(media.decode(media.write_pgm(np.rint(x)))) for i, x in pictures.items()}
    got = {r.id: r.class_id for r in media.find_copies(spark.createDataFrame([(i, media.write_pgm(np.rint(x))) for i, x in pictures.items()], "id long, image binary").repartition(4), id_col="id", image_col="image").collect()}
    for k, name in enumerate(EDITS, 1):
        true = [i for i in kept if media.agree(*read[i], *read[1000 * k + i]) >= media.INLIERS]
        assert len(true) >= 27, name  # the verification takes a copy for one
        pairwise = [i for i in true if media.share(read[i][1], read[1000 * k + i][1]) >= media.VOTES]
        assert len(pairwise) >= 0.9 * len(true), (name, len(pairwise))  # without the other copies' help
        assert sum(got[i] == got[1000 * k + i] for i in true) >= 0.9 * len(true), name
    assert all(got[i] != got[j] for i in kept for j in kept if i < j)


def test_no_link_depends_on_the_size_of_a_file(spark, monkeypatch):
    rng = np.random.default_rng(3)
    noisy = {100 * g + i: np.rint(np.clip(texture(g) + rng.normal(0, 6, (80, 80)), 0, 255)) for g in range(3) for i in range(12)}
    rows = spark.createDataFrame([(i, media.write_pgm(x)) for i, x in noisy.items()], "id long, image binary").repartition(3)
    found = [{r.id: r.class_id for r in media.find_copies(rows, id_col="id", image_col="image", limit=n).collect()} for n in (media.LIMIT, 5)]
    monkeypatch.setattr(media, "FEW", 3)
    monkeypatch.setattr(media, "CENTRES", 1)
    found += [{r.id: r.class_id for r in media.find_copies(rows, id_col="id", image_col="image", limit=n).collect()} for n in (media.LIMIT, 5)]
    assert all(f == {i: i // 100 * 100 for i in noisy} for f in found)


def test_links_of_a_group_are_all_counted(spark):
    """Every pair of near copies that shares enough points and is verified is a link, whatever the size of their files."""
    base = np.rint(texture(0))
    base[:2, :2] = 0  # no patch of a corner reaches there
    noisy = {i: media.write_pgm(base + np.pad([[i]], ((0, 79), (0, 79)))) for i in range(30)}
    read = {i: media.features(media.decode(x)) for i, x in noisy.items()}
    linked = [(i, j) for i in noisy for j in noisy if i < j and media.share(read[i][1], read[j][1]) >= media.VOTES and media.agree(*read[i], *read[j]) >= media.INLIERS]
    expected = {i: sum(i in p for p in linked) for i in noisy}
    assert set(expected.values()) == {29}
    rows = spark.createDataFrame(list(noisy.items()), "id long, image binary").coalesce(1)
    for limit in (media.LIMIT, 9):
        assert {r.id: r.n_links for r in media.find_copies(rows, id_col="id", image_col="image", limit=limit).collect()} == expected, limit


def test_neither_points_nor_pairs_are_rows(spark, monkeypatch):
    """What is staged on the way grows with the pictures, though all 435 pairs of 30 near copies are links."""
    base = np.rint(texture(0))
    base[:2, :2] = 0
    noisy = [(i, media.write_pgm(base + np.pad([[i]], ((0, 79), (0, 79))))) for i in range(30)]
    rows, staged = [], media.stage

    def counted(df, name):
        out = staged(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(media, "stage", counted)
    got = media.find_copies(spark.createDataFrame(noisy, "id long, image binary").coalesce(1), id_col="id", image_col="image").collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 29)}
    assert max(n for _, n in rows) <= 30, rows


def test_every_two_blocks_meet_once(spark):
    images = spark.range(60).select(media.F.col("id").alias("node"), media.F.lit(b"").alias("features"))
    for blocks in (1, 2, 3, 6, 7):
        met = []
        for rows, pairs in media._rounds(images, blocks):
            by = {}
            for r in rows.collect():
                assert 0 <= r.pair < pairs
                by.setdefault(r.pair, []).append((r.node, r.side))
            for of in by.values():
                met += [tuple(sorted((a, b))) for a, s in of for b, t in of if (a < b if s == t == 0 else s == 1 and t == 2)]
        assert len(met) == len(set(met)) == 60 * 59 // 2, blocks


def test_votes_of_files_equal_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    key, image, point = np.sort(rng.integers(0, 12, 400)), rng.integers(0, 40, 400), np.arange(400)
    beside = rng.choice(rng.integers(0, 1 << 60, 6), 400) ^ (1 << rng.integers(0, 50, 400))
    order = np.lexsort((point, image, key))
    cols = [c[order].astype(np.int64) for c in (key, image, point, beside)]

    def batches(n):
        for at in range(0, 400, n):
            yield media.pa.RecordBatch.from_arrays([media.pa.array(c[at : at + n]) for c in cols], media._ROW)

    def run(n):
        t = media.pa.Table.from_batches(list(media._near(batches(n)))).to_pylist()
        return {(r["a"], r["b"], r["vote"]) for r in t if r["a"] is not None}, {r["point"] for r in t if r["key"] is not None}

    close = {(*sorted((cols[1][i], cols[1][j])), min((cols[1][i], cols[2][i]), (cols[1][j], cols[2][j]))[1]) for i in range(400) for j in range(i) if cols[0][i] == cols[0][j] and cols[1][i] != cols[1][j] and bin(int(cols[3][i] ^ cols[3][j])).count("1") <= media._BESIDE}
    monkeypatch.setattr(media, "FEW", 1000)
    assert all(run(n) == (close, set()) for n in (400, 7, 1))
    monkeypatch.setattr(media, "FEW", 10)
    parts = [run(n) for n in (400, 100, 7, 1)]
    assert all(p[0] <= close and p == parts[0] for p in parts) and len(parts[0][1]) > 300


def test_edge_pictures(spark):
    x = media.write_pgm(np.rint(texture(1)))
    flat, wide = media.write_pgm(np.full((60, 60), 9)), media.write_pgm(np.rint(np.tile(texture(2), (1, 12))))
    rows = [(None, x, 1), (1, x, 2), (1, x, 2), (2, flat, 0), (3, b"P5 0 0 255\n", 0), (4, b"P5 0 5 255\n", 0), (5, wide, 0), (6, None, 0)]
    df = spark.createDataFrame(rows, "id long, image binary, `key` long").withColumnRenamed("key", "n_points")
    got = media.find_copies(df, id_col="id", image_col="image").collect()
    by = {r.id: r for r in got}
    assert len(got) == 8 and by[None].class_id == by[1].class_id == 1 and all(by[i].n_points == 0 for i in (2, 3, 4, 6)) and by[5].n_points > 4 * by[1].n_points
    assert len({by[i].class_id for i in (1, 2, 3, 4, 5, 6)}) == 6


def test_decoders_agree():
    x = np.rint(texture(1, 20))
    assert np.array_equal(media.decode(media.write_pgm(x)), media.decode(png(x)))
    assert np.array_equal(media.decode(b"P6\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6])), [[2.0, 5.0]])


def test_large_group_is_one_class(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 64)
    v /= np.linalg.norm(v)
    rows = [(i, (v + rng.normal(0, 0.002, 64)).tolist()) for i in range(60)] + [(100 + i, rng.normal(0, 1, 64).tolist()) for i in range(20)] + [(300, None), (301, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: r.class_id for r in media.find_copies(media.render(vectors), id_col="id", image_col="image").collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[100 + i] == 100 + i for i in range(20)) and got[300] == got[301] == 300


def test_query_has_every_row(spark, sf):
    from quillspark.llm import queries

    got = queries.op10_image_descriptors(spark, sf)
    assert got.count() == table(spark, sf, "embeddings").count()

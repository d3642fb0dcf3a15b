"""Language-model scores by deleted interpolation of a word bigram model.

Tokens are runs without ASCII white space, A to Z in lower case, and one end token a text. The unigram is
p1(w) = m * c(w) / N + (1 - m) / (V + 1), the bigram p(w | h) = l(b) * c(h, w) / c(h) + (1 - l(b)) * p1(w), where b is the bucket
floor(log2 c(h)) of the context's frequency; a context that was never seen leaves p1. The weights m and l(b) come from
expectation-maximisation on held-out counts: one fold of the training texts is left out of the counts against which
its tokens are weighed. The scores then use the counts of all training texts.

Nothing is broadcast that grows with the corpus. Each scan task forms blocks of about ``block_bytes`` of text, sums within a
block, and sends its sorted distinct n-gram hashes (64 bits, packed by differences) to the partition that owns their
leading bits; that partition adds up all blocks' counts and sends each block the totals in the order in which it asked.
So an n-gram that is everywhere costs one entry a block. Blocks are then joined with their answers, and tokens are
looked up in their own block's arrays. EM works on counts of log-ratios in bins of 1/16 of a doubling for each bucket, whose number is
bounded. A bigram order keeps what is moved at about twice the input; trigrams would nearly double it.

Blocks are formed anew in each pass from the same scan, so the input must read alike each time: it is staged first
unless ``stable`` says that it is a table. A block that doesn't match its answers raises an error.

Defined results: a null or empty text is one end token; repeated rows count and are scored each time; a null id is hashed as
empty text; without training texts only the uniform part is left; where only the learning fold has texts, weights can't be learned: the unigram's
is 1e-6 and the bigram's 0.5; a very long text is a block of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, mix64, rid, stage, utf8

BLOCK_BYTES = 8 << 20
#: Of the ids' crc32 remainders: folds, the one that is never trained on, the one on which weights are learned.
FOLDS, HELD_OUT, LEARN = 7, 2, 6
STEP = 16
_BINS = 64 * STEP
_NONE = -(1 << 20)


def _put(values: np.ndarray) -> bytes:
    """uint64 values by byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _get(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _put_sorted(values: np.ndarray) -> bytes:
    return _put(np.diff(values, prepend=np.uint64(0)))


def _get_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_get(blob), dtype=np.uint64)


class Block:
    """Tokens of some texts as places in the block's own vocabulary: 0 is the end, 1 the start (a context only)."""

    def __init__(self, learn: bool):
        self.learn = learn
        self.place: dict[bytes, int] = {b" end": 0, b" start": 1}  # no word holds a space
        self.parts: list[np.ndarray] = []
        self.ids: list[object] = []
        self.held: list[bool] = []
        self.size = 0

    def add(self, text: bytes, name: object, held: bool) -> None:
        words = text.lower().split()
        for w in set(words).difference(self.place):
            self.place[w] = len(self.place)
        self.parts.append(np.append(np.fromiter(map(self.place.__getitem__, words), np.int32, len(words)), np.int32(0)))
        self.ids.append(name)
        self.held.append(held)
        self.size += len(text) + 64

    def hashes(self) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.fromiter(map(xxh64_intdigest, self.place), np.uint64, len(self.place))


class Grams:
    """The n-grams of a block, from its tokens: distinct sorted keys of either order, counts, and each token's entry."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, counted: np.ndarray):
        before = np.append(np.int32(1), tokens[:-1])
        ends = np.cumsum(lengths)
        before[ends[:-1]] = 1
        self.tokens, self.before = tokens, before
        weight = np.repeat(counted, lengths)
        order = np.argsort(hashes, kind="stable")
        used = np.bincount(tokens, minlength=len(hashes))
        used[1] = 0
        place = order[used[order] > 0]
        self.word_entry = np.full(len(hashes), -1, np.int64)
        self.word_entry[place] = np.arange(len(place))
        pairs, at = np.unique(before.astype(np.int64) << 32 | tokens, return_inverse=True)
        with np.errstate(over="ignore"):
            key = mix64(hashes[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + mix64(hashes[pairs & 0xFFFFFFFF]))
        by = np.argsort(key, kind="stable")
        entry = np.empty(len(by), np.int64)
        entry[by] = np.arange(len(by))
        self.pair_entry = entry[at]
        self.keys = {1: hashes[place], 2: key[by]}
        self.counts = {1: np.bincount(tokens, weight, len(hashes))[place].astype(np.uint64), 2: np.bincount(at, weight, len(pairs))[by].astype(np.uint64)}

    def entries(self, order: int) -> np.ndarray:
        return self.word_entry[self.tokens] if order == 1 else self.pair_entry


def _blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, Block]]:
    """Blocks of the texts of one scan task, apart for the fold on which weights are learned, with ids that don't depend on batches."""
    first, done, open_ = TaskContext.get().partitionId() << 32, [0, 0], [Block(False), Block(True)]
    for b in batches:
        for name, text, fold in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
            k = int(fold == LEARN)
            open_[k].add(text, name, fold == HELD_OUT)
            if open_[k].size >= block_bytes:
                yield first + 2 * done[k] + k, open_[k]
                done[k] += 1
                open_[k] = Block(bool(k))
    for k in (0, 1):
        if open_[k].parts:
            yield first + 2 * done[k] + k, open_[k]


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def em(ratio: np.ndarray, weight: np.ndarray, rounds: int = 200) -> float:
    """Weight of the first of two distributions, of whose likelihoods ratio is known, that suits the weighted tokens best."""
    if not weight.sum():
        return 0.5
    lam = 0.5
    for _ in range(rounds):
        new = float((weight * lam * ratio / (lam * ratio + 1 - lam)).sum() / weight.sum())
        if abs(new - lam) < 1e-7:
            break
        lam = new
    return min(max(lam, 1e-6), 1 - 1e-4)


def _log_bin(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.rint(np.log2(np.where(x > 0, x, 1)) * STEP), _NONE).astype(np.int64)


def _value(bin_: np.ndarray) -> np.ndarray:
    return np.where(bin_ == _NONE, 0.0, np.exp2(np.clip(bin_, -_BINS, _BINS) / STEP))


def train_and_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, stable: bool = False) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    src = id_and_text(docs, id_col, text_col).withColumn("fold", (rid() % FOLDS).cast("int"))
    if not stable:
        src = stage(src, "texts")
    kind = src.schema["id"].dataType.simpleString()
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(4, int(np.ceil(np.log2(max(1, size / block_bytes)))))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _blocks(batches, block_bytes):
            lengths = np.fromiter(map(len, block.parts), np.int64, len(block.parts))
            g = Grams(np.concatenate(block.parts), lengths, block.hashes(), ~np.array(block.held))
            rows = []
            for order in (1, 2):
                at = _bounds(g.keys[order], bits)
                rows += [(p, name, order, _put_sorted(g.keys[order][i:j]), _put(g.counts[order][i:j])) for p, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["p", "block", "ngram", "keys", "counts"])

    asked = src.mapInArrow(ask, "p int, block bigint, ngram int, keys binary, counts binary")

    def answer(t: pa.Table) -> pa.Table:
        block, order = t["block"].to_numpy(), t["ngram"].to_numpy()
        out, totals, bins = [], [0, 0, 0], np.zeros(_BINS + 1, np.int64)
        for n in (1, 2):
            rows = np.flatnonzero(order == n)
            if not len(rows):
                continue
            keys = [_get_sorted(t["keys"][int(i)].as_py()) for i in rows]
            counts = np.concatenate([_get(t["counts"][int(i)].as_py()) for i in rows]).astype(np.int64)
            learn = np.repeat(block[rows] & 1, [len(k) for k in keys])
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            base = np.bincount(at, counts * (1 - learn), len(distinct)).astype(np.int64)
            fold = np.bincount(at, counts * learn, len(distinct)).astype(np.int64)
            if n == 1:
                totals = [int((base + fold).sum()), int(base.sum()), int((base + fold > 0).sum())]
                np.add.at(bins, np.where(base > 0, 1 + np.minimum(_log_bin(base), _BINS - 1), 0), fold)
            cut = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
            out += [(int(block[i]), n, int(t["p"][int(i)].as_py()), _put((base + fold)[c].astype(np.uint64)), _put(base[c].astype(np.uint64)) if block[i] & 1 else b"", [0, 0, 0], []) for i, c in zip(rows, cut, strict=True)]
        out.append((-1, 0, -1, b"", b"", totals, bins.tolist()))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)], names=["block", "ngram", "p", "full", "base", "totals", "bins"])

    answers = asked.groupBy("p").applyInArrow(answer, "block bigint, ngram int, p int, full binary, base binary, totals array<bigint>, bins array<bigint>")
    answers = stage(answers, "ngram-totals")
    told = answers.where("block = -1")
    all_n, base_n, all_v = (int(x or 0) for x in told.agg(*[F.sum(F.col("totals")[i]) for i in range(3)]).first())
    grid = {r.pos: r.n for r in told.select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}  # at most _BINS + 1 rows
    at = np.array(sorted(grid), np.int64)
    held = np.array([grid[i] for i in at], float)
    base_ml = np.where(at == 0, 0.0, np.exp2((at - 1) / STEP)) / max(base_n, 1)
    m = em(base_ml * (all_v + 1), held) if base_n else 1e-6

    enc_schema = f"block bigint, ngram int, p int, full binary, base binary, tokens binary, ids array<{kind}>"

    def encode(learn_only: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            z = zstandard.ZstdCompressor(level=1)
            for name, block in _blocks(batches, block_bytes):
                lengths = np.fromiter(map(len, block.parts), np.int64, len(block.parts))
                tokens = z.compress(np.ascontiguousarray(np.concatenate(block.parts).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
                both = np.append(lengths << 1, 0) | np.append(np.array(block.held, np.int64), 0)
                cols = [[name], [0], [-1], [block.hashes().tobytes()], [z.compress(both[:-1].tobytes())], [tokens], [block.ids]]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(batch_type))
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], ["block", "ngram", "p", "full", "base", "tokens", "ids"])

        rows = src.where(F.col("fold") == LEARN) if learn_only else src
        mine = answers.where("block <> -1" + (" and block % 2 = 1" if learn_only else ""))
        told_ = mine.select("block", "ngram", "p", "full", "base", F.lit(None).cast("binary").alias("tokens"), F.lit(None).cast(f"array<{kind}>").alias("ids"))
        return rows.mapInArrow(run, enc_schema).union(told_)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(src.schema["id"].dataType)

    def opened(t: pa.Table) -> tuple[Grams, np.ndarray, np.ndarray, pa.Array, dict[int, np.ndarray], dict[int, np.ndarray]]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        order, p = t["ngram"].to_numpy(), t["p"].to_numpy()
        i = int(np.flatnonzero(order == 0)[0])
        hashes = np.frombuffer(t["full"][i].as_py(), np.uint64)
        both = np.frombuffer(z.decompress(t["base"][i].as_py()), np.int64)
        tokens = np.ascontiguousarray(np.frombuffer(z.decompress(t["tokens"][i].as_py()), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int32)
        lengths, held_out = both >> 1, (both & 1).astype(bool)
        g = Grams(tokens, lengths, hashes, ~held_out)
        full: dict[int, np.ndarray] = {}
        base: dict[int, np.ndarray] = {}
        for n in (1, 2):
            rows = np.flatnonzero(order == n)
            rows = rows[np.argsort(p[rows], kind="stable")]
            full[n] = np.concatenate([_get(t["full"][int(r)].as_py()) for r in rows]).astype(np.int64)
            if len(full[n]) != len(g.keys[n]) or not np.array_equal(np.diff(_bounds(g.keys[n], bits))[p[rows]], [len(_get(t["full"][int(r)].as_py())) for r in rows]):
                raise RuntimeError("a block differs from the one whose n-grams were counted; the input doesn't read alike each time")
            if t["base"][int(rows[0])].as_py():
                base[n] = np.concatenate([_get(t["base"][int(r)].as_py()) for r in rows]).astype(np.int64)
        return g, lengths, held_out, t["ids"].combine_chunks().slice(i, 1).flatten(), full, base

    def parts(g: Grams, of: dict[int, np.ndarray], total: int, docs_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: p1, count of its context, and bigram likelihood (0 where the context is new)."""
        c1 = of[1][g.entries(1)]
        p1 = m * c1 / max(total, 1) + (1 - m) / (all_v + 1)
        words = np.append(of[1], docs_)
        entry = np.where(g.before == 1, len(of[1]), g.word_entry[g.before])
        context = words[entry]
        return p1, context, of[2][g.entries(2)] / np.maximum(context, 1)

    def learn(t: pa.Table) -> pa.Table:
        g, _, _, _, _, base = opened(t)
        docs_ = int(base[1][g.word_entry[0]])  # every text has one end
        p1, context, p2 = parts(g, base, base_n, docs_)
        seen = context > 0
        bucket = np.floor(np.log2(context[seen])).astype(np.int64)
        bin_ = _log_bin(p2[seen] / p1[seen])
        key, n = np.unique(bucket << 32 | (bin_ - _NONE), return_counts=True)
        return pa.table([pa.array(key >> 32), pa.array((key & 0xFFFFFFFF) + _NONE), pa.array(n)], names=["bucket", "bin", "n"])

    grid2 = encode(True).groupBy("block").applyInArrow(learn, "bucket bigint, bin bigint, n bigint").groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect() if base_n else []
    lam = np.full(64, 0.5)
    for b in sorted({r.bucket for r in grid2}):
        mine = [r for r in grid2 if r.bucket == b]
        lam[b:] = em(_value(np.array([r.bin for r in mine])), np.array([r.n for r in mine], float))

    def score(t: pa.Table) -> pa.Table:
        g, lengths, held_out, ids, full, _ = opened(t)
        p1, context, p2 = parts(g, full, all_n, int(full[1][g.word_entry[0]]))
        weight = np.where(context > 0, lam[np.floor(np.log2(np.maximum(context, 1))).astype(np.int64)], 0.0)
        c1 = full[1][g.entries(1)]
        at = np.cumsum(lengths) - lengths
        total = lambda x: np.add.reduceat(x, at)
        cols = [
            ids,
            pa.array(held_out),
            pa.array(lengths),
            pa.array(total((c1 > 0).astype(np.int64))),
            pa.array(np.full(len(lengths), all_n, np.int64)),
            pa.array(total(np.log10((c1 + 1) / (all_n + all_v + 1)))),
            pa.array(total(np.log10(weight * p2 + (1 - weight) * p1))),
        ]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encode(False).groupBy("block").applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

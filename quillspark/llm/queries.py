"""The registered queries of this package: thin, whole-table uses of its operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, forest, language, lm, media, packing, pii, quality, repeats, search, secrets, simhash, trie
from .base import rid, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.replace(docs, entities_col="found")
    listed = F.array_join(F.transform("found", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return done.select("doc_id", "text", F.size("found").cast("long").alias("n_entities"), listed.alias("entities"))


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "cost")


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(table(spark, sf_dir, "documents"), stable=True)


def op4_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontamination.hit_words()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_two_stage_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(rid("doc_id") % 3 != 1))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (rid("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = rid("doc_id") % 5 == 0
    return language.identify(docs, docs.where(~held), passed={"held_out": held}).select("doc_id", "held_out", "lang_pred", "score")


def op8_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.KINDS))
    # a second argument of the function would be the place in the array
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op9_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = media.render(table(spark, sf_dir, "embeddings"))
    return media.find_copies(pictures, id_col="id", image_col="image").withColumnRenamed("id", "vec_id")


def op11_sort_accumulation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    convs = turns.select(F.col("conv_id").alias("conv")).where("conv is not null").distinct()
    built = trie.prefix_trie(_rebuilt(turns, convs), convs=convs)
    nodes = built.nodes.join(trie.ends_digest(built.ends), "node", "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 5 for its own first h; h is crc32(c) % 9."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    placed = trie.scanned(trie.turns_of(turns, "conv_id", "turn", "role", "text"))
    heads = placed.where((F.col("conv") % 5 == 0) & (F.col("d") <= 8)).select(F.col("conv").alias("base"), "d", "role", "text")
    wanted = convs.select("conv", (F.col("conv") - F.col("conv") % 5).alias("base"), h.alias("h"))
    begun = wanted.join(heads, "base").where("d <= h").select("conv", "d", "role", "text")
    rows = begun.union(placed.where(F.col("d") > h).select("conv", "d", "role", "text"))
    return rows.select(F.col("conv").alias("conv_id"), F.col("d").alias("turn"), "role", "text")


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii_surrogates, op2_cost_packing, op3_deleted_interpolation, op4_wu_manber_decontamination, op5_two_stage_repeats, op6_quality_classifier, op7_language_rank_order, op8_secret_randomness, op9_simhash_pigeonring, op10_image_descriptors, op11_sort_accumulation_search, op12_prefix_trie, op13_lsh_forest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_wu_manber_decontamination": OP4_SQL, "op11_sort_accumulation_search": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_lsh_forest": OP13_SQL}


#: ASCII upper case and lower case.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item, i, grams.n FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), totals AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0
), tf AS (SELECT doc_id, any_value(len(w)) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, term
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), scored AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // nt))))) AS BIGINT) AS score
  FROM b JOIN weights USING (term) JOIN tf USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

#: A byte's share of crc32: eight shifts, each with the reversed polynomial if a bit falls out.
_CRC_BYTE = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda crc, byte: " + _CRC_BYTE + "), 4294967295)"

OP12_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, p, role, text FROM convs c JOIN own o ON o.conv_id = c.base WHERE p <= h
  UNION ALL SELECT conv_id, p, role, text FROM own JOIN convs USING (conv_id) WHERE p > h
), placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d FROM turns
), whole AS (SELECT conv_id, count(d) AS len, list({{'r': role, 't': text}} ORDER BY d) FILTER (d IS NOT NULL) AS path FROM convs LEFT JOIN placed USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, len, d, coalesce(path[1:d], []) AS prefix, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(path[d].t)) END AS bytes
  FROM (SELECT conv_id, len, path, unnest(generate_series(0, len)) AS d FROM whole)
), nodes AS (
  SELECT prefix, d, min(conv_id) AS owner, count(*) AS n, min(bytes) AS bytes, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends, max(len) = d AS leaf
  FROM prefixes GROUP BY prefix, d
), below AS (
  SELECT a.prefix AS prefix, sum((b.n - 1) * b.bytes) AS saved, count(*) FILTER (b.leaf) AS leaves, count(*) FILTER (b.d = a.d + 1) AS children
  FROM nodes a JOIN prefixes p ON p.prefix = a.prefix JOIN nodes b ON b.owner = p.conv_id AND b.d >= a.d GROUP BY a.prefix
)
SELECT a.owner AS conv_id, a.d AS depth, u.owner AS parent_conv_id, a.n AS n_convs, CAST(children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN below USING (prefix) LEFT JOIN nodes u ON a.d > 0 AND u.prefix = a.prefix[1:a.d - 1] AND u.d = a.d - 1
"""

OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * p.n >= 80 * (s.n + t.n - p.n)
), reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

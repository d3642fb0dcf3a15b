"""Queries over logs of experiments, canonical JSON, and joins and segments that must be whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_row
from ..functions import text as X
from ..operators import execution, segments
from .registry import query, rounded

#: A user's signup starts an experiment; a purchase before the next one ends it.
_LIMIT = 3 * 86400
_LOG = f"""lg AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM events),
st AS (SELECT event_id AS e, ts AS started FROM lg WHERE event_type = 'signup'),
en AS (SELECT e, arg_min(ts, (ts, event_id)) AS ended, arg_min(k, (ts, event_id)) AS k, arg_min(value, (ts, event_id)) AS value FROM lg WHERE event_type = 'purchase' AND e IS NOT NULL GROUP BY e)"""


def _log(read):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = read("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("e", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w)).where("event_type in ('signup', 'purchase') and e is not null")
    end = F.col("event_type") == "purchase"
    return e.select(
        F.when(end, F.col("e")).otherwise(F.col("event_id")).cast("string").alias("experiment"), F.when(end, "end").otherwise("start").alias("kind"), F.col("ts").alias("at"), F.lit(_LIMIT).alias("timeout_seconds"),
        F.when(end, F.when(F.col("k") % 10 == 0, 1).otherwise(0)).alias("return_code"), F.when(end & (F.col("k") % 7 != 0), F.col("value")).alias("metric"),
        F.when(end, F.when(F.col("k") % 3 == 0, "failed").otherwise("keep")).alias("status"),
    )


@query(f"""WITH {_LOG}, r AS (SELECT st.e, started, coalesce(epoch_us(ended) <= epoch_us(started) + {_LIMIT} * CAST(1000000 AS BIGINT), false) AS ok, ended, k, value FROM st LEFT JOIN en USING (e)),
q AS (SELECT e, started, ok, CASE WHEN ok THEN ended ELSE started + INTERVAL {_LIMIT} SECOND END AS ended, CASE WHEN ok THEN CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END END AS code, CASE WHEN ok AND k % 7 <> 0 THEN value END AS metric, k FROM r)
SELECT CAST(e AS VARCHAR) AS experiment, CASE WHEN NOT ok OR code <> 0 OR metric IS NULL THEN 'failed' WHEN k % 3 = 0 THEN 'discard' ELSE 'keep' END AS status, code AS return_code, metric, round((epoch_us(ended) - epoch_us(started)) / 1e6, 6) AS duration_seconds,
  CASE WHEN NOT ok THEN 'command timed out after {_LIMIT} seconds' WHEN code <> 0 THEN 'command exited with code 1' WHEN metric IS NULL THEN 'metric extraction failed' END AS error FROM q""")
def execution_records(read):
    return rounded(execution.execution_records(_log(read)).drop("started_at", "ended_at"))


@query("""SELECT event_id, sha256('{"event":{"id":' || event_id || ',"type":"' || event_type || '"},"tags":{' || CASE WHEN event_type < 'user' THEN '"' || event_type || '":1,"user":' || user_id ELSE '"user":' || user_id || ',"' || event_type || '":1' END || '},"value":' || CAST(value AS VARCHAR) || ',"values":[' || CAST(value AS VARCHAR) || ',null,' || user_id || '.0]}') AS digest FROM events""")
def canonical_json(read):
    """Rows whose columns and keys come in another order than the canonical one."""
    e = read("events")
    row = e.select(
        "event_id", F.array(F.col("value"), F.lit(None), F.col("user_id").cast("double")).alias("values"), "value",
        F.map_from_arrays(F.array(F.lit("user"), F.col("event_type")), F.array(F.col("user_id"), F.lit(1))).alias("tags"), F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")).alias("event"),
    )
    return row.select("event_id", F.sha2(canonical_row(row.drop("event_id")), 256).alias("digest"))


@query("""WITH k AS (SELECT doc_id AS id, 1 AS d, 0 AS l, 0 AS v FROM documents UNION ALL SELECT doc_id, 0, 1, 0 FROM labels UNION ALL SELECT vec_id, 0, 0, 1 FROM embeddings), g AS (SELECT id, max(d) AS d, max(l) AS l, max(v) AS v FROM k GROUP BY id)
SELECT id, concat_ws(',', CASE WHEN d = 0 THEN 'documents' END, CASE WHEN l = 0 THEN 'labels' END, CASE WHEN v = 0 THEN 'embeddings' END) AS missing FROM g WHERE d + l + v < 3""")
def segment_gaps(read):
    sides = {"documents": read("documents").select(F.col("doc_id").alias("id")), "labels": read("labels").select(F.col("doc_id").alias("id")), "embeddings": read("embeddings").select(F.col("vec_id").alias("id"))}
    return segments.gaps(sides, "id").select("id", F.array_join("missing", ",").alias("missing"))


@query("SELECT d.doc_id, source, quality, toxic, CAST(len(embedding) AS INT) AS dims FROM documents d JOIN labels l USING (doc_id) JOIN embeddings ON vec_id = d.doc_id")
def segment_join(read):
    """Documents with their labels and vectors: the whole join, of those that both sides have."""
    docs, labels = read("documents").select("doc_id", "source"), read("labels")
    vectors = read("embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dims"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi").join(vectors.select("doc_id"), "doc_id", "left_semi")
    return segments.whole_join(some, {"label": labels, "vector": vectors}, "doc_id").select("doc_id", "source", "label.quality", "label.toxic", "vector.dims")


_HEADED = "CASE WHEN {c}page_id % 3 = 1 THEN 'Capítulo ' || CASE WHEN {c}page_id % 2 = 0 THEN 'IV' ELSE CAST({c}page_id AS VARCHAR) END || chr(10) ELSE '' END"


@query(rf"""WITH p AS (SELECT page_id // 10 AS book, page_id, {_HEADED.format(c='')} || url || chr(10) || length(html) || ' Parte nueva' AS t FROM pages),
m AS (SELECT *, CASE WHEN page_id % 3 = 1 THEN 1 ELSE 0 END AS here, sum(CASE WHEN page_id % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page_id) AS seg, sum(CASE WHEN page_id % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book) AS total FROM p),
s AS (SELECT book, CASE WHEN total < 2 THEN 1 ELSE seg END AS seg, total, string_agg(t, chr(10) || chr(10) ORDER BY page_id) AS text, min(page_id) AS first FROM m WHERE total < 2 OR seg > 0 GROUP BY 1, 2, 3)
SELECT book, CAST(CASE WHEN total >= 2 AND first % 2 = 1 THEN first ELSE seg END AS BIGINT) AS number, md5(text) AS digest, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words FROM s""")
def chapters_of_pages(read):
    """Ten pages make a book; every third begins with a heading, in Arabic or Roman numbers."""
    p = read("pages")
    number = F.when(F.col("page_id") % 2 == 0, "IV").otherwise(F.col("page_id").cast("string"))
    head = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("Capítulo "), number, F.lit("\n"))).otherwise("")
    text = F.concat(head, "url", F.lit("\n"), F.length("html").cast("string"), F.lit(" Parte nueva"))
    cut = segments.split_pages(p.select(F.floor(F.col("page_id") / 10).alias("book"), "page_id", text.alias("text")), "book", "page_id", "text")
    return cut.select("book", "number", F.md5("text").alias("digest"), "n_words")

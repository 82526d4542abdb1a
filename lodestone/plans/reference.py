"""Queries of content identity, encoding, reuse and comparison, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import identity as I
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import compare, counters, reuse, timeline
from lodestone.plans.encode_table import encode_contents, encode_rows
from lodestone.session import materialize, table
from lodestone.streaming.ingest import event_counts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", I.content_id(I.as_bytes(F.col("text"))).alias("content_id"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_id FROM documents")
def q01_content_id(spark, d):
    return _ids(spark, d)


@query("SELECT 'sha256:' || sha256(text) AS content_id, count(*) AS copies, min(doc_id) AS representative FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q02_duplicate_classes(spark, d):
    return reuse.duplicate_classes(_ids(spark, d), "content_id", "doc_id")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'encoded' ELSE 'reused' END AS role FROM documents")
def q03_encode_once(spark, d):
    return reuse.encode_once(_ids(spark, d), "content_id", [F.col("doc_id")]).select("doc_id", "role")


_OUTCOME = r"""
WITH n AS (SELECT doc_id, text, nfc_normalize(replace(replace(regexp_replace(text, '^\x{FEFF}', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS t FROM documents),
o AS (SELECT doc_id, text, t, CASE WHEN text IS NULL THEN 'failed' WHEN contains(t, chr(0)) THEN 'failed'
  WHEN regexp_full_match(t, '[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*') THEN 'failed' ELSE 'ready' END AS state,
  CASE WHEN text IS NULL THEN 'io_error' WHEN contains(t, chr(0)) THEN 'invalid_text'
  WHEN regexp_full_match(t, '[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*') THEN 'insufficient_content' END AS error FROM n)
"""


@query(_OUTCOME + "SELECT doc_id, state, error, CASE WHEN state = 'ready' THEN length(t) ELSE 0 END AS characters, state = 'ready' AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS reused FROM o")
def q03_encode_documents(spark, d):
    """Every document through the text encoder, each distinct content once."""
    return encode_rows(_docs(spark, d), "doc_id", "text", with_vector=False).select("doc_id", "state", "error", F.coalesce("characters", F.lit(0)).alias("characters"), "reused")


_SAVED = "(SELECT file_id, profile_id, min(vector_sha256) AS vector_sha256 FROM file_record WHERE batch_no = 0 AND state = 'ready' GROUP BY ALL)"


@query(f"SELECT c.record_id, s.vector_sha256, s.file_id IS NOT NULL AS reused FROM file_record c LEFT JOIN {_SAVED} s USING (file_id, profile_id) WHERE c.batch_no > 0")
def q04_reuse_join(spark, d):
    """Later batches against what the first load saved."""
    r = table(spark, d, "file_record").select("record_id", "batch_no", "file_id", "profile_id", "state", "vector_sha256")
    return reuse.reuse_join(r.where("batch_no > 0").select("record_id", "file_id", "profile_id"), r.where("batch_no = 0 AND state = 'ready'"), ["file_id", "profile_id"], ["vector_sha256"]).select("record_id", "vector_sha256", "reused")


@query(f"SELECT c.record_id FROM file_record c ANTI JOIN {_SAVED} s USING (file_id, profile_id) WHERE c.batch_no > 0")
def q04_encode_set(spark, d):
    r = table(spark, d, "file_record").select("record_id", "batch_no", "file_id", "profile_id", "state")
    return reuse.encode_set(r.where("batch_no > 0"), r.where("batch_no = 0 AND state = 'ready'"), ["file_id", "profile_id"]).select("record_id")


def _listings(spark, d) -> tuple[DataFrame, DataFrame]:
    """Rows before and after, of every pair of consecutive snapshots, under the later one's number."""
    rows = materialize(table(spark, d, "snapshot_record").groupBy("snapshot_no", F.concat_ws("/", "root", "path").alias("place")).agg(F.max("file_id").alias("file_id")))
    # One row per snapshot.
    steps = rows.where("snapshot_no IS NOT NULL").select("snapshot_no").distinct().withColumn("next_no", F.lead("snapshot_no").over(Window.orderBy("snapshot_no"))).where("next_no IS NOT NULL")
    before = rows.join(steps, "snapshot_no").select(F.col("next_no").alias("snapshot_no"), "place", "file_id")
    return before, rows.join(steps.select(F.col("next_no").alias("snapshot_no")), "snapshot_no")


_LISTS = """
WITH l AS (SELECT snapshot_no, root || '/' || path AS place, max(file_id) AS file_id FROM snapshot_record GROUP BY ALL),
s AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT snapshot_no FROM l)),
a AS (SELECT s.next_no AS snapshot_no, place, file_id FROM l JOIN s USING (snapshot_no) WHERE next_no IS NOT NULL),
b AS (SELECT l.* FROM l WHERE snapshot_no IN (SELECT next_no FROM s))
"""


@query(
    _LISTS
    + """, k AS (SELECT DISTINCT snapshot_no, file_id FROM a WHERE file_id IS NOT NULL)
SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.place, b.place) AS place, CASE WHEN a.place IS NULL AND k.file_id IS NOT NULL THEN 'moved' WHEN a.place IS NULL THEN 'added'
 WHEN b.file_id IS NULL THEN 'removed' WHEN a.file_id = b.file_id THEN 'same' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.snapshot_no = b.snapshot_no AND a.place = b.place LEFT JOIN k ON k.snapshot_no = b.snapshot_no AND k.file_id = b.file_id"""
)
def q05_run_diff(spark, d):
    """Every two consecutive snapshots by path and content: a new path with known content has moved."""
    return reuse.run_diff(*_listings(spark, d), "place", "file_id", ["snapshot_no"])


@query(_LISTS + "SELECT snapshot_no, place FROM a ANTI JOIN b USING (snapshot_no, place)")
def q05_deleted_paths(spark, d):
    """Paths of each snapshot that the next one lacks."""
    before, after = _listings(spark, d)
    return before.join(after, ["snapshot_no", "place"], "left_anti").select("snapshot_no", "place")


@query(_OUTCOME + "SELECT doc_id, sha256(t) AS digest FROM n")
def q06_normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(I.as_bytes(X.nfc(X.newlines(F.col("text")))), 256).alias("digest"))


@query(_OUTCOME + "SELECT state, error, count(*) AS documents, sum(length(t)) FILTER (state = 'ready') AS characters FROM o GROUP BY ALL")
def q07_text_outcome(spark, d):
    return encode_rows(_docs(spark, d), "doc_id", "text", with_vector=False).groupBy("state", "error").agg(F.count("*").alias("documents"), F.sum("characters").alias("characters"))


_GRAMS = (
    _OUTCOME
    + """, p AS (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM o WHERE state = 'ready'),
g AS (SELECT doc_id, k, substr(t, i, k) AS gram FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= length(t)),
c AS (SELECT doc_id, gram, k, count(*) AS n FROM g GROUP BY ALL)
"""
)


def _grams(spark, d) -> DataFrame:
    """The n-grams of every document that can be encoded, with their counts."""
    made = _docs(spark, d).where("text IS NOT NULL").select("doc_id", X.nfc(X.newlines(F.col("text"))).alias("t")).where(~F.contains("t", F.lit("\0")) & F.col("t").rlike(X.SOLID))
    points = made.select("doc_id", F.split("t", "").alias("points"))
    return points.select("doc_id", F.explode(X.grams_of(F.col("points"))).alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("n"))


@query(_GRAMS + "SELECT doc_id, k AS size, sum(n)::BIGINT AS grams, count(*) AS kinds, max(n) AS most FROM c GROUP BY ALL")
def q08_ngram_counts(spark, d):
    """N-grams of every document by their size: how many, how many different, and how often
    the most frequent comes."""
    size = F.char_length("gram").cast("long").alias("size")
    return _grams(spark, d).groupBy("doc_id", size).agg(F.sum("n").alias("grams"), F.count("*").alias("kinds"), F.max("n").alias("most"))


_FEATURES = (
    _GRAMS
    + """,
b AS (SELECT gram, k, list_prepend(k::UBIGINT, list_transform(range(0, strlen(gram)), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::UBIGINT)) AS bytes FROM (SELECT DISTINCT gram, k FROM c)),
h AS (SELECT gram, list_reduce(list_prepend(14695981039346656037::UBIGINT, bytes), lambda s, x: ((xor(s, x)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS h FROM b),
f AS (SELECT doc_id, (h.h % 4096)::INT AS bucket, sum(CASE WHEN h.h < 9223372036854775808::UBIGINT THEN n ELSE -n END)::BIGINT AS total FROM c JOIN h USING (gram) GROUP BY ALL)
"""
)


def _features(spark, d) -> DataFrame:
    counted = _grams(spark, d)
    feature = counted.select("gram").distinct().withColumn("f", X.gram_feature(F.col("gram")))
    return counted.join(feature, "gram").groupBy("doc_id", F.col("f.bucket").alias("bucket")).agg(F.sum(F.col("n") * F.col("f.sign")).alias("total"))


@query(_FEATURES + "SELECT doc_id, count(*) AS buckets, sum(abs(total))::BIGINT AS weight, sum(total * bucket)::BIGINT AS moment FROM f GROUP BY 1")
def q09_hashed_features(spark, d):
    """Hashed n-grams of every document in Catalyst, each distinct gram hashed once: buckets,
    sum of the absolute totals, and sum of the totals times their bucket."""
    f = _features(spark, d)
    return f.groupBy("doc_id").agg(F.count("*").alias("buckets"), F.sum(F.abs("total")).alias("weight"), F.sum(F.col("total") * F.col("bucket")).alias("moment"))


_VECTOR_SQL = """, u AS (SELECT *, (total / sqrt(sum(total * total) OVER (PARTITION BY {0})))::FLOAT::DOUBLE AS x FROM f WHERE total <> 0)
SELECT {0}, count(*) AS filled, arg_min(bucket, -abs(total) * 4096 + bucket)::BIGINT AS strongest, round(max(abs(x)), 5) AS strength, round(sum(x * (bucket + 1)), 2) AS moment FROM u GROUP BY 1"""


def _described(vectors: DataFrame, id_: str) -> DataFrame:
    """Components of vectors that aren't 0: how many, the strongest (of equals the first), its
    size, and their sum weighted by place."""
    at = F.transform("vector", lambda x, i: F.struct(F.abs(x).alias("size"), (-i).alias("place")))
    best = F.array_max(at)
    moment = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(
        id_, F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("filled"), (-best["place"]).cast("long").alias("strongest"),
        F.round(best["size"].cast("double"), 5).alias("strength"), F.round(moment, 2).alias("moment"),
    )


@query(_FEATURES + _VECTOR_SQL.format("doc_id"))
def q10_text_vector(spark, d):
    """Text vectors of every document from the NumPy kernel, described by their components."""
    made = _docs(spark, d).select("doc_id", X.text_vectors("text").alias("o")).where("o.state = 'ready'")
    return _described(made.select("doc_id", "o.vector"), "doc_id")


_NORM = "list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))"


@query(f"SELECT r.record_id, coalesce(len(vector) = p.dimensions AND NOT isnan({_NORM}) AND abs({_NORM} - 1) <= 1e-5, false) AS valid FROM file_record r LEFT JOIN encoding_profile p USING (profile_id)")
def q11_vector_validate(spark, d):
    rows = compare.compatible(table(spark, d, "file_record").select("record_id", "profile_id", "vector"), table(spark, d, "encoding_profile"))
    return rows.select("record_id", V.is_valid(F.col("vector"), F.col("dimensions")).alias("valid"))


_PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


def _space(spark, d) -> DataFrame:
    """The embeddings as what they are, one space, whatever their labels."""
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.lit("all").alias("space"))


@query(f"SELECT * FROM ({_PAIRS}) WHERE similarity >= 0.3")
def q12_cosine_pairs(spark, d):
    pairs = compare.cosine_pairs(_space(spark, d), "vec_id", "embedding", "space", 0.3 - 5e-7)
    return pairs.withColumn("similarity", F.round("similarity", 6)).where("similarity >= 0.3")


@query(
    f"""WITH p AS ({_PAIRS}), s AS (SELECT a AS id, b AS neighbour_id, similarity FROM p UNION ALL SELECT b, a, similarity FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour_id) AS rank FROM s) WHERE rank <= 5"""
)
def q13_top_k_neighbours(spark, d):
    return compare.nearest(_space(spark, d), "vec_id", "embedding", "space", 5)


@query(
    _FEATURES
    + """, u AS (SELECT doc_id, bucket, (total / sqrt(sum(total * total) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS v FROM f WHERE total <> 0),
l AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM u GROUP BY 1)
SELECT a, b, round(s / (x.norm * y.norm), 5) AS similarity FROM (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.v * b.v) AS s FROM u a JOIN u b ON a.bucket = b.bucket AND a.doc_id < b.doc_id GROUP BY ALL)
JOIN l x ON x.doc_id = a JOIN l y ON y.doc_id = b WHERE round(s / (x.norm * y.norm), 5) >= 0.9"""
)
def q14_near_duplicate_text(spark, d):
    """Documents whose vectors are alike, by exact comparison of all blocks (the indexed way
    for large tables is near_pairs)."""
    rows = X.outcomes(_docs(spark, d), "doc_id", "text").select("doc_id", F.lit("text").alias("profile"), "vector")
    pairs = compare.cosine_pairs(rows, "doc_id", "vector", "profile", 0.9 - 6e-6)
    # Not round(), which makes a decimal of each of the many pairs.
    return pairs.withColumn("similarity", F.floor(F.col("similarity") * 100_000 + 0.5) / 100_000).where("similarity >= 0.9")


@query(
    """WITH m AS (SELECT label, i - 1 AS dim, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT label, dim, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 6) AS value FROM m"""
)
def q15_mean_pool(spark, d):
    return compare.mean_pool(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


@query(
    """SELECT count(*) AS files_processed, count(*) FILTER (state = 'ready') AS files_ready, count(*) FILTER (state NOT IN ('ready', 'skipped')) AS files_failed, count(*) FILTER (state = 'skipped') AS files_skipped,
 count(*) FILTER (state = 'ready' AND NOT reused) AS vectors_encoded, count(*) FILTER (reused) AS cache_hits, coalesce(sum(bytes), 0)::BIGINT AS bytes_hashed FROM file_record"""
)
def q16_run_counters(spark, d):
    return counters.run_counters(table(spark, d, "file_record"))


#: Headers that break one rule each, beside those of the table: name of the rule and its values.
BROKEN = {
    "fine": {}, "processed": {"files_failed": 3}, "encoded": {"vectors_encoded": 2}, "discovered": {"files_discovered": 1, "files_total": 1}, "total": {"files_total": 9, "complete": False},
    "complete": {"files_total": None}, "cancelled": {"cancelled": True}, "bytes": {"bytes_read": 0}, "workers": {"workers": 65}, "elapsed": {"elapsed_seconds": -1.0},
}
_HEADER = {"complete": True, "cancelled": False, "files_discovered": 4, "files_processed": 4, "files_total": 4, "files_ready": 3, "files_failed": 1, "files_skipped": 0, "vectors_encoded": 3, "cache_hits": 0, "bytes_read": 10, "bytes_hashed": 10, "elapsed_seconds": 1.0, "workers": 2}


def _header_sql() -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x)

    rows = ", ".join("(" + ", ".join([f"'{n}'", "0", *map(one, (_HEADER | v).values())]) + ")" for n, v in BROKEN.items())
    return f"SELECT * FROM (VALUES {rows}) v(root, snapshot_no, {', '.join(_HEADER)})"


@query(
    f"""WITH h AS (SELECT root, snapshot_no, {', '.join(_HEADER)} FROM vector_file UNION ALL BY NAME {_header_sql()})
SELECT root, snapshot_no::INT AS snapshot_no, concat_ws(',', CASE WHEN files_processed <> files_ready + files_failed + files_skipped THEN 'processed' END, CASE WHEN vectors_encoded <> files_ready - cache_hits THEN 'encoded' END,
 CASE WHEN files_discovered < files_processed THEN 'discovered' END, CASE WHEN files_total <> files_discovered THEN 'total' END, CASE WHEN complete AND coalesce(files_total, -1) <> files_processed THEN 'complete' END,
 CASE WHEN cancelled AND complete THEN 'cancelled' END, CASE WHEN bytes_read < bytes_hashed THEN 'bytes' END, CASE WHEN workers NOT BETWEEN 1 AND 64 THEN 'workers' END, CASE WHEN elapsed_seconds < 0 THEN 'elapsed' END) AS broken
 FROM h"""
)
def q16_recount(spark, d):
    """Every header, and some that are wrong on purpose, with the rules that it breaks."""
    columns = ["root", "snapshot_no", *_HEADER]
    known = table(spark, d, "vector_file").select(*columns)
    stated = spark.createDataFrame([(n, 0, *(_HEADER | v).values()) for n, v in BROKEN.items()], known.schema)
    return counters.recount(known.unionByName(stated), all_rows=True).select("root", "snapshot_no", "broken")


@query("SELECT root, snapshot_no, (CASE WHEN cancelled THEN 130 WHEN NOT complete OR files_failed > 0 OR files_skipped > 0 THEN 3 ELSE 0 END)::INT AS exit_code FROM vector_file")
def q16_exit_codes(spark, d):
    c = F.col
    return table(spark, d, "vector_file").select("root", "snapshot_no", counters.exit_code(c("cancelled"), c("complete"), c("files_failed"), c("files_skipped")).alias("exit_code"))


@query("SELECT file_id, profile_id, count(DISTINCT vector_sha256) AS values FROM file_record WHERE state = 'ready' GROUP BY ALL HAVING count(DISTINCT vector_sha256) > 1")
def q17_conflict_check(spark, d):
    return reuse.conflicts(table(spark, d, "file_record").where("state = 'ready'"), ["file_id", "profile_id"], "vector_sha256")


@query("SELECT root, snapshot_no, path, count(*) AS count FROM snapshot_record GROUP BY ALL HAVING count(*) > 1")
def q17_repeated_paths(spark, d):
    """Paths that a listing holds more than once: repeated and superseded deliveries."""
    return reuse.repeated(table(spark, d, "snapshot_record"), ["root", "snapshot_no", "path"])


def _invariants() -> dict:
    c = F.col
    ready = c("state") == "ready"
    whole = c("file_id").isNotNull() & c("profile_id").isNotNull() & c("bytes").isNotNull() & c("vector").isNotNull() & c("vector_sha256").isNotNull() & c("error").isNull()
    bare = c("vector").isNull() & c("vector_sha256").isNull() & ~c("reused") & c("error").isNotNull()
    return {"ready": ~ready | whole, "not_ready": ready | bare, "file_id": c("file_id").isNull() | c("file_id").rlike("^sha256:[0-9a-f]{64}$")}


#: Records that break a rule on purpose: state, file_id, profile_id, bytes, has a vector, has a
#: digest, reused, has an error.
BAD_RECORDS = {
    -1: ("ready", "sha256:" + "a" * 64, "p", 1, True, True, False, False), -2: ("ready", None, "p", 1, True, True, False, False), -3: ("ready", "sha256:" + "a" * 64, "p", 1, False, True, True, False),
    -4: ("ready", "sha256:" + "a" * 64, "p", 1, True, True, False, True), -5: ("failed", "sha256:" + "a" * 64, None, 1, False, False, False, False), -6: ("failed", None, None, None, True, True, False, True),
    -7: ("failed", None, None, None, False, False, True, True), -8: ("skipped", None, None, None, False, False, False, True), -9: ("failed", "sha256:" + "A" * 64, None, 1, False, False, False, True),
}
_STATED = ", ".join("(" + ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'" for x in (i, *r)) + ")" for i, r in BAD_RECORDS.items())


@query(
    f"""WITH r AS (SELECT record_id, state, file_id, profile_id, bytes, vector IS NOT NULL AS has_vector, vector_sha256 IS NOT NULL AS has_digest, reused, error IS NOT NULL AS has_error FROM file_record UNION ALL SELECT * FROM (VALUES {_STATED}))
SELECT record_id::BIGINT AS record_id, concat_ws(',', CASE WHEN state = 'ready' AND (file_id IS NULL OR profile_id IS NULL OR bytes IS NULL OR NOT has_vector OR NOT has_digest OR has_error) THEN 'ready' END,
 CASE WHEN state <> 'ready' AND (has_vector OR has_digest OR reused OR NOT has_error) THEN 'not_ready' END,
 CASE WHEN NOT regexp_full_match(file_id, 'sha256:[0-9a-f]{{64}}') THEN 'file_id' END) AS broken FROM r"""
)
def q17_record_invariants(spark, d):
    """Every record, and some that are wrong on purpose, with the rules of its state that it breaks."""
    c = F.col
    columns = ["record_id", "state", "file_id", "profile_id", "bytes", "has_vector", "has_digest", "reused", "has_error"]
    rows = table(spark, d, "file_record").withColumns({"has_vector": c("vector").isNotNull(), "has_digest": c("vector_sha256").isNotNull(), "has_error": c("error").isNotNull()}).select(*columns)
    rows = rows.unionByName(spark.createDataFrame([(i, *r) for i, r in BAD_RECORDS.items()], rows.schema))
    return rows.select("record_id", counters.broken_record_rules().alias("broken"))


#: Fixed values, written down again for the check alone: a first byte string and what it means.
_STARTS = (
    (rb"%PDF-", "text/pdf"), (rb"PK\x03\x04", "text/docx"), (rb"\x1F\x8B", "unknown/archive"), (rb"7z\xBC\xAF", "unknown/archive"), (rb"Rar!", "unknown/archive"), (rb"\xFF\xD8\xFF", "image/raster"),
    (rb"\x89PNG\x0D\x0A\x1A\x0A", "image/raster"), (rb"GIF8", "image/raster"), (rb"II*\x00", "image/raster"), (rb"MM\x00*", "image/raster"), (rb"II+\x00", "image/raster"), (rb"MM\x00+", "image/raster"), (rb"BM", "image/raster"),
    (rb"\x00\x00\x01\x00", "image/raster"), (rb"qoif", "image/raster"), (rb"DDS ", "image/raster"), (rb"v/1\x01", "image/raster"), (rb"#?RADIANCE", "image/raster"), (rb"#?RGBE", "image/raster"), (rb"farbfeld", "image/raster"),
    *[(rb"P%d" % i, "image/raster") for i in range(1, 8)],
)
_SOUNDS = (rb"ID3", rb"fLaC", rb"caff", rb"MAC ", rb"wvpk", rb"#!AMR", rb".snd", rb"MPCK", rb"FORM", rb"RF64")
_FILMS = (rb"\x1AE\xDF\xA3", rb"FLV", rb".RMF", rb"0&\xB2u\x8Ef\xCF\x11", rb"\x00\x00\x01\xBA")
_ENDINGS = {
    "image/tga": "tga", "image/heif_avif": "heic heif hif avif avifs", "video/media": "mts m2ts mpeg mpg mkv webm mov mp4 avi wmv asf flv m4v 3gp 3g2 mxf vob ogv rm rmvb m2v",
    "audio/media": "m4a mka mp3 aac wav flac aiff opus ogg oga mp2 wma ape wv caf au amr ac3 eac3 dts aif m4b ra",
}


def _sniff_sql(b: str, name: str) -> str:
    """The kind of a blob `b` of at most 512 bytes, by comparing bytes."""
    blob = lambda v: "'" + v.decode().replace("'", "''") + "'::BLOB"
    at = lambda i, n: f"array_slice({b}, {i + 1}, {i + n})"
    size = lambda v: len(v.decode().encode("latin-1").decode("unicode_escape"))
    starts = lambda v: f"{at(0, size(v))} = {blob(v)}"
    any_ = lambda vs: "(" + " OR ".join(map(starts, vs)) + ")"
    ending = f"lower(regexp_extract(coalesce({name}, ''), '(?:^|/)[^/]+\\.([^./]*)$', 1))"
    brands = "('avif'::BLOB, 'avis'::BLOB, 'heic'::BLOB, 'heix'::BLOB, 'hevc'::BLOB, 'hevx'::BLOB, 'mif1'::BLOB, 'msf1'::BLOB)"
    box = f"least(('0x' || hex({at(0, 4)}))::BIGINT, octet_length({b}))"
    listed = f"len(list_filter(range(16, {box} - 3, 4), lambda i: array_slice({b}, i + 1, i + 4) IN {brands})) > 0"
    riff = starts(rb"RIFF")
    rules = [
        *[(starts(v), kind) for v, kind in _STARTS],
        (f"{riff} AND {at(8, 4)} = 'WEBP'::BLOB", "image/raster"), (f"{riff} AND {at(8, 4)} = 'WAVE'::BLOB", "audio/media"), (f"{riff} AND {at(8, 4)} = 'AVI '::BLOB", "video/media"), (riff, "unknown/riff"),
        (any_(_SOUNDS) + f" OR ({at(0, 1)} = '\\xFF'::BLOB AND {at(1, 1)} >= '\\xE0'::BLOB)", "audio/media"),
        (f"{starts(rb'OggS')} AND contains(hex({b}), '7468656F7261')", "video/media"), (starts(rb"OggS"), "audio/media"),
        (f"{at(4, 4)} = 'ftyp'::BLOB AND ({at(8, 4)} IN {brands} OR {listed})", "image/heif_avif"), (f"{at(4, 4)} = 'ftyp'::BLOB AND {at(8, 4)} IN ('M4A '::BLOB, 'M4B '::BLOB, 'M4P '::BLOB)", "audio/media"),
        (f"{at(4, 4)} = 'ftyp'::BLOB", "video/media"), (any_(_FILMS) + f" OR {at(4, 4)} = 'moov'::BLOB OR ({at(0, 1)} = 'G'::BLOB AND {at(188, 1)} = 'G'::BLOB AND {at(376, 1)} = 'G'::BLOB)", "video/media"),
        *[(f"{ending} IN {tuple(v.split()) if ' ' in v else '(' + repr(v) + ')'}", kind) for kind, v in _ENDINGS.items()],
    ]
    return "CASE " + " ".join(f"WHEN {rule} THEN '{kind}'" for rule, kind in rules) + " ELSE 'text/utf8' END"


#: Leading bytes of formats that the tables don't hold.
MAGIC = {
    "a.pdf": "255044462D312E37", "a.zip": "504B030414", "a.gz": "1F8B08", "a.7z": "377ABCAF271C", "a.rar": "526172211A07", "a.jpg": "FFD8FFE0", "named.heic": "89504E470D0A1A0A", "prose.txt": "424D2069732061",
    "a.webp": "524946460000000057454250", "a.wav": "524946460000000057415645", "a.avi": "524946460000000041564920", "a.riff": "5249464600000000414E494D", "a.mp3": "FFFB9000", "b.mp3": "494433", "a.ogv": "4F6767530000807468656F7261", "a.oga": "4F67675300028001766F72626973",
    "a.mp4": "00000018667479706D703432000000006D703432", "a.heic": "00000018667479706D736631000000006D696631", "b.avif": "0000001C667479706D703432000000006D70343261766966", "a.m4a": "00000014667479704D344120", "a.mkv": "1A45DFA3", "a.flv": "464C5601", "code.ts": "636F6E7374", "a.tga": "0000", "empty": "", "a.mov": "000000086D6F6F76",
}


@query(
    f"WITH r AS (SELECT 'doc ' || doc_id AS name, array_slice(encode(text), 1, 512) AS b FROM documents WHERE text IS NOT NULL UNION ALL SELECT path, ''::BLOB FROM file_record WHERE path IS NOT NULL UNION ALL SELECT n, unhex(h) FROM (VALUES {', '.join(f"('{n}', '{h}')" for n, h in MAGIC.items())}) v(n, h)) "
    f"SELECT name, {_sniff_sql('b', 'name')} AS kind FROM r"
)
def q18_sniff(spark, d):
    """Family and format of texts by their bytes, of files by their names, and of magic bytes."""
    docs = _docs(spark, d).where("text IS NOT NULL").select(F.concat(F.lit("doc "), "doc_id").alias("name"), I.as_bytes(F.col("text")).alias("content"))
    files = table(spark, d, "file_record").where("path IS NOT NULL").select(F.col("path").alias("name"), F.lit(b"").alias("content"))
    magic = spark.createDataFrame([(n, bytearray.fromhex(h)) for n, h in MAGIC.items()], "name string, content binary")
    kind = I.sniff(F.col("content"), F.col("name"))
    return docs.union(files).union(magic).select("name", F.concat_ws("/", kind["family"], kind["format"]).alias("kind"))


@query("SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY string_split(path, '/')) AS place FROM (SELECT DISTINCT root, path FROM file_record WHERE path IS NOT NULL)")
def q19_path_order(spark, d):
    """Places of the paths of each root in component-wise order."""
    paths = table(spark, d, "file_record").where("path IS NOT NULL").select("root", "path").distinct()
    from pyspark.sql import Window

    return paths.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(I.path_order(F.col("path")))).cast("long"))


@query("SELECT record_id, CASE WHEN path IS NOT NULL THEN to_json(path)::VARCHAR ELSE '{\"encoding\":\"posix_bytes\",\"base64\":\"' || to_base64(path_bytes) || '\"}' END AS path_json FROM file_record WHERE path IS NOT NULL OR path_bytes IS NOT NULL")
def q19_path_codec(spark, d):
    """Paths as JSON: text, or base64 of bytes that are not UTF-8."""
    rows = table(spark, d, "file_record").where("path IS NOT NULL OR path_bytes IS NOT NULL")
    return rows.select("record_id", I.path_json(F.coalesce(I.as_bytes(F.col("path")), F.col("path_bytes"))).alias("path_json"))


_EVENTS = "(SELECT user_id, event_id, epoch_us(ts) AS us FROM events)"
_MIDPOINTS = f"""
WITH s AS (SELECT user_id, min(us) AS low, max(us) AS high FROM {_EVENTS} GROUP BY 1),
t AS (SELECT user_id, n::BIGINT AS n, low + floor((high - low) * (2 * n + 1) / 64)::BIGINT AS target FROM s, (SELECT unnest(range(0, 32)) AS n)),
j AS (SELECT t.user_id, t.n, t.target, e.event_id AS id, e.us, row_number() OVER (PARTITION BY t.user_id, t.n ORDER BY e.us, e.event_id) AS nth FROM t JOIN {_EVENTS} e ON e.user_id = t.user_id AND e.us >= t.target)
"""


def _midpoints(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timeline.first_at_or_after(rows, timeline.midpoint_targets(rows, "user_id", "at"), "user_id", "at", "event_id")


@query(_MIDPOINTS + "SELECT user_id, n, target, id, us FROM j WHERE nth = 1")
def q20_midpoint_sampling(spark, d):
    return _midpoints(spark, d).withColumnRenamed("at", "us")


@query(_MIDPOINTS + "SELECT user_id, id, us, min(n) AS n FROM j WHERE nth = 1 GROUP BY ALL")
def q20_distinct_frames(spark, d):
    return timeline.distinct_frames(_midpoints(spark, d), "user_id").withColumnRenamed("at", "us")


@query(
    f"""WITH s AS (SELECT user_id, (max(us) - min(us))::BIGINT AS span FROM {_EVENTS} GROUP BY 1), n AS (SELECT *, greatest(1, least(32, ceil(span / 3600000000.0)))::INT AS n FROM s),
w AS (SELECT user_id, span, n, unnest(range(0, n)) AS i FROM n)
SELECT user_id, i::BIGINT AS i, floor(greatest(0.0, (i + 0.5) * (span / n) - least(3600000000.0, span / n) / 2))::BIGINT AS start, floor(least(3600000000.0, span / n))::BIGINT AS length FROM w"""
)
def q21_centred_windows(spark, d):
    """Up to 32 windows of an hour, centred in equal parts of each user's time."""
    span = table(spark, d, "events").groupBy("user_id").agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("span"))
    return span.select("user_id", F.posexplode(timeline.centred_windows(F.col("span"), 3600.0)).alias("i", "w")).select("user_id", F.col("i").cast("long"), "w.start", "w.length")


@query(
    """SELECT origin, state, family, count(*) AS records FROM (SELECT 'record' AS origin, state, family FROM file_record UNION ALL BY NAME SELECT 'listing' AS origin, state, family FROM snapshot_record) GROUP BY ALL"""
)
def q22_union_records(spark, d):
    columns = ["root", "path", "file_id", "state", "family", "profile_id", "reused"]
    both = table(spark, d, "file_record").select(*columns, F.lit("record").alias("origin")).unionByName(table(spark, d, "snapshot_record").select(*columns, F.lit("listing").alias("origin")))
    return both.groupBy("origin", "state", "family").agg(F.count("*").alias("records"))


@query("SELECT r.record_id, p.name, p.family = r.family AS fits FROM file_record r JOIN encoding_profile p USING (profile_id)")
def q23_profile_lookup(spark, d):
    profiles = table(spark, d, "encoding_profile").select("profile_id", "name", F.col("family").alias("_family"))
    return table(spark, d, "file_record").select("record_id", "profile_id", "family").join(profiles, "profile_id").select("record_id", "name", (F.col("_family") == F.col("family")).alias("fits"))


@query("SELECT vec_id, i - 1 AS dim, round((embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))::FLOAT::DOUBLE, 5) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def q24_l2_normalize(spark, d):
    unit = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("dim", "x"))
    return unit.select("vec_id", F.col("dim").cast("long"), F.round(F.col("x").cast("double"), 5).alias("value"))


@query()
def q25_vector_sha256(spark, d):
    """Digests of vectors over their little-endian float32 bytes, against the stored ones."""
    rows = table(spark, d, "file_record").where("vector IS NOT NULL").select("record_id", "vector_sha256", V.vector_sha256("vector").alias("computed"))
    return rows.select("record_id", F.coalesce(F.col("computed") == F.col("vector_sha256"), F.lit(False)).alias("agrees"))


@query("SELECT user_id, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE value IS NOT NULL) WHERE rank <= 5")
def q26_peaks(spark, d):
    """The five strongest events of each user, ties to the smaller id."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").where("value IS NOT NULL").withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5").select("user_id", "event_id", "value", "rank")


@query("SELECT file_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY received_at, record_id) AS nth FROM file_record WHERE file_id IS NOT NULL) WHERE nth = 1")
def q27_first_seen(spark, d):
    """The first delivery of each content."""
    rows = table(spark, d, "file_record").where("file_id IS NOT NULL").select("file_id", "received_at", "record_id")
    return rows.groupBy("file_id").agg(F.min(F.struct("received_at", "record_id")).alias("f")).select("file_id", "f.record_id")


@query("SELECT r.record_id, c.copies, c.first_record FROM file_record r JOIN (SELECT file_id, count(*) AS copies, min(record_id) AS first_record FROM file_record GROUP BY 1) c USING (file_id)")
def q28_exact_copies(spark, d):
    """How many records share each record's content, whatever their path and state."""
    from lodestone.operators.skew import salted_join

    rows = table(spark, d, "file_record").select("record_id", "file_id")
    return salted_join(rows, rows.groupBy("file_id").agg(F.count("*").alias("copies"), F.min("record_id").alias("first_record")), "file_id").select("record_id", "copies", "first_record")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q29_stream_windows(spark, d):
    """Tumbling counts from a stream of the table, run to its end."""
    source = table(spark, d, "events")
    name = "lodestone_" + uuid.uuid4().hex
    # A stream reads folders: the pattern keeps to the one table.
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").load(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    run = event_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast(source.schema["ts"].dataType).alias("start"), "event_type", "n")


@query(
    _FEATURES.replace("SELECT doc_id, text, nfc_normalize", "SELECT 'sha256:' || sha256(text) AS doc_id, any_value(text) AS text, any_value(nfc_normalize").replace("chr(13), chr(10))) AS t FROM documents)", "chr(13), chr(10)))) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1)")
    + _VECTOR_SQL.format("doc_id").replace("SELECT doc_id, count", "SELECT doc_id AS content_id, count")
)
def q30_text_vectors(spark, d):
    """Vectors of every distinct document, described by their components."""
    made = encode_contents(_docs(spark, d), "text").where("state = 'ready'")
    return _described(made.select("content_id", "vector"), "content_id")

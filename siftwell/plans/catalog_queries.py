"""Named queries over the test tables, each with its SQL counterpart where SQL can say it.

``documents`` stands for a file collection (its id is the file id, a path is made of source, language
and id), ``embeddings`` for a vector index, ``pages`` for files that need extraction and ``benchmark``
for a set of search texts. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.catalog import new_paths, numbered_projects, with_paths
from siftwell.functions.embedding import HashedTerms, embedded
from siftwell.functions.patterns import ignored_column, keyword_like, names_match, parse_rules, path_like
from siftwell.functions.text import html_text, is_blank, is_blank_chunk, project_name, tokens
from siftwell.operators.chunking import chunked, labelled, next_label, window_starts
from siftwell.operators.outputs import counts, json_lines, paths, show_lines
from siftwell.operators.searching import chunk_details, lookup
from siftwell.operators.vectors import distance, nearest, nearest_by_lsh, nearest_of_many, similarity
from siftwell.plans.engine import Engine
from siftwell.plans.sync import classified, removed_labels, totals
from siftwell.session import share_code
from siftwell.sources.files import documents_as_files
from siftwell.sources.snapshots import first_of_each, index_counts, upserted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Search texts and filters of the named queries.
TEXT = "the and of is that with for was"
K = 20
MIN_SCORE = 0.55
PATHS = ["/corpus/src1*", "*/en/*"]
KEYWORD = "ING TH"
RULES = "# generated\n/src1/\n  *_1?.txt\n!doc_19.txt\nde/doc_2*\n**/es/doc_[0-4]*.txt\n"

FILES = "files AS (SELECT doc_id AS file_id, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_path, text, source, lang FROM documents)"
CHUNKS = (
    FILES
    + r""", toks AS (SELECT file_id, file_path, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS t FROM files),
cut AS (SELECT file_id, file_path, CAST(st // 108 AS INTEGER) AS chunk_no, t[st+1:st+128] AS w FROM (SELECT *, unnest(range(0, len(t), 108)) AS st FROM toks)),
chunks AS (SELECT row_number() OVER (ORDER BY file_path, chunk_no) - 1 AS label, file_id, file_path, chunk_no, array_to_string(w, ' ') AS chunk_text, CAST(len(w) AS INTEGER) AS token_count FROM cut)"""
)


def buckets(name: str, source: str, key: str, text: str) -> str:
    """CTE of term counts by hash bucket."""
    return (
        f"{name}_w AS (SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM {source}), "
        f"{name} AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS b, count(*) AS n FROM {name}_w GROUP BY ALL)"
    )


def offsets(files: str) -> str:
    """CTE ``tok`` of the tokens of ``files`` with their places."""
    return rf""", piece AS (SELECT file_id, unnest(regexp_extract_all(text, '[ \t\n\r\f]+|[^ \t\n\r\f]+')) AS p, unnest(range(0, len(regexp_extract_all(text, '[ \t\n\r\f]+|[^ \t\n\r\f]+')))) AS i FROM {files}),
placed AS (SELECT file_id, p, i, sum(length(p)) OVER (PARTITION BY file_id ORDER BY i) AS e FROM piece),
tok AS (SELECT file_id, p AS token, CAST(row_number() OVER (PARTITION BY file_id ORDER BY i) - 1 AS INTEGER) AS pos, CAST(e - length(p) AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM placed WHERE regexp_matches(p, '[^ \t\n\r\f]'))"""


OFFSETS = offsets("files")

SCORED = (
    "WITH "
    + CHUNKS
    + ", "
    + buckets("cb", "chunks", "label", "chunk_text")
    + f", q AS (SELECT '{TEXT}' AS text), "
    + buckets("qb", "q", "1 AS one", "text")
    + """, norms AS (SELECT label, sqrt(sum(n * n)) AS nx FROM cb GROUP BY label), dots AS (SELECT label, sum(cb.n * qb.n) AS d FROM cb JOIN qb USING (b) GROUP BY label),
scored AS (SELECT c.label, round(coalesce(d / nullif(nx * (SELECT sqrt(sum(n * n)) FROM qb), 0), 0), 9) AS score FROM chunks c LEFT JOIN norms USING (label) LEFT JOIN dots USING (label)),
"""
    + f"""hits AS MATERIALIZED (SELECT c.*, round(h.score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, label LIMIT {K}) h JOIN chunks c USING (label)),
hit_files AS MATERIALIZED (SELECT file_id, text FROM files WHERE file_id IN (SELECT file_id FROM hits))"""
    + offsets("hit_files")
    + """,
found AS (SELECT h.label, h.score, h.file_path, h.chunk_text, a.s AS start_char_offset, z.e AS end_char_offset FROM hits h
  JOIN tok a ON a.file_id = h.file_id AND a.pos = 108 * h.chunk_no JOIN tok z ON z.file_id = h.file_id AND z.pos = 108 * h.chunk_no + h.token_count - 1)
"""
)
LIKE_PATHS = "(" + " OR ".join(f"file_path LIKE '{p.replace('*', '%')}'" for p in PATHS) + ")"
LIKE_WORD = f"lower(chunk_text) LIKE '%' || lower('{KEYWORD}') || '%'"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            share_code(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return run

    return add


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return documents_as_files(spark.read.parquet(f"{sf}/documents.parquet"))


def _plain_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(_files(spark, sf))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(_plain_chunks(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("label"), "embedding")


def _probe(spark: SparkSession, sf: str) -> list[float]:
    """The vector of the smallest label."""
    return _vectors(spark, sf).orderBy("label").first()["embedding"]


# --- sources -----------------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT file_path FROM files ORDER BY file_path")
def scan_files(spark, sf):
    return _files(spark, sf).select("file_path").orderBy("file_path")


@query(f"WITH {FILES} SELECT file_path, octet_length(encode(text)) AS file_size_bytes, length(text) AS n_chars FROM files")
def file_metadata(spark, sf):
    return _files(spark, sf).select("file_path", "file_size_bytes", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {FILES} SELECT file_path, sha256(text) AS content_hash FROM files")
def content_hash(spark, sf):
    return _files(spark, sf).select("file_path", "content_hash")


@query(f"WITH {FILES} SELECT file_path FROM files WHERE regexp_matches(file_path, '^.*/doc_[0-9]*7\\.txt$')")
def glob_filter(spark, sf):
    return _files(spark, sf).where(names_match(F.col("file_path"), ["doc_*7.txt"])).select("file_path")


@query(f"WITH {FILES} SELECT file_path FROM files WHERE regexp_matches(file_path, '/(doc_1.\\.txt|doc_[2-4][^0]*\\.txt|[^/]*5\\.txt)$')")
def glob_multi(spark, sf):
    return _files(spark, sf).where(names_match(F.col("file_path"), ["doc_1?.txt", "doc_[2-4]*[!0].txt", "doc_[2-4].txt", "*5.txt"]) & ~names_match(F.col("file_path"), ["doc_[2-4]*0*[!5].txt"])).select("file_path")


@query(f"""WITH {FILES}, r AS (SELECT file_path, file_path[9:] AS p FROM files)
SELECT file_path FROM r WHERE NOT (CASE
  WHEN regexp_matches(p, '^(.*/)?es/doc_[0-4][^/]*\\.txt$') THEN true
  WHEN regexp_matches(p, '^de/doc_2[^/]*$') THEN true
  WHEN regexp_matches(p, '/doc_19\\.txt$') THEN false
  WHEN regexp_matches(p, '_1[^/]\\.txt$') THEN true
  WHEN p LIKE 'src1/%' THEN true ELSE false END)""")
def ignore_rules(spark, sf):
    relative = F.expr("substring(file_path, 9)")
    return _files(spark, sf).where(~ignored_column(relative, parse_rules(RULES))).select("file_path")


@query(f"WITH {FILES} SELECT DISTINCT file_path FROM (SELECT file_path FROM files WHERE source < 'src5' UNION ALL SELECT file_path FROM files WHERE lang = 'en')")
def multi_root_union(spark, sf):
    files = _files(spark, sf)
    one, two = files.where(F.split("file_path", "/")[2] < "src5"), files.where(F.split("file_path", "/")[3] == "en")
    return one.select("file_path").unionByName(two.select("file_path")).distinct().orderBy("file_path")


@query("SELECT file_path FROM (SELECT '/a/1.txt' AS file_path UNION SELECT '/a/2.txt' UNION SELECT '/b/3.txt')")
def missing_root_skipped(spark, sf):
    import tempfile
    from pathlib import Path

    from siftwell.sources.files import gather_all

    with tempfile.TemporaryDirectory() as top:
        for name in ("a/1.txt", "a/2.txt", "b/3.txt"):
            (Path(top) / name).parent.mkdir(exist_ok=True)
            (Path(top) / name).write_text("x")
        top = Path(top).resolve()
        found = gather_all([top / "a", top / "gone", top / "b", top / "a"])
        return spark.createDataFrame([(str(p)[len(str(top)) :],) for p in found], "file_path string")


HTML_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'))"""


@query(f"SELECT page_id, {HTML_SQL} AS text FROM pages")
def extract_html(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", html_text(F.col("html")).alias("text"))


# --- filters and chunks ---------------------------------------------------------------------------


@query(r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[\s\x{A0}\x{3000}]', '', 'g')) > 0")
def nonblank_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where(~is_blank(F.col("text"))).select("doc_id")


INVISIBLE = "\\u200b\\u200c\\u200d\\ufeff"


@query(r"""WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN regexp_replace(text, '\S', '', 'g') WHEN 1 THEN chr(8203) || chr(65279) || ' ' WHEN 2 THEN chr(8203) || left(text, 3) ELSE text END AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[\s\x{A0}\x{3000}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g')) > 0 AS keep FROM v""")
def blank_chunks(spark, sf):
    text, kind = F.col("text"), F.col("doc_id") % 4
    chunk = F.when(kind == 0, F.regexp_replace(text, r"\S", "")).when(kind == 1, F.lit("\u200b\ufeff ")).when(kind == 2, F.concat(F.lit("\u200b"), F.substring(text, 1, 3))).otherwise(text)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (~is_blank_chunk(chunk)).alias("keep"))


@query(f"WITH {FILES}{OFFSETS} SELECT file_id, pos, token, s AS start_char_offset, e AS end_char_offset FROM tok")
def token_offsets(spark, sf):
    from siftwell.operators.chunking import WordChunker

    return chunked(_files(spark, sf), WordChunker(1, 0)).select("file_id", F.col("chunk_no").alias("pos"), F.col("chunk_text").alias("token"), "start_char_offset", "end_char_offset")


@query(f"""WITH {CHUNKS}{OFFSETS}, places AS (SELECT file_id, list(s ORDER BY pos) AS s, list(e ORDER BY pos) AS e FROM tok GROUP BY file_id)
 SELECT file_id, chunk_no, token_count, s[108 * chunk_no + 1] AS start_char_offset, e[108 * chunk_no + token_count] AS end_char_offset FROM chunks JOIN places USING (file_id)""")
def chunk_windows(spark, sf):
    return _plain_chunks(spark, sf).select("file_id", "chunk_no", "token_count", "start_char_offset", "end_char_offset")


@query(f"WITH {CHUNKS} SELECT file_id, CAST(ceil(len(t) / 108.0) AS INTEGER) AS n_windows FROM toks")
def chunk_window_count(spark, sf):
    n = F.size(tokens(F.col("text")))
    return _files(spark, sf).select("file_id", F.size(window_starts(n, 128, 20)).alias("n_windows"))


@query(f"WITH {CHUNKS} SELECT file_id, chunk_no, md5(chunk_text) AS text_md5, token_count FROM chunks")
def chunk_text(spark, sf):
    return _plain_chunks(spark, sf).select("file_id", "chunk_no", F.md5("chunk_text").alias("text_md5"), "token_count")


@query(f"WITH {CHUNKS} SELECT label, file_path, chunk_no FROM chunks")
def assign_labels(spark, sf):
    return _chunks(spark, sf).select("label", "file_path", "chunk_no")


@query("""WITH v AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN CAST(3 * vec_id AS VARCHAR) WHEN 1 THEN 'v' || vec_id END AS stored FROM embeddings)
SELECT vec_id, stored, coalesce(try_cast(stored AS BIGINT), vec_id) + 1 AS next_label FROM v""")
def resume_labels(spark, sf):
    key = F.col("label")
    stored = F.when(key % 3 == 0, (3 * key).cast("string")).when(key % 3 == 1, F.concat(F.lit("v"), key.cast("string")))
    rows = _vectors(spark, sf).select(key.alias("vec_id"), stored.alias("stored"))
    return rows.select("vec_id", "stored", next_label(F.col("stored"), F.col("vec_id")).cast("long").alias("next_label"))


@query(f"WITH {CHUNKS}, {buckets('cb', 'chunks', 'label', 'chunk_text')} SELECT label, CAST(b AS INTEGER) AS bucket, CAST(n AS DOUBLE) AS n FROM cb")
def hash_embed(spark, sf):
    dense = embedded(_chunks(spark, sf).select("label", "chunk_text"), HashedTerms())
    return dense.select("label", F.posexplode("embedding").alias("bucket", "n")).where("n > 0").select("label", "bucket", F.col("n").cast("double").alias("n"))


@query(f"WITH {buckets('cb', 'benchmark', 'item_id', 'text')} SELECT item_id, CAST(b AS INTEGER) AS bucket, CAST(n AS DOUBLE) AS n FROM cb")
def query_embed(spark, sf):
    dense = embedded(spark.read.parquet(f"{sf}/benchmark.parquet"), HashedTerms(), "text")
    return dense.select("item_id", F.posexplode("embedding").alias("bucket", "n")).where("n > 0").select("item_id", "bucket", F.col("n").cast("double").alias("n"))


# --- nearest neighbours -----------------------------------------------------------------------------

PROBE = "p AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), v AS (SELECT vec_id AS label, embedding::DOUBLE[] AS e FROM embeddings)"
SQUARED = "list_sum(list_transform(list_zip(e, q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _knn_sql(score: str, k: int) -> str:
    return f"WITH {PROBE}, s AS (SELECT label, round({score}, 9) AS exact FROM v, p ORDER BY exact DESC, label LIMIT {k}) SELECT label, round(exact, 6) AS score FROM s"


@query(_knn_sql("list_cosine_similarity(e, q)", 10))
def knn_cos(spark, sf):
    return nearest(_vectors(spark, sf), _probe(spark, sf), 10, "cos")


@query(_knn_sql("list_inner_product(e, q)", 10))
def knn_ip(spark, sf):
    return nearest(_vectors(spark, sf), _probe(spark, sf), 10, "ip")


@query(_knn_sql(f"1 / (1 + {SQUARED})", 10))
def knn_l2sq(spark, sf):
    return nearest(_vectors(spark, sf), _probe(spark, sf), 10, "l2sq")


@query(_knn_sql(f"0 - {SQUARED}", 10))
def knn_fallback(spark, sf):
    return nearest(_vectors(spark, sf), _probe(spark, sf), 10, "haversine")


@query(_knn_sql("list_cosine_similarity(e, q)", 1_000_000))
def knn_k_gt_n(spark, sf):
    return nearest(_vectors(spark, sf), _probe(spark, sf), 1_000_000, "cos")


@query(f"WITH {PROBE} SELECT label, round(1 - list_cosine_similarity(e, q), 6) AS cos_distance, round({SQUARED}, 6) AS l2sq_distance, round(1 / (1 + {SQUARED}), 6) AS l2sq_score FROM v, p")
def vector_distances(spark, sf):
    probe = F.lit([float(x) for x in _probe(spark, sf)])
    e = F.col("embedding")
    return _vectors(spark, sf).select(
        "label",
        F.round(distance(e, probe, "cos"), 6).alias("cos_distance"),
        F.round(distance(e, probe, "l2sq"), 6).alias("l2sq_distance"),
        F.round(similarity(distance(e, probe, "l2sq"), "l2sq"), 6).alias("l2sq_score"),
    )


@query("""WITH v AS (SELECT vec_id AS label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE label % 100 = 0),
s AS (SELECT q.label AS query_id, v.label, round(list_cosine_similarity(v.e, q.e), 9) AS score FROM v, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INTEGER) AS rank FROM s) SELECT query_id, label, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def batch_knn(spark, sf):
    vectors = _vectors(spark, sf)
    return nearest_of_many(vectors, vectors.where("label % 100 = 0").select(F.col("label").alias("query_id"), F.col("embedding").alias("query")))


@query()
def lsh_knn(spark, sf):
    return nearest_by_lsh(spark, _vectors(spark, sf), _probe(spark, sf), 10)


@query(f"""WITH {CHUNKS}, {buckets('cb', 'chunks', 'label', 'chunk_text')}, {buckets('qb', 'benchmark', 'item_id', 'text')},
cn AS (SELECT label, sqrt(sum(n * n)) AS nx FROM cb GROUP BY label), qn AS (SELECT item_id, sqrt(sum(n * n)) AS nq FROM qb GROUP BY item_id),
d AS (SELECT item_id, label, sum(cb.n * qb.n) AS d FROM cb JOIN qb USING (b) GROUP BY ALL),
s AS (SELECT qn.item_id AS query_id, cn.label, round(coalesce(d / (nx * nq), 0), 9) AS score FROM cn CROSS JOIN qn LEFT JOIN d ON d.item_id = qn.item_id AND d.label = cn.label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INTEGER) AS rank FROM s) SELECT query_id, label, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def benchmark_search(spark, sf):
    chunks = embedded(_chunks(spark, sf).select("label", "chunk_text"), HashedTerms())
    texts = embedded(spark.read.parquet(f"{sf}/benchmark.parquet"), HashedTerms(), "text")
    return nearest_of_many(chunks, texts.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query")))


# --- search -------------------------------------------------------------------------------------------


def _search(spark, sf, min_score: float = -1.0, paths: list[str] | None = None, keyword: str | None = None, k: int = K) -> DataFrame:
    return Engine(spark).search_files(_files(spark, sf), TEXT, k, min_score, paths, keyword)


@query(SCORED + "SELECT * FROM found")
def search_basic(spark, sf):
    return _search(spark, sf)


@query(SCORED + f"SELECT * FROM found WHERE score >= {MIN_SCORE}")
def search_min_score(spark, sf):
    return _search(spark, sf, MIN_SCORE)


@query(SCORED + f"SELECT * FROM found WHERE {LIKE_PATHS}")
def search_path_filter(spark, sf):
    return _search(spark, sf, paths=PATHS)


@query(SCORED + f"SELECT * FROM found WHERE {LIKE_WORD}")
def search_keyword(spark, sf):
    return _search(spark, sf, keyword=KEYWORD)


@query(SCORED + f"SELECT * FROM found WHERE {LIKE_PATHS} AND {LIKE_WORD} AND score >= {MIN_SCORE}")
def search_combined(spark, sf):
    return _search(spark, sf, MIN_SCORE, PATHS, KEYWORD)


@query(SCORED + "SELECT * FROM found WHERE file_path LIKE '/corpus/src3/%'")
def search_underfilled(spark, sf):
    return _search(spark, sf, paths=["/corpus/src3/*"])


@query(f"WITH {CHUNKS} SELECT label, file_path, md5(chunk_text) AS text_md5 FROM chunks WHERE {LIKE_PATHS} AND {LIKE_WORD}")
def filtered_details(spark, sf):
    found = chunk_details(_chunks(spark, sf).drop("file_path"), _files(spark, sf), None, PATHS, KEYWORD)
    return found.select("label", "file_path", F.md5("chunk_text").alias("text_md5"))


@query(f"WITH {CHUNKS} SELECT file_path LIKE '/corpus/src1%' AS by_path, lower(chunk_text) LIKE '%the%' AS by_word, count(*) AS n FROM chunks GROUP BY ALL")
def filter_columns(spark, sf):
    by_path, by_word = path_like(F.col("file_path"), ["/corpus/src1*"]), keyword_like(F.col("chunk_text"), "The")
    return _plain_chunks(spark, sf).groupBy(by_path.alias("by_path"), by_word.alias("by_word")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS} SELECT label, file_path, chunk_text FROM chunks WHERE label = 7")
def chunk_lookup(spark, sf):
    return lookup(_chunks(spark, sf).drop("file_path"), _files(spark, sf), 7).select("label", "file_path", "chunk_text")


@query(f"WITH {CHUNKS} SELECT label, file_path, chunk_text FROM chunks WHERE label = -1")
def chunk_lookup_missing(spark, sf):
    return lookup(_chunks(spark, sf).drop("file_path"), _files(spark, sf), -1).select("label", "file_path", "chunk_text")


# --- outputs ---------------------------------------------------------------------------------------------


@query(SCORED + "SELECT DISTINCT file_path AS path FROM found")
def out_paths(spark, sf):
    return paths(_search(spark, sf))


@query(SCORED + "SELECT DISTINCT CASE WHEN file_path LIKE '/corpus/src1/%' THEN file_path[14:] ELSE file_path END AS path FROM found")
def out_paths_relative(spark, sf):
    return paths(_search(spark, sf), "/corpus/src1")


@query(SCORED + ", n AS (SELECT count(*) AS chunks, count(DISTINCT file_path) AS files FROM found) SELECT chunks, files, chunks || ' matching ' || CASE WHEN chunks = 1 THEN 'chunk' ELSE 'chunks' END || ' in ' || files || CASE WHEN files = 1 THEN ' file.' ELSE ' files.' END AS text FROM n")
def out_count(spark, sf):
    return counts(_search(spark, sf))


@query(SCORED + """SELECT label, score, '{"label":' || label || ',"score":' || score || ',"file_path":' || to_json(file_path) || ',"chunk_text":' || to_json(chunk_text)
 || ',"start_char_offset":' || start_char_offset || ',"end_char_offset":' || end_char_offset || '}' AS json FROM found""")
def out_json(spark, sf):
    return json_lines(_search(spark, sf))


@query(SCORED + "SELECT label, score, printf('File: %s' || chr(10) || 'Score: %.4f' || chr(10) || 'Chunk: %s', file_path, score, chunk_text) AS line FROM found")
def out_show(spark, sf):
    return show_lines(_search(spark, sf))


# --- index maintenance -----------------------------------------------------------------------------------
# The stored index knows all files but those of one source, and an older German text; of the current files another source is gone.

NEW, GONE, EDITED = "src3", "src7", "de"
STATUS = f"""WITH {FILES}, stored AS (SELECT file_id, file_path, sha256(text || CASE WHEN lang = '{EDITED}' THEN ' old' ELSE '' END) AS h FROM files WHERE source <> '{NEW}'),
now AS (SELECT file_path, sha256(text) AS h FROM files WHERE source <> '{GONE}'),
status AS (SELECT coalesce(s.file_path, n.file_path) AS file_path, s.file_id, CASE WHEN n.file_path IS NULL THEN 'deleted' WHEN s.file_path IS NULL THEN 'new' WHEN s.h = n.h THEN 'unchanged' ELSE 'changed' END AS status
 FROM stored s FULL JOIN now n ON s.file_path = n.file_path) """


def _status(spark, sf) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    old = F.when(F.col("lang") == EDITED, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    stored = documents_as_files(docs.where(F.col("source") != NEW).withColumn("text", old))
    return classified(stored, documents_as_files(docs.where(F.col("source") != GONE)))


@query(STATUS + "SELECT file_path, file_id, status FROM status")
def sync_classify(spark, sf):
    return _status(spark, sf)


@query(STATUS + "SELECT file_path FROM status WHERE status = 'deleted'")
def sync_prune(spark, sf):
    return _status(spark, sf).where("status = 'deleted'").select("file_path")


@query(STATUS + "SELECT file_path FROM status WHERE status = 'unchanged'")
def sync_unchanged(spark, sf):
    return _status(spark, sf).where("status = 'unchanged'").select("file_path")


@query(STATUS + "SELECT file_path FROM status WHERE status = 'changed'")
def sync_changed(spark, sf):
    return _status(spark, sf).where("status = 'changed'").select("file_path")


@query(STATUS + "SELECT file_path FROM status WHERE status <> 'deleted'")
def sync_result(spark, sf):
    return _status(spark, sf).where("status <> 'deleted'").select("file_path")


@query(STATUS + "SELECT status, count(*) AS files FROM status GROUP BY status")
def sync_totals(spark, sf):
    return totals(_status(spark, sf))


@query(f"{STATUS.rstrip()}, {CHUNKS.removeprefix(FILES + ',')} SELECT label FROM chunks JOIN status USING (file_id) WHERE status IN ('deleted', 'changed')")
def sync_removed_labels(spark, sf):
    return removed_labels(_chunks(spark, sf), _status(spark, sf))


@query(f"WITH {CHUNKS} SELECT label + (SELECT count(*) FROM chunks) AS label, file_path, chunk_no FROM chunks")
def rebuild_labels_continue(spark, sf):
    chunks = _plain_chunks(spark, sf)
    return labelled(chunks, chunks.count()).select("label", "file_path", "chunk_no")


@query(f"WITH {FILES} SELECT file_path, file_id, 'deleted' AS status FROM files")
def empty_scan(spark, sf):
    files = _files(spark, sf)
    return classified(files, files.where(F.lit(False)))


@query("SELECT c_name AS key, CASE WHEN c_nationkey < 5 THEN 'changed' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 'new ' || s_name, s_name FROM supplier")
def kv_upsert(spark, sf):
    customers, suppliers = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "supplier"))
    stored = customers.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    changed = customers.where("c_nationkey < 5").select(F.col("c_name").alias("key"), F.lit("changed").alias("value"))
    return upserted(stored, changed.unionByName(suppliers.select(F.concat(F.lit("new "), "s_name").alias("key"), F.col("s_name").alias("value"))))


@query("""WITH rows AS (SELECT o_orderkey AS seq, o_orderkey % 700 AS file_id, '/o/' || (o_custkey % 900) AS file_path FROM orders),
one AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seq) AS n FROM rows), two AS (SELECT seq, file_id, file_path, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS n FROM one WHERE n = 1)
SELECT file_id, file_path FROM two WHERE n = 1 AND file_id NOT IN (SELECT o_orderkey % 700 FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 700 < 100)""")
def insert_files_dedup(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 700).alias("file_id"), F.concat(F.lit("/o/"), (F.col("o_custkey") % 900).cast("string")).alias("file_path"))
    stored = orders.where("seq % 11 = 0 and file_id < 100").select("file_id", "file_path")
    return first_of_each(orders, "file_path", "seq", stored).select("file_id", "file_path")


@query("SELECT DISTINCT s_nationkey AS project_id, '/' || (s_suppkey % 7) AS path FROM supplier EXCEPT SELECT c_nationkey, '/' || (c_custkey % 7) FROM customer WHERE c_acctbal > 5000")
def insert_paths_ignore(spark, sf):
    wanted = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("project_id"), F.concat(F.lit("/"), (F.col("s_suppkey") % 7).cast("string")).alias("path"))
    stored = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("project_id"), F.concat(F.lit("/"), (F.col("c_custkey") % 7).cast("string")).alias("path"))
    return new_paths(stored, wanted)


@query(f"WITH {CHUNKS} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks")
def index_counts_query(spark, sf):
    return index_counts(_files(spark, sf), _plain_chunks(spark, sf))


@query("SELECT vec_id AS label FROM embeddings")
def index_keys(spark, sf):
    return _vectors(spark, sf).select("label")


@query("SELECT count(*) AS n, max(vec_id) AS top FROM embeddings")
def index_size(spark, sf):
    return _vectors(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("top"))


@query(f"WITH {CHUNKS} SELECT DISTINCT file_id, file_path FROM chunks")
def distinct_chunk_files(spark, sf):
    return _plain_chunks(spark, sf).select("file_id", "file_path").distinct()


def _projects(spark, sf) -> DataFrame:
    """Regions as projects."""
    return spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("long").alias("project_id"), project_name(F.col("r_name")).alias("project_name"), F.lit("/s").alias("store_path"), F.lit("m").alias("embedding_model_name"))


@query("SELECT replace(lower(r_name), ' ', '-') AS project_name FROM region UNION SELECT replace(lower(n_name), ' ', '-') FROM nation")
def project_list(spark, sf):
    stored = _projects(spark, sf)
    wanted = spark.read.parquet(f"{sf}/nation.parquet").select(project_name(F.col("n_name")).alias("project_name"))
    return stored.select("project_name").unionByName(numbered_projects(stored, wanted).select("project_name")).orderBy("project_name")


@query("""SELECT replace(lower(r_name), ' ', '-') AS project_name, coalesce(string_agg('/' || n_name, ',' ORDER BY n_name), '') AS paths
FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_regionkey = r_regionkey GROUP BY r_name""")
def project_config(spark, sf):
    roots = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey <> 2").select(F.col("n_regionkey").cast("long").alias("project_id"), F.concat(F.lit("/"), "n_name").alias("path"))
    return with_paths(_projects(spark, sf), roots).select("project_name", F.array_join("paths", ",").alias("paths"))

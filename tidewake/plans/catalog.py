"""Registered queries over the test tables, and the SQL that must give the same rows.

Members are documents of even id. The queries of code elements and perturbations are in ``code``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import data, learned, lm, measures, metrics, perturb, registry, report, scores, subword
from ..sources import files
from ..sources.scratch import scratch_path, written
from ..streaming.acquire import acquire

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- samples

SAMPLES = "samples AS (SELECT text, CAST(doc_id AS VARCHAR) AS blob_id, CAST(1 - doc_id % 2 AS INTEGER) AS label FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0)"


def collection(spark, d, label: int) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.filter(F.pmod("doc_id", F.lit(2)) == 1 - label).select(F.col("text").alias("content"), F.col("doc_id").cast("string").alias("blob_id"))


def samples(spark, d) -> DataFrame:
    return data.samples(collection(spark, d, 1), 1).unionByName(data.samples(collection(spark, d, 0), 0))


def members(spark, d) -> DataFrame:
    return data.samples(collection(spark, d, 1), 1)


def model(spark, d) -> lm.NGramLM:
    return lm.NGramLM(members(spark, d))


query("src_parquet_scan", "SELECT text AS content, CAST(doc_id AS VARCHAR) AS blob_id FROM documents")(lambda s, d: table(s, d, "documents").select(F.col("text").alias("content"), F.col("doc_id").cast("string").alias("blob_id")))
query("filter_nonblank", f"WITH {SAMPLES} SELECT blob_id FROM samples")(lambda s, d: samples(s, d).select("blob_id"))
query("proj_sample", f"WITH {SAMPLES} SELECT * FROM samples")(samples)
query("union_all", f"WITH {SAMPLES} SELECT label, count(*) AS n, count(DISTINCT text) AS texts FROM samples GROUP BY label")(lambda s, d: samples(s, d).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts")))
query("proj_label", f"WITH {SAMPLES} SELECT blob_id, label FROM samples")(lambda s, d: samples(s, d).select("blob_id", "label"))
query("blob_id_fallback", "SELECT CASE WHEN doc_id % 3 = 0 OR doc_id = 0 THEN sha1(text) ELSE CAST(doc_id AS VARCHAR) END AS blob_id FROM documents")(
    lambda s, d: table(s, d, "documents").select(data.blob_id(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")), F.col("text")).alias("blob_id"))
)
query("take_n", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1000")(lambda s, d: files.take_n(table(s, d, "documents").select("doc_id"), 1000, "doc_id"))
query("preview_parquet", "SELECT '<unknown>' AS name, CAST(doc_id AS VARCHAR) AS blob_id, CAST(length(text) AS INTEGER) AS n_chars, substr(text, 1, 40) AS head FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 10")(
    lambda s, d: files.preview(table(s, d, "documents").select(F.col("text").alias("content"), F.col("doc_id").cast("string").alias("blob_id")), 10, prefix=40)
)
query("agg_nonempty_count", f"WITH {SAMPLES} SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS nonblank FROM samples")(lambda s, d: files.row_counts(table(s, d, "documents"), "text"))


def _part(purpose: str) -> str:
    return f"{SAMPLES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|{purpose}|' || blob_id || '|' || text), blob_id, text) AS r, count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS t FROM samples)"


query("sample_exact", f"WITH {_part('sample')} SELECT blob_id, label FROM ranked WHERE r <= greatest(1, floor(c * 0.3::DOUBLE))")(lambda s, d: data.sample_exact(samples(s, d), 0.3).select("blob_id", "label"))
_QUOTA = """, q AS (SELECT label, c, t, floor(t * 0.8::DOUBLE) AS size FROM (SELECT DISTINCT label, c, t FROM ranked)),
e AS (SELECT label, floor(size * c / t) AS low, round(size * c / t - floor(size * c / t), 9) AS rest, size FROM q),
n AS (SELECT label, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= size - sum(low) OVER () THEN 1 ELSE 0 END AS n FROM e)"""
_SPLIT = f"{_part('split')}{_QUOTA}, split AS (SELECT text, blob_id, label, CASE WHEN r <= n THEN 'train' ELSE 'test' END AS split FROM ranked JOIN n USING (label))"
query("stratified_split", f"WITH {_SPLIT} SELECT blob_id, label, split FROM split")(lambda s, d: data.stratified_split(samples(s, d)).select("blob_id", "label", "split"))
query("agg_label_counts", f"WITH {_SPLIT} SELECT split, sum(label)::BIGINT AS members, sum(1 - label)::BIGINT AS others FROM split GROUP BY split")(lambda s, d: data.label_counts(data.stratified_split(samples(s, d))))
_VAL = _QUOTA.replace("floor(t * 0.8::DOUBLE)", "t - ceil(t * 0.5::DOUBLE)")
query("val_split", f"WITH {_part('val')}{_VAL} SELECT blob_id, CASE WHEN r <= n THEN 'fit' ELSE 'val' END AS split FROM ranked JOIN n USING (label)")(lambda s, d: data.val_split(samples(s, d)).select("blob_id", "split"))
query("anti_duplicates", f"WITH {SAMPLES} SELECT blob_id FROM samples WHERE label = 0 AND text NOT IN (SELECT text FROM samples WHERE label = 1)")(
    lambda s, d: data.without_seen(data.samples(collection(s, d, 0), 0), members(s, d)).select("blob_id")
)

# --- acquisition: pages as the files of nested rows of ten, some of them null; documents with flags made of their ids

_FILES_SQL = """f AS (SELECT CAST(page_id AS VARCHAR) AS blob_id, CASE page_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'C' WHEN 2 THEN 'python' END AS language, CASE WHEN page_id % 6 = 3 THEN 'PYTHON' END AS lang,
  CASE WHEN page_id % 11 > 0 THEN url || CASE page_id % 5 WHEN 0 THEN '.Py' WHEN 1 THEN '.py.bak' ELSE '' END END AS path FROM pages WHERE page_id % 7 <> 0)"""


def acquired(s, d) -> DataFrame:
    """Nested rows: files of ten pages each; a null entry for every seventh page, and a row without files."""
    i, url = F.col("page_id"), F.col("url")
    path = F.when(i % 11 > 0, F.concat(url, F.when(i % 5 == 0, ".Py").when(i % 5 == 1, ".py.bak").otherwise("")))
    language = F.when(i % 4 == 0, "Python").when(i % 4 == 1, "C").when(i % 4 == 2, "python")
    file = F.struct(i.cast("string").alias("blob_id"), language.alias("language"), F.when(i % 6 == 3, "PYTHON").alias("lang"), path.alias("path"))
    # collect_list leaves nulls out, so an entry travels in a struct of its own
    held = table(s, d, "pages").groupBy(F.floor(i / 10).alias("row_id")).agg(F.collect_list(F.struct(F.when(i % 7 != 0, file).alias("f"))).alias("held"))
    rows = held.select("row_id", F.transform("held", lambda x: x["f"]).alias("files"))
    return rows.unionByName(rows.limit(1).select(F.lit(-1).cast("bigint").alias("row_id"), F.lit(None).cast(rows.schema["files"].dataType).alias("files")))


query("explode_files", f"WITH {_FILES_SQL} SELECT * FROM f")(lambda s, d: files.explode_files(acquired(s, d)))


@query("filter_python_file", f"WITH {_FILES_SQL} SELECT blob_id FROM f WHERE lower(coalesce(language, lang, '')) = 'python' OR lower(coalesce(path, '')) LIKE '%.py'")
def _python_files(s, d):
    rows = files.explode_files(acquired(s, d))
    return rows.filter(files.is_python_file(rows)).select("blob_id")


def _tri(col) -> Column:
    return F.when(col % 3 == 0, True).when(col % 3 == 1, False)


@query("filter_non_duplicates", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND (doc_id // 3) % 3 <> 0")
def _non_duplicates(s, d):
    i = F.col("doc_id")
    rows = table(s, d, "documents").select("doc_id", _tri(i).alias("exact_duplicates_stackv2"), _tri(F.floor(i / 3)).alias("near_duplicates_stackv2"))
    return rows.filter(files.not_duplicate(rows)).select("doc_id")


query("filter_fetch_ok", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0")(
    lambda s, d: files.fetch_ok(table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("content"), F.when(F.col("doc_id") % 4 == 0, "HTTP 404").alias("status_code"))).select("doc_id")
)


@query(
    "fetch_content",
    """SELECT CASE WHEN page_id % 9 > 0 THEN CAST(page_id AS VARCHAR) END AS blob_id, CASE WHEN page_id % 9 > 0 AND page_id % 4 IN (0, 3) THEN 'é' || page_id END AS content,
CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 'HTTP 404' WHEN page_id % 4 = 2 THEN 'no route to ' || page_id END AS status_code FROM pages""",
)
def _fetch(s, d):
    """Every page's id asked for; the server knows a half, and is busy the first two times for a quarter."""
    state = scratch_path(s, "catalog")

    def get(blob: str) -> tuple[int, bytes]:
        n = int(blob)
        if n % 4 == 2:
            raise OSError(f"no route to {n}")
        return (404, b"") if n % 4 == 1 else (200, f"é{n}".encode("latin-1"))

    def busy(blob: str) -> tuple[int, bytes]:
        return (429, b"") if int(blob) % 4 == 3 else get(blob)

    rows = table(s, d, "pages").select(F.when(F.col("page_id") % 9 > 0, F.col("page_id").cast("string")).alias("blob_id"), F.lit("latin-1").alias("src_encoding"))
    files.fetch_content(rows, busy, state, wait=0.0, rounds=2)
    return files.fetch_content(rows, get, state, wait=0.0).select("blob_id", "content", "status_code")


@query("src_first_parquet", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1")
def _first_file(s, d):
    folder = scratch_path(s, "catalog")
    for name, rest in (("b", 0), ("a", 1)):
        table(s, d, "documents").filter(F.col("doc_id") % 2 == rest).select("doc_id").write.parquet(f"{folder}/{name}.parquet")
    return files.read_collection(s, folder)


def _streamed(s, d, name: str, schema: str, keep) -> DataFrame:
    """Everything that keep leaves of a table (a file or a folder, hence the pattern), acquired as a stream."""
    out = scratch_path(s, "catalog")
    acquire(s, f"{d}/{name}.parque?", schema, 1 << 40, keep, out, scratch_path(s, "catalog"))
    return s.read.parquet(f"{out}/*")


query("src_hub_stream_seen", "SELECT page_id FROM pages WHERE url LIKE '%.py' OR url LIKE '%/en/%'")(
    lambda s, d: _streamed(s, d, "pages", "page_id bigint, url string", lambda rows: rows.filter(F.col("url").rlike(r"\.py$|/en/")).select("page_id"))
)
query("src_hub_stream_unseen", "SELECT doc_id FROM documents WHERE lang = 'en'")(lambda s, d: _streamed(s, d, "documents", "doc_id bigint, lang string", lambda rows: rows.filter("lang = 'en'").select("doc_id")))

# --- scalar functions

query("py_strip", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", tx.py_strip("text").alias("stripped")))
query("py_splitlines", "SELECT doc_id, CAST(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS INTEGER) AS lines FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C]') AS l FROM documents)")(lambda s, d: table(s, d, "documents").select("doc_id", F.size(tx.py_splitlines("text")).alias("lines")))
query("sha1_hex", "SELECT doc_id, sha1(text) AS h FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.sha1("text").alias("h")))
query("slice_len_find", "SELECT doc_id, substr(text, 6, 10) AS part, CAST(length(text) AS INTEGER) AS n, CAST(strpos(text, ' ') - 1 AS INTEGER) AS at FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.py_slice("text", F.lit(5), F.lit(15)).alias("part"), F.length("text").alias("n"), tx.find_from("text", " ", 0).alias("at"))
)
# rows of the programme for the longest common subsequence; what stands left of a cell counts through the running maximum
LCS = "list_reduce(list_concat([[0 for y in range(length({1}) + 1)]], [[unicode(x)] for x in string_split({0}, '')]), lambda r, x: list_concat([0], [list_max([greatest(r[k + 1], r[k] + CASE WHEN unicode(substr({1}, k::INT, 1)) = x[1] THEN 1 ELSE 0 END) for k in range(1, j + 1)]) for j in range(1, length({1}) + 1)]))[-1]"
_SPACES = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
_SHORT = f"t AS (SELECT doc_id, regexp_replace(substr(text, 1, 24), '^{_SPACES}+|{_SPACES}+$', '', 'g') AS x, regexp_replace(substr(text, 2 + doc_id % 9, 24), '^{_SPACES}+|{_SPACES}+$', '', 'g') AS y FROM documents)"
query("fuzz_ratio", f"WITH {_SHORT} SELECT doc_id, CASE WHEN x = '' AND y = '' THEN 100 WHEN x = '' OR y = '' THEN 0 ELSE CAST(round(200.0::DOUBLE * {LCS.format('x', 'y')} / (length(x) + length(y))) AS INTEGER) END AS ratio FROM t")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.fuzz_ratio(F.substring("text", 1, 24), F.substring(F.col("text"), (2 + F.col("doc_id") % 9).cast("int"), F.lit(24))).alias("ratio"))
)
query("cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity([x::DOUBLE for x in a.embedding], [x::DOUBLE for x in b.embedding]), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")(
    lambda s, d: (lambda e: e.select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("x")).join(e.select(F.col("vec_id").alias("b"), F.col("embedding").cast("array<double>").alias("y")), F.col("b") == F.col("a") + 1).select("a", "b", F.round(tx.cosine("x", "y"), 6).alias("cos")))(table(s, d, "embeddings"))
)
query("draws", "SELECT doc_id, CAST('0x' || substr(md5('42|d|' || doc_id), 1, 8) AS BIGINT) AS draw FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", tx.draw_int(42, "d", "doc_id").alias("draw")))

# --- bigram model and scores

_LM = f"""{SAMPLES}, tok AS (SELECT blob_id, label, regexp_extract_all(text, '[^ \\t-\\r]+') AS t FROM samples),
pos AS (SELECT blob_id, label, i AS pos, t[i] AS prev, t[i + 1] AS token FROM (SELECT blob_id, label, t, unnest(generate_series(1, len(t) - 1)) AS i FROM tok)),
c2 AS (SELECT prev, token, count(*) AS c2 FROM pos WHERE label = 1 GROUP BY ALL), c1 AS (SELECT prev, sum(c2) AS c1 FROM c2 GROUP BY prev),
v AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(t) AS w FROM tok WHERE label = 1)),
lp AS (SELECT blob_id, label, pos, token, ln((coalesce(c2, 0) + 0.1::DOUBLE) / (coalesce(c1, 0) + 0.1::DOUBLE * v)) AS lp FROM pos LEFT JOIN c2 USING (prev, token) LEFT JOIN c1 USING (prev), v)"""
_CUT = f"{_LM}, lpc AS (SELECT * FROM lp WHERE pos < 2048), rk AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY lp) AS low, count(*) OVER (PARTITION BY blob_id) AS n FROM lpc)"
_SCORED = "SELECT s.blob_id, s.label, round(score, 6) AS score FROM samples s LEFT JOIN x USING (blob_id)"
_LOSS = f"{_LM}, x AS (SELECT blob_id, avg(lp) AS score FROM lp WHERE pos < 2048 GROUP BY blob_id)"
_MKP = f"{_CUT}, x AS (SELECT blob_id, avg(lp) AS score FROM rk WHERE low <= greatest(1, floor(n * 0.3::DOUBLE)) GROUP BY blob_id)"
_PD = f"""{_CUT}, w AS (SELECT *, least(5, n) AS f, least(30, n) AS m FROM rk), w2 AS (SELECT *, CASE WHEN f + m > n THEN greatest(1, floor(m * (n::DOUBLE / (f + m)))) ELSE m END AS m2, CASE WHEN f + m > n THEN greatest(1, floor(f * (n::DOUBLE / (f + m)))) ELSE f END AS f2 FROM w),
x AS (SELECT blob_id, avg(CASE WHEN n - low < f2 THEN lp END) - avg(CASE WHEN low <= m2 THEN lp END) AS score FROM w2 GROUP BY blob_id)"""
_r = lambda df: df.withColumn("score", F.round("score", 6))

query("lm_token_logprobs", f"WITH {_LM} SELECT blob_id, CAST(pos AS INTEGER) AS pos, token, round(lp, 6) AS lp FROM lp")(lambda s, d: model(s, d).token_logprobs(samples(s, d)).select("blob_id", "pos", "token", F.round("lp", 6).alias("lp")))
query("win_prev_token", f"WITH {_LM} SELECT blob_id, CAST(pos AS INTEGER) AS pos, prev, token FROM pos")(lambda s, d: lm.positions(samples(s, d)))
query("lm_truncate", f"WITH {_LM} SELECT blob_id, array_to_string(t[1:{scores.LOSS_TOKENS}], ' ') AS head, array_to_string(t[greatest(1, len(t) - {learned.PROMPT_TOKENS - 1}):], ' ') AS tail FROM tok")(
    lambda s, d: samples(s, d).select("blob_id", F.array_join(lm.truncate(lm.tokenize("text"), scores.LOSS_TOKENS), " ").alias("head"), F.array_join(lm.truncate(lm.tokenize("text"), learned.PROMPT_TOKENS, keep_end=True), " ").alias("tail"))
)
#: A public tokenizer's file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query("lm_truncate_subword")
def _truncated(s, d):
    """Tokens of each document, and its head and tail of as many as the attacks read."""
    own = subword.Subword(TOKENIZER)
    return samples(s, d).select("blob_id", own.summary(F.col("text"), scores.LOSS_TOKENS, learned.PROMPT_TOKENS).alias("x")).select("blob_id", "x.*")


@query("attack_loss_subword")
def _loss_subword(s, d):
    own = subword.Subword(TOKENIZER)
    return _r(scores.loss_attack(lm.NGramLM(members(s, d), cut=own.tokens, joined=own.joined), samples(s, d)))


query("lookup_token_logprob", f"WITH {_LM} SELECT prev, token, round(ln((coalesce(c2, 0) + 0.1::DOUBLE) / (coalesce(c1, 0) + 0.1::DOUBLE * v)), 6) AS lp FROM (SELECT DISTINCT prev, token FROM pos) LEFT JOIN c2 USING (prev, token) LEFT JOIN c1 USING (prev), v")(
    lambda s, d: model(s, d).pair_logprobs(lm.positions(samples(s, d))).select("prev", "token", F.round("lp", 6).alias("lp"))
)
query("agg_mean_logprob", f"WITH {_LOSS} {_SCORED}")(lambda s, d: _r(scores.loss_attack(model(s, d), samples(s, d))))
query("attack_loss", f"WITH {_LOSS} {_SCORED}")(QUERIES["agg_mean_logprob"])
query("agg_min_k", f"WITH {_MKP} {_SCORED}")(lambda s, d: _r(scores.min_k_attack(model(s, d), samples(s, d))))
query("attack_mkp", f"WITH {_MKP} {_SCORED}")(QUERIES["agg_min_k"])
query("win_rank_logprob", f"WITH {_CUT} SELECT blob_id, CAST(low AS INTEGER) AS low, round(lp, 6) AS lp FROM rk")(lambda s, d: scores.ranks(scores.lists(model(s, d), samples(s, d), 2048)).select("blob_id", "low", F.round("lp", 6).alias("lp")))
query("agg_polarized_distance", f"WITH {_PD} SELECT blob_id, round(score, 6) AS score FROM x")(lambda s, d: _r(scores.polarized_distance(scores.lists(model(s, d), samples(s, d), 2048).filter(F.size("l") > 0))))
query("win_token_chunks", f"WITH {_LM} SELECT blob_id, CAST(floor(pos / 64) AS INTEGER) AS chunk, count(*) AS scored FROM pos WHERE pos % 64 <> 0 GROUP BY ALL")(lambda s, d: lm.chunked_positions(samples(s, d), 64).groupBy("blob_id", "chunk").agg(F.count("*").alias("scored")))
# a swap of places i and j as a list ['i', 'j'], applied one after another to the list of tokens
_DRAWN = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
_VARIANTS = f"""vt AS (SELECT blob_id, label, CAST(v AS INTEGER) AS variant, CAST(floor(len(t) * 0.3::DOUBLE) AS BIGINT) AS m, t FROM tok, (SELECT unnest(generate_series(1, 5)) AS v)),
dr AS (SELECT blob_id, variant, k, {_DRAWN.format(1)} % n AS i, {_DRAWN.format(9)} % (n - 1) AS j FROM (SELECT blob_id, variant, k, n, md5('42|swap|' || blob_id || '|' || variant || '|' || k) AS h FROM (SELECT blob_id, variant, len(t) AS n, unnest(generate_series(0, m - 1)) AS k FROM vt WHERE m > 0))),
ds AS (SELECT blob_id, variant, list([CAST(least(i, j2) AS VARCHAR), CAST(greatest(i, j2) AS VARCHAR)] ORDER BY k) AS ds FROM (SELECT *, CASE WHEN j >= i THEN j + 1 ELSE j END AS j2 FROM dr) GROUP BY ALL),
sx AS (SELECT vt.blob_id, vt.label, vt.variant, array_to_string(CASE WHEN ds IS NULL THEN t ELSE list_reduce(list_concat([t], ds), lambda a, x: list_concat(list_concat(list_concat(a[1:x[1]::BIGINT], [a[x[2]::BIGINT + 1]]), list_concat(a[x[1]::BIGINT + 2:x[2]::BIGINT], [a[x[1]::BIGINT + 1]])), a[x[2]::BIGINT + 2:])) END, ' ') AS text
  FROM vt LEFT JOIN ds USING (blob_id, variant) UNION ALL SELECT blob_id, label, 0, text FROM samples)"""
query("token_swap", f"WITH {_LM}, {_VARIANTS} SELECT blob_id, variant, sha1(text) AS h FROM sx")(lambda s, d: scores.swap_tokens(samples(s, d).select("blob_id", "text")).select("blob_id", "variant", F.sha1("text").alias("h")))
_PAC = f"""{_LM}, {_VARIANTS},
sp AS (SELECT blob_id, variant, t[i] AS prev, t[i + 1] AS token FROM (SELECT blob_id, variant, t, unnest(generate_series(1, len(t) - 1)) AS i FROM (SELECT blob_id, variant, regexp_extract_all(text, '[^ \\t-\\r]+')[1:4096] AS t FROM sx))),
sl AS (SELECT blob_id, variant, ln((coalesce(c2, 0) + 0.1::DOUBLE) / (coalesce(c1, 0) + 0.1::DOUBLE * v)) AS lp FROM sp LEFT JOIN c2 USING (prev, token) LEFT JOIN c1 USING (prev), v),
sr AS (SELECT *, row_number() OVER (PARTITION BY blob_id, variant ORDER BY lp) AS low, count(*) OVER (PARTITION BY blob_id, variant) AS n FROM sl),
sw AS (SELECT *, least(5, n) AS f, least(30, n) AS m FROM sr),
sz AS (SELECT *, CASE WHEN f + m > n THEN greatest(1, floor(m * (n::DOUBLE / (f + m)))) ELSE m END AS m2, CASE WHEN f + m > n THEN greatest(1, floor(f * (n::DOUBLE / (f + m)))) ELSE f END AS f2 FROM sw),
sd AS (SELECT blob_id, variant, avg(CASE WHEN n - low < f2 THEN lp END) - avg(CASE WHEN low <= m2 THEN lp END) AS score FROM sz GROUP BY blob_id, variant),
sa AS (SELECT sx.blob_id, sx.label, sx.variant, coalesce(score, 0.0) AS score FROM sx LEFT JOIN sd USING (blob_id, variant))"""
query("attack_pac", f"WITH {_PAC} SELECT blob_id, label, round(max(CASE WHEN variant = 0 THEN score END) - avg(CASE WHEN variant > 0 THEN score END), 6) AS score FROM sa GROUP BY blob_id, label")(lambda s, d: _r(scores.swap_attack(model(s, d), samples(s, d))))
query("agg_pac", "WITH v AS (SELECT user_id, CAST(event_id % 6 AS INTEGER) AS variant, avg(value) AS score FROM events GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS blob_id, round(CASE WHEN count(*) FILTER (variant > 0) = 0 THEN 0.0 ELSE max(CASE WHEN variant = 0 THEN score END) - avg(CASE WHEN variant > 0 THEN score END) END, 6) AS score FROM v GROUP BY user_id")(
    lambda s, d: _r(scores.combine_mutants(table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("blob_id"), (F.col("event_id") % 6).cast("int").alias("variant")).agg(F.avg("value").alias("score"))))
)
query("ppl_text", f"WITH {_LM}, m AS (SELECT blob_id, avg(lp) AS m FROM lp GROUP BY blob_id) SELECT s.blob_id, round(ln(CASE WHEN m IS NULL THEN 1e6::DOUBLE ELSE exp(-m) END), 6) AS log_ppl FROM samples s LEFT JOIN m USING (blob_id)")(
    lambda s, d: lm.perplexity(model(s, d), samples(s, d)).select("blob_id", F.round(F.log("ppl"), 6).alias("log_ppl"))
)
_KN = """kt AS (SELECT list_concat(['', ''], regexp_extract_all(text, '[^ \\t-\\r]+')) AS t FROM conversations),
k3 AS (SELECT t[i] AS u, t[i + 1] AS v, t[i + 2] AS w, count(*) AS n FROM (SELECT t, unnest(generate_series(1, len(t) - 2)) AS i FROM kt) GROUP BY ALL),
k2 AS (SELECT v, w, count(*) AS n FROM k3 GROUP BY ALL), k1 AS (SELECT w, count(*) AS n FROM k2 GROUP BY ALL),
a3 AS (SELECT u, v, sum(n)::DOUBLE AS total, 0.75::DOUBLE * count(*) / sum(n)::DOUBLE AS r3 FROM k3 GROUP BY ALL), a2 AS (SELECT v, sum(n)::DOUBLE AS total, 0.75::DOUBLE * count(*) / sum(n)::DOUBLE AS r2 FROM k2 GROUP BY ALL),
a1 AS (SELECT sum(n)::DOUBLE AS total, 0.75::DOUBLE * count(*) / sum(n)::DOUBLE / (count(*) + 1) AS unknown FROM k1),
dt AS (SELECT doc_id, text, list_concat(['', ''], CASE WHEN length(text) > 1024 THEN t[greatest(1, len(t) - 1023):] ELSE t END) AS t FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS t FROM documents)),
dp AS (SELECT doc_id, t[i] AS u, t[i + 1] AS v, t[i + 2] AS w FROM (SELECT doc_id, t, unnest(generate_series(2, len(t) - 2)) AS i FROM dt)),
dl AS (SELECT doc_id, ln(coalesce(greatest(k3.n - 0.75::DOUBLE, 0) / a3.total, 0) + coalesce(a3.r3, 1) * (coalesce(greatest(k2.n - 0.75::DOUBLE, 0) / a2.total, 0) + coalesce(a2.r2, 1) * (coalesce(greatest(k1.n - 0.75::DOUBLE, 0) / a1.total, 0) + a1.unknown))) AS lp
  FROM dp LEFT JOIN k3 USING (u, v, w) LEFT JOIN a3 USING (u, v) LEFT JOIN k2 USING (v, w) LEFT JOIN a2 USING (v) LEFT JOIN k1 USING (w), a1),
dm AS (SELECT doc_id, avg(lp) AS m FROM dl GROUP BY doc_id)"""
query("src_feature_models", f"WITH {_KN} SELECT doc_id, round(ln(CASE WHEN text = '' THEN 100.0::DOUBLE WHEN m IS NULL THEN 1e6::DOUBLE ELSE exp(-m) END), 6) AS log_ppl FROM dt LEFT JOIN dm USING (doc_id)")(
    lambda s, d: measures.KneserNey(table(s, d, "conversations")).perplexity(table(s, d, "documents"), ("doc_id",)).select("doc_id", F.round(F.log("ppl"), 6).alias("log_ppl"))
)
query("embed_text")(lambda s, d: table(s, d, "documents").select("doc_id", measures.WordVectors(table(s, d, "conversations")).embed(F.col("text")).alias("embedding")))
query("lm_successors", f"WITH {_LM} SELECT prev, token FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY c2 DESC, token) AS r FROM c2) WHERE r = 1")(lambda s, d: model(s, d).successors())
_PATHS = """su AS (SELECT prev, token FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY c2 DESC, token) AS r FROM c2) WHERE r = 1),
walk(start_token, step, here, path) AS (SELECT prev, 1, token, token FROM su UNION ALL SELECT start_token, step + 1, su.token, path || ' ' || su.token FROM walk JOIN su ON su.prev = walk.here WHERE step < 50),
paths AS (SELECT start_token, arg_max(path, step) AS path FROM walk GROUP BY start_token)"""
query("lm_generate", f"WITH RECURSIVE {_LM}, {_PATHS} SELECT blob_id, coalesce(path, '') AS output FROM tok LEFT JOIN paths ON start_token = t[-1]")(lambda s, d: model(s, d).generate(samples(s, d).select("blob_id", "text"), 50).select("blob_id", "output"))

# --- evaluation

_ROC = """sc AS (%s), g AS (SELECT score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM sc GROUP BY score),
k AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g),
pt AS (SELECT fp / n::DOUBLE AS fpr, tp / p::DOUBLE AS tpr, score FROM k UNION ALL SELECT 0.0, 0.0, NULL)"""
_TPR = "(SELECT coalesce((SELECT lt + (rt - lt) * (%s::DOUBLE - lf) / (rf - lf) FROM (SELECT fpr AS rf, tpr AS rt FROM pt WHERE fpr > %s ORDER BY fpr, tpr LIMIT 1)), lt) FROM (SELECT fpr AS lf, tpr AS lt FROM pt WHERE fpr <= %s ORDER BY fpr DESC, tpr DESC LIMIT 1))"
_METRICS = f"""SELECT 'roc auc' AS metric, round((SELECT sum((fpr - pf) * (tpr + pt_)) / 2 FROM (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, tpr) AS pf, lag(tpr) OVER (ORDER BY fpr, tpr) AS pt_ FROM pt)), 6) AS value
UNION ALL SELECT 'TPR @ 1% FPR', round({_TPR % ((0.01,) * 3)}, 6) UNION ALL SELECT 'TPR @ 0.1% FPR', round({_TPR % ((0.001,) * 3)}, 6)"""
_m = lambda df: metrics.metrics(df).withColumn("value", F.round("value", 6))
_EVENTS = "SELECT round(value, 1) AS score, CAST(user_id % 2 AS INTEGER) AS label FROM events"


def event_scores(s, d) -> DataFrame:
    return table(s, d, "events").select(F.round("value", 1).alias("score"), (F.col("user_id") % 2).cast("int").alias("label"))


def line_scores(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") % 2).cast("int").alias("label"))


_curve = lambda df: metrics.roc_curve(df).select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))
query("agg_roc_curve", f"WITH {_ROC % _EVENTS} SELECT round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM pt")(lambda s, d: _curve(event_scores(s, d)))
query("win_cumulative_roc", f"WITH {_ROC % _EVENTS} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM k")(lambda s, d: metrics.roc_counts(event_scores(s, d)).select("score", "tp", "fp"))
query("agg_roc_auc", f"WITH {_ROC % _EVENTS}, r AS ({_METRICS}) SELECT * FROM r WHERE metric = 'roc auc'")(lambda s, d: _m(event_scores(s, d)).filter("metric = 'roc auc'"))
query("agg_tpr_at_fpr", f"WITH {_ROC % _EVENTS}, r AS ({_METRICS}) SELECT * FROM r WHERE metric <> 'roc auc'")(lambda s, d: _m(event_scores(s, d)).filter("metric <> 'roc auc'"))
query("roc_metrics_lineitem", f"WITH {_ROC % 'SELECT l_extendedprice AS score, CAST(l_orderkey % 2 AS INTEGER) AS label FROM lineitem'} {_METRICS}")(lambda s, d: _m(line_scores(s, d)))
query("attack_loss_metrics", f"WITH {_LOSS}, {_ROC % 'SELECT round(coalesce(score, -100.0), 6) AS score, s.label FROM samples s LEFT JOIN x USING (blob_id)'} {_METRICS}")(lambda s, d: _m(_r(scores.loss_attack(model(s, d), samples(s, d)).fillna(-100.0, ["score"]))))
query("metrics_undefined", "SELECT * FROM (VALUES ('roc auc', NULL::DOUBLE), ('TPR @ 1% FPR', NULL), ('TPR @ 0.1% FPR', NULL)) v(metric, value)")(lambda s, d: _m(event_scores(s, d).filter("label = 1")))


@query("src_predictions_csv", f"SELECT CAST(event_id AS VARCHAR) AS blob_id, label, score FROM (SELECT event_id, round(value, 1) AS score, CAST(user_id % 2 AS INTEGER) AS label FROM events)")
def _predictions(s, d):
    path = scratch_path(s, "catalog")
    files.write_csv(table(s, d, "events").select(F.col("event_id").cast("string").alias("blob_id"), (F.col("user_id") % 2).cast("int").alias("label"), F.round("value", 1).alias("score")), path)
    return files.read_predictions(s, path)


query("recompute_metrics", f"WITH {_ROC % _EVENTS} {_METRICS}")(lambda s, d: _m(_predictions(s, d)))

# --- runs

_RUNS_SQL = """runs AS (SELECT event_type || CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_1' ELSE '_a_b' END AS run_folder, CAST(event_id % 5 AS BIGINT) AS row_idx,
  CASE event_id % 5 WHEN 0 THEN 'roc auc' WHEN 1 THEN 'TPR @ 1% FPR' WHEN 2 THEN 'roc auc' WHEN 4 THEN 'TPR @ 0.1% FPR' END AS metric, CASE WHEN event_id % 5 = 4 AND user_id % 3 = 1 THEN 'n/a' ELSE '0.' || CAST(1000 + count(*) % 1000 AS VARCHAR) END AS value FROM events GROUP BY event_type, user_id % 3, event_id % 5),
last AS (SELECT run_folder, metric, arg_max(value, row_idx) AS raw FROM runs WHERE metric IS NOT NULL GROUP BY ALL),
uni AS (SELECT run_folder, string_split(run_folder, '_')[1] AS attack_name, metric, try_cast(raw AS DOUBLE) AS value FROM last)"""


def runs(s, d) -> DataFrame:
    """Metrics of fifteen runs counted from the events: five rows each, with a repeated metric, a null one and a value that is no number."""
    k, u = (F.col("event_id") % 5).cast("bigint"), F.col("user_id") % 3
    counts = table(s, d, "events").groupBy("event_type", u.alias("u"), k.alias("row_idx")).agg(F.count("*").alias("n"))
    metric = F.when(F.col("row_idx").isin(0, 2), "roc auc").when(F.col("row_idx") == 1, "TPR @ 1% FPR").when(F.col("row_idx") == 4, "TPR @ 0.1% FPR")
    value = F.when((F.col("row_idx") == 4) & (F.col("u") == 1), "n/a").otherwise(F.concat(F.lit("0."), (1000 + F.col("n") % 1000).cast("string")))
    return counts.select(F.concat("event_type", F.when(F.col("u") == 0, "").when(F.col("u") == 1, "_1").otherwise("_a_b")).alias("run_folder"), "row_idx", metric.alias("metric"), value.alias("value"))


@query("src_metrics_csv", f"WITH {_RUNS_SQL} SELECT run_folder, metric, raw AS value FROM last")
def _run_folders(s, d):
    root, rows = scratch_path(s, "catalog"), written(runs(s, d), "catalog")
    for (folder,) in rows.select("run_folder").distinct().collect():  # three for each kind of event
        files.write_small_csv(rows.filter(F.col("run_folder") == folder).orderBy("row_idx").select("metric", "value"), f"{root}/{folder}/metrics.csv")
    return report.last_metrics(files.read_runs(s, root))


query("src_run_folders", f"WITH {_RUNS_SQL} SELECT DISTINCT run_folder FROM runs")(lambda s, d: _run_folders(s, d).select("run_folder").distinct())
query("split_attack_and_id", f"WITH {_RUNS_SQL} SELECT DISTINCT run_folder, CASE WHEN strpos(run_folder, '_') > 0 THEN substr(run_folder, 1, strpos(run_folder, '_') - 1) ELSE run_folder END AS attack, CASE WHEN strpos(run_folder, '_') > 0 THEN substr(run_folder, strpos(run_folder, '_') + 1) ELSE '' END AS id FROM runs")(
    lambda s, d: runs(s, d).select("run_folder", *[c.alias(n) for c, n in zip(report.split_run(F.col("run_folder")), ("attack", "id"), strict=True)]).distinct()
)
query("union_metric_columns", f"WITH {_RUNS_SQL} SELECT attack_name, run_folder, max(CASE WHEN metric = 'TPR @ 1% FPR' THEN value END) AS \"TPR @ 1% FPR\", max(CASE WHEN metric = 'TPR @ 0.1% FPR' THEN value END) AS \"TPR @ 0.1% FPR\", max(CASE WHEN metric = 'roc auc' THEN value END) AS \"roc auc\" FROM uni GROUP BY ALL")(lambda s, d: report.unify_wide(runs(s, d)))
query("agg_attack_mean", f"WITH {_RUNS_SQL} SELECT metric, attack_name, round(avg(value), 9) AS mean FROM uni WHERE value IS NOT NULL GROUP BY ALL")(lambda s, d: report.attack_means(runs(s, d)).withColumn("mean", F.round("mean", 9)))
query("pred_not_numeric", f"WITH {_RUNS_SQL} SELECT run_folder, metric, value FROM uni WHERE value IS NOT NULL")(lambda s, d: report.unify_long(runs(s, d)).filter("value is not null").select("run_folder", "metric", "value"))
_BARS = """ba AS (SELECT metric, attack_name, avg(value) AS v, dense_rank() OVER (ORDER BY metric) - 1 AS k, dense_rank() OVER (ORDER BY attack_name) - 1 AS i FROM uni WHERE value IS NOT NULL GROUP BY metric, attack_name),
bx AS (SELECT *, 260 * greatest(0.0, least(1.0, v)) AS tall FROM ba),
le AS (SELECT string_agg('<label><input type="checkbox" checked onchange="show(this, ' || chr(39) || 'a' || i || chr(39) || ')">' || attack_name || '</label> ', '' ORDER BY i) AS legend FROM (SELECT DISTINCT i, attack_name FROM ba)),
ch AS (SELECT k, '<text x="20" y="' || (k * 360 + 24) || '" font-size="16">' || metric || '</text>' || string_agg('<g class="a' || i || '"><rect x="' || (40 + i * 110) || '" y="' || format('{:.1f}', k * 360 + 310 - tall) || '" width="70" height="' || format('{:.1f}', tall) || '" fill="#4c78a8"/><text x="' || (40 + i * 110) || '" y="' || (k * 360 + 328) || '">' || attack_name || '</text><text x="' || (40 + i * 110) || '" y="' || format('{:.1f}', k * 360 + 304 - tall) || '">' || format('{:.4f}', v) || '</text></g>', '' ORDER BY i) AS part FROM bx GROUP BY k, metric)"""
_HEAD = report.HEAD.replace("'", "''")
query("sink_dashboard", f"""WITH {_RUNS_SQL}, {_BARS} SELECT '{_HEAD}' || max(legend) || '</p><svg xmlns="http://www.w3.org/2000/svg" width="' || (SELECT greatest(900, 80 + 110 * (max(i) + 1)) FROM ba) || '" height="' || greatest(360 * count(*), 500) || '" font-family="sans-serif" font-size="12">' || string_agg(part, '' ORDER BY k) || '</svg>' AS page FROM ch, le""")(
    lambda s, d: s.createDataFrame([(report.dashboard(report.attack_means(runs(s, d))),)], "page string")
)

# --- files of a run


def _ran(s, d) -> tuple[str, DataFrame]:
    """A run folder of the loss attack over the samples of two tokens or more, and its summary."""
    folder = scratch_path(s, "catalog")
    rows = samples(s, d).filter(F.size(lm.tokenize("text")) > 1)
    return folder, registry.run("loss", rows, folder, model=model(s, d))


_RAN = _SPLIT.replace("FROM documents WHERE", r"FROM documents WHERE len(regexp_extract_all(text, '[^ \t-\r]+')) > 1 AND")
_RUN_LM = f"{_LM}, x AS (SELECT blob_id, avg(lp) AS score FROM lp WHERE pos < 2048 GROUP BY blob_id)".replace("samples AS", "every AS", 1).replace("FROM samples)", "FROM every)", 1)
_RUN = f"{_RAN}, {_RUN_LM}"
# means of equal texts, which SQL sums in any order, stay ties at nine places
_TESTED = "SELECT round(x.score, 9) AS score, split.label FROM split JOIN x USING (blob_id) WHERE split = 'test'"
query("sink_predictions", f"WITH {_RUN} SELECT blob_id, split.label, round(x.score, 6) AS score FROM split JOIN x USING (blob_id) WHERE split = 'test'")(lambda s, d: _r(files.read_predictions(s, f"{_ran(s, d)[0]}/predictions.csv")))
query("sink_metrics", f"WITH {_RUN}, {_ROC % _TESTED} {_METRICS}")(lambda s, d: s.read.schema("metric string, value double").csv(f"{_ran(s, d)[0]}/metrics.csv", header=True).withColumn("value", F.round("value", 6)))
query(
    "sink_logs",
    f"WITH {_RUN}, {_ROC % _TESTED}, me AS ({_METRICS}) SELECT * FROM (VALUES ('attack', 'loss'), ('sample_fraction', '1.0'), ('train_test_split', '0.8'), ('seed', '42')) v(item, value) UNION ALL SELECT split || ' members', CAST(sum(label) AS VARCHAR) FROM split GROUP BY split UNION ALL SELECT split || ' others', CAST(sum(1 - label) AS VARCHAR) FROM split GROUP BY split UNION ALL SELECT metric, CASE WHEN value IS NULL THEN NULL ELSE 'defined' END FROM me",
)(lambda s, d: _ran(s, d)[1].select("item", F.when(F.col("item").isin(*metrics.NAMES) & F.col("value").isNotNull(), F.lit("defined")).otherwise(F.col("value")).alias("value")))
query("sink_parquet", "SELECT page_id, url FROM pages")(lambda s, d: s.read.parquet(files.write_parquet(table(s, d, "pages").select("page_id", "url"), scratch_path(s, "catalog"), "pages")))

# --- stability

_U = "CAST('0x' || substr(md5('42|prefix|' || blob_id), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE"
query("prefix_split", f"WITH {SAMPLES}, a AS (SELECT blob_id, text, CAST(floor(length(text) * (0.4::DOUBLE + 0.2::DOUBLE * ({_U}))) AS BIGINT) AS k FROM samples) SELECT blob_id, sha1(substr(text, 1, k)) AS prefix, sha1(substr(text, k + 1)) AS gt FROM a")(lambda s, d: perturb.prefix_split(samples(s, d)).select("blob_id", F.sha1("prefix").alias("prefix"), F.sha1("gt").alias("gt")))
_SIMS = "r AS (SELECT CAST(event_id // 12 AS VARCHAR) AS blob_id, event_id % 12 AS variant, value / 1000 AS sim, 1 + value AS ppl FROM events)"


def event_sims(s, d) -> DataFrame:
    """Groups of twelve events; what the last group's missing variants leave undefined is null."""
    return table(s, d, "events").select(F.floor(F.col("event_id") / 12).cast("string").alias("blob_id"), F.lit(0).alias("label"), (F.col("event_id") % 12).cast("int").alias("variant"), (F.col("value") / 1000).alias("sim"), (1 + F.col("value")).alias("ppl"))


query("agg_sim_stats", f"WITH {_SIMS} SELECT blob_id, round(avg(sim), 9) AS m, round(stddev_pop(sim), 6) AS s FROM r GROUP BY blob_id")(lambda s, d: learned.feature_vectors(event_sims(s, d)).select("blob_id", F.round(F.get("features", F.lit(12)), 9).alias("m"), F.round(F.get("features", F.lit(13)), 6).alias("s")))
query("agg_ppl_stats", f"WITH {_SIMS} SELECT r.blob_id, CASE WHEN count(*) = 12 THEN round(avg((r.ppl - b.ppl) / b.ppl) FILTER (r.variant > 0), 6) END AS m, CASE WHEN count(*) = 12 THEN round(stddev_pop((r.ppl - b.ppl) / b.ppl) FILTER (r.variant > 0), 6) END AS s FROM r JOIN r b ON r.blob_id = b.blob_id AND b.variant = 0 GROUP BY r.blob_id")(lambda s, d: learned.feature_vectors(event_sims(s, d)).select("blob_id", F.round(F.get("features", F.lit(25)), 6).alias("m"), F.round(F.get("features", F.lit(26)), 6).alias("s")))
_WIDE = ", ".join([f"max(sim) FILTER (variant = {i}) AS s{i}, max(ppl) FILTER (variant = {i}) AS p{i}" for i in range(12)])
_RELATIVE = "[" + ", ".join(f"(p{i} - p0) / p0" for i in range(1, 12)) + "]"
_FEATURES = f"""{_SIMS}, wi AS (SELECT blob_id, count(*) AS n, avg(sim) AS sm, stddev_pop(sim) AS ss, {_WIDE} FROM r GROUP BY blob_id), re AS (SELECT *, {_RELATIVE} AS rel FROM wi),
fe AS (SELECT blob_id, list_concat(list_concat([{", ".join(f"s{i}" for i in range(12))}, sm, ss], rel), [CASE WHEN n = 12 THEN list_avg(rel) END, CASE WHEN n = 12 THEN list_stddev_pop(rel) END]) AS f FROM re)"""
query("adv_features", f"WITH {_FEATURES} SELECT blob_id, CAST(i AS INTEGER) AS i, CASE WHEN i < 13 THEN round(f[i + 1], 9) ELSE round(f[i + 1], 6) END AS x FROM (SELECT blob_id, f, unnest(range(0, len(f))) AS i FROM fe)")(
    lambda s, d: learned.feature_vectors(event_sims(s, d)).select("blob_id", F.posexplode("features").alias("i", "x")).withColumn("x", F.when(F.col("i") < 13, F.round("x", 9)).otherwise(F.round("x", 6)))
)
query("mlp_eval", "SELECT round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS loss, round(avg((CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE 0 END)::DOUBLE), 6) AS accuracy FROM (SELECT 1 / (1 + exp((value - 100) / 50)) AS p, CAST(user_id % 2 AS INTEGER) AS y FROM events)")(
    lambda s, d: metrics.cross_entropy(table(s, d, "events").select((1 / (1 + F.exp((F.col("value") - 100) / 50))).alias("score"), (F.col("user_id") % 2).cast("int").alias("label"))).select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))
)
query("standard_scaler", "SELECT CAST(i - 1 AS INTEGER) AS i, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END, 6) AS std FROM (SELECT i, embedding[i]::DOUBLE AS x FROM (SELECT embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)) GROUP BY i")(
    lambda s, d: learned.scaler(table(s, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))).select("i", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
)
query("attack_miaadv")(lambda s, d: registry.run_attack("miaadv", samples(s, d), model=model(s, d), features=measures.TrainedFeatures(table(s, d, "conversations"))))

# --- bag of words

_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_BOW = f"""{SAMPLES}, w AS (SELECT blob_id, {_W} AS w FROM samples), g AS (SELECT blob_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM w),
tf AS (SELECT blob_id, term, count(*) AS tf FROM g GROUP BY ALL), vo AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 50000),
ti AS (SELECT blob_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM samples)) / (1 + df)) + 1) AS w FROM tf JOIN vo USING (term))"""
query("win_ngrams", f"WITH {_BOW} SELECT blob_id, term, tf FROM tf")(lambda s, d: learned.ngram_counts(samples(s, d)))
query("agg_vocab", f"WITH {_BOW} SELECT term, cf, df FROM vo")(lambda s, d: learned.vocabulary(learned.ngram_counts(samples(s, d))).select("term", "cf", "df"))
query("vocab_top_50k", f"WITH {_BOW} SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM vo")(lambda s, d: learned.vocabulary(learned.ngram_counts(samples(s, d))).select("term", "idx"))


@query("tfidf", f"WITH {_BOW} SELECT blob_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY blob_id)), 6) AS w FROM ti")
def _tfidf(s, d):
    rows = samples(s, d)
    counts = learned.ngram_counts(rows)
    return learned.tfidf(counts, learned.vocabulary(counts), rows.count()).select("blob_id", "term", F.round("w", 6).alias("w"))


query("attack_bow")(lambda s, d: registry.run_attack("bow", samples(s, d)))
query("topk_features")(lambda s, d: learned.BagOfWords().fit(samples(s, d)).top_features())

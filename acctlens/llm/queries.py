"""One query per operator of this package, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctlens.llm import (bottom_k, byte_bpe, cross_polytope, fill_middle, lm_score, packing, pivotal_grams, secret_scan,
                          simhash_bk, simple8b, toxicity, url_lm, vertical_join)

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _blend_sql(order: int, kind: str) -> str:
    """Witten-Bell of one order and class over counts n{order}, contexts t{order} and the order below."""
    lower = "1 / 32.0" if order == 1 else f"p{order - 1}{kind}"
    return (f"CASE WHEN coalesce(t{order}.n{kind}, 0) > 0 THEN (coalesce(n{order}.n{kind}, 0) + t{order}.k{kind} * ({lower})) "
            f"/ (t{order}.n{kind} + t{order}.k{kind}) ELSE {lower} END AS p{order}{kind}")


def _order_sql(order: int) -> str:
    gram = "abcd"[4 - order:]
    context = gram[:-1]
    keys = lambda g: ", ".join(g)
    sums = "sum(na) AS na, sum(nb) AS nb"
    on = lambda t, g: " AND ".join(f"{t}{order}.{x} = q.{x}" for x in g) or "TRUE"
    return f"""n{order} AS (SELECT {keys(gram)}, {sums} FROM n GROUP BY {keys(gram)}),
t{order} AS (SELECT {keys(context) + ", " if context else ""}{sums}, count(*) FILTER (WHERE na > 0) AS ka, count(*) FILTER (WHERE nb > 0) AS kb
       FROM n{order}{" GROUP BY " + keys(context) if context else ""}),
q{order} AS (SELECT q.*, {_blend_sql(order, "a")}, {_blend_sql(order, "b")} FROM q{order - 1} q
       LEFT JOIN n{order} ON {on("n", gram)} LEFT JOIN t{order} ON {on("t", context)}),"""


_OP1_SQL = """
WITH u AS (SELECT page_id, row_number() OVER () AS r, coalesce(url, '') AS url,
                  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, coalesce(rest, url) AS txt, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h0 FROM u),
b AS (SELECT page_id, r, txt, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(coalesce(rest, ''), length(h0) + 1), '^[^?#]*') AS path FROM h),
v AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM b),
w AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rv FROM v),
ch AS (SELECT r, rv, i, CASE WHEN i > length(txt) THEN NULL ELSE unicode(substr(txt, i, 1)) END AS x
       FROM w, LATERAL (SELECT unnest(range(1, length(txt) + 2)) AS i)),
sy AS (SELECT r, rv, i, CASE WHEN x IS NULL THEN 0 WHEN x BETWEEN 97 AND 122 THEN x - 96 WHEN x BETWEEN 65 AND 90 THEN x - 64
                             WHEN x BETWEEN 48 AND 57 THEN 27 WHEN x = 47 THEN 28 WHEN x = 46 THEN 29 WHEN x IN (45, 95) THEN 30 ELSE 31 END AS s FROM ch),
g AS (SELECT r, rv, s AS d, coalesce(lag(s, 1) OVER o, 0) AS c, coalesce(lag(s, 2) OVER o, 0) AS b, coalesce(lag(s, 3) OVER o, 0) AS a
      FROM sy WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT a, b, c, d, count(*) FILTER (WHERE rv = 'allow') AS na, count(*) FILTER (WHERE rv = 'block') AS nb FROM g WHERE rv IS NOT NULL GROUP BY a, b, c, d),
q0 AS (SELECT DISTINCT a, b, c, d FROM g),
""" + "\n".join(_order_sql(k) for k in (1, 2, 3, 4)) + """
sc AS (SELECT g.r, sum(CAST(round((ln(p4a) - ln(p4b)) * 1e6) AS BIGINT)) / count(*) / 1e6 AS score FROM g JOIN q4 USING (a, b, c, d) GROUP BY g.r),
s AS (SELECT w.*, sc.score FROM w JOIN sc USING (r)),
hb AS (SELECT floor(score / 0.005) AS bin, count(*) FILTER (WHERE rv = 'allow') AS al, count(*) FILTER (WHERE rv = 'block') AS bl
       FROM s WHERE rv IS NOT NULL GROUP BY 1),
k AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) AS low,
             round(1 - (sum(al) OVER (ORDER BY bin) - al) / sum(al) OVER () + (sum(bl) OVER (ORDER BY bin) - bl) / sum(bl) OVER (), 12) AS kept FROM hb),
th AS (SELECT (min(low) + max(bin)) / 2 * 0.005 AS t FROM k WHERE kept = (SELECT max(kept) FROM k))
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict FROM s, th"""


@register("op1_url_filter", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@register("op4_nearest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = simple8b.token_folder(spark)
    simple8b.write_token_files(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return simple8b.document_digests(simple8b.read_token_files(spark, folder))


@register("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@register("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.neighbour_digests(_table(spark, sf_dir, "documents"))


@register("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return byte_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"),
                                       public_tokenizers.PATTERN)


@register("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@register("op10_lm_score")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return lm_score.word_difference(documents, labels.where(F.col("quality") == 1).select("doc_id"))


_OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS lo, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(list_slice(tokens, 1, lo), '') AS prefix, array_to_string(list_slice(tokens, lo + 1, hi), '') AS middle,
             array_to_string(list_slice(tokens, hi + 1, n), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


@register("op11_fill_middle", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivotal_grams.variant_forms(pivotal_grams.words_of(_table(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


_OP13_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
c AS (SELECT min(r) AS c, list_sort(g) AS g FROM s GROUP BY list_sort(g)),
m AS (SELECT s.r, s.doc_id, len(s.g) AS n, c.c FROM s JOIN c ON c.g = list_sort(s.g)),
t AS (SELECT c, len(g) AS n, unnest(g) AS x FROM c),
o AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.c <> b.c GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * k >= 80 * (na + nb - k)),
reach AS (SELECT c AS a, c AS b FROM c WHERE len(g) > 0 UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
low AS (SELECT reach.a AS c, min(m.doc_id) AS low FROM reach JOIN m ON m.c = reach.b GROUP BY reach.a)
SELECT m.doc_id, m.n AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE low.low END AS component_id FROM m LEFT JOIN low ON low.c = m.c"""


@register("op13_ngram_join", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical_join.link_documents(_table(spark, sf_dir, "documents"))

"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshelf.llm import byte_bpe, merkle, pii, secrets, spelling, token_files, toxicity, warc
from loomshelf.llm.common import read
from loomshelf.llm.decontaminate import leaks
from loomshelf.llm.exact_dedup import exact_dedup
from loomshelf.llm.line_dedup import line_verdicts
from loomshelf.llm.perplexity import judge
from loomshelf.llm.simhash import simhash_components

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, words=secrets.ranks(secrets.corpus_words(docs))).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "guess")],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(read(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = read(spark, sf_dir, "documents").select("doc_id", byte_bpe.round_trip(F.col("text")).alias("coded"))
    return coded.select("doc_id", "coded.*").select(
        "doc_id",
        F.expr("CAST(octet_length(token_ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_hash")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = toxicity.train(docs, labels.where(~fold))
    scored = toxicity.score(docs.select("doc_id", "text", fold.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(token_files.write_tokens(read(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(read(spark, sf_dir, "documents")).drop("text_hash")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(read(spark, sf_dir, "documents"), slip=97))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(struck, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(docs, field_cols=fields, presented=merkle.leaf_digest(*[docs[c] for c in fields[:-1]], text))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling": op11_spelling,
    "op12_pii": op12_pii,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM h
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "op10_line_dedup": r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM t),
     b AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
     c AS (SELECT doc_id, line_no, len(w) AS n, w, md5(array_to_string(w, ' ')) AS k, doc_id * 1000000000 + line_no AS o FROM b WHERE len(w) > 0),
     f AS (SELECT k, min(o) AS o, any_value(n) AS n, any_value(w) AS w FROM c GROUP BY k),
     p AS (SELECT o, n, w, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 5),
     v AS (SELECT o, n, i, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) AS v FROM p),
     s AS (SELECT o, min(o) OVER (PARTITION BY n, i, v) AS q FROM v),
     d AS (SELECT v.o AS x, f.o AS y FROM v JOIN f ON f.k = v.v AND f.n = v.n - 1 AND f.n >= 5),
     e AS (SELECT o, q FROM s UNION ALL SELECT x, y FROM d UNION ALL SELECT y, x FROM d),
     m AS (SELECT o, min(q) AS q FROM e WHERE q < o GROUP BY o),
     g AS (SELECT f.k, coalesce(m.q, f.o) AS q FROM f LEFT JOIN m ON f.o = m.o)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(n AS INTEGER) AS n_words, o = q AS kept, q // 1000000000 AS keep_doc_id,
       CAST(q % 1000000000 AS INTEGER) AS keep_line_no
FROM c JOIN g ON c.k = g.k""",
    "op11_spelling": r"""
WITH RECURSIVE z AS (SELECT list(list_reduce([k, -1, -1, -1, -1, -1, -1, -1, -1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY k) AS z FROM (SELECT unnest(range(256)) AS k)),
     r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
     g AS (SELECT doc_id, r, count(*) AS n FROM r WHERE length(r) >= 5 GROUP BY ALL),
     h AS (SELECT r, n, xor(4294967295, list_reduce(list_concat([4294967295],
                  flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))),
                  lambda x, y: xor(x >> 8, z.z[(xor(x, y) & 255) + 1]))) AS h
           FROM g, z),
     c AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM h),
     w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     v AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
     p AS (SELECT a.word, b.word AS near, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
           UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word
           UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
     q AS (SELECT word, count(*) AS n_near, min({'m': -m, 'near': near}) AS best FROM p GROUP BY word),
     f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.near END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n
           FROM w LEFT JOIN q ON w.word = q.word),
     t AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT t.word, f.form, k + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
     e AS (SELECT word, arg_max(root, k) AS root FROM t GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON f.word = e.word""",
    "op13_merkle": r"""
WITH RECURSIVE d AS (
       SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i,
              list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
                          lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END) % 2 = 1 AS struck
       FROM documents),
     h AS (SELECT doc_id, g, i, struck, replace(text, chr(10), '') AS t,
                  concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
                                CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                                CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                                CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head,
                  CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS own FROM d),
     l AS (SELECT doc_id, g, i, sha256(head || own) AS leaf,
                  sha256(head || CASE WHEN coalesce(struck, FALSE) AND t IS NOT NULL THEN strlen(t) || ':' || t ELSE own END) AS shown FROM h),
     u AS (SELECT 0 AS lvl, g, i, leaf AS x, count(*) OVER (PARTITION BY g) AS n FROM l
           UNION ALL
           SELECT lvl + 1, g, i // 3, sha256(string_agg(x, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, g, i // 3, n),
     s AS (SELECT g, x AS subroot FROM u WHERE n = 1),
     v AS (SELECT 0 AS lvl, g AS i, subroot AS x, count(*) OVER () AS n FROM s
           UNION ALL
           SELECT lvl + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (n + 2) // 3 FROM v WHERE n > 1 GROUP BY lvl, i // 3, n),
     a AS (SELECT lvl, g, i, x, n FROM u UNION ALL SELECT lvl + 1000, -1, i, x, n FROM v),
     r AS (SELECT lvl, g, i, coalesce(string_agg(x, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le,
                  coalesce(string_agg(x, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri
           FROM a WHERE n > 1 WINDOW w AS (PARTITION BY lvl, g, i // 3 ORDER BY i)),
     p AS (SELECT l.doc_id, l.g, l.i, list({'le': r.le, 'ri': r.ri} ORDER BY r.lvl) FILTER (r.lvl IS NOT NULL) AS steps
           FROM l LEFT JOIN r ON (r.lvl < 1000 AND r.g = l.g AND r.i = l.i // CAST(pow(3, r.lvl) AS BIGINT))
                              OR (r.lvl >= 1000 AND r.i = l.g // CAST(pow(3, r.lvl - 1000) AS BIGINT)) GROUP BY ALL),
     f AS (SELECT l.doc_id, leaf, subroot, (SELECT x FROM v WHERE n = 1) AS root, coalesce(steps, []) AS steps,
                  list_reduce(list_concat([{'le': shown, 'ri': ''}], coalesce(steps, [])), lambda y, z: {'le': sha256(z.le || y.le || z.ri), 'ri': ''}).le AS folded_root
           FROM l JOIN s ON l.g = s.g JOIN p ON p.g = l.g AND p.i = l.i)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda z: z.le || z.ri), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM f""",
}

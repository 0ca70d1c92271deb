"""The queries op1 to op13 over the driver's tables, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import ann_search
from .bpe import bpe_decode, bpe_encode
from .classifier import FtrlConfig, score, train, training_rows
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .filter_audit import document_flags, replay_orders
from .lm_scoring import lm_scores
from .packing import pack_documents
from .shingle_join import shingle_components
from .spelling import spelling_forms, word_counts
from .token_counts import token_counts
from .url_filter import DAMPING, LINKS, LOWER, STEPS, THRESHOLD, UPPER, Rule, url_filter
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of an id's text, modulo folds; a null id is in no fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    decoded = bpe_decode(encoded, path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("digest", "text_sha256")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM t
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10))


#: A document is predicted good from this score on.
GOOD = 0.7


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, config = table(spark, sf_dir, "documents"), FtrlConfig()
    weights = train(training_rows(docs, table(spark, sf_dir, "labels"), lambda i: fold(i, 4) != 2, config), config)
    return score(docs, weights, config).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


#: Documents of more tokens are over the limit.
TOKEN_LIMIT = 4096


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"), n=4, percent=85)


#: Brute force over all pairs that share a shingle.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
edges AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS c FROM edges UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def _op8_sql() -> str:
    """The steps of the rank, unrolled."""
    after = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    host = lambda u: f"translate(regexp_extract({after(u)}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    steps = [
        f"""p AS MATERIALIZED (SELECT page_id, html, {host("coalesce(url, '')")} AS host, regexp_extract({after("coalesce(url, '')")}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
        f"rules(verdict, rhost, rpath) AS (VALUES {rules})",
        """fit AS MATERIALIZED (SELECT page_id, html, p.host, p.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS ruling
FROM p LEFT JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY ALL)""",
        f"links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{LINKS.replace(chr(39), chr(39) * 2)}', 1)) AS u FROM p)",
        f"""named AS (SELECT src, {host("u")} AS dst FROM (SELECT src, CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END AS u FROM links WHERE starts_with(u, '//') OR regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://')))""",
        "counted AS (SELECT src, dst, count(*) AS n FROM named WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL)",
        "edges AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM counted)",
        "ways AS MATERIALIZED (SELECT src AS host, dst AS to_, 0 AS kind, share FROM edges UNION ALL SELECT dst, src, 1, share / sum(share) OVER (PARTITION BY dst) FROM edges)",
        f"""r0 AS MATERIALIZED (SELECT host, 0 AS kind, count(*) * {1 - DAMPING} AS rank FROM fit WHERE ruling = 'allow' GROUP BY host UNION ALL SELECT host, 1, count(*) * {1 - DAMPING} FROM fit WHERE ruling = 'block' GROUP BY host)""",
    ]
    for k in range(1, STEPS + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT host, kind, sum(rank) AS rank FROM (SELECT * FROM r0 UNION ALL SELECT to_, w.kind, rank * share * {DAMPING} FROM r{k - 1} r JOIN ways w ON r.host = w.host AND r.kind = w.kind) GROUP BY ALL)")
    steps.append(f"marks AS (SELECT host, round(coalesce(sum(rank) FILTER (kind = 0), 0), 9) AS trust, round(coalesce(sum(rank) FILTER (kind = 1), 0), 9) AS distrust FROM r{STEPS} GROUP BY host)")
    last = f"SELECT page_id, f.host, path, rule, coalesce(ruling, CASE WHEN coalesce(distrust > {THRESHOLD} * (trust + distrust), false) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM fit f LEFT JOIN marks m ON m.host = f.host"
    return "WITH " + ", ".join(steps) + " " + last


OP8_SQL = _op8_sql()


#: A digest's 160 bits, five at a time.
OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS keep, CAST(CAST(from_hex(sha) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM b
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Follows the ids of each document.
END_ID = 2


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


#: A run whose crc32 this divides has a slip of the pen.
SLIP = 97


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(word_counts(table(spark, sf_dir, "documents"), slip=SLIP))


#: The reversed polynomial of the crc32.
CRC = 0xEDB88320


def _op11_sql() -> str:
    """The crc32 by its table of bytes, near words by what is left without one code point."""
    bit = f"list_transform({{}}, lambda c: CASE WHEN c % 2 = 1 THEN xor(c // 2, {CRC}) ELSE c // 2 END)"
    byte = "range(256)"
    for _ in range(8):
        byte = bit.format(byte)
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {byte} AS t),
runs AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) WHERE length(r) >= 5 GROUP BY ALL),
bytes AS (SELECT r, n, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs),
hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
near AS MATERIALIZED (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM less x JOIN less y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, v.word, v.n FROM less x JOIN v ON v.word = x.a || x.b UNION SELECT v.word, v.n, x.word, x.n FROM less x JOIN v ON v.word = x.a || x.b),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * v.n THEN b.near_n END AS form_n,
         CASE WHEN b.near_n >= 2 * v.n THEN (SELECT min(near) FROM near x WHERE x.word = v.word AND x.near_n = b.near_n) END AS form
  FROM v LEFT JOIN best b ON b.word = v.word),
chain AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, n, f.form, root, n_near, form_n FROM forms f JOIN chain c ON c.word = f.word WHERE c.next IS NULL
"""


OP11_SQL = _op11_sql()


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Brute force: every run of as many words as a window has, of every document.
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS t FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: {{'i': i, 't': array_to_string(w[i : i + size - 1], ' ')}})) AS r FROM d, sizes WHERE len(w) >= size),
hits AS MATERIALIZED (SELECT doc_id, r.i AS i, r.size AS size, item_id FROM runs r JOIN windows x ON x.size = r.size AND x.t = r.r.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_orders(document_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END) AS fails FROM t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN marks m ON m.doc_id = f.doc_id GROUP BY ALL),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
replay AS (
  SELECT part, fails, good, toxic, n, o, step, o[step] AS letter, least(CASE WHEN contains(fails, 'A') THEN instr(o, 'A') ELSE 6 END, CASE WHEN contains(fails, 'B') THEN instr(o, 'B') ELSE 6 END,
    CASE WHEN contains(fails, 'C') THEN instr(o, 'C') ELSE 6 END, CASE WHEN contains(fails, 'D') THEN instr(o, 'D') ELSE 6 END, CASE WHEN contains(fails, 'E') THEN instr(o, 'E') ELSE 6 END) AS first
  FROM docs, orders, range(1, 6) AS s(step)),
counted AS (
  SELECT part, o AS filter_order, step, letter, coalesce(sum(n) FILTER (first > step), 0) AS kept, coalesce(sum(n) FILTER (first = step), 0) AS removed,
    coalesce(sum(n) FILTER (first < step AND contains(fails, letter)), 0) AS redundant, coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
    coalesce(sum(n) FILTER (first = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (first = step AND toxic), 0) AS toxic_lost FROM replay GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality": op4_quality,
    "op5_ann": op5_ann,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_url_filter": op8_url_filter,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_decontaminate": op12_decontaminate,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_url_filter": OP8_SQL, "op9_warc": OP9_SQL, "op11_spelling": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_filter_audit": OP13_SQL}

"""One query for each operator, over its whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm import (
    bitpack, decontaminate, hilbert_search, lexical_search, licenses, line_dedup, minhash, packing,
    resampling, sharding, suffix_repeats, toxicity, warc,
)
from tickloom.llm.tables import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: shingles of four words, similarity of 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 length buckets and batches of 65,536 padded tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back in byte ranges."""
    return warc.archive_table(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


TOXIC_FROM = 0.3


def held_out() -> Column:
    """Whether a row's label is kept out of training."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def op4_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"),
                         toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one, among all."""
    return hilbert_search.nearest(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards: five regions of two racks of four."""
    return sharding.shard_documents(
        table(spark, sf_dir, "documents"), sharding.Topology.uniform(5, 2, 4))


def op7_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, taken as files.

    English documents stand in the directory of their source and others in one below it for their
    language; a document whose first or last line states a licence speaks for its directory.
    """
    path = F.concat_ws("/", "source", F.when(F.col("lang") != "en", F.col("lang")),
                       F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(
        "doc_id", "text", path.alias("path"), (F.size(F.split("text", "\n")) - 1).alias("last"))
    found = licenses.scan_licenses(
        files, "path", licence_file=(F.col("own_line") == 0) | (F.col("own_line") == F.col("last")))
    score = F.floor(F.col("own_score") * 1e6 + 0.5) / 1e6
    return found.select("doc_id", "path", "own_license", score.alias("own_score"), "own_line",
                        "license", "license_dir")


def op8_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against ten-word windows of all benchmark items."""
    found = decontaminate.decontaminate(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[F.col(f"__found.{c}").alias(c) for c in (
        "n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op9_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level token ids, written bit-packed and read back."""
    return bitpack.token_table(
        table(spark, sf_dir, "documents"), TOKENIZER)


def op10_near_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the lines that repeat earlier lines: within two edits, or short ones exactly."""
    found = line_dedup.dedup_lines(
        table(spark, sf_dir, "documents").select("doc_id", "text"), short_copies=True)
    return found.select("doc_id", "__lines.n_lines", F.size("__lines.removed").alias("n_removed"),
                        "__lines.removed")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words, drawn towards the benchmark's features."""
    drawn = resampling.resample(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item, of all documents."""
    return lexical_search.search(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 35 words that occur more than once."""
    found = suffix_repeats.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"__repeats.{c}").alias(c) for c in (
        "n_words", "n_removed", "kept_sha256")])


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dups": op1_minhash_near_dups,
    "op2_length_buckets": op2_length_buckets,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_string_kernel_toxicity": op4_string_kernel_toxicity,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_hash_tree_shards": op6_hash_tree_shards,
    "op7_license_inheritance": op7_license_inheritance,
    "op8_benchmark_windows": op8_benchmark_windows,
    "op9_packed_token_ids": op9_packed_token_ids,
    "op10_near_line_dedup": op10_near_line_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_lexical_search": op12_lexical_search,
    "op13_suffix_repeats": op13_suffix_repeats,
}


#: Ten-word windows of the items, looked for among those of the documents.
OP8_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
piece AS (SELECT item_id, len(g) AS size, g AS words FROM (
    SELECT item_id, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
        lambda i: w[i:i + least(10, len(w)) - 1])) AS g FROM item WHERE len(w) > 0)),
shape AS (SELECT DISTINCT size FROM piece),
place AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM doc, shape
    WHERE len(w) >= size),
hit AS (SELECT doc_id, pos, place.size, item_id FROM place
    JOIN piece ON piece.words = place.w[pos:pos + place.size - 1] AND piece.size = place.size),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
    SELECT doc_id, unnest(range(pos, pos + size)) AS k FROM (SELECT DISTINCT doc_id, pos, size FROM hit))
    GROUP BY doc_id),
owner AS (SELECT doc_id, count(*) AS n_items,
    sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN owner USING (doc_id)
"""

#: Base-32 digits from the 40 hexadecimal digits of SHA-1, four for each five.
OP3_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
named AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM page),
digits AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT
        >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest FROM named),
first AS (SELECT h, min(page_id) AS page FROM named GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = page THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> page THEN page END AS refers_to
FROM digits JOIN first USING (h)
"""

#: Cosines of all lines with all templates, then the nearest of at most two directories.
OP7_SQL = """
WITH template(license, notice) AS (VALUES {templates}),
part AS (SELECT license, unnest(list_filter(string_split_regex(lower(notice), '[^a-z0-9]+'),
    lambda w: w <> '')) AS word FROM template),
doc AS (SELECT doc_id, text, concat_ws('/', source, CASE WHEN lang <> 'en' THEN lang END) AS dir,
    concat_ws('/', source, CASE WHEN lang <> 'en' THEN lang END, doc_id) AS path, source FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS place
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM doc)),
token AS (SELECT doc_id, place, word, count(*) AS n FROM (SELECT doc_id, place,
    unnest(string_split_regex(lower(line), '[^a-z0-9]+')) AS word FROM line)
    WHERE word <> '' GROUP BY ALL),
size AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT word, ln((any_value(size.n) + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf
    FROM (SELECT doc_id, word FROM token UNION SELECT NULL, word FROM part),
    size GROUP BY word),
raw AS (SELECT license, word, count(*) * any_value(idf) AS v FROM part JOIN idf USING (word)
    GROUP BY license, word),
vector AS (SELECT license, word, v / sqrt(sum(v * v) OVER (PARTITION BY license)) AS v FROM raw),
norm AS (SELECT doc_id, place, sqrt(sum((token.n * idf) ** 2)) AS norm
    FROM token JOIN idf USING (word) GROUP BY doc_id, place),
score AS (SELECT doc_id, place, license, sum(n * idf * v) / any_value(norm) AS score
    FROM token JOIN idf USING (word) JOIN vector USING (word) JOIN norm USING (doc_id, place)
    GROUP BY doc_id, place, license),
own AS (SELECT doc_id, place, license, score FROM score WHERE score >= 0.7
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place, license) = 1),
governed AS (SELECT dir, license FROM own JOIN doc USING (doc_id)
    WHERE place IN (0, len(string_split(text, chr(10))) - 1)
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path, license) = 1)
SELECT doc_id, path, own.license AS own_license, floor(score * 1e6 + 0.5) / 1e6 AS own_score,
    place::INTEGER AS own_line, coalesce(own.license, here.license, above.license, root.license) AS license,
    CASE WHEN own.license IS NULL THEN CASE WHEN here.license IS NOT NULL THEN doc.dir
        WHEN above.license IS NOT NULL THEN doc.source
        WHEN root.license IS NOT NULL THEN '' END END AS license_dir
FROM doc LEFT JOIN own USING (doc_id) LEFT JOIN governed AS here ON here.dir = doc.dir
LEFT JOIN governed AS above ON above.dir = doc.source LEFT JOIN governed AS root ON root.dir = ''
""".format(templates=", ".join(f"('{name}', '{notice}')" for name, notice in licenses.TEMPLATES))

#: CRC-32 of each distinct feature, byte by byte through the table of its 256 steps.
OP11_SQL = r"""
WITH step AS (SELECT list(list_reduce(list_concat([i], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) AS r(i)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
item AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
seen AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
        lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM doc),
wanted AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)),
        lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM item),
name AS (SELECT DISTINCT f FROM (SELECT f FROM seen UNION ALL SELECT f FROM wanted)),
bytes AS (SELECT f, list_concat([4294967295], list_transform(range(1, 2 * strlen(f), 2),
        lambda i: ('0x' || substr(hex(encode(f)), i, 2))::BIGINT)) AS b FROM name),
bucket AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 10000
    AS bucket FROM bytes, step),
held AS (SELECT bucket, count(*) AS n FROM seen JOIN bucket USING (f) GROUP BY bucket),
aim AS (SELECT bucket, count(*) AS n FROM wanted JOIN bucket USING (f) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM held) AS s, (SELECT coalesce(sum(n), 0)::BIGINT FROM aim) AS t),
gain AS (SELECT held.bucket, floor(1000 * ln(((coalesce(aim.n, 0) + 1) * (s + 10000))::DOUBLE
        / ((held.n + 1) * (t + 10000))::DOUBLE))::BIGINT AS gain
    FROM held LEFT JOIN aim USING (bucket), total),
weight AS (SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight, count(*) AS n_features
    FROM seen JOIN bucket USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM doc LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
    25 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

#: Scores of all documents for all items, from the terms of both.
OP12_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
corpus AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM doc WHERE len(w) > 0),
share AS (SELECT doc_id, 25 + (75 * len(w) * docs) // words AS m FROM doc, corpus WHERE len(w) > 0),
asked AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(w) AS term FROM item) GROUP BY ALL),
held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM held, corpus GROUP BY term),
score AS (SELECT item_id, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN share USING (doc_id)
    GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
    doc_id, score FROM score WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

#: Windows of 35 words by their text, which blanks cannot make ambiguous.
OP13_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
win AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM doc WHERE len(w) >= 35)),
again AS (SELECT doc_id, pos FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(pos, pos + 35)) AS k FROM again)
    GROUP BY doc_id),
word AS (SELECT doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM doc)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM word
    ANTI JOIN (SELECT doc_id, unnest(ks) AS pos FROM gone) USING (doc_id, pos) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracles() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op7_license_inheritance": OP7_SQL, "op3_warc_round_trip": OP3_SQL, "op8_benchmark_windows": OP8_SQL,
            "op11_importance_resampling": OP11_SQL, "op12_lexical_search": OP12_SQL,
            "op13_suffix_repeats": OP13_SQL}

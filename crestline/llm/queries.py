"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import decontam, html_tree, importance, langid, mixing, pii, quality_pu, quality_rules, sharding, simhash, token_output, variants, warc
from crestline.llm.shared import id_remainder, scratch, table

SHARDS = 8
#: What the SQL twins share: A-Z in lower case, words of letters and digits, and stand-ins of one byte for letters of two.
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FEATURE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOREIGN = "".join(map(chr, range(0xC0, 0x100)))
STAND_IN = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and c != 39)[:64]
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(id_remainder(F.col("doc_id")) != 0))
    return docs.select("doc_id", (id_remainder(F.col("doc_id")) == 0).alias("held_out"), langid.predict(F.col("text"), model, docs).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id", "n_links")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), scratch(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select("doc_id", "mix.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    refs = quality_rules.references(docs)
    return docs.select("doc_id", quality_rules.judged(F.col("text"), docs, refs).alias("r")).select("doc_id", "r.*")


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id")) == 0
    model = quality_pu.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scores = docs.select("doc_id", held_out.alias("held_out"), quality_pu.scored(F.col("text"), model, docs).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.all_spans(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("found"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("found")), 256).alias("base_sha256"), pii.joined(F.concat("found", "terms")).alias("spans"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_tree.train(pages)
    return pages.select("page_id", "url", html_tree.main_text(F.col("html"), model, pages).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", decontam.leaked(docs, table(spark, sf_dir, "benchmark")).alias("items"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), F.col("items.item_id").alias("item_ids"), F.array_min("items.distance").alias("least_distance"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_output.token_digest(token_output.read_tokens(spark, path))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced(table(spark, sf_dir, "documents"), scratch(spark, "slot-map"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place_in_shard").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


def crc32_sql(blob: str) -> str:
    """CRC-32 of a BLOB, half a byte at a time; the list holds the values of all half bytes."""
    half = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
    at = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT)"
    first = f"xor({half}[(xor(c, b) & 15) + 1], c >> 4)"
    second = f"xor({half}[(xor({first}, b >> 4) & 15) + 1], ({first}) >> 4)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {at}), lambda c, b: {second}))"


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_warc, op4_mixing, op5_quality_rules, op6_quality_pu, op7_pii, op8_html_text, op9_decontamination, op10_token_output, op11_importance, op12_sharding, op13_spelling_variants)}
ORACLES: dict[str, str] = {
    "op3_warc": """SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last_id <> page_id THEN last_id END AS refers_to
    FROM pages LEFT JOIN (SELECT html, max(page_id) AS last_id FROM pages WHERE octet_length(encode(html)) >= 1000 GROUP BY html HAVING count(*) > 1) USING (html)""",
    "op11_importance": rf"""WITH features AS (SELECT 's' AS side, doc_id, unnest(regexp_extract_all({LOWER_SQL}, '{FEATURE}')) AS w FROM documents
      UNION ALL SELECT 't', NULL, unnest(regexp_extract_all({LOWER_SQL}, '{FEATURE}')) FROM benchmark),
    buckets AS (SELECT w, {crc32_sql("encode(w)")} % 10000 AS b FROM (SELECT DISTINCT w FROM features)),
    placed AS (SELECT side, doc_id, b FROM features JOIN buckets USING (w)),
    sizes AS (SELECT count(*) FILTER (side = 's')::DOUBLE AS s_all, count(*) FILTER (side = 't')::DOUBLE AS t_all FROM placed),
    gains AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
      FROM (SELECT b, count(*) FILTER (side = 's')::DOUBLE AS s, count(*) FILTER (side = 't')::DOUBLE AS t FROM placed GROUP BY b), sizes),
    means AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gains USING (b) WHERE side = 's' GROUP BY doc_id),
    scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN means USING (doc_id)),
    ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scores LEFT JOIN ranks USING (doc_id)""",
    "op12_sharding": f"""WITH RECURSIVE records AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("encode(coalesce(text, ''))")} AS crc, ({crc32_sql("encode(doc_id::VARCHAR)")} % 4096)::INT AS vs FROM documents),
    units AS (SELECT vs, sum(size)::BIGINT AS bytes, count(*) AS n, (vs * {SHARDS} // 4096)::INT AS home, row_number() OVER (ORDER BY sum(size) DESC, vs) AS k FROM records GROUP BY vs),
    total AS (SELECT sum(bytes)::BIGINT AS total FROM units),
    stay(k, vs, loads, fits) AS (SELECT 0::BIGINT, NULL::INT, list_transform(range({SHARDS}), lambda x: 0::BIGINT), false
      UNION ALL SELECT u.k, u.vs, CASE WHEN (s.loads[u.home + 1] + u.bytes) * {SHARDS} <= total THEN list_transform(s.loads, lambda x, i: x + CASE WHEN i = u.home + 1 THEN u.bytes ELSE 0 END) ELSE s.loads END,
        (s.loads[u.home + 1] + u.bytes) * {SHARDS} <= total FROM stay s JOIN units u ON u.k = s.k + 1, total),
    gone AS (SELECT u.vs, u.bytes, row_number() OVER (ORDER BY u.k) AS g FROM stay s JOIN units u USING (vs) WHERE NOT s.fits),
    move(g, vs, loads, shard) AS (SELECT 0::BIGINT, NULL::INT, (SELECT loads FROM stay ORDER BY k DESC LIMIT 1), NULL::INT
      UNION ALL SELECT o.g, o.vs, list_transform(m.loads, lambda x, i: x + CASE WHEN i = list_position(m.loads, list_min(m.loads)) THEN o.bytes ELSE 0 END), list_position(m.loads, list_min(m.loads))::INT - 1 FROM move m JOIN gone o ON o.g = m.g + 1),
    shards AS (SELECT u.vs, coalesce(m.shard, u.home) AS shard FROM units u LEFT JOIN move m USING (vs))
    SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY vs, doc_id, crc, size) - 1 AS slot, NULL::INT AS grown_shard, vs AS virtual_slot FROM records JOIN shards USING (vs)""",
    "op13_spelling_variants": f"""WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
    hashed AS (SELECT *, {crc32_sql("encode(doc_id || ':' || run)")} AS h FROM runs),
    words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    plain AS (SELECT word, n, length(word) AS size, translate(word, '{FOREIGN}', '{STAND_IN}') AS w FROM words),
    near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM plain a JOIN plain b ON abs(a.size - b.size) <= 1 AND levenshtein(a.w, b.w) = 1),
    best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN form END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
    chains AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chains c USING (word) JOIN forms e ON e.word = c.root WHERE e.form IS NULL""",
}

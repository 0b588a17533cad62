"""One query per operator over its whole table, and the SQL it should equal where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdcover.llm import (align, bpe, chat, exact_dedup, filter_audit, jaccard_join, line_dedup,
                            packing, quality_rules, toxicity, training_order, url_filter, warc)

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

#: The rules of op1: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Labels of these documents may be learned from.
TRAIN = "crc32(cast(doc_id AS string)) % 4 <> 2"
SHUFFLE_KEY = 20_240_229


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The listed URLs are those of pages whose number is a document labelled toxic."""
    pages = _read(spark, folder, "pages").select("page_id", "url")
    toxic = _read(spark, folder, "labels").where("toxic = 1").select("doc_id").distinct()
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)(?:[^0-9/]|/?$|/?[?#])', 1) AS bigint)")
    listed = (pages.withColumn("doc_id", number).join(toxic, "doc_id")
              .select("url", F.lit("block").alias("verdict")))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


OP1 = r"""
WITH parsed AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
           try_cast(regexp_extract(url, '/([0-9]+)(?:[^0-9/]|/?$|/?[?#])', 1) AS bigint) AS doc_id
    FROM pages),
listed AS (
    SELECT DISTINCT host, regexp_replace(path, '/+$', '') AS path FROM parsed
    WHERE host <> '' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting AS (
    SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
    FROM (SELECT DISTINCT host, path FROM parsed) u
    JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY host, path)
SELECT page_id, a.host, a.path, rule,
       coalesce(v, CASE WHEN l.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM parsed a LEFT JOIN fitting f ON a.host = f.host AND a.path = f.path
LEFT JOIN listed l ON a.host = l.host AND regexp_replace(a.path, '/+$', '') = l.path
"""


def op2_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the written order; ids_crc32 is that of the record read back from its shard."""
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    layout, index = training_order.materialise(docs, WORD_TOKENIZER, SHUFFLE_KEY)
    back = training_order.read_records(spark, layout).select("slot", F.crc32("ids").alias("ids_crc32"))
    return index.drop("ids_crc32").join(back, "slot")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "source", "text")
    return quality_rules.judge(docs, carry=["doc_id"]).select(
        "doc_id", *quality_rules.MEASURES, "base_failed", "kept")


OP3 = rf"""
WITH words AS (
    SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(
        coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
triples AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS t FROM windows),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c
                                 FROM triples) WHERE c > 1),
repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) AS r(k) GROUP BY doc_id),
measured AS (
    SELECT words.doc_id, source, len(w)::bigint AS n_words,
           length(regexp_replace(text, '[ \t-\r]', '', 'g'))::bigint AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
           len(lines) AS n_lines, coalesce(n, 0)::bigint AS n_repeat_words
    FROM words LEFT JOIN repeated USING (doc_id)),
judged AS (
    SELECT *, n_words < {quality_rules.MIN_WORDS}
              OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed,
           [n_words < {quality_rules.MIN_WORDS},
            100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words,
            100 * n_symbols > {quality_rules.MAX_SYMBOLS} * word_chars,
            100 * n_dup_lines > {quality_rules.MAX_DUP_LINES} * n_lines] AS failed
    FROM measured),
hosts AS (
    SELECT source, rule, count(*)::double AS n, count(*) FILTER (failed[rule])::double AS f
    FROM judged, range(1, {len(quality_rules.RULES)} + 1) AS r(rule) WHERE source IS NOT NULL
    GROUP BY source, rule),
sums AS (
    SELECT rule, count(*)::double AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) AS squares,
           sum(n * n) AS sizes FROM hosts GROUP BY rule),
spread AS (
    SELECT rule, m, CASE WHEN k < 2 OR m * (1 - m) = 0 OR n * n <= sizes OR n <= k THEN NULL ELSE
        ((squares - m * m * n) / (k - 1) - (m * n - squares) / (n - k))
        / ((squares - m * m * n) / (k - 1)
           + ((n - sizes / n) / (k - 1) - 1) * (m * n - squares) / (n - k)) END AS s FROM sums),
prior AS (
    SELECT rule, m, CASE WHEN s IS NULL OR s <= 1 / ({quality_rules.DEFAULT_WEIGHT} + 1)
                         THEN {quality_rules.DEFAULT_WEIGHT} ELSE 1 / least(s, 0.999) - 1 END AS weight
    FROM spread),
posterior AS (
    SELECT source, (f + m * weight) / (n + weight) AS mean, n + weight AS total
    FROM hosts JOIN prior USING (rule)),
rejected AS (
    SELECT source FROM posterior
    WHERE mean - {quality_rules.CERTAIN} * sqrt(mean * (1 - mean) / (total + 1)) > {quality_rules.MAX_SHARE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(source NOT IN (SELECT source FROM rejected), true) AS kept
FROM judged
"""


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes_of(_read(spark, folder, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup(_read(spark, folder, "documents").select("doc_id", "text"))


OP5 = r"""
WITH lines AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
    SELECT doc_id, i, [l[i], l[i + 1], l[i + 2]] AS w
    FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)),
firsts AS (
    SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY w) AS first FROM windows),
covered AS (
    SELECT doc_id, list(DISTINCT i + k) AS gone FROM firsts, range(3) AS r(k)
    WHERE (doc_id, i) > first GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([
           l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(gone, i)], chr(10)) END AS text,
       coalesce(len(gone), 0)::integer AS n_removed
FROM lines LEFT JOIN covered USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, folder, "labels"), F.expr(TRAIN))
    return toxicity.score(docs, model).select(
        "doc_id", (~F.expr(TRAIN)).alias("held_out"), "score", "predicted", "passages")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), WORD_TOKENIZER).drop("class")


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The lower half of the ids counts as the corpus so far."""
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    half = F.lit(None) if low is None else F.col("doc_id") < low + (high - low + 1) // 2
    return exact_dedup.dedup(docs, half).drop("text", "known")


OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, "text", BYTE_RANKS, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, "ids", BYTE_RANKS, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        bpe.sha256_of_ids("ids").alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


#: A conversation whose texts are control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): every conversation as JSON, in the layout that fits its roles: a prompt, an
    instruction, or one of three kinds of message lists by the number of turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles, text = F.transform("t", lambda t: t["role"]), lambda i: F.get("t", F.lit(i))["text"]

    def listed(role: str, content: str):
        return F.transform("t", lambda t: F.struct(t["role"].alias(role), t["text"].alias(content)))

    def record(**fields):
        return F.to_json(F.struct(F.coalesce("conv_id", F.lit(0)).alias("id"),
                                  *[v.alias(k) for k, v in fields.items()]))

    nested = F.transform("t", lambda t: F.struct(
        F.struct(t["role"].alias("role")).alias("speaker"), t["text"].alias("text")))
    layout = (F.when(roles == F.array(F.lit("user"), F.lit("assistant")),
                     record(prompt=text(0), response=text(1)))
              .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
                    record(system=text(0), instruction=text(1), output=text(2)))
              .when(F.size("t") % 3 == 0, record(messages=listed("role", "content")))
              .when(F.size("t") % 3 == 1, record(conversations=listed("from", "value")))
              .otherwise(record(dialog=F.struct(nested.alias("turns")))))
    return turns.select("conv_id", layout.alias("record"))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    hostile = F.array(*[F.struct(*map(F.lit, row)) for row in HOSTILE])
    rows = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(
        spark.range(1).select(F.inline(hostile)))
    turns = chat.canonical_turns(conversation_records(rows)).drop("record")
    out = chat.formatted(turns).select("conv_id", "formatted", "loss_spans")
    read = out.withColumns({"read": chat.read_turns(F.col("formatted")),
                            "loss": chat.under_mask(F.col("formatted"), F.col("loss_spans"))})
    line = F.array_join(F.transform("read", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_CONTROL = "|".join("".join(c if c.isalnum() or c == "_" else "\\" + c for c in s)
                    for s in sorted(chat.CONTROL, key=len, reverse=True))
OP10 = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                     (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
    SELECT *, len(regexp_extract_all(role || chr(10) || text, '{_CONTROL}')) AS breaks,
           length(role || text) - length(replace(role || text, chr(92), '')) AS slashes FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.START)} + length(role) + 1 + length(text) + {len(chat.END)} + 1
           + slashes + 2 * breaks)::bigint AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit_documents(docs, _read(spark, folder, "labels"), F.col("lang"))


OP11 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w
    FROM documents),
flagged AS (
    SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
           100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
           regexp_matches(text, '[#$%&*|]') AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM texts),
known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
    SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good,
           count(*) FILTER (toxic) AS toxic
    FROM flagged LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT v.l || w.l || x.l || y.l || z.l AS filter_order
    FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
ranked AS (
    SELECT cells.*, filter_order, least(
        CASE WHEN a THEN strpos(filter_order, 'A') ELSE 9 END,
        CASE WHEN b THEN strpos(filter_order, 'B') ELSE 9 END,
        CASE WHEN c THEN strpos(filter_order, 'C') ELSE 9 END,
        CASE WHEN d THEN strpos(filter_order, 'D') ELSE 9 END,
        CASE WHEN e THEN strpos(filter_order, 'E') ELSE 9 END) AS first
    FROM cells, orders),
steps AS (
    SELECT *, substr(filter_order, step, 1) AS letter,
           CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
           a::int + b::int + c::int + d::int + e::int AS k
    FROM ranked, (SELECT unnest(range(1, 6))::int AS step)),
counted AS (
    SELECT part, filter_order, step, letter,
           coalesce(sum(n) FILTER (first > step), 0)::bigint AS kept,
           coalesce(sum(n) FILTER (first = step), 0)::bigint AS removed,
           coalesce(sum(n) FILTER (fails AND first < step), 0)::bigint AS redundant,
           coalesce(sum(n) FILTER (fails AND k = 1), 0)::bigint AS unique_fails,
           coalesce(sum(good) FILTER (first = step), 0)::bigint AS good_lost,
           coalesce(sum(toxic) FILTER (first = step), 0)::bigint AS toxic_lost
    FROM steps GROUP BY ALL)
SELECT * EXCLUDE (letter),
       (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley FROM counted
"""


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    return align.aligned_documents(docs, BYTE_TOKENIZER, PIECE_MODEL).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page is written to an archive, all archives are read back, and revisits find the payload
    that they refer to."""
    pages = _read(spark, folder, "pages").select("page_id", "url", "html")
    archives = warc.write_archives(pages)
    records, _ = warc.read_archives(archives, payloads=False)
    return warc.resolved(records).select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_key").cast("long").alias("refers_to"))


OP13 = """
WITH sized AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN record_type = 'revisit' THEN first END AS refers_to
FROM sized
"""

QUERIES = {
    "op1_url_filter": (op1_url_filter, OP1),
    "op2_training_order": (op2_training_order, None),
    "op3_quality_rules": (op3_quality_rules, OP3),
    "op4_jaccard_join": (op4_jaccard_join, None),
    "op5_line_dedup": (op5_line_dedup, OP5),
    "op6_toxicity": (op6_toxicity, None),
    "op7_packing": (op7_packing, None),
    "op8_exact_dedup": (op8_exact_dedup, OP8),
    "op9_byte_bpe": (op9_byte_bpe, None),
    "op10_chat": (op10_chat, OP10),
    "op11_filter_audit": (op11_filter_audit, OP11),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_warc": (op13_warc, OP13),
}

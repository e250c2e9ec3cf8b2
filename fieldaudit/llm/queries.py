"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, fingerprints, html_text, language, ngram_join, packing, quality, runs, token_files, toxicity, warc
from ..session import ship
from .common import shared_dir, table
from .tokens import vocabulary


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.checksums(token_files.read_tokens(spark, out))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(rows.unionByName(more).withColumn("parts", chat.text_parts(F.col("text"))))
    turns, loss = chat.read_turns(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss"))
    back = chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder).agg(F.sum("records")).collect()
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return warc.read_warc(spark, folder, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(table(spark, sf_dir, "documents"), prepare=runs.planted))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def _shipped(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


QUERIES = {f.__name__: _shipped(f) for f in (op1_fingerprints, op2_decontaminate, op3_ngram_join, op4_token_files, op5_quality, op6_html_text, op7_chat, op8_warc, op9_toxicity, op10_packing, op11_align, op12_runs, op13_language)}


def _escaped(text: str) -> str:
    """SQL for the escaping of ``chat.escape``."""
    out = f"replace(coalesce({text}, ''), '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


#: SHA-1 in base 32 from hex: five hex digits give four characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {5 * g + 1}, 5))::INTEGER >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0))

ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.oracle_sql(),
    # these pages hold their main text in one plain article element, so a pattern finds it
    "op6_html_text": """
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS x FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h[1-6]|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
        c AS (SELECT page_id, url, replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS x FROM b),
        d AS (SELECT page_id, url, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS text FROM c)
        SELECT page_id, url, text, length(text) AS n_chars FROM d""",
    "op7_chat": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('{chat.TURN}{chat.TEXT}{chat.END}') + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op8_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first THEN first END AS refers_to
        FROM f""",
}

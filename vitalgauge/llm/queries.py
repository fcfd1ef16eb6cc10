"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgauge.llm import (
    byte_pair,
    chat,
    decontaminate,
    fingerprint,
    html_text,
    language,
    lexical,
    near_join,
    pieces,
    quality,
    spelling,
    token_files,
    url_filter,
)
from vitalgauge.llm.common import named, table


URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url names its document; the document's label, poor or toxic, is the url's."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")
    )
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    urls = pages.select("url", F.try_to_number(number, F.lit("9" * 18)).cast("bigint").alias("doc_id")).distinct()
    return url_filter.judge_urls(pages, urls.join(labels, "doc_id").select("url", "bad"), URL_RULES)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digests(turns.unionByName(own))


OP2_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|im_start|>') + length(replace(role, '<|', '<||')) + length('<|im_sep|>')
        + length(replace(text, '<|', '<||')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return pages.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.read_token_files(spark, parts)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.classes(table(spark, sf_dir, "documents"), spec=near_join.JoinSpec(width=3, percent=90))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.train(docs.where(~held_out))
    judged = language.identify(named(docs, doc_id="doc_id", text="text"), model)
    return judged.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.accepted").alias("accepted"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the encoding of every document, and whether decoding the ids gives the text back."""
    return pieces.digest(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")), n_grades=3)
    rated = quality.score(named(docs, doc_id="doc_id", text="text"), model)
    tails = F.col("quality.tails")
    return rated.select(
        "doc_id",
        F.col("quality.expected").alias("expected_grade"),
        tails[0].alias("p_acceptable"),
        tails[1].alias("p_good"),
        (tails[1] >= 0.5).alias("selected"),
    )


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_pair.encode(named(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), out="ids")
    decoded = byte_pair.decode(encoded.drop("text"), ids="ids", out="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sized AS (
    SELECT doc, doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0
), held AS (
    SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sized
), counted AS (
    SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM sized) GROUP BY doc, term
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), weighted AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(all_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
    FROM counted, held GROUP BY term
), scored AS (
    SELECT item_id, doc, doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms)))) AS BIGINT) AS score
    FROM wanted JOIN weighted USING (term) JOIN counted USING (term) JOIN sized USING (doc), held
    GROUP BY item_id, doc, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank,
        doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spelling.spelling_variants(documents, noise=spelling.NOISE, min_length=6, min_count=5, ratio=5)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_decontamination": op8_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_files": op10_token_files,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op12_ranked_search": OP12_SQL}

"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import collocations, decontaminate, html_main, jaccard, licenses, merkle, quality, repetition
from pagemill.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagemill.llm.bpe import compile_merges, encode_documents

    machine = compile_merges(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return encode_documents(table(spark, sf_dir, "documents"), machine)


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.toxicity import score_documents, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold("doc_id", 4) != 2))
    return score_documents(docs, model, fold("doc_id", 4) == 2)


@query()
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs, fold("doc_id", 3) != 1), fold("doc_id", 3) == 1)


@query(
    """
    WITH page AS (SELECT row_number() OVER () AS row_id, * FROM documents),
    line AS (SELECT row_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM page),
    seen AS (
        SELECT source, line, count(DISTINCT row_id) AS pages FROM line WHERE line <> '' GROUP BY source, line
    ),
    host AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
    common AS (
        SELECT seen.source, list(line) AS drops
        FROM seen JOIN host ON seen.source IS NOT DISTINCT FROM host.source
        WHERE pages >= 5 AND pages > 0.1 * total GROUP BY seen.source
    ),
    kept AS (
        SELECT doc_id, CASE WHEN drops IS NULL THEN text ELSE array_to_string(list_filter(
            string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(drops, trim(x))), chr(10)) END AS text
        FROM page LEFT JOIN common ON page.source IS NOT DISTINCT FROM common.source
    )
    SELECT doc_id, text, coalesce(length(text), 0) AS n_chars FROM kept
    """
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.line_dedup import drop_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs).selectExpr("doc_id", "text", "coalesce(bigint(length(text)), 0L) AS n_chars")


@query()
def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.maxscore import quantised, top_k

    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(vectors, "vec_id % 50 = 0", 5)


@query(licenses.oracle(licenses.TEMPLATES))
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query(decontaminate.oracle())
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.question_and_answer(table(spark, sf_dir, "benchmark"))
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), items)


@query()
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query()
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs))


@query(repetition.oracle())
def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


@query(collocations.oracle())
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(merkle.oracle())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_table(table(spark, sf_dir, "documents"))

"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Plan.  kneser.py counts the n-grams of all trusted texts by language, joins the grams of all documents with the counts in
shards, and scores every document.  A document is rejected
1. if its perplexity is over a quantile of the trusted texts of its language;
2. where toxic texts of its language are labelled, if its contrast is over a limit between theirs and those of toxic texts:
   a second model of the same kind counts the toxic texts, and words that it finds likelier speak against a document;
3. where none are, if its worst word is over a quantile of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quandrel.llm import kneser
from quandrel.llm.staging import light_batches, staged

#: Lists of at most so many trusted ids, and of languages with a threshold, are broadcast.
BROADCAST_ROWS = 1_000_000
#: Up to so many grams of all documents, 20 bytes each, are broadcast with their probabilities.
BROADCAST_GRAMS = 2_000_000
#: Shares of trusted texts that each rule allows, the contrast's at least.
QUANTILE, WORD_QUANTILE, CONTRAST_QUANTILE = 0.98, 0.98, 0.95
#: The contrast's limit lies so far from the value that all but EDGE of trusted texts stay under to the one that all but EDGE
#: of toxic texts stay over; nearer to the trusted ones, for toxic texts with new words score lower than those labelled.
EDGE, WAY = 0.1, 1 / 3


def small(table: DataFrame) -> DataFrame:
    """``table``, broadcast if its rows were counted and are few; else a join shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def flagged(ids: DataFrame | None, docs: DataFrame, name: str) -> DataFrame:
    """(_<name>_id, name): the distinct ids, none of them null."""
    rows = docs.select("doc_id").limit(0) if ids is None else ids.select("doc_id")
    rows = rows.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(f"_{name}_id")).distinct().withColumn(name, F.lit(True))
    return small(staged(rows, name))


def classify(
    docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, word_quantile: float = WORD_QUANTILE, contrast_quantile: float = CONTRAST_QUANTILE, toxic_ids: DataFrame | None = None
) -> DataFrame:
    """(doc_id, th, lang, perplexity, threshold, worst_word, word_threshold, contrast, contrast_threshold, kept) for each row.

    ``trusted_ids`` (doc_id) names trusted documents of ``docs``, ``toxic_ids`` (doc_id) toxic ones; an id in both is
    toxic.  Their texts, all of them, train the models of their language.  th is xxhash64 of the text.  A row is kept if
    none of its scores is over its threshold, the quantile of that score among trusted rows of its language; the contrast's
    lies on the way to the toxic rows' contrasts if that is higher.  A row as high as the threshold stays.  Trusted and toxic
    rows are scored without what they alone hold.  The worst word counts only where there is no contrast.  Languages without trusted rows, and null ones, take the models and thresholds of all languages; with
    no trusted rows at all every text is kept.

    Null and empty texts have no perplexity and are not kept.  Rows that repeat a doc_id are judged each by its own text.
    Rows of a null doc_id are judged but never trusted.  Other columns play no part, whatever their names.
    """
    light_batches(docs.sparkSession)
    mine = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    for ids, name in ((trusted_ids, "good"), (toxic_ids, "toxic")):
        mine = mine.join(flagged(ids, docs, name), F.col("doc_id") == F.col(f"_{name}_id"), "left").drop(f"_{name}_id")
    toxic = F.coalesce("toxic", F.lit(False))
    mine = mine.withColumns({"trusted": F.coalesce("good", F.lit(False)) & ~toxic, "toxic": toxic}).drop("good")
    known = mine.filter("(trusted or toxic) and text > ''")
    number = (2 * (F.pmod(F.xxhash64("lang"), F.lit(kneser.LANGUAGES)) + 1)).cast("int")
    languages = small(staged(known.filter("trusted").select("lang").distinct().withColumn("of_own", number), "languages"))
    modelled = mine.join(languages, "lang", "left").select("doc_id", "lang", "th", "trusted", "toxic", F.coalesce("of_own", F.lit(0)).alias("model"), "text")
    side = F.col("toxic").cast("int")
    training = known.select((number + side).alias("model"), "th", "text")
    if not modelled.filter("model = 0 and text > ''").isEmpty():
        training = training.unionByName(known.select(side.alias("model"), "th", "text"))
    scored = staged(kneser.score_documents(modelled, training, BROADCAST_GRAMS), "scored")

    labelled = scored.filter("(trusted or toxic) and perplexity is not null")
    rules = (("perplexity", "threshold", quantile), ("worst_word", "word_threshold", word_quantile), ("contrast", "contrast_threshold", contrast_quantile))
    among = lambda of, score, share: F.percentile_approx(F.when(F.col(of), F.col(score)), share, 10_000)
    near, far = among("trusted", "contrast", 1 - EDGE), among("toxic", "contrast", EDGE)
    limit_of = {limit: among("trusted", score, share) for score, limit, share in rules}
    limit_of["contrast_threshold"] = F.greatest(limit_of["contrast_threshold"], near + WAY * (far - near))
    limits = [value.alias(f"{limit}_of") for limit, value in limit_of.items()]
    by_lang = small(staged(labelled.groupBy("lang").agg(*limits), "limits"))
    of_all = labelled.agg(*limits).first()
    judged = scored.join(by_lang, "lang", "left").withColumns({limit: F.coalesce(f"{limit}_of", F.lit(of_all[f"{limit}_of"]).cast("double")) for _, limit, _ in rules})
    under = lambda score, limit: F.coalesce(F.col(score) <= F.col(limit), F.lit(True))
    second = F.when(F.col("contrast").isNotNull(), under("contrast", "contrast_threshold")).otherwise(under("worst_word", "word_threshold"))
    kept = F.col("perplexity").isNotNull() & under("perplexity", "threshold") & second
    return judged.select("doc_id", "th", "lang", *(c for score, limit, _ in rules for c in (score, limit)), kept.alias("kept"))


def trusted_by_labels(labels: DataFrame) -> DataFrame:
    """Documents labelled of good quality and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")


def toxic_by_labels(labels: DataFrame) -> DataFrame:
    """Documents labelled toxic."""
    return labels.filter(F.col("toxic") == 1).select("doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with their columns: rows of one doc_id and text share their fate."""
    judged = classify(docs, trusted_by_labels(labels), quantile, toxic_ids=toxic_by_labels(labels)).filter("not kept")
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    bad = staged(judged.select(name.alias("rejected_id"), F.col("th").alias("rejected_th")).distinct(), "rejected").alias("rejected")
    mine = docs.alias("mine")
    own = F.coalesce(F.concat(F.lit("="), F.col("mine.doc_id").cast("string")), F.lit(""))
    same = (own == F.col("rejected.rejected_id")) & (F.xxhash64(F.coalesce("mine.text", F.lit(""))) == F.col("rejected.rejected_th"))
    return mine.join(small(bad).alias("rejected"), same, "left_anti").select("mine.*")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, trusted_by_labels(labels), toxic_ids=toxic_by_labels(labels)).select("doc_id", "lang", "perplexity", "threshold", "contrast", "contrast_threshold", "kept")

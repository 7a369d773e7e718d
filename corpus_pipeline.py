"""From raw documents to packed training sequences: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the
columns of ``documents``. A doc_id stands for one document: the quality stage keeps or drops its rows together, and
the near-copy stage leaves one of them. Rows without an id are documents of their own.

In every stage columns other than those of ``documents`` are ignored, whatever their names; an empty table gives
an empty one; texts are taken whole, however long; what a null, an empty text, a tie or a repeated row gives is
said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, language_id, packing, quality_classifier, suffix_array_dedup
from tessera.llm.common import bounded_batches, identified, released, stage, table, unstage
from tessera.llm.repeats import Windows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is that of a text whose cosine is at least this share of the one that 99 of 100 learned texts of it reach.
COSINE_SHARE, COSINE_RANK = 0.5, 0.01
#: The cosine of a text with fewer letters says little, so it does not reject the text.
LEAST_LETTERS = 60
#: Cosines are whole multiples of 1 / UNITS; a cell of CELL units is counted first, then the cosines of one cell.
UNITS, CELL = 10**9, 10**5
#: Near copies share 0.8 of their shingles of five words; op6 keeps its own contract.
NEAR = jaccard_join.Join(n=5, percent=80)
#: Passages of more than 50 words are cut whatever their bytes, besides op3's strings of 400 bytes.
PASSAGES = Windows(width=51, seed=8, unit="word", earlier_only=False)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose id is among those of kept; rows without an id are told apart by the caller."""
    kept = kept.where("doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(*COLUMNS).join(kept, docs["doc_id"] == F.col("kept_id"), "left_semi")


def _at_rank(counts: DataFrame, value: str, below: str) -> DataFrame:
    """Of counts (lang_pred, value, n, k), the value that holds the k-th row of its language, and the rows below it."""
    upto = F.sum("n").over(Window.partitionBy("lang_pred").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where("upto - n < k and k <= upto")
    return found.select("lang_pred", "k", value, (F.col("upto") - F.col("n")).alias(below))


def least_cosines(scores: DataFrame) -> DataFrame:
    """lang_pred and least: COSINE_SHARE of the score (lang_pred, score) that lies at COSINE_RANK of a language's rows.

    All rows are counted. Cells bound the windows to UNITS / CELL + 1 rows a language, and CELL of the one cell that has the rank.
    """
    scores = scores.select("lang_pred", F.round(F.col("score") * UNITS).cast("long").alias("unit"))
    cells = scores.groupBy("lang_pred", F.floor(F.col("unit") / CELL).alias("cell")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang_pred"))
    cell = _at_rank(cells.withColumn("k", F.ceil(total * COSINE_RANK)), "cell", "below")
    inside = scores.withColumn("cell", F.floor(F.col("unit") / CELL)).join(F.broadcast(cell), ["lang_pred", "cell"])  # cell has a row a language
    units = inside.groupBy("lang_pred", "unit").agg(F.count("*").alias("n"), F.first(F.col("k") - F.col("below")).alias("k"))
    return _at_rank(units, "unit", "below").select("lang_pred", (COSINE_SHARE * F.col("unit") / UNITS).alias("least"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that was learned, with lang set to the one that was found.

    A language's least cosine is learned from all its labelled rows and holds for texts of some length. Null and empty texts and those without a letter have
    no language and go, as do all if no row has a lang. Equal texts fare alike; of equal cosines the first language
    by name counts. A null lang is filled in; rows with a null doc_id are judged, but not learned from.
    """
    p = language_id.Profiles()
    prototypes = language_id.learned(docs, p)
    # labelled rows are predicted here and again below: staged with their texts, all rows would lie on disk until the result is written
    labelled = identified(docs, "doc_id", "text", "lang").where(~language_id.held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    scores = language_id.predict(labelled, prototypes, p, carry=("lang",)).where(F.col("lang") == F.col("lang_pred"))
    scores = stage(scores.select("lang_pred", "score"))
    least = stage(least_cosines(scores))
    unstage(scores)
    found = language_id.predict(docs, prototypes, p, carry=("text", "lang", "source", "n_chars"))
    kept = found.where("lang_pred <> 'und'").join(F.broadcast(least), "lang_pred", "left")  # least has a row a language
    short = F.char_length(F.regexp_replace("text", r"\P{L}+", "")) < LEAST_LETTERS
    kept = kept.where(F.coalesce(F.col("score") >= F.col("least"), F.lit(True)) | short)
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts get a score like all others. Of rows that repeat a doc_id all stay if one is accepted; a row without an id
    stays if its own text is accepted. Labels that
    are null or neither 0 nor 1 are not learned from; without labels of both kinds every score is 0.5 and all stay.
    """
    # equal texts have equal scores, so a row without an id goes by its text
    docs = docs.select(*COLUMNS, F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    accepted = quality_classifier.rank(docs, table(spark, sf_dir, "labels"), carry="digest").where("predicted = 1")
    texts = accepted.where("doc_id is null").select("digest").distinct()
    unnamed = docs.where("doc_id is null").join(texts, "digest", "left_semi").select(*COLUMNS)
    return _only(docs, accepted).unionByName(unnamed)


def _one_row_each(docs: DataFrame) -> DataFrame:
    """One row for each doc_id, that with the longest text; without an id, all rows."""
    if not docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count():
        return docs
    rest = [c for c in COLUMNS if c != "doc_id"]
    longest = F.max(F.struct(F.coalesce(F.char_length("text"), F.lit(-1)).alias("size"), *rest)).alias("row")
    known = docs.where("doc_id is not null").groupBy("doc_id").agg(longest)
    known = known.select("doc_id", *[F.col(f"row.{c}") for c in rest])
    return stage(known.unionByName(docs.where("doc_id is null").select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by shingles.

    Null, empty and blank texts are linked with nothing and stay. Of rows that repeat a doc_id the one with the longest
    text stays, the largest by content on ties. Rows with a null doc_id stay.
    """
    docs = _one_row_each(docs)  # the next stage would take repeated rows for copies and cut both
    found = jaccard_join.jaccard_components(docs, NEAR)
    return _only(docs, found.where("doc_id = component_id")).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings and passages that stand elsewhere too; characters stay whole.

    All occurrences go, also within one document. A null text becomes empty; a text that repeats wholly becomes empty
    and stays as a row. Equal rows are occurrences of each other. A row with a null doc_id counts as an occurrence
    and keeps its own text.
    """
    found = suffix_array_dedup.remove_repeats(docs, carry=("lang", "source"), whole_characters=True, passages=PASSAGES)
    text = F.col("kept").cast("string")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. A null or empty text is the end id alone; every row is packed, repeated ones too."""
    import public_tokenizers

    return packing.pack(docs, packing.Packing(public_tokenizers.path("word_bpe_49k.json")), with_ids=False).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: The classifiers, the join and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written as Parquet and read again."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        with released(spark):
            before, docs = docs, stage(work(spark, docs, sf_dir), outlive=True)
        if before is not docs and hasattr(before, "_staged_path"):
            unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)

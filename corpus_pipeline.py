"""A training-data pipeline over documents: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage works on all rows that the stage before kept and wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspark.llm import decontam, jaccard, langid, packing, suffix
from factspark.llm._common import discard, slices, staged, watched

#: Ids of documents to drop that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _apart(docs: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns named like those that a stage makes for itself under other names, and what to select in the end."""
    clash = {c: f"_given_{c}" for c in docs.columns if c.lower() in made}
    return docs.withColumnsRenamed(clash), [F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected (no text, no letter, narrow margin); a null lang becomes the predicted one."""
    docs, given = _apart(docs, "lang_pred", "lang_score", "lang_rejected")
    model = langid.fit(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    found = langid.identify(docs, model).where(~F.col("lang_rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*given)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates, one without id only if none has one.

    Rows are judged by text under staged row numbers, so rows that share an id or have none are judged apart. Texts without
    words are in no group; of these, rows alike in doc_id and text stay once.
    """
    docs, given = _apart(docs, "_row")
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = jaccard.near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
    wordless = F.col("n_shingles") == 0
    about = rows.select("_row", "doc_id", F.when(F.trim(F.regexp_replace("text", r"\s+", "")) == "", F.col("text")).alias("_text")).join(groups, "_row")
    group = [F.when(~wordless | F.col("doc_id").isNull(), F.col("component_id")), F.when(wordless, F.col("doc_id")), F.when(wordless, F.col("_text"))]
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("doc_id").asc_nulls_last(), "_row"))
    drop = staged(about.withColumn("_nth", nth).where("_nth > 1").select("_row"), "dropped")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop
    return rows.join(drop, "_row", "left_anti").select(*given)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts (a character cut in two goes too) and drops documents of which nothing is left.
    n_chars, if there is such a column, becomes the length of what is left."""
    docs, given = _apart(docs, "removed_spans", "_k1", "_k2", "_all", "_spans")
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    found = suffix.removed(docs)
    names = found.columns
    text, spans = names.index("text"), names.index("removed_spans")
    chars = names.index("n_chars") if "n_chars" in names else None

    def cut(batches):
        for b in slices(batches):
            old = b.column(text).to_pylist()
            new = [suffix.kept_bytes(t.encode(), s).decode(errors="ignore") if s else t for t, s in zip(old, b.column(spans).to_pylist(), strict=True)]
            gone = pa.array([t == o or bool(t.strip()) for t, o in zip(new, old, strict=True)], pa.bool_())
            cols = {"text": pa.array(new, pa.string())}
            if chars is not None:
                cols["n_chars"] = pa.array([len(t) if t != o else n for t, o, n in zip(new, old, b.column(chars).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([cols.get(n, b.column(i)) for i, n in enumerate(names)], names).filter(gone)

    return found.mapInArrow(cut, found.schema).select(*given)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which any window of a benchmark item occurs."""
    docs, given = _apart(docs, "n_words", "hit_spans", "hit_items")
    found = decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_spans") == 0).select(*given)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids, with the ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL has neither compression nor suffix arrays nor tokenizers; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage has read and made on its way is deleted once its result is written."""
    docs, given = spark.read.parquet(f"{sf_dir}/documents.parquet"), True
    for name, stage in STAGES:
        with watched() as made:
            out = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*(t for t in made if t is not out), *([] if given else [docs]))
        docs, given = out, False
    return docs

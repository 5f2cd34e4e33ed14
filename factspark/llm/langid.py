"""Language ID by compression: the language whose dictionary packs a text smallest, with narrow wins rejected."""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices

UNKNOWN = "und"
#: The fit's bounds: bytes of a dictionary, of all dictionaries together, and of the shortest one that is worth having. A label's
#: dictionary is made of whole texts of a sample of about twice its bytes; of more than ALL_BYTES / LEAST_BYTES labels the most frequent are learned.
DICT_BYTES, ALL_BYTES, LEAST_BYTES = 200_000, 64_000_000, 1_000
#: Texts are packed in pieces of so many bytes, so that the dictionary and not the text's own past decides; level 6 is the
#: lowest that searches a dictionary well.
PIECE, LEVEL = 1_024, 6
#: Below this share of the second-smallest size saved, a prediction is rejected.
MARGIN = 0.003
_WORDS = re.compile(r"[^\W\d_]+")


def fit(train: DataFrame, text: str = "text", lang: str = "lang", dict_bytes: int = DICT_BYTES, all_bytes: int = ALL_BYTES) -> dict[str, bytes]:
    """lang -> zstandard raw-content dictionary: distinct texts of the language, whole, in the order of their hash, until it is full.

    The bytes of each language's distinct texts are counted first. They tell the share of hashes that gives twice the bytes a
    dictionary takes, so the sample is a filter, copies count once, and nothing is sorted but the sample of one language, where its
    dictionary is made; only dictionaries come to the driver, all_bytes at most. A language with less text has a shorter one."""
    given = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    sizes = given.select("lang", "h", F.octet_length("t").cast("long").alias("n")).groupBy("lang", "h").agg(F.max("n").alias("n")).groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n").alias("bytes"))
    most = max(1, all_bytes // LEAST_BYTES)
    known = sizes.orderBy(F.desc("texts"), "lang").limit(most).collect()
    if not known:
        return {}
    each = max(1, min(dict_bytes, all_bytes // len(known)))
    limits = [(r["lang"], min(2**64 - 1, 2**64 * 2 * each // max(1, r["bytes"])) - 2**63) for r in known]
    # as many rows as languages, which are bounded above
    limits = F.broadcast(train.sparkSession.createDataFrame(limits, "lang string, most long"))
    few = given.withColumn("lang", F.col("lang").cast("string")).join(limits, "lang").where(F.col("h") <= F.col("most")).select("lang", "h", "t").distinct()

    def dictionary(key, table):
        out, size = [], 0
        for t in table.sort_by([("h", "ascending"), ("t", "ascending")]).column("t").to_pylist():
            if size >= each:
                break
            if words := _words(t):
                out.append(words)
                size += len(words) + 1
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "d": pa.array([b" ".join(out)[:each]], pa.binary())})

    found = few.groupBy("lang").applyInArrow(dictionary, "lang string, d binary").collect()
    return {r["lang"]: bytes(r["d"]) for r in sorted(found, key=lambda r: r["lang"])}


def _words(text: str) -> bytes:
    """Lower-case runs of letters, as signs, digits and capitals tell nothing of a language."""
    found = " ".join(_WORDS.findall(text.lower()))
    if not found.replace(" ", "").isalpha():  # word characters that are no letters, as fractions and Roman numerals
        found = " ".join("".join(c if c.isalpha() else " " for c in found).split())
    return found.encode()


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.packers = {}
        for k, d in dictionaries.items():
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z.precompute_compress(level=level)
            self.packers[k] = zstandard.ZstdCompressor(dict_data=z, write_content_size=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). score: the share of the second-smallest size that the smallest saves, times 10, at most 1."""
        data = _words(text or "")
        if not data or not self.packers:
            return UNKNOWN, 0.0, True
        short = data if len(data) >= 256 else (data + b" ") * (256 // (len(data) + 1) + 1)
        sizes = []
        for name, p in self.packers.items():
            sizes.append((sum(len(p.compress(short[i : i + PIECE])) for i in range(0, len(short), PIECE)), name))
        sizes.sort()
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], min(1.0, 10 * margin), margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected. Texts without a letter, and null, are `und` and rejected; an empty
    table gives no rows; ties go to the first language by name; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    names = docs.columns
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(True).alias("lang_rejected")).schema

    def run(batches):
        c = Classifier(dictionaries)
        for b in slices(batches):
            found = [c.predict(t) for t in b.column(names.index(text)).to_pylist()]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))

"""Fill-in-the-middle: texts cut into units by zero-width boundary expressions, rearranged as prefix, suffix and middle, and read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a text that are split at a time, so that the pieces of one block are held, whatever the text's length.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Units:
    """A unit grammar, by the pairs of neighbouring character classes (as Java's expressions have them) that stay together.

    Any two neighbours that are in none of the pairs have a boundary between them, so a boundary is judged by the code points on
    its two sides alone, and every code point lies in exactly one unit.
    """

    joins: tuple[tuple[str, str], ...] = ()

    @property
    def boundary(self) -> str:
        """The zero-width expression of the boundaries: lookbehind for the left neighbour's class, lookahead for the right one's."""
        return "(?s)(?<=.)(?=.)" + "".join(f"(?!(?<={left})(?={right}))" for left, right in self.joins)


CODE_POINTS = Units()
#: White space and the word after it, as `\s*\S+` (and white space at the end).
WORDS = Units(((r"\S", r"\S"), (r"\s", r"\s"), (r"\s", r"\S")))
#: A line and its line break, as `[^\n]*\n`.
LINES = Units(((r"[^\n]", "."),))
#: Runs of letters, of digits and of white space; any other code point alone.
RUNS = Units(((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\s")))


def _pieces(text: Column, units: Units) -> Column:
    """The units of a text that isn't empty (split gives one empty piece for an empty one)."""
    return F.split(text, units.boundary, -1)


def _block(text: Column, i: Column, block: int) -> Column:
    """Block i and the code point after it: the boundaries inside are those after each of the block's code points."""
    return F.substr(text, i * block + 1, F.lit(block + 1))


def ends_in_blocks(text: Column, units: Units, block: int = BLOCK) -> Column:
    """Boundaries in each block of a text; their sum and 1 is the number of units of a text that isn't empty."""
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil((F.char_length(text) - 1) / block).cast("int"), F.lit(1)) - 1)
    return F.transform(blocks, lambda i: F.size(_pieces(_block(text, i, block), units)) - 1)


def end_of(text: Column, counts: Column, u: Column, units: Units, block: int = BLOCK) -> Column:
    """Code points in the first u units (0 to all of them) of a text with `counts` boundaries in its blocks."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("at"), u.cast("int").alias("left"))
    step = lambda acc, c: F.struct((acc["i"] + 1).alias("i"), F.when((acc["at"] < 0) & (acc["left"] <= c), acc["i"]).otherwise(acc["at"]).alias("at"), F.when((acc["at"] < 0) & (acc["left"] > c), acc["left"] - c).otherwise(acc["left"]).alias("left"))
    found = F.aggregate(counts, zero, step)
    inside = F.char_length(F.array_join(F.slice(_pieces(_block(text, found["at"], block), units), 1, F.greatest(found["left"], F.lit(1))), ""))
    return F.when(u <= 0, F.lit(0)).when(found["at"] < 0, F.char_length(text)).otherwise(found["at"] * block + inside)


def _draws(id_col: Column, seed: str) -> list[Column]:
    """h1 to h4: the first groups of eight hex digits of the id's SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, units: Units = CODE_POINTS, seed: str = "1", rate: int = 90, spm_rate: int = 20, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """A row per document: id_col, n_units, form (plain, psm or spm), prefix_chars, middle_chars, output, restored.

    A text is cut after two drawn numbers of units. It stays plain if it is empty, if it holds a marker, or for 100 - rate in
    100 documents. Marked texts are psm (prefix, suffix, middle), or spm (suffix, prefix, middle) for spm_rate in 100. restored
    is read back from output and form alone: as no text with a marker in it is rearranged and no marker overlaps another one,
    the first occurrence of each marker is the one that was put there. Draws come from the id, so equal ids draw alike and
    null ids draw as an empty one; a null text is empty. Repeated rows are documents of their own, an empty table gives no rows, other columns are left
    out, whatever their names. A projection: no shuffle, and pieces of one block of a text at a time, however long it is.
    """
    p, s, m = map(F.lit, markers)
    h1, h2, h3, h4 = _draws(F.col(id_col), seed)
    t, n = F.col("_text"), F.col("n_units")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    rows = rows.withColumn("_counts", F.when(t != "", ends_in_blocks(t, units, block)))
    rows = rows.withColumn("n_units", F.when(t == "", F.lit(0)).otherwise(F.aggregate("_counts", F.lit(1), lambda a, c: a + c)).cast("long"))
    plain = (t == "") | t.contains(p) | t.contains(s) | t.contains(m) | (F.col("_h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("_h4") % 100 < spm_rate, "spm").otherwise("psm"))
    u1, u2 = F.col("_h1") % (n + 1), F.col("_h2") % (n + 1)
    marked = F.col("form") != "plain"
    for name, u in (("_e1", F.least(u1, u2)), ("_e2", F.greatest(u1, u2))):
        rows = rows.withColumn(name, F.when(marked, end_of(t, F.col("_counts"), u, units, block)))
    first, middle, last = F.substr(t, F.lit(1), F.col("_e1")), F.substr(t, F.col("_e1") + 1, F.col("_e2") - F.col("_e1")), F.substr(t, F.col("_e2") + 1)
    rows = rows.withColumn("output", F.when(~marked, t).when(F.col("form") == "psm", F.concat(p, first, s, last, m, middle)).otherwise(F.concat(s, last, p, first, m, middle)))
    return rows.select(
        F.col("_id").alias(id_col),
        "n_units",
        "form",
        F.col("_e1").cast("long").alias("prefix_chars"),
        (F.col("_e2") - F.col("_e1")).cast("long").alias("middle_chars"),
        "output",
        restored(F.col("output"), F.col("form"), markers).alias("restored"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of transform stands for."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands between the first and the second marker, between the second one and the middle's, and after that."""
        after = F.substring_index(output, m, 1)
        return F.substr(F.substring_index(after, second, 1), F.lit(len(first) + 1)), F.substr(after, F.char_length(F.substring_index(after, second, 1)) + len(second) + 1), F.substr(output, F.char_length(after) + len(m) + 1)

    a, b, c = parts(p, s)
    x, y, z = parts(s, p)
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(y, z, x)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

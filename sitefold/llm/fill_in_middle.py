"""Fill-in-middle examples in native Spark SQL: cuts between units, sentinels between the parts, and the way back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of ASCII letters, or any other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"


@dataclass(frozen=True)
class Arrangement:
    """Marks of the three parts, the seed of the draws, and of 100 texts how many are arranged, and of 100 of those suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 1
    arranged: int = 90
    suffix_first: int = 20

    def __post_init__(self):
        marks = self.marks()
        if not all(marks) or len(set(marks)) < 3 or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("marks must not be empty, equal or part of each other")
        for a in marks:
            for b in marks:
                if any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError("no mark may begin as another or itself ends: a text beside it could complete one")

    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def pattern(self) -> str:
        return "|".join(re.escape(m) for m in self.marks())


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the hex SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column, marks: Arrangement = Arrangement()) -> Column:
    """The text of an output: what lies between the marks, in its old order. Plain outputs are texts as they are."""
    parts = F.split(output, marks.pattern())
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: Arrangement = Arrangement()) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per input row.

    A text is cut into ``n`` units (``UNIT``), two draws from its id give the cuts, a third says whether it is arranged at
    all and a fourth which part comes first: ``psm`` is prefix, suffix, middle, ``spm`` is suffix, prefix, middle. All
    texts are cut whole, by expressions of the scan alone: nothing is shuffled, and a row needs its own units in memory.

    Null and empty texts, and texts that hold one of the marks, stay plain; so ``restored`` always gives the exact text (null
    counts as empty). Plain rows have no cuts (null). A null id draws as an empty one. Rows that repeat an id are cut by the
    same draws, each with its own text. Other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), marks.seed)
    held = [F.contains(F.col("text"), F.lit(m)) for m in marks.marks()]
    plain = (F.col("text") == "") | held[0] | held[1] | held[2] | (h3 % 100 >= marks.arranged)
    units = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(UNIT), 0).alias("units"), F.when(plain, "plain").when(h4 % 100 < marks.suffix_first, "spm").otherwise("psm").alias("form"))
    sized = units.withColumn("n", F.size("units")).withColumns({"x": (h1 % (F.col("n") + 1)).cast("int"), "y": (h2 % (F.col("n") + 1)).cast("int")})
    cut = sized.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    parts = cut.select(
        "doc_id", "text", "form", F.col("n").cast("long").alias("n"), part(F.lit(1), F.col("a")).alias("prefix"),
        part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, F.col("n") - F.col("b")).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in marks.marks())
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    )
    return parts.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))

"""Line deduplication by a deletion-neighbourhood join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.workspace import Workspace

#: Lines with fewer characters are always kept: short lines (a brace, a heading, an answer) recur without being copied.
LEAST = 16
#: Parts of a line of which one holds the edit; parts longer than SHORT are cut again.
PARTS = 4
SHORT = 128
#: Every two lines one edit apart have lengths in a common bucket c, of lengths 2c - 1 to 2c + 1.
_BUCKETS = ("n div 2", "(n + 1) div 2")


def _key(bucket: str, part: int) -> str:
    """What two lines with an edit in this part have in common: so many bytes before it and after it as there are characters
    at least. Bytes are cut without counting characters, and the first k bytes lie within the first k characters."""
    base = f"(2 * ({bucket}) - 1)"
    before, after = f"cast({part} * {base} div {PARTS} AS int)", f"cast(({PARTS} - 1 - {part}) * {base} div {PARTS} AS int)"
    raw = "cast(norm AS binary)"
    return f"xxhash64({part}, {bucket}, substring({raw}, 1, {before}), substring({raw}, octet_length(norm) - {after} + 1, {after}))"


def _lines(docs: DataFrame, least: int) -> DataFrame:
    rows = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.expr("lower(trim(BOTH ' \\t\\r' FROM line))").alias("norm")).withColumn("n", F.length("norm")).where(F.col("n") >= least)


def _variants(lines: DataFrame) -> DataFrame:
    """``(key, o, kind)``: hashed deletion variants of the part of each line that may hold an edit.

    Kind 0 tells the place of the deletion too, so lines that meet differ by a substitution there; kind 1 is a deletion
    without its place and kind 2 the undeleted part, so lines of kinds 1 and 2 that meet differ by an insertion. Parts of more
    than SHORT characters are cut again into as many sub-parts as these have characters, so the work on a line grows with
    its length to the power of 1.5. All characters around the variant enter its key: lines that meet are one edit apart, and
    the earliest of them is a partner of every other.
    """
    base = "(2 * bucket - 1)"
    head, tail = f"cast(part * {base} div {PARTS} AS int)", f"cast(({PARTS} - 1 - part) * {base} div {PARTS} AS int)"
    middles = (
        lines.withColumn("bucket", F.expr(f"CASE WHEN place < {PARTS} THEN {_BUCKETS[0]} ELSE {_BUCKETS[1]} END")).withColumn("part", F.expr(f"place % {PARTS}"))
        .selectExpr("o", f"xxhash64(key, left(norm, {head}), right(norm, {tail})) AS key", f"substring(norm, {head} + 1, n - {head} - {tail}) AS middle", f"{base} - {head} - {tail} AS size")
        .withColumn("subs", F.expr(f"CASE WHEN size <= {SHORT} THEN 1 ELSE cast(ceil(sqrt(size)) AS int) END"))
        .withColumn("sub", F.explode(F.expr("sequence(0, subs - 1)")))
    )
    before, after = "cast(sub * size div subs AS int)", "cast(size - (sub + 1) * size div subs AS int)"
    parts = middles.selectExpr(
        "o", f"xxhash64(key, sub, left(middle, {before}), right(middle, {after})) AS key", f"substring(middle, {before} + 1, length(middle) - {before} - {after}) AS w"
    )
    cut = parts.selectExpr("o", "key", "w", "explode(sequence(0, length(w))) AS i")
    cut = cut.withColumn("v", F.expr("CASE WHEN i = 0 THEN w ELSE concat(left(w, i - 1), substring(w, i + 1)) END"))
    kinds = F.expr(
        "CASE WHEN i = 0 THEN array(named_struct('key', xxhash64(key, v), 'kind', 2))"
        " ELSE array(named_struct('key', xxhash64(key, v, i), 'kind', 0), named_struct('key', xxhash64(key, v), 'kind', 1)) END"
    )
    return cut.select("o", F.explode(kinds).alias("k")).select("k.key", "o", "k.kind")


def repeated_lines(docs: DataFrame, space: Workspace, least: int = LEAST) -> DataFrame:
    """``(doc_id, removed)``: for each document that loses any, the positions of its lines that go.

    A line's order is one decimal, doc_id * 2^32 + position, so that all minima are hash aggregates.
    """
    lines = _lines(docs, least)
    keys = [F.expr(_key(_BUCKETS[0], q)) for q in range(PARTS)] + [F.expr(f"CASE WHEN n % 2 = 1 THEN {_key(_BUCKETS[1], q)} END") for q in range(PARTS)]
    names = [f"k{i}" for i in range(2 * PARTS)]
    hashed = space.write(lines.select("doc_id", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), *[k.alias(c) for k, c in zip(keys, names, strict=True)]), "hashed")
    order = "cast(doc_id AS decimal(20,0)) * 4294967296BD + pos"
    firsts = hashed.select("h1", "h2", "doc_id", F.expr(order).alias("o")).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.withColumn("first", F.expr("cast(o - cast(doc AS decimal(20,0)) * 4294967296BD AS int)"))
    posts = hashed.select("h1", F.posexplode(F.array(*names)).alias("place", "key")).where("key IS NOT NULL")
    shared = posts.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key")
    near = space.write(posts.join(shared, "key").groupBy("h1").agg(F.collect_set(F.struct("place", "key")).alias("keys")), "near")
    near = space.write(firsts.select("h1", "doc", "first", "o").join(near, "h1").withColumnRenamed("doc", "doc_id"), "firsts")
    wanted = near.groupBy("doc_id").agg(F.collect_list(F.struct("first", "o", "keys")).alias("wanted"))
    found = docs.where("text IS NOT NULL").hint("merge").join(wanted, "doc_id").select("wanted", F.split("text", "\n", -1).alias("lines"))
    picked = found.select(F.explode(F.expr("transform(wanted, w -> named_struct('o', w.o, 'keys', w.keys, 'line', get(lines, w.first)))")).alias("x"))
    texts = space.write(
        picked.select("x.o", "x.keys", F.expr("lower(trim(BOTH ' \\t\\r' FROM x.line))").alias("norm")).where("norm IS NOT NULL").dropDuplicates(["o"]), "texts"
    )
    rows = texts.select("o", "norm", F.length("norm").alias("n"), F.explode("keys").alias("k")).select("o", "norm", "n", "k.place", "k.key")
    variants = space.write(_variants(rows), "variants")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("o"))
    met = variants.groupBy("key").agg(F.min(of(0)).alias("swap"), F.max(of(0)).alias("last"), F.min(of(1)).alias("cut"), F.min(of(2)).alias("whole"))
    met = met.where("swap < last OR (cut IS NOT NULL AND whole IS NOT NULL)")
    pairs = variants.join(met, "key").select("o", F.expr("CASE kind WHEN 0 THEN swap WHEN 1 THEN whole ELSE cut END").alias("earlier")).where("earlier < o").distinct()
    text = texts.select("o", "norm")
    verified = pairs.join(text, "o").join(text.toDF("earlier", "other"), "earlier").where("levenshtein(norm, other, 1) BETWEEN 0 AND 1").select("o").distinct()
    verified = space.write(verified.join(near.select("o", "doc_id", F.col("first").alias("pos")), "o").select("doc_id", "pos"), "verified")
    copied = firsts.where("n > 1").select("h1", "h2", "doc", "first")
    copies = hashed.select("doc_id", "pos", "h1", "h2").join(copied, ["h1", "h2"]).where("doc_id <> doc OR pos <> first").select("doc_id", "pos")
    gone = space.write(copies.unionByName(verified).groupBy("doc_id").agg(F.collect_set("pos").alias("removed")), "gone")
    space.drop("hashed", "near", "firsts", "texts", "variants", "verified")
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept_text)``, one row per input row.

    Lines are what line feeds separate; they are compared lower-cased, without spaces, tabs and carriage returns at their
    ends. A line goes if an earlier one, by (doc_id, position), is equal, or if the first line equal to an earlier-seen one
    is at most one character edit away from it. Lines of fewer than ``least`` characters stay.

    Equal lines are found by two 64-bit hashes. Of lines that differ, only those go on that have all but one of four parts
    in common with another one; of their remaining part every single-character deletion is emitted as a hashed key, and
    lines that meet are verified by their edit distance. All decisions are minima per key, so a line that a third of all
    documents have costs no task more than another.

    Null texts have no lines and stay null; empty texts have one empty line. Rows with a null doc_id lose nothing and take
    no part. Rows that repeat a doc_id are one document and lose the same. Other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "lines")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = repeated_lines(base.where("doc_id IS NOT NULL"), space, least)
    return kept_lines(base, gone)


def kept_lines(base: DataFrame, gone: DataFrame) -> DataFrame:
    """``base`` with ``n_lines``, ``n_removed`` and ``kept_text`` instead of ``text``."""
    joined = base.hint("merge").join(gone, "doc_id", "left").withColumn("lines", F.when(F.col("removed").isNotNull(), F.split("text", "\n", -1)))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), removed), i -> lines[i]), '\\n')")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    others = [c for c in base.columns if c not in ("doc_id", "text")]
    return joined.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("kept_text"), *others,
    )

"""Reachability from an entry page over links and redirects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.operators.checkpoints import Tables
from sitefold.operators.spread import SHARE, dealt_join, parts_of, share_of

#: The most buckets of the store of edges; there is one for each SHARE of them.
BUCKETS = 4096
#: Buckets up to which each task that writes the store may have a file in each of them; more are gathered first.
FEW = 8
_SEEN = "url_key string, depth int, bucket int, part int, round int"


@dataclass
class Walk:
    """What a walk did: rounds of pointer doubling and of the walk, edges in the store, and those in the buckets that each round read."""

    doublings: int = 0
    rounds: int = 0
    edges: int = 0
    read: list[int] = field(default_factory=list)


def outgoing(state: DataFrame) -> DataFrame:
    """``(src, outs)``: the keys of a page's links and redirect target, without repeats and itself."""
    out = F.array_union("internal_links_out", F.when(F.col("redirect_target").isNotNull(), F.array("redirect_target")).otherwise(F.array().cast("array<string>")))
    keys = state.select(F.col("url_key").alias("src"), out.alias("outs"))
    return keys.select("src", F.expr("array_distinct(filter(transform(outs, u -> regexp_replace(u, '(?s)#.*$', '')), u -> u <> src))").alias("outs"))


def _chains(pages: DataFrame, into: DataFrame, entry_key: str, tables: Tables, walk: Walk) -> DataFrame | None:
    """``(key, top, steps, pred, succ)`` of inner pages: one edge in, one out, and so on a chain whose first page is ``top``.

    Pointer doubling: each round a page takes over the pointer of the page that it points to, so that its way up doubles. Pages
    of a ring that nothing enters never get to a top; they are left out, as nothing reaches them. None if no two inner pages
    follow one another: there is nothing to shorten then.
    """
    single = pages.where(F.size("outs") == 1).where(F.col("src") != entry_key).select(F.col("src").alias("key"), F.col("outs")[0].alias("succ"))
    inner = single.join(into.where("n = 1").select(F.col("dst").alias("key"), "pred"), "key")
    above = inner.select(F.col("key").alias("pred"), F.lit(True).alias("more"))
    marked = inner.join(above, "pred", "left").select("key", "pred", F.coalesce("more", F.lit(False)).alias("more"))
    # up: the topmost page known so far; more: whether the page above it is inner too
    steps = tables.write(marked.select("key", F.when(F.col("more"), F.col("pred")).otherwise(F.col("key")).alias("up"), F.col("more").cast("int").alias("steps"), "more"), "steps-0")
    open_ = steps.where("more").count()
    if not open_:
        return None
    while open_:
        walk.doublings += 1
        done, rest = steps.where("NOT more"), steps.where("more")
        jump = steps.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("more").alias("more2"))
        moved = rest.join(jump, "up").select("key", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("more2").alias("more"))
        steps = tables.write(done.unionByName(moved), f"steps-{walk.doublings}")
        before, open_ = open_, steps.where("more").count()
        if open_ == before:  # only rings are left
            steps = steps.where("NOT more")
            break
    return tables.write(steps.select("key", F.col("up").alias("top"), "steps").join(inner, "key"), "chains")


def reachable_keys(state: DataFrame, entry_key: str, walk: Walk | None = None, share: int = SHARE) -> DataFrame:
    """``(url_key, depth)`` of all rows that can be reached, with their distance in hops; empty if the entry is no row.

    Long chains (pages that one edge enters and one leaves) are first made into single edges of their length, in about as many
    rounds as that length has binary digits. Then rounds relax distances: a round's frontier is what got a first or smaller
    distance in the one before. The edges are written once, in buckets by their source; a round reads the buckets in which its
    frontier has edges, so rounds of few pages read little, however large the site is. A page with more than ``share`` links
    has them in several buckets; one with more links to it is dealt out over several tasks. The walk passes through rows of any
    status; keys without a row are dead ends. Each step is a written table, so a lost executor costs no earlier step. ``walk``
    is told what was done.
    """
    spark, tables, told = state.sparkSession, Tables(state.sparkSession, "reach"), walk is not None
    walk = walk or Walk()
    pages = outgoing(state)
    rows = pages.select("src", F.explode("outs").alias("dst"), F.size("outs").alias("n_out"))
    into = tables.write(rows.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.max("src").alias("pred")), "into")
    total = into.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    share = share_of(total, share)
    buckets = max(1, min(BUCKETS, -(-total // share)))
    bucket = F.pmod(F.xxhash64("src", "part"), F.lit(buckets)).cast("int").alias("bucket")
    chains = _chains(pages, into, entry_key, tables, walk)
    links = rows.withColumn("steps", F.lit(1))
    if chains is not None:
        inner = chains.select("key")
        tops = chains.where("key = top").select("top", "pred")
        last = chains.select("top", F.col("steps").alias("n"), "succ").join(inner.select(F.col("key").alias("succ")), "succ", "left_anti")
        short = tops.join(last, "top").join(pages.select(F.col("src").alias("pred"), F.size("outs").alias("n_out")), "pred")
        links = links.join(inner.select(F.col("key").alias("src")), "src", "left_anti").join(inner.select(F.col("key").alias("dst")), "dst", "left_anti")
        links = links.unionByName(short.select(F.col("pred").alias("src"), F.col("succ").alias("dst"), "n_out", (F.col("n") + 2).alias("steps")))
    ends = pages.select(F.col("src").alias("dst"), F.expr(f"CASE WHEN size(outs) > 0 THEN {parts_of('size(outs)', share)} ELSE 0 END").alias("dst_parts"))
    known = dealt_join(links, ends, "dst", into.select("dst", "n") if total > share else None, share, F.xxhash64("src"))
    known = known.withColumn("part", F.expr(f"CAST(pmod(xxhash64(dst), {parts_of('n_out', share)}) AS int)")).select("src", "part", "dst", "steps", "dst_parts", bucket)
    store = tables.write(known.repartition(buckets, "bucket") if buckets > FEW else known, "store", ("bucket",))
    sizes = {r["bucket"]: r["count"] for r in store.groupBy("bucket").count().collect()} if told else {}
    walk.edges = sum(sizes.values())

    def placed(found: DataFrame, parts: str) -> DataFrame:
        """Rows once for each part of their links, with its bucket; once and without one if they have no links."""
        dealt = found.select("url_key", "depth", F.col("url_key").alias("src"), F.expr(f"explode_outer(CASE WHEN {parts} > 0 THEN sequence(0, {parts} - 1) END)").alias("part"))
        return dealt.select("url_key", "depth", F.when(F.col("part").isNotNull(), bucket).alias("bucket"), "part")

    entry = ends.where(F.col("dst") == entry_key).head()
    rows, path = [(entry_key, 0, entry["dst_parts"])] if entry else [], f"{tables.root}/seen"
    fresh_rows = placed(spark.createDataFrame(rows, "url_key string, depth int, dst_parts int"), "dst_parts")
    while True:
        fresh_rows.write.parquet(f"{path}/round={walk.rounds}")
        seen = spark.read.schema(_SEEN).parquet(path)
        front = seen.where(F.col("round") == walk.rounds)
        wanted = front.agg(F.collect_set("bucket").alias("b")).head()["b"]
        if not wanted:
            break
        walk.rounds += 1
        walk.read.append(sum(sizes.get(b, 0) for b in wanted))
        near = store.where(F.col("bucket").isin(wanted)) if len(wanted) < buckets else store
        step = near.drop("bucket").join(front.where("part IS NOT NULL").select(F.col("url_key").alias("src"), "depth", "part"), ["src", "part"])
        step = step.groupBy(F.col("dst").alias("url_key")).agg(F.min(F.col("depth") + F.col("steps")).cast("int").alias("depth"), F.max("dst_parts").alias("dst_parts"))
        if chains is None:  # all edges have one length: what was seen is final
            better = step.join(seen.select("url_key"), "url_key", "left_anti")
        else:
            best = seen.join(step.select("url_key"), "url_key", "left_semi").groupBy("url_key").agg(F.min("depth").alias("had"))
            better = step.join(best, "url_key", "left").where("had IS NULL OR depth < had")
        fresh_rows = placed(better, "dst_parts")
    if chains is None:
        return seen.where("coalesce(part, 0) = 0").select("url_key", "depth")
    found = seen.groupBy("url_key").agg(F.min("depth").alias("depth"))
    on_chain = chains.select("key", "top", "steps").join(tops, "top").join(found.withColumnRenamed("url_key", "pred"), "pred")
    return found.unionByName(on_chain.select(F.col("key").alias("url_key"), (F.col("depth") + 1 + F.col("steps")).cast("int").alias("depth")))


def with_reachability(state: DataFrame, entry_key: str) -> DataFrame:
    found = reachable_keys(state, entry_key).select("url_key", F.lit(True).alias("found"))
    return state.drop("is_reachable").join(found, "url_key", "left").withColumn("is_reachable", F.coalesce("found", F.lit(False))).drop("found")

"""Mixing documents to target weights by soft domain membership. DataFrame functions only."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm.workspace import Workspace

#: Shares of all tokens that the domains are to have; domains that are not named share what is left over evenly.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
BUCKETS = 1 << 12
#: Labelled documents that the classifier is fitted on at most (about). Each document carries one posterior for each domain and
#: the driver a matrix of domains, so more than DOMAINS are an error.
LABELLED = 20_000
DOMAINS = 1000
#: A longer document counts as so many words of evidence, so its membership stays soft: its words depend on each other.
EVIDENCE = 24
ROUNDS = 200
TOLERANCE = 1e-5
#: Steps after which the rates are written.
WRITTEN = 10


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per word of the whole texts, with its bucket; a text without words gives rows with an empty word."""
    flat = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    words = docs.select(*keep, F.explode(F.split(flat, " ", -1)).alias("word"))
    return words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))


def _sample(labelled: DataFrame, shares: dict[str, int], most: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of their id: of each domain all, or its even part of ``most`` where there are more."""
    if sum(shares.values()) <= most:
        return labelled
    rates = _mapped({d: min(1.0, most / len(shares) / n) for d, n in shares.items()})
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.element_at(rates, F.col("domain")) * (1 << 20))


def _mapped(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def memberships(docs: DataFrame, labelled: DataFrame, space: Workspace, most: int = LABELLED, evidence: float = EVIDENCE) -> tuple[DataFrame, list[str]]:
    """``(doc_id, n_tokens, p array<double>)`` and the domains in the order of ``p``.

    Multinomial naive Bayes over hashed words. Domains and their prior shares are those of all labelled documents; word counts
    come from a bounded sample of them, stratified by domain, and make a bounded table of weights. Both are broadcast.
    """
    known = space.write(labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain")), "labelled")
    shares = dict(known.groupBy("domain").count().limit(DOMAINS + 1).collect())
    if len(shares) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    domains, known = sorted(shares), _sample(known, shares, most)
    if not domains:
        none = _words(docs, "doc_id").groupBy("doc_id").agg(F.count_if(F.col("word") != "").alias("n_tokens"))
        return space.write(none.withColumn("p", F.array().cast("array<double>")), "members"), []
    counts = _words(docs.join(F.broadcast(known), "doc_id"), "doc_id", "domain").where("word <> ''").groupBy("domain", "bucket").count()
    table = counts.groupBy("bucket").pivot("domain", domains).sum("count")
    table = space.write(table.select("bucket", *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("double").alias(f"c{k}") for k, d in enumerate(domains)]), "counts")
    totals = table.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) for k in range(len(domains))]).first()
    everyone = sum(shares[d] for d in domains)
    weights = table.select("bucket", *[F.log((F.col(f"c{k}") + 1) / (totals[k] + BUCKETS)).alias(f"w{k}") for k in range(len(domains))])
    seen = _words(docs, "doc_id").join(F.broadcast(weights), "bucket", "left")
    real = F.col("word") != ""
    likely = seen.groupBy("doc_id").agg(
        F.count_if(real).alias("n_tokens"),
        *[F.sum(F.when(real, F.coalesce(f"w{k}", F.log(F.lit(1.0 / (totals[k] + BUCKETS))))).otherwise(0.0)).alias(f"s{k}") for k in range(len(domains))],
    )
    scale = F.least(F.lit(float(evidence)), F.col("n_tokens")) / F.greatest(F.col("n_tokens"), F.lit(1))
    scores = F.array(*[F.col(f"s{k}") * scale + float(np.log(shares[d] / everyone)) for k, d in enumerate(domains)])
    p = F.expr("transform(scores, x -> exp(x - array_max(scores)))")
    members = likely.select("doc_id", "n_tokens", scores.alias("scores")).select("doc_id", "n_tokens", p.alias("e"))
    return space.write(members.select("doc_id", "n_tokens", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b))").alias("p")), "members"), domains


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], space: Workspace, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``members`` with ``rate``: nonnegative rates near 1 whose expected domain totals match the targets.

    Projected gradient descent on the weighted squared gaps between ``sum(rate * n_tokens * p)`` and the targets. A step is
    ``rate = max(0, rate - p . g)`` with one vector ``g`` for all documents, so Spark keeps the rates and each round moves
    only one number per domain. A domain that no document belongs to can't be filled, and the share of a target whose domain no
    labelled document has goes to the others in proportion; both are warned of, with the largest gap that is left.
    """
    d, spark = len(domains), members.sparkSession
    size = [F.sum(F.col("n_tokens") * F.col("p")[k]) for k in range(d)]
    first = members.agg(F.sum("n_tokens"), *size).first() if d else None
    if not d or not first[0]:
        return members.withColumn("rate", F.lit(1.0))
    total, have = float(first[0]), np.array(first[1 : d + 1], float)
    named = {k: v for k, v in targets.items() if k in domains}
    if len(named) < len(targets):
        warnings.warn(f"no labelled document has the domains {sorted(set(targets) - set(named))}", stacklevel=2)
    rest = max(0.0, 1 - sum(named.values())) / max(1, d - len(named))
    want = np.array([named.get(k, rest) for k in domains])
    want = want / want.sum() if want.sum() > 0 else np.full(d, 1 / d)
    root = np.sqrt(total / np.maximum(have, 1e-9 * total))
    # one row for each domain of a document, so that a domain's row of the matrix is one group of d sums
    each = members.select("n_tokens", "p", F.posexplode("p").alias("i", "x")).where("x > 0")
    cross = {r["i"]: r[1:] for r in each.groupBy("i").agg(*[F.sum(F.col("n_tokens") * F.col("x") * F.col("p")[j]) for j in range(d)]).collect()}
    curve = root[:, None] * np.array([cross.get(i, [0.0] * d) for i in range(d)], float) / total * root[None, :]
    step = 1 / np.linalg.eigvalsh(curve)[-1]
    rated, history = members.withColumn("rate", F.lit(1.0)), []

    def with_history(frame: DataFrame) -> DataFrame:
        """The steps as one row of a table, not as literals: so every round has the same plan, compiled once."""
        if not history:
            return frame
        written = ",".join("array(" + ",".join(f"{x!r}D" for x in g) + ")" for g in history)
        steps = spark.sql(f"SELECT * FROM VALUES (array({written})) AS t(steps)")
        move = "aggregate(steps, rate, (r, g) -> greatest(0D, r - aggregate(zip_with(p, g, (a, b) -> a * b), 0D, (a, b) -> a + b)))"
        return frame.join(F.broadcast(steps)).withColumn("rate", F.expr(move)).drop("steps")

    def totals(frame: DataFrame) -> np.ndarray:
        sums = frame.select((F.col("rate") * F.col("n_tokens")).alias("n"), F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum(F.col("n") * F.col("x")).alias("s"))
        found = {r["i"]: r["s"] for r in sums.collect()}
        return np.array([found.get(i, 0.0) for i in range(d)], float)

    for k in range(rounds + 1):
        now = with_history(rated)
        gap = totals(now) / total - want
        if np.abs(gap).max() < tolerance or k == rounds:
            break
        history.append([float(x) for x in step * root**2 * gap])
        if len(history) == WRITTEN:
            rated, history = space.write(with_history(rated), f"rates{k}"), []
    if np.abs(gap).max() >= tolerance:
        warnings.warn(f"targets are missed by up to {np.abs(gap).max():.2g} of all tokens", stacklevel=2)
    return with_history(rated)


def mix_to_targets(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
    most: int = LABELLED,
    evidence: float = EVIDENCE,
) -> DataFrame:
    """``(doc_id, n_tokens, domain, membership, rate, copies)``, one row per doc_id.

    ``labelled`` has ``doc_id`` and ``domain``. ``rate`` is how often a document is to be read on average; ``copies`` rounds
    it up or down by a hash of the id, so that totals stay as expected. ``domain`` is the likeliest one and ``membership``
    its posterior. Tokens are words between spaces, tabs and line ends.

    Null and empty texts have 0 tokens and the domains' shares as posteriors. Rows that repeat a doc_id are one document
    of all their words, and so are all rows with a null one. Without labelled documents all rates are 1 and domains null. An empty table gives
    no rows; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "mixing")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members, domains = memberships(texts, labelled, space, most, evidence)
    rated = fit_rates(members, domains, TARGETS if targets is None else targets, space)
    names = F.array(*[F.lit(d) for d in domains]) if domains else F.array().cast("array<string>")
    chance = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rated.select(
        "doc_id", "n_tokens", F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1).alias("domain"), F.array_max("p").alias("membership"), "rate",
        (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long").alias("copies"),
    )

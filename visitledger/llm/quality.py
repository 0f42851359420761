"""Quality of documents from their own evidence and that of their site."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger.llm.exact_dedup import keyed, row_hash, whole
from visitledger.sources.staging import stage

#: Values a feature is binned into, and what is added to each bin's counts.
BINS = 16
SMOOTHING = 1.0
#: The classifier is fitted on about this many labelled documents, chosen by a hash of their id.
LABELLED = 20_000
#: A document whose probability of being good is below this is rejected. The README has
#: the errors on held-out labels at this and other cuts.
THRESHOLD = 0.2
#: Bounds of the weight, in documents, of what a site is shrunk towards.
STRENGTH = (2.0, 10_000.0)


def repetition(words: Column) -> Column:
    """How much of a text is one word again and again, 0 to 1.

    The larger of two shares: that of neighbouring words which are equal, and that of
    words which repeat the most frequent one. A single word repeats nothing.
    """

    def equal(w: Column) -> Column:
        """A 1 for each word that equals the one before it, else a 0."""
        pairs = F.size(w) - 1
        marks = F.zip_with(
            F.slice(w, F.lit(1), pairs), F.slice(w, F.lit(2), pairs), lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0"))
        )
        return F.array_join(marks, "")

    def share(w: Column) -> Column:
        beside = F.length(F.replace(equal(w), F.lit("0"), F.lit("")))
        again = F.array_max(F.transform(F.split(equal(F.sort_array(w)), "0+"), lambda run: F.length(run)))
        return F.greatest(beside, again) / F.greatest(F.size(w) - 1, F.lit(1))

    return F.get(F.transform(F.array(words), share), F.lit(0))  # the words are split once


def features(text: Column) -> dict[str, Column]:
    """Bin of each feature of a text, 0 to BINS - 1."""
    t = F.coalesce(text, F.lit(""))
    length = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(F.lower(F.trim(t)), r"\s+")
    lines = F.split(t, "\n")
    many = F.size(words).cast("double")

    def share(pattern: str) -> Column:
        """Characters outside `pattern`, a class of those to leave out."""
        return F.length(F.regexp_replace(t, f"[{pattern}]+", "")) / length

    def fine(x: Column) -> Column:
        """Shares near 0 get bins of their own."""
        return F.floor(F.sqrt(x) * BINS)

    found = {
        "capitals": fine(share(r"^\p{Lu}")),
        "symbols": fine(share(r"\p{L}\p{M}\p{N}\s.,;:!?'\"()\-")),
        "exclaimed": fine((length - F.length(F.replace(t, F.lit("!"), F.lit("")))) / length),
        "digits": fine(share(r"^\p{N}")),
        "fresh_words": F.floor(F.size(F.array_distinct(words)) / many * BINS),
        "fresh_lines": F.floor(F.size(F.array_distinct(lines)) / F.size(lines) * BINS),
        "word_length": F.floor(length / many),
        "repetition": fine(repetition(words)),
    }
    return {k: F.least(F.greatest(v, F.lit(0)), F.lit(BINS - 1)).cast("int") for k, v in found.items()}


@dataclass
class Evidence:
    """Log likelihood ratio, good against bad, of each bin of each feature."""

    ratios: dict[str, list[float]]

    def column(self, bins: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for name, ratios in self.ratios.items():
            total = total + F.get(F.array(*[F.lit(r) for r in ratios]), bins[name])
        return total


def fit_evidence(labelled: DataFrame) -> tuple[Evidence, float]:
    """Fit on `labelled`: the bins of `features` by name, and how often each row is called good and bad.

    Spark counts good and bad per bin; what comes back has BINS rows per feature.
    Also returns the share of good labels. Without labels there is no evidence
    either way, and the share is a half.
    """
    bins = [c for c in labelled.columns if c not in ("good", "bad")]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("bin")) for k in bins]))
    rows = (
        labelled.select("good", "bad", pairs.alias("x"))
        .groupBy("x.feature", "x.bin")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .collect()
    )
    ratios, share = {}, 0.5
    for name in bins:
        good, bad = [SMOOTHING] * BINS, [SMOOTHING] * BINS
        for r in rows:
            if r["feature"] == name:
                good[r["bin"]] += float(r["good"])
                bad[r["bin"]] += float(r["bad"])
        ratios[name] = [log(g / sum(good)) - log(b / sum(bad)) for g, b in zip(good, bad)]
        share = (sum(good) - SMOOTHING * BINS) / max(1.0, sum(good) + sum(bad) - 2 * SMOOTHING * BINS) if rows else 0.5
    return Evidence(ratios), min(max(share, 1e-3), 1 - 1e-3)


def _logit(p: Column) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(inside / (F.lit(1.0) - inside))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _strength(mean: Column, spread: Column) -> Column:
    """Weight of the level above, from how much the sites below it differ."""
    low, high = (F.lit(x) for x in STRENGTH)
    found = mean * (F.lit(1.0) - mean) / F.greatest(spread, F.lit(1e-9)) - F.lit(1.0)
    return F.coalesce(F.greatest(F.least(found, high), low), high)


def site_posteriors(scored: DataFrame, prior: float) -> DataFrame:
    """Host and path posteriors: host, path, path_n, path_sum, host_rate, path_strength.

    `scored` has host, path and evidence, a row per document of the whole corpus.
    Every document counts with its own probability of being good. The global
    rate is the prior of hosts and a host's shrunken rate that of its paths; how
    strongly is estimated from the spread of the rates at that level (method of
    moments), so sites with few documents stay near the level above.
    """
    p = _sigmoid(F.col("evidence") + F.lit(log(prior / (1 - prior))))
    paths = stage(
        scored.withColumn("p", p).groupBy("host", "path").agg(F.sum("p").alias("path_sum"), F.count(F.lit(1)).alias("path_n")),
        "quality-paths",
    )
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    hosts = stage(hosts.withColumn("raw", F.col("host_sum") / F.col("host_n")), "quality-hosts")
    top = hosts.agg(
        (F.sum("host_sum") / F.sum("host_n")).alias("rate"),
        F.var_samp("raw").alias("spread"),
    ).withColumn("strength", _strength(F.col("rate"), F.col("spread")))
    host_rate = (F.col("host_sum") + F.col("strength") * F.col("rate")) / (F.col("host_n") + F.col("strength"))
    shrunk = hosts.crossJoin(F.broadcast(top)).select(F.col("host").alias("_host"), host_rate.alias("host_rate"))
    placed = paths.join(shrunk, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    placed = stage(placed, "quality-placed")
    off = F.col("path_sum") / F.col("path_n") - F.col("host_rate")
    below = placed.agg(F.avg("host_rate").alias("mean"), F.avg(off * off).alias("spread"))
    below = below.select(_strength(F.col("mean"), F.col("spread")).alias("path_strength"))
    return placed.crossJoin(F.broadcast(below))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Bins and label counts of about LABELLED documents that have labels."""
    counts = (
        labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.sum("quality").cast("long").alias("good"), F.sum(1 - F.col("quality")).cast("long").alias("bad"))
    )
    counts = stage(counts, "quality-labels")
    share = min(1.0, LABELLED / max(1, counts.count()))
    chosen = counts.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample is bounded by LABELLED, so it may be sent to every task
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select(
        *[v.alias(k) for k, v in features(F.col("text")).items()], "good", "bad"
    )


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
) -> DataFrame:
    """One row per document: id, row (a hash of all columns), evidence, host_rate, path_rate, quality, keep.

    A naive Bayes classifier over binned features, fitted on `labels` (id_col,
    quality), gives each document's evidence. Its site gives the prior: the
    path's posterior rate without the document itself, shrunk towards the host's
    and that towards the global rate. Both meet in log odds; a document is kept
    if its probability of being good reaches THRESHOLD. The evidence of a text is
    worked out once and written; the rest works on these narrow rows.

    Null texts count as empty; null hosts and paths are sites like others. Labels
    that are null, neither 0 nor 1, or of unknown documents are left out; a
    document with several labels counts with each. Without labels everything has
    its site's rate of 0.5 and is kept. Repeated rows are scored each. An empty
    table gives an empty result.
    """
    evidence, prior = fit_evidence(_labelled(docs, labels, id_col, text_col))
    scored = docs.select(
        F.col(id_col).alias("id"),
        row_hash(docs).alias("row"),
        F.col(host_col).alias("host"),
        F.col(path_col).alias("path"),
        evidence.column(features(F.col(text_col))).alias("evidence"),
    )
    scored = stage(scored, "quality-evidence")
    sites = stage(site_posteriors(scored, prior), "quality-sites")
    sites = sites.withColumnsRenamed({"host": "site_host", "path": "site_path"})
    own = _sigmoid(F.col("evidence") + F.lit(log(prior / (1 - prior))))
    others = F.greatest(F.col("path_sum") - own, F.lit(0.0)) + F.col("path_strength") * F.col("host_rate")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")), "left")
    return (
        joined.withColumn("path_rate", others / (F.col("path_n") - 1 + F.col("path_strength")))
        .withColumn("quality", _sigmoid(F.col("evidence") + _logit(F.col("path_rate"))))
        .withColumn("keep", F.col("quality") >= THRESHOLD)
        .select("id", "row", "evidence", "host_rate", "path_rate", "quality", "keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows of `docs` that `quality_scores` keeps, with all their columns."""
    scores = quality_scores(docs, labels, id_col, **columns)
    kept = scores.where("keep").select(keyed(F.col("id")).alias("_kept_id"), F.col("row").alias("_kept_row"))
    kept = stage(kept.distinct(), "quality-kept")
    hashed = docs.select(whole(docs), keyed(F.col(id_col)).alias("id"), row_hash(docs).alias("row"))
    same = (hashed["id"] == kept["_kept_id"]) & (hashed["row"] == kept["_kept_row"])
    return hashed.join(kept, same, "left_semi").select("doc.*")

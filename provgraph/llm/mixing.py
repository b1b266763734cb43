"""Mixing sources to target weights, with soft membership, in DataFrame functions alone.

A naive Bayes classifier of hashed words, fitted to a labelled table, gives every document a posterior
over domains. Documents then get rates within bounds so that the expected domain token totals, sums of
rate * tokens * posterior, meet targets in the least-squares sense, and of such rates nearly those
closest to 1. Such rates are 1 - posterior . shift, cut to the bounds, with one shift for all documents:
the minimum of a convex function of as many variables as there are domains, found by Newton's method
with a line search. A step is one distributed sum of the totals and their slopes and one of the function
at several lengths of the step.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.llm.shared import Stage

BUCKETS = 4096
#: Most labelled rows that the classifier is fitted to; of more, those with the smallest hash of their id.
SAMPLE = 20_000
#: First weight of the distance of rates from 1 against that of totals, as shares of all tokens, from targets.
KEPT = 1e-4

log = logging.getLogger(__name__)


def words_of(text: Column) -> Column:
    """Words between white space, A-Z and other letters as lower case; none of a null or empty text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def buckets_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _numbers(values) -> Column:
    """An array of doubles as one literal."""
    return F.from_json(F.lit(json.dumps([round(float(v), 4) for v in values])), "array<double>")


@dataclass
class DomainModel:
    """Log prior of each domain and log likelihood of each bucket, less the mean over domains."""

    domains: list[str]
    prior: np.ndarray
    likelihood: np.ndarray

    def evidence(self, buckets: Column) -> Column:
        """array<double>: for each domain its prior + summed likelihoods / number of words to the power 3/4.

        The divisor tempers evidence that words only seem to give apiece, so membership stays soft.
        """
        scale = F.pow(F.greatest(F.size(buckets), F.lit(1)).cast("double"), F.lit(0.75))

        def summed(k: int) -> Column:
            table = _numbers(self.likelihood[k])
            return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))

        return F.array(*(F.lit(float(self.prior[k])) + summed(k) / scale for k in range(len(self.domains)))).cast("array<double>")


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DomainModel:
    """Fit to ``labelled`` (id, domain) joined with the texts.

    At most ``sample`` labelled ids, those with the smallest hash, take part; null ids and domains do
    not, and of several domains of one id the smallest counts; rows that repeat an id all count. Only
    counts for each domain and bucket reach the driver. Without labelled documents there are no domains.
    """
    chosen = labelled.where(f"{id_col} is not null and domain is not null").groupBy(id_col).agg(F.min("domain").alias("domain")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col)  # bounded by ``sample``
    counted = rows.select("domain", buckets_of(words_of(F.col("text"))).alias("buckets"))
    many = counted.groupBy("domain").count().orderBy("domain").collect()
    if not many:
        return DomainModel([], np.zeros(0), np.zeros((0, BUCKETS)))
    domains = [r.domain for r in many]
    seen = np.zeros((len(domains), BUCKETS))
    # explode_outer: for explode the optimizer would filter on the array below the join, for every document
    for r in counted.select("domain", F.explode_outer("buckets").alias("b")).where("b is not null").groupBy("domain", "b").count().collect():
        seen[domains.index(r.domain), r.b] = r["count"]
    share = (seen + 1) / (seen.sum(axis=1, keepdims=True) + BUCKETS)
    prior = np.log(np.array([r["count"] for r in many]) / sum(r["count"] for r in many))
    return DomainModel(domains, prior, np.log(share) - np.log(share).mean(axis=0))


@dataclass
class Rates:
    """Rates as a function of the posterior, and the totals that they reach beside their targets."""

    domains: list[str]
    shift: np.ndarray
    low: float
    high: float
    totals: np.ndarray
    targets: np.ndarray

    def rate(self, posterior: Column) -> Column:
        return _rate(_along(posterior, self.shift), self.low, self.high)

    def report(self) -> str:
        """Reached and target totals of each domain."""
        return ", ".join(f"{x} {t:.1f} of {w:.1f}" for x, t, w in zip(self.domains, self.totals, self.targets, strict=True))


def _along(posterior: Column, shift: np.ndarray) -> Column:
    """posterior . shift, with the shift as a literal, so that plans and generated code stay small."""
    held = F.from_json(F.lit(json.dumps([float(x) for x in shift])), "array<double>")
    return F.aggregate(F.zip_with(posterior, held, lambda p, x: p * x), F.lit(0.0), lambda s, y: s + y)


def _middle(low: float, high: float) -> float:
    return min(max(1.0, low), high)


def _rate(along: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.lit(_middle(low, high)) - along))


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], budget: float = 1.0, low: float = 0.0, high: float = math.inf, close: float = 1e-4) -> Rates:
    """Rates within [low, high] for ``members`` (n_tokens, posterior).

    Targets are the weights, brought to sum 1, times ``budget`` times all tokens; a domain without a
    weight has target 0. A step is two sums over all documents. There are as many as it takes until
    every total is within ``close`` of all tokens. Where a minimum is found before, the weight of the
    distance from 1 goes down to a tenth; if that moves no total by half of ``close``, targets are out of
    reach and the totals are the nearest ones.
    """
    d = len(domains)
    if not d:
        return Rates([], np.zeros(0), low, high, np.zeros(0), np.zeros(0))
    at = lambda k: F.get("posterior", F.lit(k))
    tokens = F.col("n_tokens").cast("double")
    whole = members.agg(F.coalesce(F.sum(tokens), F.lit(0.0))).first()[0]
    total = max(whole, 1.0)
    want = np.array([max(0.0, weights.get(x, 0.0)) for x in domains])
    targets = want / max(want.sum(), 1e-300) * budget * whole
    out = Rates(domains, np.zeros(d), low, high, np.zeros(d), targets)
    summed = lambda x: F.coalesce(F.sum(tokens * x), F.lit(0.0))
    upper = np.triu_indices(d)
    kept, last = KEPT, None
    while True:
        rated = members.select("n_tokens", "posterior", out.rate(F.col("posterior")).alias("rate"))
        free = ((F.col("rate") > low) & (F.col("rate") < high)).cast("double")
        found = rated.agg(*(summed(at(k) * F.col("rate")) for k in range(d)), *(summed(at(j) * at(k) * free) for j, k in zip(*(x.tolist() for x in upper), strict=True))).first()
        out.totals = np.array(found[:d])
        bend = np.zeros((d, d))
        bend[upper] = np.array(found[d:]) / total
        error = (out.totals - targets) / total
        if np.abs(error).max() <= close:
            break
        if np.abs(kept * out.shift - error).max() <= close / 100:
            if last is not None and np.abs(out.totals - last).max() <= close / 2 * total:
                break
            kept, last = kept / 10, out.totals
        slope = kept * out.shift - error
        bend = np.maximum(bend, bend.T) + np.eye(d) * kept
        tried = out.shift - np.array([0.0, *(0.25**k for k in range(15))])[:, None] * np.linalg.solve(bend, slope)
        held = members.select("n_tokens", *(_along(F.col("posterior"), v).alias(f"u{k}") for k, v in enumerate(tried)))
        middle = _middle(low, high)
        least = lambda u: F.pow(_rate(u, low, high) - middle, F.lit(2.0)) / 2 + u * _rate(u, low, high)
        gained = np.array(held.agg(*(summed(least(F.col(f"u{k}"))) for k in range(len(tried)))).first())
        loss = kept / 2 * (tried**2).sum(axis=1) - gained / total + tried @ targets / total
        if loss.argmin() == 0:  # as near as doubles come
            break
        out.shift = tried[loss.argmin()]
    log.info("totals reached: %s", out.report())
    return out


def memberships(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words) and posterior; no shuffle."""
    held = docs.withColumn("_buckets", buckets_of(words_of(F.col(text_col).cast("string"))))
    held = held.withColumn("n_tokens", F.size("_buckets").cast("long")).withColumn("_raw", model.evidence(F.col("_buckets")))
    held = held.withColumn("_most", F.array_max("_raw")).withColumn("_raised", F.transform("_raw", lambda x: F.exp(x - F.col("_most"))))
    held = held.withColumn("_sum", F.aggregate("_raised", F.lit(0.0), lambda s, x: s + x))
    return held.withColumn("posterior", F.transform("_raised", lambda x: x / F.col("_sum"))).drop("_buckets", "_raw", "_most", "_raised", "_sum")


def mix_to_targets(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0, low: float = 0.0, high: float = math.inf, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Rates]:
    """(id, n_tokens, posterior, domain, rate) of every row, and the fit.

    Null and empty texts have no tokens, the prior as posterior, and a rate like any other; null ids
    and repeated rows stay. Other columns of ``docs`` are left out. Targets that bounds or too few
    documents make unreachable are met as nearly as the bounds allow. Of equal posteriors the domain that
    sorts first is told. Without labelled documents (an empty table of either kind) there are no domains:
    posteriors are empty, the domain is null and every rate is the one within the bounds next to 1.
    """
    model = fit_domains(docs, labelled, id_col, text_col)
    stage = Stage(docs.sparkSession, "mixing")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members = stage.put(memberships(narrow, model).select("id", "n_tokens", "posterior"), "members")
    fit = fit_rates(members, model.domains, weights, budget, low, high)
    names = F.array(*(F.lit(x) for x in model.domains))
    domain = F.lit(None).cast("string") if not model.domains else F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return members.select(F.col("id").alias(id_col), "n_tokens", "posterior", domain.alias("domain"), fit.rate(F.col("posterior")).alias("rate")), fit


def repeat_by_rate(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float, low: float, high: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` floor(rate) times, and once more with the rest as its chance, by a hash of its id.

    Rows of one id, or without one, are decided alike. Without labelled documents rates are those next to 1.
    """
    model = fit_domains(docs, labelled, id_col, text_col)
    stage = Stage(docs.sparkSession, "mixing")
    # the rows with their posteriors are written once: every step, and the rates, read the columns they need
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("text"), F.col(id_col).alias("_id"))
    members = stage.put(memberships(held, model).select("_row", "_id", "n_tokens", "posterior"), "members")
    fit = fit_rates(members, model.domains, weights, budget, low, high)
    copies = F.floor(fit.rate(F.col("posterior")) + F.pmod(F.xxhash64("_id", F.lit("mixing")), F.lit(1 << 20)) / (1 << 20)).cast("int")
    return members.select("_row", copies.alias("_copies")).where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains from a table (doc_id, quality, toxic): toxic, else good or poor by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


WEIGHTS = {"good": 0.8, "poor": 0.15, "toxic": 0.05}


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed, fit = mix_to_targets(docs, label_domains(labels), WEIGHTS)
    shown = [F.get("posterior", F.lit(k)).alias(f"p_{x}") for k, x in enumerate(fit.domains)]
    return mixed.select("doc_id", "n_tokens", *shown, "domain", "rate")

"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A classifier of hashed letter n-grams, fitted on labelled documents of any domain column, predicts how likely a
document is of each domain. Projected gradient steps then fit a nonnegative rate for each document so
that the expected tokens of the domains match the targets in the least-squares sense.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import SPACED_WORD, column, cut, labelled_sample

#: Most labelled texts that the classifier is fitted on.
SAMPLE = 20_000
#: Letters of a word's beginning and end that count, and buckets that they are hashed into; a domain is as many numbers, so a hundred domains are 3 MB.
LETTERS, BUCKETS = 3, 4096
#: Share of all domains' words in each domain's probabilities, so that an unseen bucket speaks for none.
BACKGROUND = 0.1
#: Gradient rounds at most, and the relative error of the totals at which they end.
ROUNDS, ERROR = 25, 1e-4


class Membership(NamedTuple):
    """Domains, and of each the log prior and the log probability of each bucket of n-grams."""

    domains: list[str]
    prior: list[float]
    grams: list[list[float]]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _words(text: Column) -> Column:
    """The white-space tokens of a text, A-Z and all other capitals lowered."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _grams(words: Column, buckets: int) -> Column:
    """The buckets of the words' beginnings and of their ends, each with a mark on its side."""

    def bucket(gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")

    firsts = F.transform(words, lambda w: bucket(F.concat(F.substring(w, 1, LETTERS), F.lit("-"))))
    return F.concat(firsts, F.transform(words, lambda w: bucket(F.concat(F.lit("-"), F.substring(w, -LETTERS, LETTERS)))))


def tokens(text: Column) -> Column:
    """White-space tokens of a text: places where a word starts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("double")


def train(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> Membership:
    """The n-gram model (multinomial naive Bayes) of the domains of at most ``sample`` labelled documents.

    N-grams are counted by Spark; only BUCKETS numbers a domain come to the driver. Every domain of the
    sample counts.
    """
    named = docs.where(column(domain_col).isNotNull()).select(column(id_col).alias("doc_id"), column(text_col).alias("text"), column(domain_col).cast("string").alias("domain"))
    chosen = labelled_sample(named, labels.select("doc_id", F.lit(1.0).alias("known")), "known", sample).select("doc_id").withColumnRenamed("doc_id", "s_id")
    rows = named.join(F.broadcast(chosen), F.col("doc_id") == F.col("s_id")).select("domain", _words(F.col("text")).alias("words"))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {d: [0.0] * BUCKETS for d in sorted(sizes)}
    held = rows.select("domain", F.explode(_grams(F.col("words"), BUCKETS)).alias("bucket")).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))
    for r in held.collect():
        counts[r["domain"]][r["bucket"]] += r["n"]
    whole = sum(sizes.values())
    of_all = [sum(x) + 0.5 for x in zip(*counts.values())]
    shares = [[v / (sum(x) or 1.0) for v in x] for x in (*counts.values(), of_all)]
    words = [[log((1 - BACKGROUND) * v + BACKGROUND * b) for v, b in zip(x, shares[-1])] for x in shares[:-1]]
    return Membership(list(counts), [log(sizes[d] / whole) for d in counts], words)


def _adder(table: Column) -> Callable[[Column, Column], Column]:
    return lambda total, at: total + F.get(table, at)


def with_membership(rows: DataFrame, model: Membership, text: Column, column: str = "posterior") -> DataFrame:
    """``rows`` with an array of the document's posterior of each domain; the sum is one.

    All words of a text count; the longer a text, the surer its domain. A table of BUCKETS numbers
    a domain goes along in the plan as one value.
    """
    if not model.domains:
        return rows.withColumn(column, F.array().cast("array<double>"))
    others, domains, size = [c for c in rows.columns if c != column], range(len(model.domains)), len(model.grams[0])
    row = rows.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_mix_row"), _words(text).alias("_mix_words")).select("_mix_row", _grams(F.col("_mix_words"), size).alias("_mix_at"))
    # Folded into one value by Spark: an array of literals would be as many expressions.
    tables = [F.from_json(F.lit(json.dumps(x)), "array<double>") for x in model.grams]
    logs = [F.aggregate("_mix_at", F.lit(model.prior[k]), _adder(tables[k])) for k in domains]
    weighed = row.select("_mix_row", F.array(*logs).alias("_mix_logs")).select("_mix_row", "_mix_logs", F.array_max("_mix_logs").alias("_mix_top"))
    weights = weighed.select("_mix_row", *(F.exp(F.col("_mix_logs")[k] - F.col("_mix_top")).alias(f"_mix_w{k}") for k in domains))
    whole = weights.withColumn("_mix_whole", _sum([F.col(f"_mix_w{k}") for k in domains]))
    return whole.select(*(F.col("_mix_row")[c].alias(c) for c in others), F.array(*(F.col(f"_mix_w{k}") / F.col("_mix_whole") for k in domains)).alias(column))


def rate(posterior: Column, steps: list[list[float]]) -> Column:
    """The document's rate after the given gradient steps: each is projected on rates of zero or more."""
    out = F.lit(1.0)
    for step in steps:
        out = F.greatest(F.lit(0.0), out - reduce(lambda a, b: a + b, (posterior[k] * F.lit(v) for k, v in enumerate(step))))
    return out


class Fit(NamedTuple):
    """Gradient steps, and how far the totals stay from the targets after them (of all tokens, the worst domain's)."""

    steps: list[list[float]]
    residual: float


def fit_steps(rows: DataFrame, model: Membership, targets: Mapping[str, float] | None = None, rounds: int = ROUNDS, error: float = ERROR) -> Fit:
    """Gradient steps that bring the expected domain tokens of ``rows`` (n_tokens, posterior) to the targets.

    Targets are shares of all tokens by domain (equal shares by default; domains that aren't named
    have none); a target for a domain that isn't among the labelled ones is an error. A round is one
    distributed sum of as many numbers as there are domains. All rates start at one, and a document's
    gradient is a function of its posterior, so the steps themselves, a few numbers each, are all that
    has to be kept between rounds.
    """
    if unknown := [d for d, w in (targets or {}).items() if w and d not in model.domains]:
        raise ValueError(f"targets name domains that no labelled document has: {', '.join(sorted(unknown))}")
    k = len(model.domains)
    wanted = [1.0 if targets is None else float(targets.get(d, 0.0)) for d in model.domains]
    start: list[float] | None = None
    steps: list[list[float]] = []
    while True:
        now = rate(F.col("posterior"), steps) * F.col("n_tokens")
        row = rows.agg(*(F.sum(now * F.col("posterior")[i]).alias(f"s{i}") for i in range(k))).first()
        have = [row[f"s{i}"] or 0.0 for i in range(k)]
        if start is None:
            start, whole = have, sum(have)
            goal = [whole * w / (sum(wanted) or 1.0) for w in wanted]
        residual = max(abs(h - g) for h, g in zip(have, goal)) / whole if whole > 0 else 0.0
        if residual <= error or len(steps) == rounds:
            return Fit(steps, residual)
        # Scaled by the totals at the start, the normal matrix has no eigenvalue above one: a full step is stable.
        steps.append([(h - g) / max(s, 1e-9) for h, g, s in zip(have, goal, start)])


def _rated(docs: DataFrame, row: list[Column], labels: DataFrame, targets: Mapping[str, float] | None, id_col: str, text_col: str, domain_col: str, sample: int) -> tuple[DataFrame, Membership, Fit]:
    """``row``, n_tokens, posterior, rate and copies of each document; texts are classified once, then the lineage is cut."""
    model = train(docs, labels, domain_col, sample, text_col, id_col)
    text = column(text_col)
    facts = docs.select(*row, tokens(text).alias("n_tokens"), F.xxhash64(column(id_col), text).alias("key"), text.alias("text"))
    rows = cut(with_membership(facts, model, F.col("text")).drop("text"))
    fit = fit_steps(rows, model, targets) if model.domains else Fit([], 0.0)
    rated = rows.withColumn("rate", rate(F.col("posterior"), fit.steps))
    return rated.withColumn("copies", copies(F.col("rate"), F.col("key"))), model, fit


def mixing_rates(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """Per document its tokens, membership by domain (a map), rate and copies, and the ``residual`` of the whole fit.

    ``copies`` is the rate rounded to a whole number, up or down by a hash of id and text with a chance
    of the fraction, so the expected copies are the rate. Null and empty texts have no tokens and the
    prior's membership; a domain with a null name isn't learnt; rows with equal id and text share rate
    and copies; extra columns are ignored. Without labelled rows there are no domains, and all rates are
    one. A target for a domain that isn't among the labelled ones is an error.
    """
    rated, model, fit = _rated(docs, [column(id_col).alias("doc_id")], labels, targets, id_col, text_col, domain_col, sample)
    names = F.array(*(F.lit(d) for d in model.domains)).cast("array<string>")
    membership = F.map_from_arrays(names, "posterior").alias("membership")
    return rated.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), membership, "rate", "copies", F.lit(fit.residual).alias("residual"))


def copies(rate_: Column, key: Column) -> Column:
    """A whole number whose expectation over keys is the rate."""
    chance = F.shiftrightunsigned(F.xxhash64(key, F.lit("copies")), 11).cast("double") / F.lit(float(1 << 53))
    return (F.floor(rate_) + (chance < rate_ - F.floor(rate_)).cast("long")).cast("int")


def mixed_documents(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with each row as often as its rate says; all columns stay.

    Rows lie beside their posteriors in the checkpoint between the passes, so nothing is joined and no
    text is shuffled or classified twice.
    """
    rated, _, _ = _rated(docs, [F.struct(*map(column, docs.columns)).alias("row")], labels, targets, id_col, text_col, domain_col, sample)
    # A row repeats by exploding a list of as many numbers as it has copies.
    return rated.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))

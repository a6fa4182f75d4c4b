"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic model of surface features gives each document's own evidence. Soft counts of good documents
are aggregated by path and host; a sparse path is shrunk toward its host and a sparse host toward the
corpus, with as much weight as the spread between them calls for.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import bounded_broadcast, column, cut, labelled_sample

#: Most labelled texts that the document model is fitted on.
SAMPLE = 20_000
#: A document is kept if its posterior of being good is at least this.
THRESHOLD = 0.5
#: Rows of the table of paths that may be broadcast (about 60 bytes each).
BROADCAST_PATHS = 200_000
#: Bounds of the weight that shrinkage may have, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0

_CLASSES = (b"#*$%&@^~=_<>{}[]\\", b"|", b"!?", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\r\x0b\x0c", b".,;:", bytes(range(128, 256)))
_CLASS_OF = np.full(256, len(_CLASSES))
for _n, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes)] = _n


def features_of(text: str | None) -> list[float]:
    """Surface features: shares of byte classes, word and line repetition, lengths."""
    data = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, counts, len(_CLASSES) + 1)[: len(_CLASSES)] / max(1, len(data))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    return [
        *np.sqrt(shares).tolist(),
        np.log1p(len(words)),
        len(set(words)) / np.sqrt(max(1, len(words))),
        len(set(lines)) / max(1, len(lines)),
        len(data) / max(1, len(words)) / 10.0,
        float(len(words) < 10),
    ]


class Model(NamedTuple):
    """A logistic model on standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(rows)), (rows - self.centre) / self.scale, ((rows - self.centre) / self.scale) ** 2])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """Newton's method for the ridge-penalised logistic likelihood; features enter with their squares.

    Without labelled rows, or with one class alone, only the prior is fitted.
    """
    k = len(features_of(""))
    if not len(rows):
        return Model(np.zeros(k), np.ones(k), np.zeros(2 * k + 1))
    centre, scale = rows.mean(0), rows.std(0) + 1e-6
    z = np.column_stack([np.ones(len(rows)), (rows - centre) / scale, ((rows - centre) / scale) ** 2])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (labels - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(centre, scale, w)


def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features_of(t) for t in texts], dtype="object")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The document model, from at most ``sample`` labelled texts; their features alone come to the driver."""
    rows = labelled_sample(docs, labels, label_col, sample).select(F.pandas_udf(_features, "array<double>")("text").alias("x"), "label").collect()
    return fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]))


def document_evidence(model: Model, text: Column) -> Column:
    """The model's probability that a document is good."""

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        rows = np.array([features_of(t) for t in texts]) if len(texts) else np.empty((0, len(model.centre)))
        return pd.Series(np.clip(model.probability(rows), 1e-6, 1 - 1e-6))

    return evidence(text)


def _weight(groups: DataFrame, mean: str, prior: Column) -> float:
    """Documents that the prior of these groups is worth, by the method of moments.

    ``groups`` has counts ``n`` and soft counts ``s``. The spread of the means beyond what chance gives
    in groups of these sizes is the spread of the groups' true rates.
    """
    d = F.col("s") / F.col("n") - prior
    chance = prior * (1 - prior)
    row = groups.where("n > 1").agg(
        F.sum(F.col("n") * d * d).alias("spread"), F.sum(chance).alias("chance"), F.sum(F.col("n") * chance).alias("room"), F.sum(chance * 1.0).alias("each")
    ).first()
    if not row or row["spread"] is None:
        return LEAST_WEIGHT
    # spread = sum of chance + tau * (room - each), where tau is the share of the room that groups differ by.
    tau = (row["spread"] - row["chance"]) / max(row["room"] - row["each"], 1e-12)
    return float(np.clip(1 / tau - 1, LEAST_WEIGHT, MOST_WEIGHT)) if tau > 0 else MOST_WEIGHT


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _posteriors(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """Per document its row as a struct, and a struct of the document's, host's and path's probability and the posterior.

    The evidence on a host or path that a document meets leaves the document itself out. Hosts and
    paths are aggregated before they are shuffled, so a host with a third of all rows is one row a
    task; documents meet the table of paths by a broadcast of checked size, else by a join that Spark
    can split. Null and empty texts have the features of an empty text; null hosts and paths are
    groups of their own; repeated rows count as often as they stand; with no labels all documents have
    a posterior of one half. Columns may have any names.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, sample=sample)
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    host, path = named(host_col), named(path_col)
    paths = cut(
        docs.select(host.alias("host"), path.alias("path"), document_evidence(model, F.col(text_col)).alias("p"))
        .groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"))
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (whole["s"] or 0.0) / whole["n"] if whole["n"] else 0.5
    host_weight = _weight(hosts, "host", F.lit(mean))
    of_host = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), F.col("s").alias("h_s"))
    joined = paths.join(of_host, F.col("host") == F.col("h_host"))
    host_mean = (F.col("h_s") + host_weight * mean) / (F.col("h_n") + host_weight)
    path_weight = _weight(joined, "path", host_mean)
    facts = joined.select(F.col("host").alias("_q_of_host"), F.col("path").alias("_q_of_path"), F.struct("n", "s", "h_n", "h_s").alias("_q_of"))
    # A row goes along as one struct, so that its columns may have any names.
    row = F.struct(*(column(c) for c in docs.columns)).alias("_q_row")
    scored = docs.select(row, document_evidence(model, F.col(text_col)).alias("_q_p"), host.alias("_q_host"), path.alias("_q_path"))
    met = scored.join(bounded_broadcast(facts, BROADCAST_PATHS), (F.col("_q_host") == F.col("_q_of_host")) & (F.col("_q_path") == F.col("_q_of_path")))
    of, own = F.col("_q_of"), F.col("_q_p")
    host_p = (of["h_s"] - own + host_weight * mean) / (of["h_n"] - 1 + host_weight)
    path_p = (of["s"] - own + path_weight * host_p) / (of["n"] - 1 + path_weight)
    posterior = 1 / (1 + F.exp(-(_logit(own) + _logit(path_p) - _logit(F.lit(mean)))))
    return met.select("_q_row", F.struct(own.alias("p_document"), host_p.alias("p_host"), path_p.alias("p_path"), posterior.alias("posterior")).alias("_q_found"))


def with_posterior(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` with ``_q``, the struct of :func:`_posteriors`; a column of that name is replaced, all others stay."""
    found = _posteriors(docs, labels, **how)
    return found.select(*(F.col("_q_row")[c].alias(c) for c in docs.columns if c != "_q"), F.col("_q_found").alias("_q"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per document its evidence, what its host and path say, the posterior, and whether it is kept."""
    needed = docs.select(F.col(id_col).alias("doc_id"), "text", "source", "lang")
    found = with_posterior(needed, labels)
    return found.select("doc_id", "_q.*", (F.col("_q.posterior") >= threshold).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """``docs`` with the rows whose posterior of being good is at least ``threshold``; all columns stay."""
    found = _posteriors(docs, labels, **how).where(F.col("_q_found.posterior") >= threshold)
    return found.select(*(F.col("_q_row")[c].alias(c) for c in docs.columns))

"""Rates for documents so that the expected tokens of every domain meet a target.

Domains are soft: a classifier learned from the labelled table gives each document a posterior over them. Rates are
found by projected gradient steps on the squared gaps between expected and wanted tokens. All of it is DataFrame work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BUCKETS, own_name
from gridloom.session import cut_lineage

FIT_ROWS = 20_000
FEATURES = 128
STEPS = 40
TOLERANCE = 1e-4
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


@dataclass(frozen=True)
class Domains:
    """Domains, their log shares, and for each feature word its log chance among the feature words of each domain."""

    names: list[str]
    start: list[float]
    odds: dict[str, list[float]]


def _words(text: str) -> Column:
    """Lower-cased runs of letters and digits; none for null and empty texts."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def learn(documents: DataFrame, labels: DataFrame, domain: str = "lang", rows: int = FIT_ROWS, features: int = FEATURES) -> Domains:
    """A naive Bayes classifier over the words that tell domains apart best, from documents that the labelled table covers.

    About ``rows`` labelled keys are drawn by hash, so what is broadcast is bounded. Kept are the ``features`` words of
    the highest mutual information with the domain. Rows without a domain teach nothing; without any rows there are no
    domains.
    """
    keys = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    n = keys.count()
    drawn_keys = keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)) < int(BUCKETS * min(1.0, rows / max(1, n))) + 1)
    known = documents.select("doc_id", F.col(domain).cast("string").alias("domain"), "text").where(F.col(domain).isNotNull())
    drawn = known.join(F.broadcast(drawn_keys), "doc_id", "left_semi")
    present = cut_lineage(drawn.select("domain", F.array_distinct(_words("text")).alias("words")))
    totals = {r["domain"]: r["n"] for r in present.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, size = sorted(totals), sum(totals.values())
    if not names:
        return Domains([], [], {})
    each = present.select("domain", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(names)))
    held = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    chances = [(F.col(f"n{i}") + 0.5) / (totals[d] + 1.0) for i, d in enumerate(names)]
    overall = (held + 0.5) / (size + 1.0)
    gain = sum(
        (F.lit(totals[d] / size) * (c * F.log(c / overall) + (1 - c) * F.log((1 - c) / (1 - overall))) for d, c in zip(names, chances, strict=True)),
        F.lit(0.0),
    )
    model = counts.where(held >= 2).select("word", gain.alias("gain"), F.array(*chances).alias("chances"))
    chosen = sorted(model.orderBy(F.desc("gain"), "word").limit(features).collect(), key=lambda r: r["word"])
    sums = [sum(r["chances"][i] for r in chosen) for i in range(len(names))]
    odds = {r["word"]: [math.log(c / s) for c, s in zip(r["chances"], sums, strict=True)] for r in chosen}
    return Domains(names, [math.log(totals[d] / size) for d in names], odds)


def posteriors(docs: DataFrame, domains: Domains, tokens: str, posterior: str, text: str = "text") -> DataFrame:
    """``docs`` with two more columns: its words (long) and the chance of each domain (array<double>, order of the names).

    A row needs no other row. The model is a constant of at most ``FEATURES`` words in the plan.
    """
    words, found = _words(text), own_name([*docs.columns, tokens, posterior])
    if not domains.odds:
        known = [math.exp(s) for s in domains.start]
        return docs.withColumns({tokens: F.size(words).cast("long"), posterior: F.array(*(F.lit(p) for p in known)).cast("array<double>")})
    hits = F.array_intersect(words, F.array(*(F.lit(w) for w in domains.odds)))
    weights = F.create_map(*(x for w, odds in domains.odds.items() for x in (F.lit(w), F.array(*(F.lit(float(v)) for v in odds)))))
    start = F.array(*(F.lit(float(p)) for p in domains.start))
    counted = docs.withColumns({tokens: F.size(words).cast("long"), found: hits})
    total = F.aggregate(found, start, lambda acc, w: F.zip_with(acc, F.element_at(weights, w), lambda a, b: a + b))
    scored = counted.withColumn(found, total)
    # 1 / sum(exp(other - own)) needs no array for the shifted scores.
    parts = [F.col(found)[i] for i in range(len(domains.names))]
    normal = F.array(*(1.0 / sum((F.exp(F.least(other - own, F.lit(700.0))) for other in parts), F.lit(0.0)) for own in parts))
    return scored.withColumn(posterior, normal).drop(found)


def rate_column(posterior: str, gaps: list[list[float]], step: float) -> Column:
    """The rate after the given gradient steps: a function of a row's posterior alone, so no state is kept per row."""
    rate = F.lit(1.0)
    for gap in gaps:
        slope = sum((F.col(posterior)[d] * g for d, g in enumerate(gap)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - step * slope)
    return rate


def fit_rates(scored: DataFrame, domains: Domains, targets: dict[str, float] | None, tokens: str, posterior: str, total: float | None = None, steps: int = STEPS) -> tuple[Column, dict[str, float]]:
    """The rate of a row as a column, and the expected tokens of each domain under it.

    Minimises sum_d (A_d - T_d)^2 / G_dd over rates >= 0, with A_d = sum_i rate_i tokens_i posterior_id, starting from
    rates of one. A gradient step changes a rate by the row's posterior times a vector shared by all rows, so a pass
    over the table returns one sum per domain and the rates are recomputed from the steps so far. ``targets`` are
    weights (missing domains: zero; None or all zero: equal); ``total`` defaults to the tokens of the table.
    """
    names = domains.names
    many = len(names)
    weights = [max(0.0, (targets or {}).get(d, 0.0)) for d in names]
    weights = weights if sum(weights) else [1.0] * many
    if not many:
        return F.lit(1.0), {}
    p = [F.col(posterior)[d] for d in range(many)]
    n = F.col(tokens).cast("double")
    sums = [F.sum(n).alias("n")] + [F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(many) for j in range(i, many)]
    first = scored.agg(*sums).first()
    if not first["n"]:
        return F.lit(1.0), dict.fromkeys(names, 0.0)
    whole = first["n"] if total is None else total
    want = [w / sum(weights) * whole for w in weights]
    gram = [[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(many)] for i in range(many)]
    scale = [1.0 / max(gram[d][d], 1e-9 * first["n"]) for d in range(many)]
    # The largest eigenvalue of the scaled Gram matrix is at most its largest row sum.
    step = 1.0 / max(sum(math.sqrt(scale[i] * scale[j]) * gram[i][j] for j in range(many)) for i in range(many))
    gaps: list[list[float]] = []
    before = math.inf
    while True:
        rate = rate_column(posterior, gaps, step)
        row = scored.agg(*(F.sum(n * p[d] * rate).alias(f"a{d}") for d in range(many))).first()
        have = [row[f"a{d}"] or 0.0 for d in range(many)]
        loss = sum((h - w) ** 2 * s for h, w, s in zip(have, want, scale, strict=True))
        done = max(abs(h - w) for h, w in zip(have, want, strict=True)) <= TOLERANCE * whole or before - loss <= 1e-9 * max(loss, 1e-30)
        if done or len(gaps) >= steps:
            return rate, dict(zip(names, have, strict=True))
        before = loss
        gaps.append([(h - w) * s for h, w, s in zip(have, want, scale, strict=True)])


def mix(
    docs: DataFrame, documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang",
    key: str = "doc_id", text: str = "text", columns: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_domain``, ``mix_posterior``, ``mix_rate`` and ``mix_copies``; no row is dropped.

    The classifier learns from ``documents`` and ``labels``; ``docs`` are what is mixed. ``mix_rate`` is how often a
    document should be seen, ``mix_copies`` that number rounded up or down by a hash of the key, so that the expectation
    is kept; a document that is not drawn has zero copies. Null and empty texts have no tokens and the posterior of a text
    without feature words. Repeated rows get equal values. Without labelled rows there are no domains and every rate
    is one; an empty table gives an empty result. Input columns of the names above are replaced.
    """
    names = ["mix_tokens", "mix_domain", "mix_posterior", "mix_rate", "mix_copies"]
    kept = [c for c in (columns or docs.columns) if c.lower() not in names]
    domains = learn(documents, labels, domain)
    needed = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, key, text])))
    scored = posteriors(needed, domains, "mix_tokens", "mix_posterior", text)
    written = cut_lineage(scored.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, key])), "mix_tokens", "mix_posterior"))
    rate, _ = fit_rates(written, domains, targets, "mix_tokens", "mix_posterior")
    best = F.array_position("mix_posterior", F.array_max("mix_posterior"))
    name = F.element_at(F.array(*(F.lit(d) for d in domains.names)), best.cast("int")) if domains.names else F.lit(None).cast("string")
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(BUCKETS)) / BUCKETS
    rated = written.withColumns({"mix_domain": name, "mix_rate": rate})
    copies = F.floor("mix_rate") + F.when(draw < F.col("mix_rate") - F.floor("mix_rate"), 1).otherwise(0)
    return rated.withColumn("mix_copies", copies.cast("long")).select(*(F.col(f"`{c}`") for c in kept), *names)

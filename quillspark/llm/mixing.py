"""Mixing sources to target weights with soft memberships, in DataFrame functions only.

A multinomial classifier is fitted on labelled rows (word counts of each domain in hashed buckets) and gives every
document posteriors over the domains. A document's expected tokens by domain are its tokens times its posteriors. Its
rate, how often it is used, solves the least squares problem that the rates' expected domain totals equal the targets,
rates being 0 or more, by projected gradient steps from rate 1. A step needs only the domains' totals under the present
rates: one aggregate over a narrow table, with one row of sums to the driver. A rate is a function of the document's
tokens and posteriors and of the steps so far, so no rate is stored or joined. Steps are scaled by the inverse of the
domains' second moments over the rows whose rate can change, so that a few suffice; the same aggregate tries it along with
plain gradient steps of several lengths, and the one that leaves the least squared gap is taken. The steps end at the
targets, or where none lessens the gap: no rates of 0 or more come nearer then, and a warning says how far off they stay.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.quality import let, words_of

BUCKETS = 1 << 15


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else clean or low by quality; rows without id or quality go."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))


@dataclass
class Mixer:
    """Domains in order, log prior and log likelihood a bucket, the scale of tokens, and the gradient steps so far."""

    domains: list[str]
    prior: list[float]
    table: list[list[float]]
    total: float = 1.0
    steps: list[list[float]] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    wanted: list[float] = field(default_factory=list)

    def posteriors(self, words: Column) -> Column:
        """Array of the domains' posteriors; the prior for a text without words."""
        place = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
        logs = []
        for p, row in zip(self.prior, self.table, strict=True):
            literal = F.split(F.lit(",".join(f"{x:.5g}" for x in row)), ",").cast("array<double>")
            logs.append(lambda g, t=literal, p=p: let(t, lambda m: F.aggregate(g, F.lit(p), lambda a, b: a + F.get(m, b))))
        scores = let(F.transform(words, place), lambda g: F.array(*(f(g) for f in logs)))
        odds = let(scores, lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        return let(odds, lambda o: F.transform(o, lambda x: x / F.aggregate(o, F.lit(0.0), lambda a, b: a + b)))

    def rate(self, tokens: Column, posteriors: Column) -> Column:
        """max(0, r - step . share) over the steps, from r = 1; share = tokens x posteriors / all tokens."""
        part = [tokens / F.lit(self.total) * F.get(posteriors, F.lit(i)) for i in range(len(self.domains))]
        rate = F.lit(1.0)
        for step in self.steps:
            rate = F.greatest(F.lit(0.0), rate - sum((F.lit(g) * x for g, x in zip(step, part, strict=True)), F.lit(0.0)))
        return rate


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivoting; the matrices here have a row a domain."""
    n, rows = len(right), [[*r, b] for r, b in zip(matrix, right, strict=True)]
    for i in range(n):
        k = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[k] = rows[k], rows[i]
        for j in range(n):
            if j != i and rows[i][i]:
                f = rows[j][i] / rows[i][i]
                rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    return [r[n] / r[i] if r[i] else 0.0 for i, r in enumerate(rows)]


def fit_classifier(docs: DataFrame, domains: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Mixer:
    """Word likelihoods of each domain (0.1 added to every count) from at most max_labelled labelled documents, first by hash."""
    sample = domains.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("id"), "domain")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    words = rows.select("domain", F.explode(words_of(F.col("text"))).alias("w"))
    counts = words.groupBy("domain", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    folded = counts.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sum("n").alias("n"))
    found = {r["domain"]: r for r in folded.collect()}  # a row a domain, BUCKETS entries at most
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # labels whose document is there
    names = sorted(found)
    all_docs = sum(sizes[d] for d in names) or 1
    table = [[math.log((found[d]["m"].get(b, 0) + 0.1) / (found[d]["n"] + 0.1 * BUCKETS)) for b in range(BUCKETS)] for d in names]
    return Mixer(names, [math.log(sizes[d] / all_docs) for d in names], table)


def fit_rates(narrow: DataFrame, mixer: Mixer, weights: dict[str, float], budget: float | None = None, max_steps: int = 40, tolerance: float = 1e-4) -> Mixer:
    """Add gradient steps to mixer until its expected totals are within tolerance (of all tokens) of the targets.

    narrow: n_tokens and p (posteriors). weights: a share a domain, absent ones 0, scaled to sum 1. budget: tokens wanted;
    by default what the domain with the largest weight offers, over its weight, so that none of it has to go.
    """
    d = len(mixer.domains)
    if not d:
        return mixer
    share = [F.col("n_tokens") * F.get("p", F.lit(i)) for i in range(d)]
    sums = narrow.agg(F.sum("n_tokens").alias("all"), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(share)), *(F.sum(share[i] * share[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d))).first()
    if not sums["all"]:
        return mixer
    mixer.total = float(sums["all"])
    scale = [max(0.0, weights.get(x, 0.0)) for x in mixer.domains]
    if not sum(scale):
        raise ValueError("no domain of the labels has a weight")
    scale = [w / sum(scale) for w in scale]
    top = max(range(d), key=lambda i: scale[i])
    wanted = budget if budget is not None else sums[f"s{top}"] / scale[top]
    mixer.wanted = [w * wanted / mixer.total for w in scale]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def moments(row) -> list[list[float]]:
        out = [[(row[f"g{min(i, j)}_{max(i, j)}"] or 0.0) / mixer.total**2 for j in range(d)] for i in range(d)]
        ridge = 1e-9 * max(out[i][i] for i in range(d)) + 1e-300
        return [[x + ridge * (i == j) for j, x in enumerate(r)] for i, r in enumerate(out)]

    def measured(steps: list[list[float]]) -> list[tuple[list[float], list[list[float]]]]:
        """Domain totals, and moments of the rows that a further gradient step can change, after each of the steps."""
        rated = narrow.select("n_tokens", "p", mixer.rate(F.col("n_tokens"), F.col("p")).alias("r"))
        sums = []
        for k, step in enumerate(steps):
            after = F.greatest(F.lit(0.0), F.col("r") - sum((F.lit(g / mixer.total) * x for g, x in zip(step, share, strict=True)), F.lit(0.0)))
            sums += [F.sum(after * s).alias(f"{k}s{i}") for i, s in enumerate(share)]
            sums += [F.sum(F.when(after > 0, share[i] * share[j])).alias(f"{k}g{i}_{j}") for i, j in pairs]
        row = rated.agg(*sums).first().asDict()
        parts = [{name.removeprefix(str(k)): x for name, x in row.items() if name.startswith((f"{k}s", f"{k}g"))} for k in range(len(steps))]
        return [([x[f"s{i}"] / mixer.total for i in range(d)], moments(x)) for x in parts]

    gap = lambda reached: [a - b for a, b in zip(reached, mixer.wanted, strict=True)]
    loss = lambda reached: sum(x * x for x in gap(reached))
    all_rows = free = moments(sums)
    mixer.steps, mixer.reached = [], [sums[f"s{i}"] / mixer.total for i in range(d)]
    for _ in range(max_steps):
        before = gap(mixer.reached)
        if max(map(abs, before)) <= tolerance:
            return mixer
        ahead = [sum(x * y for x, y in zip(row, before, strict=True)) for row in free]
        length = sum(x * y for x, y in zip(before, ahead, strict=True)) / (sum(x * x for x in ahead) or 1.0)
        lengths = [length * 4**k for k in range(-1, 4)] + [1 / (sum(all_rows[i][i] for i in range(d)) or 1.0)]
        steps = [_solve(free, before), *([x * g for g in before] for x in lengths)]
        found = measured(steps)
        best = min(range(len(steps)), key=lambda k: loss(found[k][0]))
        if loss(found[best][0]) >= loss(mixer.reached) * (1 - 1e-5):
            break
        mixer.steps.append(steps[best])
        mixer.reached, free = found[best]
    if max(map(abs, gap(mixer.reached))) > tolerance:
        off = ", ".join(f"{x}: {a:.4f} for {b:.4f}" for x, a, b in zip(mixer.domains, mixer.reached, mixer.wanted, strict=True))
        warnings.warn(f"rates don't meet the targets after {len(mixer.steps)} steps, shares of all tokens are {off}", stacklevel=2)
    return mixer


def copies(rate: Column, *key: Column) -> Column:
    """Whole uses of a document: the rate rounded down, or up where a hash of key says so; their mean is the rate."""
    draw = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("int")


def memberships(docs: DataFrame, mixer: Mixer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p): words and posteriors of every row; a null text has none and the prior."""
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), mixer.posteriors(F.col("w")).alias("p"))


def mix(docs: DataFrame, domains: DataFrame, weights: dict[str, float], budget: float | None = None, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Mixer]:
    """(doc_id, n_tokens, p_<domain>..., rate, copies) of every row, and the fitted mixer.

    Without a labelled document there are no domains and every rate is 1. Texts without words have the rate 1, as nothing
    can be gained from them; texts of any length count whole. Repeated rows have one rate; a null id is an id like any
    other; an empty table gives no rows; other columns are ignored. Warns if the rates don't
    meet the targets; the mixer has what they reach.
    """
    mixer = fit_classifier(docs, domains, max_labelled, id_col, text_col)
    if not mixer.domains:
        plain = docs.select(F.col(id_col).alias("doc_id"), F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("n_tokens"))
        return plain.select("doc_id", "n_tokens", F.lit(1.0).alias("rate"), F.lit(1).alias("copies")), mixer
    narrow = written(memberships(docs, mixer, id_col, text_col), "memberships")
    fit_rates(narrow, mixer, weights, budget)
    out = narrow.withColumn("rate", mixer.rate(F.col("n_tokens"), F.col("p")))
    return out.select("doc_id", "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(mixer.domains)), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies")), mixer


def mixed_documents(docs: DataFrame, domains: DataFrame, weights: dict[str, float], budget: float | None = None, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, each as often as its copies say (none at all where that is 0).

    Rates are computed again in the row, so texts are read twice and never shuffled. Cases as for mix().
    """
    mixer = fit_classifier(docs, domains, max_labelled, id_col, text_col)
    if not mixer.domains:
        return docs
    fit_rates(written(memberships(docs, mixer, id_col, text_col), "memberships"), mixer, weights, budget)
    words = words_of(F.col(text_col).cast("string"))
    times = let(words, lambda w: let(mixer.posteriors(w), lambda p: copies(mixer.rate(F.size(w).cast("long"), p), F.col(id_col))))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.explode(F.array_repeat(F.lit(0), times)).alias("i")).select("row.*")

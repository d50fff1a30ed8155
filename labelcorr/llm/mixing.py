"""Soft-membership mixing: rates per document that bring domains to their target weights."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import training_rows, written

log = logging.getLogger(__name__)

MAX_TRAINING_ROWS = 20_000
MOST = 4.0  # how often a document may be seen: four epochs
GRID = 1024
MAX_CELLS = 1 << 20  # the grid is coarser where there are so many domains that it had more cells
FEW_FILES = 8  # of the training rows
MAX_STEPS = 150
RECENT = 4  # a step may be worse than the last one, but not than so many
TOLERANCE = 1e-4  # of the wanted tokens
STILL = 1e-5  # the root mean square of a step that ends the fit
DOMAINS = ("clean_high", "clean_low", "toxic")
SIGNALS = ("log_words", "mean_word", "symbols", "shouted", "bangs", "pipes", "insults")
INSULTS = "idiot moron loser clown scum trash pathetic worthless disgusting stupid fool bastard asshole"


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, domain)`` as a place in ``DOMAINS``, of rows with both labels."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    whole = F.col("toxic").isin(0, 1) & F.col("quality").isin(0, 1)
    return labels.filter(whole).select(id_col, domain.alias("domain"))


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_tokens`` (words between white space) and ``SIGNALS`` of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.col("_tokens"), F.lit(1))

    counted = docs.withColumn("_tokens", F.regexp_count(text, F.lit(r"\S+")).cast("long"))
    insults = F.regexp_count(text, F.lit(f" (?:{'|'.join(INSULTS.split())})"))
    return counted.withColumns(
        {
            "log_words": F.log1p("_tokens"),
            "mean_word": F.length(text) / F.greatest(F.col("_tokens"), F.lit(1)),
            "symbols": share("[#$%&*]{2,}"),
            "shouted": share("[A-Z]{2,}"),
            "bangs": share("!!"),
            "pipes": share(r"\|"),
            "insults": F.log1p(insults),
        }
    )


@dataclass(frozen=True)
class DomainModel:
    """Multinomial logistic weights over the signals, for the domains that have examples."""

    size: int
    present: tuple[int, ...] = ()
    weights: tuple[tuple[float, ...], ...] = ()
    biases: tuple[float, ...] = ()

    def posteriors(self) -> list[Column]:
        """P(domain | text) as expressions over the signals; equal where nothing was learnt."""
        if not self.present:
            return [F.lit(1.0 / self.size)] * self.size
        raw = [
            reduce(add, [F.lit(w) * F.col(s) for w, s in zip(row, SIGNALS)], F.lit(bias))
            for row, bias in zip(self.weights, self.biases)
        ]
        top = F.greatest(*raw) if len(raw) > 1 else raw[0]
        powers = [F.exp(z - top) for z in raw]
        total = reduce(add, powers)
        of = dict(zip(self.present, powers))
        return [of[k] / total if k in of else F.lit(0.0) for k in range(self.size)]


def fit_domains(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: str = "domain",
    size: int = len(DOMAINS),
    max_rows: int = MAX_TRAINING_ROWS,
) -> DomainModel:
    """Learn the domain of a text from at most about ``max_rows`` labelled rows."""
    some = training_rows(
        docs.select(id_col, text_col), labelled, domain, max_rows, id_col, range(size)
    )
    rows = signals(some, text_col).select(F.col("_label").cast("int").alias("_label"), *SIGNALS)
    rows = written(rows.repartition(FEW_FILES), "domain-rows")
    present = sorted(r["_label"] for r in rows.select("_label").distinct().collect())
    if len(present) < 2:
        flat = tuple([0.0] * len(SIGNALS) for _ in present)
        return DomainModel(size, tuple(present), flat, tuple(0.0 for _ in present))
    place = F.array_position(F.array(*[F.lit(k) for k in present]), F.col("_label")) - 1
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", family="multinomial", regParam=0.001, maxIter=60
    ).fit(
        rows.select(
            array_to_vector(F.array(*SIGNALS)).alias("_x"), place.cast("double").alias("_y")
        )
    )
    return DomainModel(
        size,
        tuple(present),
        tuple(tuple(float(w) for w in row) for row in model.coefficientMatrix.toArray()),
        tuple(float(b) for b in model.interceptVector.toArray()),
    )


@dataclass(frozen=True)
class Mixture:
    """The steps of the fit; the rate of a document follows from its posteriors alone.

    ``missed`` is how far the expected tokens of each domain stay from the wanted
    ones, as shares of all wanted tokens: not 0 where the bounds keep the target
    out of reach.
    """

    least: float
    most: float
    steps: tuple[tuple[float, ...], ...] = field(default=())
    missed: tuple[float, ...] = field(default=())

    def rate(self, posteriors: Sequence[Column]) -> Column:
        """A step has a number per domain: go down the gradient, then back into the bounds."""
        start = F.lit(self.start)
        if not self.steps:
            return start

        def moved(rate: Column, step: Column) -> Column:
            change = reduce(add, [step[k] * p for k, p in enumerate(posteriors)])
            return F.greatest(F.lit(self.least), F.least(F.lit(self.most), rate - change))

        told = (f"array({', '.join(f'{float(x)!r}D' for x in step)})" for step in self.steps)
        return F.aggregate(F.expr(f"array({', '.join(told)})"), start, moved)

    @property
    def start(self) -> float:
        return float(min(self.most, max(1.0, self.least)))


def fit_rates(
    members: DataFrame,
    posteriors: Sequence[str],
    target: Sequence[float],
    least: float = 0.0,
    most: float = MOST,
    total: float | None = None,
) -> Mixture:
    """Least squares: rates in ``[least, most]`` whose expected tokens per domain meet the target.

    ``members`` has ``_tokens`` and a column per domain with its posterior. With
    ``s`` the expected tokens per domain and ``b`` the wanted ones, projected
    gradient steps make ``|s - b|^2`` least: down the gradient, then back into
    the bounds. The first step, and any after one that makes things worse than
    the last few were, is by the inverse of the largest eigenvalue of
    ``sum(tokens p p')``; the others are by the curvature that the last step met
    (Barzilai and Borwein). Distances are weighted by tokens, so a step changes a
    rate by its posteriors alone, and documents whose posteriors agree to
    1 / ``GRID`` are one cell of the fit, with their mean posteriors. One aggregate
    over the documents gives the cells, of which there are at most ``MAX_CELLS``
    however many documents there are; the steps are taken on them without further
    jobs. The fit ends when ``s`` is within
    ``TOLERANCE`` of ``b``, when a plain step would no longer move the rates, or
    after ``MAX_STEPS`` steps, and tells in ``missed`` how far it came; it never
    raises for a target out of reach. Domains with a target of 0 are wanted to
    have no tokens. Wanted tokens are ``target`` times ``total``: by default the
    tokens there are, or, if rates may not fall below 1, as many as the domain
    with the largest surplus asks for.
    """
    if not 0 <= least <= most or min(target) < 0 or sum(target) <= 0:
        raise ValueError("bounds and targets are not negative, one target is positive")
    size = len(posteriors)
    share = np.array(target, float) / sum(target)
    tokens = F.col("_tokens").cast("double")
    grid = grid_of(size)
    cells = members.filter("_tokens > 0").groupBy(
        *[F.round(F.col(c) * grid).alias(f"_at{k}") for k, c in enumerate(posteriors[:-1])]
    )
    weighted = [(F.sum(tokens * F.col(c)) / F.sum(tokens)).alias(f"_p{k}") for k, c in enumerate(posteriors)]
    found = cells.agg(F.sum(tokens).alias("_w"), *weighted).filter("_w > 0")
    found = found.select("_w", *[f"_p{k}" for k in range(size)]).toArrow()
    w, *p = (np.asarray(column, float) for column in found.columns)
    p = np.stack(p, axis=1)
    weight = float(w.sum())
    steepest = float(np.linalg.eigvalsh((p.T * w) @ p)[-1])

    def tokens_at(rates: np.ndarray) -> np.ndarray:
        """The expected tokens per domain."""
        return (w * rates) @ p

    rates = np.full(len(w), Mixture(least, most).start)
    now = tokens_at(rates)
    if total is None:
        wants = share > 0
        total = float((now[wants] / share[wants]).max()) if least >= 1 else float(now.sum())
    wanted = share * total
    close = TOLERANCE * max(1.0, total)
    height = lambda s: float(((s - wanted) ** 2).sum())
    steps: list[tuple[float, ...]] = []
    best, heights = (steps, now, rates), [height(now)]
    careful = True  # is the next step by the largest eigenvalue?
    width = 0.0
    while np.abs(now - wanted).max() > close and len(heights) <= MAX_STEPS and steepest > 0:
        by = 1 / steepest if careful else width
        step = by * (now - wanted)
        gone = np.clip(rates - p @ step, least, most)
        new, moved = tokens_at(gone), float((w * (gone - rates) ** 2).sum())
        still = moved <= STILL**2 * weight
        if careful and still:
            break
        heights.append(height(new))
        if heights[-1] > max(heights[-RECENT - 1 : -1]):
            (steps, now, rates), careful = best, True
            continue
        bent = float(((new - now) ** 2).sum())
        careful, width = still or bent == 0, moved / bent if bent else 0.0
        steps, now, rates = [*steps, tuple(map(float, step))], new, gone
        if heights[-1] < height(best[1]):
            best = (steps, now, rates)
    steps, now, _ = best
    missed = tuple(float(v) for v in (now - wanted) / max(1.0, total))
    if np.abs(now - wanted).max() > close:
        log.warning("the mix misses its target by %s of all tokens", missed)
    return Mixture(least, most, tuple(steps), missed)


def grid_of(size: int) -> int:
    """Cells per unit of a posterior, so that ``size`` domains have at most ``MAX_CELLS``."""
    return min(GRID, int(MAX_CELLS ** (1 / max(1, size - 1))))


def document_rates(
    docs: DataFrame,
    labelled: DataFrame,
    target: Sequence[float],
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.0,
    most: float = MOST,
) -> DataFrame:
    """``(id, tokens, p_<domain>..., rate, copies)`` of every row.

    ``rate`` is how often a document is to be seen, ``copies`` that number
    rounded up or down by a hash of the id so that the expectation holds. A null
    or empty text has no tokens and the posteriors of an empty text; repeated
    rows are each rated; without labels all domains are equally likely. Other
    columns are not looked at; an empty table gives an empty result.
    """
    _, members, mixture = _fitted(docs, labelled, target, id_col, text_col, least, most)
    names = [f"p_{d}" for d in DOMAINS]
    rated = members.withColumn("rate", mixture.rate([F.col(n) for n in names]))
    return rated.select(
        "id", F.col("_tokens").alias("tokens"), *names, "rate", copies("rate", "id").alias("copies")
    )


def mixed(
    docs: DataFrame,
    labelled: DataFrame,
    target: Sequence[float],
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 1.0,
    most: float = MOST,
) -> DataFrame:
    """All rows of ``docs`` with all their columns and ``copies``, how often each is to be seen.

    With ``least`` at 1 no document is lost; rows with 0 copies go. Texts are
    not repeated: what follows handles a document once and counts it ``copies``
    times. A column ``copies`` of ``docs`` is replaced. Nulls, empty texts,
    repeated rows and empty tables are as in ``document_rates``.
    """
    model, _, mixture = _fitted(docs, labelled, target, id_col, text_col, least, most)
    kept = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "copies"]).alias("_doc"),
    )
    rated = _with_posteriors(kept, model, "_text")
    rated = rated.withColumn("_rate", mixture.rate([F.col(f"p_{d}") for d in DOMAINS]))
    rated = rated.select("_doc", copies("_rate", "_id").alias("copies"))
    return rated.filter("copies > 0").select("_doc.*", "copies")


def copies(rate: str, id_col: str) -> Column:
    """The rate rounded up or down by a hash of the id."""
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(rate)
    return (whole + F.when(part < F.col(rate) - whole, 1).otherwise(0)).cast("int")


def _with_posteriors(rows: DataFrame, model: DomainModel, text_col: str) -> DataFrame:
    """Add ``_tokens``, the signals and the posteriors, each computed once per row."""
    told = signals(rows, text_col)
    posteriors = [p.alias(f"p_{d}") for d, p in zip(DOMAINS, model.posteriors())]
    told = _once(told, rows.columns, [F.col(c) for c in ("_tokens", *SIGNALS)])
    return _once(told, told.columns, posteriors)


def _once(rows: DataFrame, keep: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """``keep`` and ``values``, which come out of a generator: the optimizer would else put
    their expressions wherever they are used, also into the steps of the fit."""
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*values))))


def _fitted(docs, labelled, target, id_col, text_col, least, most):
    """The model of domains, ``(id, _tokens, p_<domain>...)`` of all rows, and the mixture."""
    model = fit_domains(docs, labelled, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    names = [f"p_{d}" for d in DOMAINS]
    members = written(
        _with_posteriors(rows, model, "_text").select("id", "_tokens", *names), "members"
    )
    return model, members, fit_rates(members, names, target, least, most)

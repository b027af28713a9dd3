"""Quality classifier: naive Bayes evidence a document, empirical Bayes a site.

Evidence is the sum of log-odds of binned text features, learnt by grouped counts
of labelled documents.  It gives each document a probability; sites are judged by
grouped sums of those: a host's rate is drawn towards the global rate, a section's
towards its host's, each by a prior worth as many documents as the spread between
sites supports (method of moments).  A document's final log-odds are its evidence
with, for the prior, the rate that the other documents of its section and host give:
its own probability is taken out of both sums, so that its evidence counts once.
All sums are of whole millionths, so they don't depend on the order of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, fresh, written

#: Bins a feature, and a fixed width of a bin for each.
BINS = 20
UNIT = 1_000_000
#: Evidence goes no further than that, so that sites can matter.
EVIDENCE_LIMIT = 12.0
#: Bounds of a prior's weight, in documents.
WEIGHTS = (1.0, 1e6)
#: Probability of good quality below which a document is rejected: good documents are to stay.
THRESHOLD = 0.3
SYMBOLS = "#$%&*!|<>{}[]=_~^\\@+"


def features(text: Column) -> dict[str, Column]:
    """Bins 0 to BINS - 1 of each feature of a text, null counting as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    # a pattern over what else there is, as one match takes a whole run of it
    count = lambda chars: F.length(F.regexp_replace(t, "[^" + "".join(rf"\{c}" if c in SYMBOLS else c for c in chars) + "]+", ""))
    spaces, symbols, capitals, stops = count(" \n"), count(SYMBOLS), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(".,")
    words = F.split(t, " ")
    bin_ = lambda x: F.least(F.floor(x), F.lit(BINS - 1)).cast("int")
    return {
        "symbols": bin_(symbols * 100 / n),
        "capitals": bin_(capitals * 100 / n / 2),
        "word_length": bin_(F.length(t) / (spaces + 1)),
        "stops": bin_(stops * 100 / n),
        "length": bin_(F.log2(n)),
        "distinct": bin_(F.size(F.array_distinct(words)) * BINS / F.size(words)),
    }


NAMES = ("symbols", "capitals", "word_length", "stops", "length", "distinct")


def _site(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and section: a source's part before the first ``/``, and the next part, or the language where there is none."""
    s = F.coalesce(source, F.lit(""))
    parts = F.split(s, "/")
    return F.element_at(parts, 1), F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.coalesce(lang, F.lit("")))


def _prepared(docs: DataFrame, text_col: str, source_col: str, lang_col: str, *keep: Column) -> DataFrame:
    host, section = _site(F.col(source_col), F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string"))
    f = features(F.col(text_col))
    return docs.select(*keep, host.alias("host"), section.alias("section"), F.array(*[f[k] for k in NAMES]).alias("f"))


def train(rows: DataFrame, labels: DataFrame) -> list[list[float]]:
    """Log-odds ``[feature][bin]`` with add-one counts; ``rows(doc_id, f)``, ``labels(doc_id, label)``.

    The driver gets the counts of features times bins times two labels.
    """
    known = rows.join(labels, "doc_id").select("f", "label")
    counts = known.select("label", F.posexplode("f").alias("k", "bin")).groupBy("k", "bin", "label").agg(F.count("*").alias("n")).collect()
    n = {(r["k"], r["bin"], r["label"]): r["n"] for r in counts}
    total = [sum(n.get((0, b, y), 0) for b in range(BINS)) for y in (0, 1)]

    def share(k: int, b: int, label: int) -> float:
        return math.log((n.get((k, b, label), 0) + 1) / (total[label] + BINS))

    odds = [[round(share(k, b, 1) - share(k, b, 0), 6) for b in range(BINS)] for k in range(len(NAMES))]
    return odds + [[round(math.log((total[1] + 1) / (total[0] + 1)), 6)]]


def _stored() -> list[Column]:
    return [F.element_at("f", k + 1) for k in range(len(NAMES))]


def evidence(bins: list[Column], model: list[list[float]]) -> Column:
    """The log-odds that the features speak for, without any prior.

    Each feature's column stands in the expression once, so that no text is
    measured twice.
    """
    total = F.lit(0.0)
    for bin_, odds in zip(bins, model):
        total = total + F.element_at(F.lit(odds).cast("array<double>"), bin_ + 1)
    return F.greatest(F.least(total, F.lit(EVIDENCE_LIMIT)), F.lit(-EVIDENCE_LIMIT))


def _one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """A label a document; of several, the lower."""
    sound = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    return sound.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"))


def _weight(groups: DataFrame, parent: str) -> float:
    """Documents that a prior for ``groups(s, n, <parent>)`` is worth, from the spread of their rates about their parents'."""
    rate, mu = F.col("s") / UNIT / F.col("n"), F.col(parent)
    sums = groups.agg(
        F.sum(F.round(F.col("n") * (rate - mu) * (rate - mu) * UNIT).cast("long")).alias("q"),
        F.sum(F.round(mu * (1 - mu) * UNIT).cast("long")).alias("v"),
        F.sum(F.round(mu * (1 - mu) * F.col("n") * UNIT).cast("long")).alias("nv"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.count("*").alias("groups"),
    ).first()
    if not sums["groups"] or sums["groups"] < 2 or not sums["n"]:
        return WEIGHTS[1]
    free = sums["n"] - sums["nn"] / sums["n"]
    spread = (sums["q"] - sums["v"]) / UNIT / free if free > 0 else 0.0
    if spread <= 0:
        return WEIGHTS[1]
    mean_variance = sums["nv"] / UNIT / sums["n"]
    return min(max(round(mean_variance / spread - 1, 6), WEIGHTS[0]), WEIGHTS[1])


@dataclass(frozen=True)
class Sites:
    """Sums of probabilities in millionths ``s`` and numbers ``n`` of sections and hosts, and how they are shrunk."""

    table: DataFrame  # (of, part, s, n, host_s, host_n)
    mean: float
    host_weight: float
    section_weight: float

    def rate(self, own: Column | int, one: int, name=lambda c: F.col(c)) -> Column:
        """A section's rate without ``one`` document of probability ``own``, drawn towards its host's without it, and that towards the mean."""
        m, w = F.lit(self.host_weight), F.lit(self.section_weight)
        host = ((name("host_s") - own) / UNIT + m * F.lit(self.mean)) / (name("host_n") - one + m)
        rate = ((name("s") - own) / UNIT + w * host) / (name("n") - one + w)
        return F.greatest(F.least(rate, F.lit(1 - 1e-6)), F.lit(1e-6))


def _sites(scored: DataFrame, prior: float) -> Sites:
    """Grouped sums of ``scored(host, section, y)``, y in millionths; ``prior``: the mean where there is no row."""
    cells = written(scored.groupBy("host", "section").agg(F.sum("y").alias("s"), F.count("*").alias("n")), "sections")
    total = cells.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(max(total["s"] / UNIT / total["n"], 1e-6), 1 - 1e-6) if total["n"] else prior
    hosts = cells.groupBy(F.col("host").alias("own")).agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n"))
    hosts = written(hosts, "hosts")
    m = _weight(hosts.select(F.col("host_s").alias("s"), F.col("host_n").alias("n"), F.lit(mean).alias("mean")), "mean")
    both = cells.join(hosts, F.col("host") == F.col("own")).drop("own")
    table = written(both.withColumnsRenamed({"host": "of", "section": "part"}), "sites")
    host_rate = (F.col("host_s") / UNIT + F.lit(m) * F.lit(mean)) / (F.col("host_n") + F.lit(m))
    w = _weight(table.select("s", "n", host_rate.alias("host_rate")), "host_rate")
    discard(cells, hosts)
    return Sites(table, mean, m, w)


def _probability(odds: Column, rate: Column) -> Column:
    return F.round(1 / (1 + F.exp(-(odds + F.log(rate / (1 - rate))))), 6)


def _guess(odds: Column, model) -> Column:
    """A document's probability in millionths, by its evidence and the labels' own odds."""
    return F.round(1 / (1 + F.exp(-(odds + F.lit(model[-1][0])))) * UNIT).cast("long")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality"):
    """The evidence model, the sites, and the features of each document."""
    rows = written(_prepared(docs, text_col, source_col, lang_col, F.col(id_col).alias("doc_id")), "features")
    model = train(rows, _one_label(labels, id_col, label_col))
    scored = rows.select("host", "section", _guess(evidence(_stored(), model), model).alias("y"))
    return model, _sites(scored, 1 / (1 + math.exp(-model[-1][0]))), rows


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, host, section, p_doc, site_rate, p_good, keep)`` for each row of ``docs``.

    ``p_doc`` is the probability by evidence with the global rate for the prior,
    ``site_rate`` the section's posterior, ``p_good`` the probability by evidence with
    the posterior of the section's other documents; a document is kept at ``threshold``
    or more.  Null and empty texts are judged as texts of no characters, a null source
    is a host of its own.  Labels other than 0 and 1 are ignored, the lower of several
    counts, and without any the evidence is nil and the prior even, so that everything is
    kept.  Repeated rows get a row each; an empty table gives an empty result.
    """
    model, sites, rows = fit(docs, labels, id_col, text_col, source_col, lang_col, label_col)
    known = rows.select("doc_id", "host", "section", evidence(_stored(), model).alias("odds"))
    judged = known.join(sites.table, (F.col("host") == F.col("of")) & (F.col("section") == F.col("part")))
    p = _probability(F.col("odds"), sites.rate(_guess(F.col("odds"), model), 1))
    p_doc = _probability(F.col("odds"), F.lit(sites.mean)).alias("p_doc")
    out = judged.select("doc_id", "host", "section", p_doc, F.round(sites.rate(0, 0), 6).alias("site_rate"), p.alias("p_good"))
    return out.withColumn("keep", F.col("p_good") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, with all their columns.

    Texts are not shuffled where Spark broadcasts the sites' sums, a row a section.
    """
    model, sites, rows = fit(docs, labels, id_col, text_col, source_col, lang_col, label_col)
    discard(rows)
    *own, odds = fresh(docs, "of", "part", "s", "n", "host_s", "host_n", "odds")
    names = dict(zip(("of", "part", "s", "n", "host_s", "host_n"), own))
    named = sites.table.select(*[F.col(c).alias(names[c]) for c in names])
    host, section = _site(F.col(source_col), F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string"))
    f = features(F.col(text_col))
    measured = docs.withColumn(odds, evidence([f[k] for k in NAMES], model))
    both = measured.join(named, (host == F.col(names["of"])) & (section == F.col(names["part"])))
    rate = sites.rate(_guess(F.col(odds), model), 1, lambda c: F.col(names[c]))
    return both.filter(_probability(F.col(odds), rate) >= threshold).select(*[F.col(c) for c in docs.columns])

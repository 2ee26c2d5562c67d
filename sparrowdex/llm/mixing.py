"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The cells' token weights
are raked until their source, language and topic marginals are the targets; a cell's
weight over its tokens, scaled to the token budget and cut at 1, is the probability
with which each of its documents is sampled, by a hash of the document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

AXES = ("source", "language", "topic")
TOPICS = ("code", "license", "link", "contact", "prose")
STRATA = 256
KEYS = ["mix_source", "mix_language", "mix_topic"]
#: Cells that are raked on the driver at most; more are raked in Spark, to the same weights.
DRIVER_CELLS = 200_000


def topic_of(text: Column) -> Column:
    """A coarse topic by the first rule that holds."""
    has = lambda *marks: F.greatest(*(F.contains(text, F.lit(m)) for m in marks), F.lit(False))
    return (
        F.when(has("def ", "return ", "#include", "public class", "function(") & has("{", "():", ";\n"), "code")
        .when(has("License", "license", "Copyright", "copyright"), "license")
        .when(has("http://", "https://"), "link")
        .when(has("@"), "contact")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def stratum(value: Column, named: list[str], hashed: bool = True) -> Column:
    """The value if a target names it; other values share ``STRATA`` strata by their hash, and null has one.

    Not ``hashed``: each value is a stratum of its own, with another # before one that begins with #.
    """
    if not hashed:
        return F.when(value.isNull(), F.lit("#null")).when(F.startswith(value, F.lit("#")), F.concat(F.lit("#"), value)).otherwise(value)
    other = F.concat(F.lit("#"), F.pmod(F.crc32(value.cast("binary")), F.lit(STRATA)).cast("string"))
    return F.when(value.isNull(), F.lit("#null")).when(value.isin(named), value).otherwise(other) if named else F.when(value.isNull(), F.lit("#null")).otherwise(other)


@dataclass(frozen=True)
class Targets:
    """Weights by axis and stratum (they need not add up to 1).

    A stratum without a weight gets its share of tokens to the power ``flat`` of its
    axis, so that 1 keeps the shares and less lifts the small ones.  ``budget`` is the
    share of all tokens to sample.  With ``hashed``, values without a weight share
    strata by hash; without it each value is its own stratum.
    """

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    flat: tuple[float, float, float] = (0.8, 0.9, 0.95)
    budget: float = 0.7
    rounds: int = 100
    tolerance: float = 1e-9
    hashed: bool = True


#: The weights of op9 and of the pipeline's stage.  Languages and topics have stated ones; sources are tempered, as any number of them may come.
PRODUCTION = Targets(
    weights={"language": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}, "topic": {"prose": 0.7, "code": 0.1, "link": 0.1, "license": 0.05, "contact": 0.05}},
    hashed=False,
)


def rake(index: np.ndarray, tokens: np.ndarray, marginals: list[np.ndarray], rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of cells (``index``: rows of a stratum number for each axis), from ``tokens``, with the given marginals as far as the cells allow."""
    w = tokens.astype(float)
    for _ in range(rounds):
        off = 0.0
        for axis, want in enumerate(marginals):
            have = np.bincount(index[:, axis], weights=w, minlength=len(want))
            scale = np.divide(want, have, out=np.zeros(len(want)), where=have > 0)
            off = max(off, float(np.abs(have - want).max() / max(want.sum(), 1e-300)))
            w = w * scale[index[:, axis]]
        if off < tolerance:
            break
    return w


def calibrate(weight: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight / tokens) that sample ``budget`` tokens in expectation, or all that can be."""
    rate = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    low, high = 0.0, 1.0
    for _ in range(200):
        if (np.minimum(1, high * rate) * tokens).sum() >= budget or high > 1e18:
            break
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * rate) * tokens).sum() < budget else (low, mid)
    return np.minimum(1, high * rate)


def cell_probabilities(cells: list[tuple[str, str, str, int, int]], targets: Targets) -> list[tuple[str, str, str, float, float]]:
    """(source, language, topic, weight, probability) of cells given as (source, language, topic, tokens, documents)."""
    if not cells:
        return []
    cells = sorted(cells)
    tokens = np.array([c[3] for c in cells], float)
    total = tokens.sum()
    names = [sorted({c[a] for c in cells}) for a in range(3)]
    at = [{n: i for i, n in enumerate(x)} for x in names]
    index = np.array([[at[a][c[a]] for a in range(3)] for c in cells], np.int64).reshape(-1, 3)
    marginals = []
    for a, axis in enumerate(AXES):
        have = np.bincount(index[:, a], weights=tokens, minlength=len(names[a])) / max(total, 1)
        given = targets.weights.get(axis, {})
        want = np.array([given.get(n, h ** targets.flat[a] if h > 0 else 0.0) for n, h in zip(names[a], have, strict=True)])
        want = np.where(have > 0, want, 0)
        marginals.append(total * want / max(want.sum(), 1e-300))
    weight = rake(index, tokens, marginals, targets.rounds, targets.tolerance)
    p = np.where(tokens > 0, calibrate(weight, tokens, targets.budget * total), targets.budget)
    share = weight / max(weight.sum(), 1e-300)
    return [(*c[:3], float(s), float(q)) for c, s, q in zip(cells, share, p, strict=True)]


def _scale_for(rows: DataFrame, budget: float) -> float:
    """``calibrate``'s factor for a table of tokens t and weights w, many factors tried in each pass."""

    def sampled(factors: list[float]) -> list[float]:
        rate = F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0)
        return list(rows.agg(*(F.sum(F.least(F.lit(1.0), F.lit(c) * rate) * F.col("t")).alias(f"c{i}") for i, c in enumerate(factors))).head())

    powers = [2.0**k for k in range(61)]
    high = next((c for c, t in zip(powers, sampled(powers), strict=True) if t >= budget), powers[-1])
    low = 0.0
    for _ in range(10):
        factors = np.linspace(low, high, 65).tolist()
        over = next((i for i, t in enumerate(sampled(factors[:-1])) if t >= budget), 64)
        low, high = factors[max(over - 1, 0)], factors[over]
    return high


def raked_table(cells: DataFrame, targets: Targets) -> DataFrame:
    """``cell_probabilities`` of a table of cells (KEYS, t tokens), in Spark for any number of them."""
    total = cells.agg(F.sum("t")).head()[0]
    wants = []
    for axis, key, flat in zip(AXES, KEYS, targets.flat, strict=True):
        have = F.col("t") / float(max(total, 1))
        given = targets.weights.get(axis, {})
        want = F.pow(have, F.lit(flat))
        if given:
            want = F.coalesce(F.create_map(*(F.lit(x) for pair in given.items() for x in (pair[0], float(pair[1]))))[F.col(key)], want)
        rows = cells.groupBy(key).agg(F.sum("t").alias("t")).select(key, F.when(F.col("t") > 0, want).otherwise(0.0).alias("want"))
        sum_ = rows.agg(F.sum("want")).head()[0]
        wants.append(C.cut(rows.withColumn("want", float(total) * F.col("want") / max(sum_, 1e-300)), "mix-want"))
    few = [w.count() <= 100_000 for w in wants]
    w = cells.select(*KEYS, "t", F.col("t").cast("double").alias("w"))
    held: list[DataFrame] = []
    for _ in range(targets.rounds):
        off, done = 0.0, []
        for key, want, small in zip(KEYS, wants, few, strict=True):
            scale = C.cut(w.groupBy(key).agg(F.sum("w").alias("have")).join(want, key), "mix-scale")
            done.append(scale)
            r = scale.agg(F.max(F.abs(F.col("have") - F.col("want"))), F.sum("want")).head()
            off = max(off, r[0] / max(r[1], 1e-300))
            by = scale.select(key, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("by"))
            w = w.join(F.broadcast(by) if small else by, key).select(*KEYS, "t", (F.col("w") * F.col("by")).alias("w"))
        w = C.cut(w, "mix-weights")
        C.drop(*held, *done)
        held = [w]
        if off < targets.tolerance:
            break
    C.drop(*wants)
    sum_ = w.agg(F.sum("w")).head()[0]
    c = _scale_for(w, targets.budget * total)
    p = F.when(F.col("t") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("w") / F.col("t"))).otherwise(F.lit(targets.budget))
    return w.select(*KEYS, (F.col("w") / max(sum_, 1e-300)).alias("mix_weight"), p.alias("mix_probability"))


def with_strata(docs: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    have = set(docs.columns)
    value = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda axis: sorted(targets.weights.get(axis, {}))
    key = F.concat_ws(":", F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    return docs.withColumns({
        "mix_source": stratum(value("source"), named("source"), targets.hashed),
        "mix_language": stratum(value("lang"), named("language"), targets.hashed),
        "mix_topic": topic_of(text),
        "mix_tokens": token_count(text),
        "mix_u": F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52),
    })


def probabilities(rows: DataFrame, targets: Targets, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(KEYS, mix_weight, mix_probability) of the cells of ``rows`` (KEYS, mix_tokens), to be broadcast if they are few."""
    spark = rows.sparkSession
    cells = rows.groupBy(*KEYS).agg(F.sum("mix_tokens").alias("t"), F.count("*").alias("n"))
    if not targets.hashed:
        cells = C.cut(cells, "mix-cells", 6_400_000)
        if cells.count() > driver_cells:
            return raked_table(cells, targets)
    got = [(c[0], c[1], c[2], c[3], c[4]) for c in cells.collect()]
    C.drop(cells)
    return F.broadcast(spark.createDataFrame(cell_probabilities(got, targets), "mix_source string, mix_language string, mix_topic string, mix_weight double, mix_probability double"))


def mixing_report(docs: DataFrame, targets: Targets = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``mix`` without the texts: doc_id, source, lang and the mix_ columns but mix_u; the texts are read once, into a narrow table."""
    have = set(docs.columns)
    value = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
    aside = {c: f"own_{c}" for c in docs.columns if c.startswith("mix_")}
    rows = with_strata(docs.withColumnsRenamed(aside), targets, id_col, text_col)
    rows = C.cut(rows.select(F.col(id_col).cast("long").alias("doc_id"), value("source"), value("lang"), *KEYS, "mix_tokens", "mix_u"), "mix-strata")
    out = rows.join(probabilities(rows, targets, driver_cells), KEYS)
    return out.select("doc_id", "source", "lang", *KEYS, "mix_tokens", "mix_weight", "mix_probability", (F.col("mix_u") < F.col("mix_probability")).alias("mix_sampled"))


def mix(docs: DataFrame, targets: Targets = Targets(), id_col: str = "doc_id", text_col: str = "text", driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The rows with mix_source, mix_language, mix_topic, mix_tokens, mix_u, mix_weight, mix_probability and mix_sampled (mix_u < mix_probability).

    Tokens are words between ASCII white space.  A null source or language is a stratum of its own, as a missing
    column is; a null or empty text has no tokens and, in a cell without any, the
    budget as its probability.  Rows with one id and one text are sampled together;
    null ids count as one id.  Columns of the mix_ names are replaced, others kept.  An empty
    table gives an empty result.

    Hashed cells are at most (named + 257) sources x languages of the same kind x 5
    topics.  Up to ``driver_cells`` cells, their sums are raked on the driver and the table of
    probabilities is broadcast; more are raked in Spark and joined.
    """
    rows = with_strata(docs, targets, id_col, text_col)
    table = probabilities(rows, targets, driver_cells)
    rows = rows.drop("mix_weight", "mix_probability", "mix_sampled")
    out = rows.join(table, KEYS)
    return out.withColumn("mix_sampled", F.col("mix_u") < F.col("mix_probability"))


def sampled(docs: DataFrame, targets: Targets = Targets(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, with all their columns, those of mix_ names too."""
    aside = {c: f"own_{c}" for c in docs.columns if c.startswith("mix_")}
    rows = mix(docs.withColumnsRenamed(aside), targets, id_col, text_col).where("mix_sampled")
    return rows.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))

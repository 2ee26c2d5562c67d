"""Quality by co-training of two views: the text's content and the row's metadata.

Each view has a classifier of its own.  Both start from labelled rows; in every
round each labels the unlabelled rows of a pool that it is surest of, and these go
to the *other* view's training set.  At last each view is calibrated on labelled
rows that it was not trained on, and the calibrated log odds are added, the
common prior counted once.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .fitting import Logistic, sigmoid

TEXT_NAMES = (
    "log words", "letters a word", "its spread", "capitals", "digits", "punctuation", "beyond ASCII", "line ends", "exclamation and question marks",
    "other signs", "distinct words", "commonest word", "distinct 3-word shingles", "distinct bytes", "entropy of bytes", "longest word", "empty",
)
_OTHERS, _SIZES = 64, 12
#: Sampled rows from which on a language or source has a column of its own.
NAMED = 20

_KIND = np.zeros(256, np.int64)  # letters, capitals, digits, punctuation, beyond ASCII, line ends, white space, ! and ?, other signs
_KIND[:] = 8
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[33, 63]] = 7
_KIND[[34, 39, 40, 41, 44, 45, 46, 58, 59]] = 3
_KIND[128:] = 4
_KIND[[10, 13]] = 5
_KIND[[9, 11, 12, 32]] = 6


def text_features(texts: list[bytes]) -> np.ndarray:
    """A row of ``TEXT_NAMES`` for each whole text."""
    out = np.zeros((len(texts), len(TEXT_NAMES)))
    for i, (data, (words, starts)) in enumerate(zip(texts, C.batch_words(texts), strict=True)):
        n = len(words)
        if not n:
            out[i, -1] = 1
            continue
        byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        kind = np.bincount(_KIND, weights=byte, minlength=9)
        solid = max(1.0, len(data) - kind[6] - kind[5])
        size = np.diff(np.append(starts, len(data) + 1)) - 1
        ranked = np.sort(words)
        runs = np.diff(np.append(np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])), n))
        three = np.sort(C.shingles(words, 3))
        p = byte[byte > 0] / len(data)
        out[i] = [
            np.log1p(n), min(solid / n, 30.0), min(float(size.std()), 30.0), kind[1] / solid, kind[2] / solid, kind[3] / n, kind[4] / solid, kind[5] / n, kind[7] / n,
            kind[8] / solid, len(runs) / n**0.85, runs.max() / n, (1 + np.count_nonzero(three[1:] != three[:-1])) / len(three), np.log1p((byte > 0).sum()), float(-(p * np.log(p)).sum()), np.log1p(int(size.max())), 0.0,
        ]
    return out


def metadata_features(langs: list, sources: list, sizes: list, named: dict[str, list[str]] | None = None) -> np.ndarray:
    """Language and source, and the stated length by its magnitude, as indicators.

    ``named`` languages and sources have a column each; others share ``_OTHERS`` columns by hash, and null has one.
    """
    import zlib

    blocks = []
    for name, values in (("lang", langs), ("source", sources)):
        at = {v: i for i, v in enumerate((named or {}).get(name, []))}
        out = np.zeros((len(values), len(at) + _OTHERS + 1))
        for i, v in enumerate(values):
            out[i, -1 if v is None else at[v] if v in at else len(at) + zlib.crc32(v.encode()) % _OTHERS] = 1
        blocks.append(out)
    out = np.zeros((len(sizes), _SIZES))
    for i, n in enumerate(sizes):
        out[i, 0 if n is None else 1 + min(_SIZES - 2, max(0, int(n)).bit_length() // 2)] = 1
    return np.hstack([*blocks, out])


@dataclass(frozen=True)
class Views:
    """The fitted views and their calibrations, small arrays as JSON."""

    spec: str

    @property
    def named(self) -> dict[str, list[str]]:
        return json.loads(self.spec)["named"]

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        s = json.loads(self.spec)
        z = [np.clip(((x - np.array(m["mean"])) / np.array(m["scale"])) @ np.array(m["beta"][:-1]) + m["beta"][-1], -30, 30) for x, m in ((text, s["text"]), (meta, s["meta"]))]
        odds = [a + b * v for v, (a, b) in zip(z, s["platt"], strict=True)]
        return sigmoid(odds[0] + odds[1] - s["prior"])


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = 5, share: float = 0.05, sure: float = 0.95, counts: dict[int, int] | None = None, named: dict[str, list[str]] | None = None) -> Views:
    """``y``: 1, 0, or -1 for unlabelled rows.  Every third labelled row is left to the calibration.

    A round exchanges at most ``share`` of the pool for each view, half of it from each
    end, and only rows whose probability is ``sure`` or more.  ``counts``: the labelled rows of
    each kind that ``y`` is a sample of; calibration and prior are weighted back to them.
    ``named``: the values with metadata columns of their own.
    """
    known = np.flatnonzero(y >= 0)
    check = known[2::3]
    base = np.setdiff1d(known, check)
    pool = np.flatnonzero(y < 0)
    views = [text, meta]
    given: list[dict[int, float]] = [{}, {}]
    stands = np.array([(counts or {}).get(k, (y == k).sum()) / max((y == k).sum(), 1) for k in (0, 1)])
    weight = stands[y[known]] / stands[y[known]].mean()
    rate = float(np.clip(np.average(y[known], weights=weight), 1e-3, 1 - 1e-3))

    def fit(v: int) -> Logistic:
        extra = np.array(sorted(given[v]), np.int64)
        rows = np.concatenate([base, extra]).astype(np.int64)
        target = np.concatenate([y[base], [given[v][i] for i in extra.tolist()]]).astype(float)
        return Logistic(views[v][rows], target, penalty=2.0, weight=np.concatenate([np.ones(len(base)), np.full(len(extra), 0.3)]))

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        most = int(len(pool) * share / 2)
        for v in (0, 1):
            open_ = np.array([i for i in pool.tolist() if i not in given[1 - v]], np.int64)
            if not len(open_) or not most:
                continue
            z = models[v].logit(views[v][open_])
            order = np.argsort(z, kind="stable")
            edge = np.log(sure / (1 - sure))
            for i in order[:most][z[order[:most]] <= -edge].tolist():
                given[1 - v][int(open_[i])] = 0.0
            for i in order[-most:][z[order[-most:]] >= edge].tolist():
                given[1 - v][int(open_[i])] = 1.0
        models = [fit(0), fit(1)]
    platt = []
    for v in (0, 1):
        z = models[v].logit(views[v][check])
        m = Logistic(z[:, None], y[check].astype(float), penalty=1.0, weight=weight[2::3])
        slope = float(m.beta[0] / m.scale[0])
        platt.append((float(m.beta[1] - slope * m.mean[0]), slope) if slope > 0 else (float(np.log(rate / (1 - rate))), 0.0))
    spec = {k: {"mean": m.mean.tolist(), "scale": m.scale.tolist(), "beta": m.beta.tolist()} for k, m in zip(("text", "meta"), models, strict=True)}
    return Views(json.dumps(spec | {"named": named or {}, "platt": platt, "prior": float(np.log(rate / (1 - rate)))}))


def _features(b: pa.RecordBatch, named: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    return text_features(C.text_bytes(b.column("text"))), metadata_features(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), named)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = text_features(C.text_bytes(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row", "y", "lang", "source", "n_chars")] + [pa.array(list(x), pa.list_(pa.float64()))], ["row", "y", "lang", "source", "n_chars", "x"])


def _view(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    have = set(docs.columns)
    col = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), col("lang", "string"), col("source", "string"), col("n_chars", "long"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Views | None:
    """The two views from at most ``sample`` labelled rows (``labels``: doc_id, quality) and as many unlabelled ones, those with the least hashes.

    Rows that are equal in id, text and metadata count once; a document with labels of both kinds is good.  The sample is
    weighted back to all labelled rows of ``docs``.  The unlabelled rows are the pool from which the rounds of co-training
    draw.  A language or source with ``NAMED`` rows in the sample has a column of its own.  None without labelled rows of both kinds.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("y"))
    rows = _view(docs, id_col, text_col).where("doc_id is not null")
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text", "lang", "source", "n_chars"))
    # one narrow row each; a document whose labels are all null is neither labelled nor in the pool
    keys = C.cut(rows.select("row", "doc_id").join(known.withColumn("labelled", F.lit(True)), "doc_id", "left").where("labelled is null or y is not null").select("row", "doc_id", F.coalesce("y", F.lit(-1)).alias("y")).distinct(), "quality-rows")
    n = {r.y: r.n for r in keys.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        C.drop(keys)
        return None
    least = lambda y, most: keys.where(F.col("y") == y).orderBy("row", "doc_id").limit(most)
    chosen = least(0, sample // 2).union(least(1, sample // 2)).union(least(-1, sample))
    rows = rows.join(F.broadcast(chosen), ["row", "doc_id"]).dropDuplicates(["row", "doc_id"])
    got = rows.mapInArrow(_sampled, "row long, y int, lang string, source string, n_chars long, x array<double>").toArrow()
    C.drop(keys)
    order = np.lexsort([got["y"].to_numpy(), got["row"].to_numpy()])
    got = got.take(pa.array(order))
    y = got["y"].to_numpy()
    meta = {c: got[c].to_pylist() for c in ("lang", "source", "n_chars")}
    named = {c: sorted(v for v, k in Counter(meta[c]).items() if v is not None and k >= NAMED) for c in ("lang", "source")}
    return cotrain(np.array(got["x"].to_pylist()), metadata_features(meta["lang"], meta["source"], meta["n_chars"], named), y, counts=n, named=named)


def _scored(batches: Iterator[pa.RecordBatch], views: Views | None) -> Iterator[pa.RecordBatch]:
    named = {} if views is None else views.named
    for b in batches:
        score = np.ones(b.num_rows) if views is None else views.score(*_features(b, named))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])


def without_poor(docs: DataFrame, views: Views | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns; all of them without a model.

    A null or empty text is scored as an empty one, null metadata as values of their own; repeated rows fare alike.  A score
    equal to ``threshold`` is kept.
    """
    if views is None:
        return docs
    named = views.named

    def keep(b: pa.RecordBatch) -> list[bool]:
        x = text_features(C.text_bytes(b.column(text_col)))
        return (views.score(x, metadata_features(*(C.column(b, c) for c in ("lang", "source", "n_chars")), named)) >= threshold).tolist()

    return C.filter_rows(docs, keep)


def quality(docs: DataFrame, views: Views | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (probability of good quality), kept (score >= threshold).

    A null or empty text has the features of an empty text; null or missing lang,
    source and n_chars are values of their own.  Without a model (no labels) every row
    scores 1.  Ids may be null or repeated; each row is scored by itself.  Other
    columns are not looked at; an empty table gives an empty result.
    """
    out = _view(docs, id_col, text_col).mapInArrow(lambda it: _scored(it, views), "doc_id long, score double")
    return out.withColumn("kept", F.col("score") >= threshold)

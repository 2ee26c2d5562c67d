"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: case, accents, full-width forms, look-alike letters of
other scripts, digits and signs that stand for letters, and invisible characters.
The letters that ``1`` may stand for fall together (``l`` and ``i``), in the
lexicon too.  An entry is a whole word or a word beginning; hits within an
exception phrase do not count.  The summed weights are normalised by the text's
length and calibrated to a probability.

The lexicon begins with a short fixed list and is completed from labelled rows:
the whole words, of any length, and the word beginnings that set toxic rows apart.  A weight is
a logarithm of odds that is drawn to 0 by a few rows of the common kind, so that what
a handful of rows hold by chance weighs little.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .fitting import Logistic, sigmoid

# Look-alike letters of other scripts, and what stands for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "l": "i"}
# Words that insult, with weights, and harmless phrases that hold them.
WORDS = {"idiot": 3.0, "moron": 3.0, "stupid": 2.5, "loser": 2.5, "scum": 3.0, "trash": 1.5, "clown": 1.5, "pathetic": 2.0, "worthless": 2.5, "disgusting": 2.0, "imbecile": 3.0, "dumbass": 3.5, "asshole": 3.5, "bastard": 3.0, "bitch": 3.5, "retard": 3.5}
EXCEPTIONS = ("idiot proof", "trash can", "trash bin", "trash collection", "clown fish", "clown nose", "circus clown", "sore loser", "loser bracket")
#: Letters of a learned beginning; whole words of any length are learned beside them.
LENGTHS = range(4, 13)
#: Rows of the common kind by which a weight is drawn to 0, the least weight, and the least toxic rows of an entry.
DRAWN, FLOOR, LEAST = 4.0, 2.0, 4


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            c = LOOKALIKES.get(c, c)
            c = DISGUISES.get(c, c)
            kind = unicodedata.category(c)
            out += c if kind[0] in "LN" else "" if kind[0] == "M" or kind == "Cf" else " "
        self[code] = out
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """The text's folded words, each between spaces."""
    return f" {text.translate(_FOLDS)} "


@dataclass(frozen=True)
class Lexicon:
    """``entries``: (folded beginning after a space, weight); a whole word ends with a space.  ``beta``: the calibration."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    beta: tuple[float, float]

    @classmethod
    def fixed(cls) -> Lexicon:
        return cls(tuple((fold(w).rstrip(), x) for w, x in WORDS.items()), tuple(" ".join(fold(x).split()) for x in EXCEPTIONS), (-4.0, 3.0))


@lru_cache(8)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    out = ahocorasick.Automaton()
    for key, weight in lexicon.entries:
        out.add_word(key, (len(key), weight))
    for x in lexicon.exceptions:
        out.add_word(f" {x} ", (len(x) + 2, None))
    if not len(out):
        out.add_word("\0", (1, 0.0))
    out.make_automaton()
    return out


def hits(lexicon: Lexicon, folded: str) -> tuple[float, int]:
    """Summed weights of the hits outside exception phrases, and their number; of entries that begin together the heaviest counts."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in _automaton(lexicon).iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        else:
            found[start] = max(weight, found.get(start, 0.0))
    if spared and found:
        at = np.array(sorted(found))
        spared.sort()
        for lo, hi in spared:
            for x in at[np.searchsorted(at, lo) : np.searchsorted(at, hi)].tolist():  # the closing space may begin the next word
                found.pop(x, None)
    return sum(found.values()), len(found)


def density(weight: float, words: int) -> float:
    """Logarithm of the weight for each thousand words, of short texts as if they had 60 words more."""
    return float(np.log1p(1000 * weight / (words + 60)))


def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    a, b = lexicon.beta
    for batch in batches:
        n_hits, x = [], []
        for t in batch.column(1):
            folded = fold(t.as_py() or "")
            weight, n = hits(lexicon, folded)
            n_hits.append(n)
            x.append(density(weight, len(folded.split())) if n else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hits, pa.int64()), pa.array(sigmoid(a + b * np.array(x, float)))], ["doc_id", "n_hits", "score"])


def _keys(folded: str) -> set[str]:
    """The text's words as entries, whole and by their beginnings."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {" " + w[:k] for w in words for k in LENGTHS if len(w) > k}


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows, and in how many toxic ones, an entry occurs, summed by task."""
    one, all_ = Counter(), Counter()
    for batch in batches:
        for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            got = _keys(fold(t))
            all_.update(got)
            if y:
                one.update(got)
        if len(all_) > 150_000:
            yield from _counted(one, all_)
            one, all_ = Counter(), Counter()
    yield from _counted(one, all_)


def _counted(one: Counter, all_: Counter) -> Iterator[pa.RecordBatch]:
    keys = list(all_)
    yield from pa.table({"key": pa.array(keys, pa.string()), "n1": pa.array([one[k] for k in keys], pa.int64()), "n": pa.array([all_[k] for k in keys], pa.int64())}).to_batches(20_000)


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the least hash of their 3-word shingles, which near copies mostly share."""
    for b in batches:
        least = [int(C.as_long(C.shingles(w, 3)).min()) if len(w) else 0 for w, _ in C.batch_words(C.text_bytes(b.column("text")))]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), b.column("text"), pa.array(least, pa.int64())], ["h", "y", "text", "family"])


def entries(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries with their weights from ``counts`` (entry, toxic rows, clean rows) of ``toxic`` and ``clean`` rows.

    A beginning is left out where a longer entry stands in nine tenths of its toxic rows.
    """
    share = toxic / (toxic + clean)
    weight = {k: np.log((n1 + DRAWN * share) / (n0 + DRAWN * (1 - share))) - np.log(toxic / clean) for k, n1, n0 in counts}
    rows = {k: n1 for k, n1, _ in counts if n1 >= LEAST and weight[k] >= FLOOR}
    implied = {k[:i] for k, n1 in rows.items() for i in range(1, len(k)) if n1 >= 0.9 * rows.get(k[:i], np.inf)}
    return {k: float(min(6.0, weight[k])) for k in rows if k not in implied}


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, keep: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The fixed lexicon completed and calibrated from labelled rows (``labels``: doc_id, toxic).

    Equal texts count once, and are toxic if any of their labels says so.  At most ``sample`` texts are looked at, a third of
    them toxic, those with the least hashes; near copies among them mostly count once.  At most ``keep`` entries reach the
    driver.  The calibration is weighted back to all labelled texts of ``docs``.  Without texts of both labels the fixed lexicon is returned.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic") > 0).alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    hashes = texts.select("doc_id", "h").join(known, "doc_id").groupBy("h").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    hashes = C.cut(hashes, "labelled-hashes")
    every = {r.y: r.n for r in hashes.groupBy("y").agg(F.count("*").alias("n")).collect()}
    start = Lexicon.fixed()
    if not every.get(True) or not every.get(False):
        C.drop(hashes)
        return start
    chosen = hashes.where("y").orderBy("h").limit(sample // 3).union(hashes.where("not y").orderBy("h").limit(sample - sample // 3))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "h"]).select("h", "y", "text").dropDuplicates(["h"]).coalesce(16)
    rows = rows.mapInArrow(_family, "h long, y boolean, text string, family long")
    rows = rows.groupBy("family").agg(F.max("y").alias("y"), F.min_by("text", "h").alias("text"))
    rows = C.cut(rows.select("y", "text"), "labelled")
    C.drop(hashes)
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        C.drop(rows)
        return start
    counts = rows.mapInArrow(_support, "key string, n1 long, n long").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    odds = F.log((F.col("n1") + 0.5) / n[True]) - F.log((F.col("n") - F.col("n1") + 0.5) / n[False])
    top = counts.where(F.col("n1") >= LEAST).withColumn("odds", odds).where(F.col("odds") >= FLOOR).orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "key").limit(keep).collect()
    learned = entries([(r.key, r.n1, r.n - r.n1) for r in top], n[True], n[False])
    fixed = {k: w for k, w in start.entries if not any(k.startswith(x) for x in learned)}
    lexicon = Lexicon(tuple(sorted((fixed | learned).items())), start.exceptions, start.beta)

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = []
            for t in batch.column("text").to_pylist():
                folded = fold(t)
                x.append(density(hits(lexicon, folded)[0], len(folded.split())))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.float64())], ["y", "x"])

    pairs = rows.mapInArrow(weigh, "y boolean, x double").collect()
    x, y = np.array([r.x for r in pairs]), np.array([r.y for r in pairs], float)
    weight = np.where(y > 0, every[True] / n[True], every[False] / n[False])
    model = Logistic(x[:, None], y, penalty=1e-2, weight=weight / weight.mean())
    slope = float(model.beta[0] / model.scale[0])
    C.drop(rows)
    if slope <= 0:
        return lexicon
    return Lexicon(lexicon.entries, lexicon.exceptions, (float(model.beta[1] - slope * model.mean[0]), slope))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` scores below ``threshold``, with all their columns.

    A null or empty text has no hits and stays; repeated rows fare alike.  A score equal to ``threshold`` is rejected.
    """

    def keep(b: pa.RecordBatch) -> list[bool]:
        texts = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(text_col)], ["doc_id", "text"])
        return [x < threshold for out in _score(iter([texts]), lexicon) for x in out.column("score").to_pylist()]

    return C.filter_rows(docs, keep)


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_hits, score (0 to 1), predicted (1 from ``threshold`` on).

    A null or empty text has no hits and the score of a text without any.  Ids may
    be null or repeated; each row is scored by itself, from its whole text alone.
    Other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lambda it: _score(it, lexicon), "doc_id long, n_hits long, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))

"""The inverted index as DataFrames, and BM25 over phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import small_batches, spread

K1, B = 1.2, 0.75
FIELDS = ("content", "source_path", "document_title", "heading_path")
#: A place is the field's number times this, and the position within the field.
FIELD = 1 << 32
#: Bytes of words in texts that are ``folded``: digits, letters, and all over 127.
WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
#: By the code of a letter of two bytes, from U+00C0 to U+027F, the code of the letter without its mark.
UNMARKED = np.array([ord(T.LETTERS.get(chr(c), chr(c))) for c in range(0xC0, 0x280)])
#: Chunks of a slice at most.
SLICE = 1000
#: Terms of a search up to which the scan of the postings is told which terms to read.
FEW = 2000


@dataclass(frozen=True)
class Index:
    """postings (term, chunk_id, dl, tf, places), terms (term, df) and the corpus' row (n, avgdl).

    ``dl`` is the chunk's length in terms, ``places`` its sorted places of the term.  ``buckets``: how
    many buckets a stored table of postings has, by a hash of the term; none where it isn't stored.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    buckets: int | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """The postings that may be of the ``wanted`` terms (term): for few terms, only their buckets and row groups are read."""
        few = _few(wanted, "term")
        if few is None:
            return self.postings
        rows = self.postings
        if self.buckets is not None:
            rows = rows.where(F.col("bucket").isin(sorted({bucket(t, self.buckets) for t in few})))
        return rows.where(F.col("term").isin(few))


def _few(rows: DataFrame, key: str) -> list[str] | None:
    """The distinct keys, sorted, if there are at most ``FEW``."""
    found = [r[0] for r in rows.select(key).distinct().limit(FEW + 1).collect()]
    return sorted(found) if len(found) <= FEW else None


def bucket(term: str, buckets: int) -> int:
    """The bucket of a term, as ``bucket_of``."""
    import zlib

    return zlib.crc32(term.encode()) % buckets


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def field_columns(chunks: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return chunks.select(F.col("id").alias("chunk_id"), "content", m["source_path"].alias("source_path"), m["document_title"].alias("document_title"), T.joined_path(F.coalesce(m["heading_path"], F.array().cast("array<string>"))).alias("heading_path"))


def term_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, terms, sizes, dl): the terms of a chunk's fields in order, and how many of them each field has."""
    terms = F.array(*(T.index_terms(F.col(f)) for f in FIELDS))
    rows = field_columns(chunks).select("chunk_id", terms.alias("fields")).select("chunk_id", F.flatten("fields").alias("terms"), F.transform("fields", F.size).alias("sizes"))
    return rows.withColumn("dl", F.size("terms").cast("long"))


def field_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, and a chunk's four fields as ``folded`` texts), of which ``termed`` makes the rows of ``term_rows``."""
    return field_columns(chunks).select("chunk_id", *(T.folded(F.col(f)).alias(f) for f in FIELDS))


def _unmarked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text whose letters have lost their marks, and the places of second bytes that are none any more."""
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    code = (data[at].astype(np.int64) & 0x1F) << 6 | data[at + 1] & 0x3F
    plain = UNMARKED[code - 0xC0]
    other = plain != code
    at, plain = at[other], plain[other]
    if not len(at):
        return data, at
    data, one = data.copy(), plain < 128
    data[at] = np.where(one, plain, 0xC0 | plain >> 6)
    data[at[~one] + 1] = 0x80 | plain[~one] & 0x3F
    return data, at[one] + 1


def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term_rows`` of ``field_texts``, a slice of chunks at a time: words are cut from the bytes of a whole slice at once, where the expression matches them one by one."""
    none, blank = (pa.scalar(x, pa.large_binary()) for x in (b"", b" "))
    for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        texts = [b.column(f) for f in FIELDS]
        joined = pc.binary_join_element_wise(*(x.cast(pa.large_binary()) for x in texts), none, blank)  # a blank ends each field
        n = b.num_rows
        starts = np.frombuffer(joined.buffers()[1], np.int64)[: n + 1]
        data = np.frombuffer(joined.buffers()[2], np.uint8)[: starts[n]]
        word = WORD[data]
        first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        if len(word) and word[0]:
            first = np.append(0, first)
        size = np.stack([pc.binary_length(x).to_numpy() for x in texts], 1).astype(np.int64) + 1
        upto = np.searchsorted(first, (starts[:n, None] + np.cumsum(size, 1)).ravel())  # words before the end of each field
        last = np.flatnonzero(word[:-1] & ~word[1:]) + 1  # a blank is last
        data, gone = _unmarked(data)
        word[gone] = False
        to = np.append(0, np.cumsum(last - first) - np.searchsorted(gone, last))
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data[word]))
        ends = np.append(0, upto[len(FIELDS) - 1 :: len(FIELDS)]).astype(np.int32)
        sizes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(FIELDS), pa.int32()), pa.array(np.diff(upto, prepend=0), pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.ListArray.from_arrays(pa.array(ends), words), sizes, pa.array(np.diff(ends), pa.int64())], ["chunk_id", "terms", "sizes", "dl"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a chunk, from ``field_texts``.

    The terms of a slice of chunks are numbered and sorted as arrays; grouping within a
    chunk needs no shuffle, and built-in functions could do it only with one.
    """
    for b in termed(batches):
        terms = b.column("terms")
        flat = terms.flatten().dictionary_encode()
        codes = flat.indices.to_numpy()
        size = terms.value_lengths().to_numpy()
        row = np.repeat(np.arange(b.num_rows), size)
        ends = np.cumsum(b.column("sizes").flatten().to_numpy().reshape(b.num_rows, len(FIELDS)), 1)
        within = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        of = (within[:, None] >= ends[row]).sum(1)
        start = np.where(of > 0, ends[row, np.maximum(of - 1, 0)], 0)
        place = of.astype(np.int64) * FIELD + within - start
        order = np.lexsort([codes, row])  # stable, so places stay in order
        codes, row, place = codes[order], row[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])) if len(codes) else np.zeros(0, np.int64)
        ends_ = np.append(first, len(codes))
        yield pa.RecordBatch.from_arrays(
            [flat.dictionary.take(pa.array(codes[first])), b.column("chunk_id").take(pa.array(row[first])), b.column("dl").take(pa.array(row[first])), pa.array(np.diff(ends_), pa.int32()), pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), pa.array(place, pa.int64()))],
            ["term", "chunk_id", "dl", "tf", "places"],
        )


def build(chunks: DataFrame) -> Index:
    """Index all chunks by the terms of their four fields, chunk by chunk, without a shuffle."""
    small_batches(chunks.sparkSession)
    chunks = spread(chunks)
    rows = term_rows(chunks)
    by = field_texts(chunks).mapInArrow(_grouped, "term string, chunk_id string, dl long, tf int, places array<long>")
    return Index(by, by.groupBy("term").agg(F.count("*").alias("df")), rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a slice of chunks for each term and field: chunks, places, and first places (from 1)."""
    for b in _grouped(batches):
        places = b.column("places")
        size, flat = places.value_lengths().to_numpy(), places.flatten().to_numpy()
        terms = b.column("term").dictionary_encode()
        key = np.repeat(terms.indices.to_numpy().astype(np.int64), size) * len(FIELDS) + flat // FIELD
        row = np.repeat(np.arange(b.num_rows), size)
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])[: len(key)]  # places are sorted, so a field's come together
        keys, of = np.unique(key, return_inverse=True)
        count = lambda w=None, of=of, n=len(keys): pa.array(np.bincount(of, w, n).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [terms.dictionary.take(pa.array(keys // len(FIELDS))), pa.array((keys % len(FIELDS)).astype(np.int32)), count(first), count(), count(np.where(first, flat % FIELD, 0))],
            ["term", "field", "n_chunks", "tf", "first_positions"],
        )


def summary(chunks: DataFrame) -> DataFrame:
    """(term, field, n_chunks, tf, first_positions): the postings of all chunks summed up; they are summed where they are made and stored nowhere."""
    small_batches(chunks.sparkSession)
    rows = field_texts(spread(chunks)).mapInArrow(_summed, "term string, field int, n_chunks long, tf long, first_positions long")
    return rows.groupBy("term", "field").agg(*(F.sum(c).alias(c) for c in ("n_chunks", "tf", "first_positions")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and in how many chunks of a slice each is."""
    for b in termed(batches):
        terms = b.column("terms")
        flat = terms.flatten().dictionary_encode()
        n = max(len(flat.dictionary), 1)
        held = np.unique(np.repeat(np.arange(b.num_rows), terms.value_lengths().to_numpy()) * n + flat.indices.to_numpy()) % n
        yield pa.RecordBatch.from_arrays([flat.dictionary, pa.array(np.bincount(held, minlength=len(flat.dictionary)), pa.int64())], ["term", "df"])


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df), as ``build`` has it, summed by slices of chunks first."""
    small_batches(chunks.sparkSession)
    return field_texts(spread(chunks)).mapInArrow(_counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def postings(index: Index) -> DataFrame:
    """(term, chunk_id, field, tf, positions): the places of each term by field."""
    of = lambda k: F.transform(F.filter("places", lambda p: F.floor(p / FIELD) == k), lambda p: (p % FIELD).cast("int"))
    each = F.filter(F.array(*(F.struct(F.lit(k).alias("field"), of(k).alias("positions")) for k in range(len(FIELDS)))), lambda x: F.size(x["positions"]) > 0)
    rows = index.postings.select("term", "chunk_id", F.explode(each).alias("f"))
    return rows.select("term", "chunk_id", "f.field", F.size("f.positions").cast("long").alias("tf"), "f.positions")


def plans(queries: DataFrame, tokens: Column, expanded: Column, normalized: Column) -> DataFrame:
    """The passes of each query (qid): all its tokens, its tokens as one phrase, any of its expanded tokens.

    One row for each phrase: qid, pass, phrase, words, needed (how many phrases a
    chunk must hold).  A query of one token has one pass; one without tokens is
    its own text as a phrase, if it has any.
    """
    passes = F.when(F.size(tokens) == 0, F.array(F.struct(F.lit(1).alias("pass"), F.array(normalized).alias("phrases"), F.lit(1).alias("needed"))))
    every = F.struct(F.lit(1).alias("pass"), tokens.alias("phrases"), F.size(tokens).alias("needed"))
    passes = passes.when(F.size(tokens) == 1, F.array(every)).otherwise(
        F.array(every, F.struct(F.lit(2).alias("pass"), F.array(normalized).alias("phrases"), F.lit(1).alias("needed")), F.struct(F.lit(3).alias("pass"), expanded.alias("phrases"), F.lit(1).alias("needed")))
    )
    rows = queries.select("qid", F.explode(passes).alias("p")).select("qid", "p.pass", "p.needed", F.posexplode("p.phrases").alias("phrase", "text"))
    return rows.select("qid", "pass", "phrase", T.index_terms(F.col("text")).alias("words"), "needed").where(F.size("words") > 0)


def phrase_hits(index: Index, plan: DataFrame) -> DataFrame:
    """(words, chunk_id, dl, tf, df): a phrase's places in a chunk, its words one after the other within one field.

    A phrase of one word is a row of the postings.  For a longer one the chunks of its rarest word are looked up first,
    and the other words only in these.
    """
    wanted = plan.select("words").distinct()
    terms = wanted.select("words", F.posexplode("words").alias("at", "term"))
    found = index.of(terms)
    one = wanted.where(F.size("words") == 1).select("words", F.element_at("words", 1).alias("term"))
    single = found.join(one, "term").join(index.terms, "term").select("words", "chunk_id", "dl", "tf", "df")

    several = terms.where(F.size("words") > 1).join(index.terms, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = several.groupBy("words").agg(F.min(F.struct("df", "at", "term")).alias("r")).where("r.df > 0").select("words", "r.at", "r.term")
    starts = lambda at: F.transform("places", lambda p: p - at)
    seeds = index.of(rarest).join(rarest, "term").select("words", "chunk_id", "dl", F.col("at").alias("seed_at"), starts(F.col("at")).alias("s"))
    others = several.select("words", "at", "term").join(seeds.select("words", "chunk_id", "seed_at"), "words").where("at <> seed_at")
    near = _few(seeds, "chunk_id")
    held = (found if near is None else found.where(F.col("chunk_id").isin(near))).join(others, ["term", "chunk_id"]).groupBy("words", "chunk_id").agg(F.count("*").alias("n"), F.collect_list(starts(F.col("at"))).alias("all"))
    places = seeds.join(held, ["words", "chunk_id"]).where(F.col("n") == F.size("words") - 1)
    tf = F.size(F.aggregate("all", F.col("s"), lambda a, b: F.array_intersect(a, b)))
    phrases = places.select("words", "chunk_id", "dl", tf.alias("tf")).where("tf > 0")
    df = phrases.groupBy("words").agg(F.count("*").alias("df"))
    return single.unionByName(phrases.join(df, "words"))


def bm25(index: Index, plan: DataFrame) -> DataFrame:
    """(qid, pass, chunk_id, score): chunks that hold the phrases a pass needs; a lower score is better.

    Phrases that several passes of a query ask for are looked up and added up once, by how often each
    pass asks.  Scores are rounded to nine decimals, so that ranks don't depend on the order of sums.
    """
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(1e-6)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = phrase_hits(index, plan).crossJoin(F.broadcast(index.corpus)).select("words", "chunk_id", part.alias("part"))
    # hits are dealt by chunk before queries multiply them, so the sums need no shuffle of their own
    parts = parts.repartition("chunk_id")
    passes = (1, 2, 3)
    of = lambda k: F.col("pass") == k
    asked = plan.groupBy("qid", "words").agg(*(F.count_if(of(k)).alias(f"n{k}") for k in passes), *(F.max(F.when(of(k), F.col("needed"))).alias(f"needed{k}") for k in passes))
    sums = asked.join(parts, "words").groupBy("qid", "chunk_id").agg(
        *(F.sum(f"n{k}").alias(f"held{k}") for k in passes), *(F.max(f"needed{k}").alias(f"needed{k}") for k in passes), *(F.sum(F.col("part") * F.col(f"n{k}")).alias(f"total{k}") for k in passes)
    )
    each = F.array(*(F.when(F.col(f"held{k}") >= F.col(f"needed{k}"), F.struct(F.lit(k).alias("pass"), F.round(-F.col(f"total{k}"), 9).alias("score"))) for k in passes))
    return sums.select("qid", "chunk_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("p")).select("qid", "p.pass", "chunk_id", "p.score")


def candidates(scored: DataFrame, top_k: int = 5, own: DataFrame | None = None) -> DataFrame:
    """The best chunks of each pass, max(10 * top_k, 40) of them; a chunk keeps the score of its first pass.

    ``own`` (qid, top_k) gives queries a number of their own.
    """
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid", "pass").orderBy("score", "chunk_id")))
    if own is None:
        best = ranked.where(F.col("r") <= max(10 * top_k, 40))
    else:
        best = ranked.join(own.select("qid", "top_k"), "qid").where(F.col("r") <= F.greatest(10 * F.col("top_k"), F.lit(40)))
    first = best.withColumn("f", F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("pass"))).where("f = 1")
    return first.select("qid", "chunk_id", "pass", "score")


def snippet(content: Column, words: Column, size: int = 20) -> Column:
    """The window of ``size`` tokens with the most distinct hits, the earliest of equals, with hits in brackets."""
    tokens = F.regexp_extract_all(content, F.lit(r"[^\s]+"), F.lit(0))
    folded = lambda x: F.array_join(T.index_terms(x), " ")
    hit = F.transform(tokens, lambda x: F.exists(T.index_terms(x), lambda t: F.array_contains(words, t)))

    def pick(parts: Column) -> Column:
        last = F.greatest(F.size(parts) - size, F.lit(0))
        held = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.size(F.array_distinct(F.transform(F.filter(F.slice(parts, i + 1, size), lambda p: p["hit"]), lambda p: folded(p["word"])))).alias("n"), (-i).alias("at")))
        at = -F.array_max(held)["at"]
        shown = F.array_join(F.transform(F.slice(parts, at + 1, size), lambda p: F.when(p["hit"], F.concat(F.lit("["), p["word"], F.lit("]"))).otherwise(p["word"])), " ")
        return F.concat(F.when(at > 0, "...").otherwise(""), shown, F.when(at + size < F.size(parts), "...").otherwise(""))

    parts = F.arrays_zip(tokens.alias("word"), hit.alias("hit"))
    return F.when(F.size(tokens) > 0, T.let(parts, pick)).otherwise("")

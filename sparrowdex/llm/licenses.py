"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined to the positions of the same
k-grams in the templates.  A hit votes for its template's diagonal, the offset of the
text's position to the template's.  Neighbouring diagonals that follow each other
in the text are merged (a word more or less shifts the diagonal), and a merged span
is accepted when its words verified by hits are a large enough share of both the
span and the template.  Where accepted spans overlap, the best one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

# Phrases of the base scan with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wordings by which public licenses are granted, with their labels.
TEMPLATES = (
    ("mit", "licensed under the MIT License"),
    ("mit", "released under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
)


def _words(text: str) -> np.ndarray:
    return C.word_hashes(text.encode(), C.ALNUM)[0]


def _starts(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = len(words) - len(phrase) + 1
    if n <= 0 or not len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[words[at + j] == phrase[j]]
    return at


def _grams(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = [C.as_long(C.shingles(words, k) if len(words) >= k else words[:0]) for words, _ in C.batch_words(C.text_bytes(b.column(2)), C.ALNUM)]
        ends = np.cumsum([0, *map(len, grams)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams) if grams else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "th", "grams"])


def _base(batches: Iterator[pa.RecordBatch], phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    base = [(_words(p), label) for p, label in phrases.items()]
    for b in batches:
        n, found, first, last, labels = [], [], [], [], []
        for words, _ in C.batch_words(C.text_bytes(b.column(2)), C.ALNUM):
            at = [(_starts(words, p), label) for p, label in base]
            every = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in at)])
            n.append(len(words))
            found.append(len(every))
            first.append(int(every.min()) if len(every) else None)
            last.append(int(every.max()) if len(every) else None)
            labels.append(",".join(sorted({label for a, label in at if len(a)})))
        long = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), long(n), long(found), long(first), long(last), pa.array(labels, pa.string())], ["doc_id", "th", "n_words", "n_base", "first_word", "last_word", "base_labels"])


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 3, share: float = 0.8, slack: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters and digits and anything beyond ASCII, A-Z in
    lower case.  ``n_base`` counts the places where a phrase's words stand one after the
    other, and first_word and last_word are the first and the last of them, null without any.
    ``labels`` are those of the base and of accepted ``spans`` (label, start word, end
    word, similarity), distinct and sorted; both label columns are empty strings without any.
    ``score`` is 1 with a base place, else the best span's similarity, else 0.
    A null or empty text has no words.  Ids may be null or repeated; equal rows get
    equal results.  Other columns are not looked at; an empty table gives an empty result.

    The templates and their positions are parameters of a fixed size and are
    broadcast; only hits are shuffled, and a group holds the hits of one text.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 400)
    at = [(int(h), t, label, p, len(_words(text))) for t, (label, text) in enumerate(templates) for p, h in enumerate(C.as_long(C.shingles(_words(text), k)).tolist()) if len(_words(text)) >= k]
    index = F.broadcast(spark.createDataFrame(at, "gram long, template int, label string, tpos int, tsize int"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    base_scan = rows.mapInArrow(lambda it: _base(it, phrases), "doc_id long, th long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    grams = rows.mapInArrow(lambda it: _grams(it, k), "doc_id long, th long, grams array<long>")

    hits = grams.select("doc_id", "th", F.posexplode("grams").alias("pos", "gram")).join(index, "gram")
    votes = hits.groupBy("doc_id", "th", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.min("pos").alias("lo"), (F.max("pos") + k).alias("hi"), F.collect_set("tpos").alias("held"), F.first("label").alias("label"), F.first("tsize").alias("tsize")
    )
    w = Window.partitionBy("doc_id", "th", "template").orderBy("lo", "diagonal")
    new = F.coalesce((F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > slack) | (F.col("lo") - F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) > slack + k), F.lit(True))
    merged = votes.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("doc_id", "th", "template", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.first("label").alias("label"), F.first("tsize").alias("tsize"))
    verified = F.size(F.array_distinct(F.flatten(F.transform("held", lambda p: F.sequence(p, p + k - 1)))))
    spans = spans.withColumn("similarity", verified / F.greatest("tsize", F.col("hi") - F.col("lo"))).where(F.col("similarity") >= share)
    span = F.struct(F.col("label"), F.col("lo").cast("long").alias("start"), F.col("hi").cast("long").alias("end"), F.col("similarity").cast("double").alias("similarity"))
    per_doc = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(span)).alias("all"))
    beaten = lambda x: F.exists("all", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & ((y["similarity"] > x["similarity"]) | ((y["similarity"] == x["similarity"]) & (y["end"] - y["start"] > x["end"] - x["start"]) & (y["label"] != x["label"]))))
    per_doc = per_doc.select("doc_id", "th", F.filter("all", lambda x: ~beaten(x)).alias("spans"))

    out = base_scan.alias("s").join(per_doc.alias("p"), F.expr("s.doc_id <=> p.doc_id and s.th = p.th"), "left").select("s.*", "p.spans")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    added = F.coalesce(F.transform("spans", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["similarity"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(F.array_sort(F.array_distinct(F.concat(base, added))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(best, F.lit(1.0))).alias("score"), "spans",
    )

"""Documents for the tests of the training-data operators."""

import random

#: Names that operators use inside; here they are columns of the input that must not matter.
CLASHING = ["node", "key", "score", "th", "comp", "mix_u", "mix_weight", "length", "cell", "cells", "places", "arc", "y", "x", "row", "r", "p", "a", "b", "kept", "labels", "text_crc32", "sig", "home", "component_id", "doc", "m", "q", "n"]


def make_documents(spark, rows, clashing=True):
    """``rows``: (doc_id, text, lang, source); n_chars is added, and columns with clashing names."""
    extra = [0] * len(CLASHING) if clashing else []
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} int" for c in (CLASHING if clashing else []))
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *extra) for i, t, lang, s in rows], schema).repartition(3)


VOCABULARY = [a + b + c for a in ("ba", "ko", "mi", "tu", "se", "ra") for b in ("lo", "ne", "di", "ga", "") for c in ("r", "s", "n", "")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


#: Nulls, empty and white texts, one word, repeated rows and ids, null ids, signs beyond ASCII, a very long text.
EDGE = [
    (1, None, None, None), (2, "", "en", "src0"), (3, "  \n\t ", "en", None), (4, "word", None, "src1"), (5, "the same text here for all of them", "en", "src0"), (5, "the same text here for all of them", "en", "src0"), (6, "the same text here for all of them", "de", "src0"),
    (6, "another text under the same id as before", "de", "src0"), (None, "a text whose id is null and that is alone", "en", "src0"), (None, "the same text here for all of them", "en", "src0"), (7, "Größe 日本語 👍 été", "fr", "src2"), (8, "x " * 60_000, "en", "src0"), (9, "y" * 200_000, "en", "src0"), (-3, "a negative id is an id as well", "en", "src0"),
]

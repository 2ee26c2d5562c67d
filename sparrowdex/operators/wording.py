"""The sentences of outcomes and contracts, and how they are filled in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grades.
STRONG, WEAK, MISS = "STRONG PASS", "WEAK PASS", "MISS"
#: The engine's own sentences, by what they are said of.
FAILURES = {
    "nothing": "The search found nothing.",
    "source": "The first result is from {source}, which this case doesn't prefer.",
    "versioned": "The first result is a copy in a versioned folder: {path}",
    "wrapper": "The first result is markup more than text: {path}",
    "disallowed": "The first result is from a path that this case rules out: {path}",
    "paths": "None of the {n} results is from a path that this case names.",
    "weak": "No result has anything that this case asks for.",
}
RANKINGS = {
    "source_later": "{source} is preferred and comes at rank {rank}, behind {top}: found, but ordered badly.",
    "source_absent": "{source} is preferred, and the first result is from {top}.",
    "preferred_later": "A preferred result comes at rank {rank} only.",
    "no_match": "There are results, and none of them matches.",
    "no_candidates": "There are no results to order.",
    "later": "A match comes at rank {rank} only.",
}
BUNDLES = {
    "absent": "there is no bundle",
    "path": "a named path is in the bundle",
    "no_path": "no named path is in the bundle",
    "primary": "the match is from {source}",
    "preferred": "has preferred sources ({sources})",
    "not_preferred": "has no preferred source",
    "acceptable": "has acceptable sources ({sources})",
    "mixed": "mixes sources ({sources})",
    "present": "has the headings {headings}",
    "missing": "lacks the headings {headings}",
    "over": "takes {n} tokens of {budget}",
    "redundant": "repeats {n} of its parts",
    "small": "holds very little",
    "cut": "holds a part of the match only",
    "fine": "holds the match within its budget",
}
CONTRACT = {"ranking": "Rank {rank} {source} bundle from {place}.", "support": " Added support for {reason}.", "title": "{title} — {place}", "summary": "{title} — {place}: {point}"}


def say(sentence: str, **values: Column) -> Column:
    """The sentence with its places filled in; null if a value is."""
    parts = re.split(r"\{(\w+)\}", sentence)
    return F.concat(*(F.lit(x) if i % 2 == 0 else values[x].cast("string") for i, x in enumerate(parts)))

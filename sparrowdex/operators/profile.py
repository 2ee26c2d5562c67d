"""Query profiles: normalised and expanded tokens, intents, families and hints, for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import default_rules as D
from . import rules as R


def expand(tokens: Column, aliases: dict[str, list[str]]) -> Column:
    """Each token, its singular and its aliases, distinct in order."""
    none = F.array().cast("array<string>")
    table = F.create_map(*(x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if aliases else None
    singular = lambda t: F.when(t.endswith("s") & (F.length(t) > 3), F.array(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(none)
    also = lambda t: F.coalesce(table[t], none) if table is not None else none
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), singular(t), also(t)))))


def phrases(tokens: Column) -> Column:
    """Runs of three tokens, then of two, distinct in order."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.array_distinct(F.concat(runs(3), runs(2)))


def _hints(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def profile(queries: DataFrame, rules=D) -> DataFrame:
    """``queries`` (qid, raw_query) with tokens, normalized, expanded, phrases, file_hints, subtree_hints, intent, families and task.

    A general task with hints is decided by the rules for hinted tasks.  A null query has no tokens.
    """
    rows = queries.withColumn("raw_query", F.coalesce("raw_query", F.lit("")))
    rows = rows.withColumn("tokens", T.distinct_words(F.col("raw_query"), rules.STOPWORDS))
    rows = rows.withColumn("normalized", F.when(F.size("tokens") > 0, F.array_join("tokens", " ")).otherwise(T.strip(F.col("raw_query"))))
    rows = rows.withColumn("expanded", expand(F.col("tokens"), rules.ALIASES)).withColumn("phrases", phrases(F.col("tokens")))
    subtree = F.filter(F.transform(_hints(F.col("raw_query"), T.PATH_HINT), lambda h: F.lower(F.regexp_replace(h, "^[/`]+|[/`]+$", ""))), lambda h: (h != "") & ~F.element_at(F.split(h, "/"), -1).contains("."))
    rows = rows.withColumn("file_hints", T.anchors(F.col("raw_query"))).withColumn("subtree_hints", F.array_distinct(subtree))
    rows = rows.withColumn("intent", R.first(rules.CONCEPTUAL, "keyword")).withColumn("families", R.labels(rules.FAMILIES)).withColumn("task", R.first(rules.TASK, "general"))
    hinted = (F.col("task") == "general") & (F.size("file_hints") + F.size("subtree_hints") > 0)
    return rows.withColumn("task", F.when(hinted, R.first(rules.HINTED_TASK, "general")).otherwise(F.col("task")))

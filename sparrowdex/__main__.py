"""Command line: ingest, ingest-pages, ingest-wiki, query, stats, inspect-chunk, inspect-doc, eval, verify."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contract, diagnostics, evaluation, parsing
from .operators import bundles as B
from .plans import engine, rendering
from .plans.store import Store, ingest
from .sources import files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparrowdex", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *words: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--store", required=True)
        p.add_argument("--json", action="store_true")
        for w in words:
            p.add_argument(w)
        for k, v in options.items():
            p.add_argument("--" + k.replace("_", "-"), **({"action": "store_true"} if v is False else {"type": type(v), "default": v} if v is not None else {}))
        return p

    limits = {"max_tokens": 400, "overlap_tokens": 60, "tokenizer": "regex", "append": False}
    add("ingest", "source", **limits)
    add("ingest-pages", "navigation", "payload", base_url="https://example.org", share="site", **limits)
    add("ingest-wiki", "dump", base_url="https://example.org", **limits)
    add("query", "text", top_k=5, context_bundle=False, include_previous=False, include_next=False, bundle_max_tokens=600, explain=False, json_contract=False)
    add("stats", limit=10)
    add("inspect-chunk", "id")
    add("inspect-doc", "id")
    add("eval", "cases", with_bundles=False, bundle_max_tokens=450, baseline=None, markdown=False, details=False)
    v = add("verify", "cases", bundle_max_tokens=450, baseline=None, worktree=None, allow_dirty=False, base_url="https://example.org", share="site", without_bundles=False, **limits)
    v.add_argument("--ingest", help="a markdown tree, a wiki dump, or a payload of pages (with --navigation) to ingest first")
    v.add_argument("--kind", choices=("markdown", "pages", "wiki"), default="markdown")
    v.add_argument("--navigation")
    v.add_argument("--smoke", action="append", default=[], help="a query whose three best results are part of the payload; may be given more than once")
    return top


def _emit(rows: list[dict], as_json: bool) -> None:
    for row in rows:
        print(json.dumps(row, indent=2, sort_keys=True, default=str, ensure_ascii=False) if as_json else "\n".join(f"{k}: {v}" for k, v in row.items()))


def _dicts(df: DataFrame) -> list[dict]:
    """Rows of a result that is short by its nature: a report, a query's results, one document."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _ingest(spark: SparkSession, a: argparse.Namespace, store: Store) -> list[dict]:
    kind = {"ingest": "markdown", "ingest-pages": "pages", "ingest-wiki": "wiki"}.get(a.command) or a.kind
    if a.command == "verify":
        a.source = a.dump = a.payload = a.ingest
    if kind == "markdown":
        parsed = parsing.markdown(files.markdown_tree(spark, a.source), files.worktree(a.source)["commit"])
    elif kind == "wiki":
        parsed = parsing.wikitext(files.wiki_dump(spark, a.dump), a.base_url)
    else:
        whole = lambda p: spark.read.text(p, wholetext=True).withColumnRenamed("value", "json")
        pages = files.included_pages(files.landed_pages(whole(a.payload)), files.page_index(whole(a.navigation)))
        parsed = parsing.design_pages(pages.withColumn("scraped", F.current_timestamp()), a.base_url, a.share)
    return [ingest(store, *parsed, a.max_tokens, a.overlap_tokens, a.append, a.tokenizer)]


def _query(spark: SparkSession, a: argparse.Namespace, store: Store) -> list[dict]:
    asked, chunks = spark.createDataFrame([("q", a.text)], "qid string, raw_query string"), store.read("chunks")
    if a.json_contract:
        e = engine.contracts(asked, store, a.top_k, a.include_previous, a.include_next, a.bundle_max_tokens)
        return [json.loads(r.json) for r in contract.as_json(e).collect()]
    results, profiles = engine.search(asked, store, a.top_k)
    if a.context_bundle:
        return _dicts(B.bundles(engine.kept(results), engine.kept(profiles), chunks, a.include_previous, a.include_next, a.bundle_max_tokens).orderBy("rank"))
    return _dicts((results if a.explain else results.drop("breakdown")).orderBy("rank"))


def _stats(a: argparse.Namespace, store: Store) -> list[dict]:
    t = [store.read(x) for x in ("documents", "sections", "chunks")]
    g = diagnostics
    return [{
        "overview": _dicts(g.overview(*t))[0], "sources": _dicts(g.source_counts(*t)), "chunks_per_document": _dicts(g.chunks_per_document(*t, limit=a.limit)), "largest_chunks": _dicts(g.largest_chunks(*t, limit=a.limit)),
        "small_chunks": _dicts(g.small_chunks(*t, limit=a.limit)), "duplicate_chunk_candidates": _dicts(g.duplicate_chunks(*t, limit=a.limit)),
    }]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparrowdex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store)
    t = [store.read(x) for x in ("documents", "sections", "chunks")] if a.command.startswith("inspect") else []
    if a.command.startswith("ingest"):
        rows = _ingest(spark, a, store)
    elif a.command == "query":
        rows = _query(spark, a, store)
    elif a.command == "stats":
        rows = _stats(a, store)
    elif a.command in ("inspect-chunk", "inspect-doc"):
        rows = _dicts((diagnostics.inspect_chunk if a.command == "inspect-chunk" else diagnostics.inspect_document)(*t, a.id))
        if not rows:
            print(f"not found: {a.id}", file=sys.stderr)
            return 1
    else:
        cases = files.eval_cases(spark, a.cases)
        old = engine.kept(files.report_artifact(spark, a.baseline)) if a.baseline else None
        base = evaluation.report(old) if old is not None else None
        told = {"ingest": _ingest(spark, a, store)[0]} if a.command == "verify" and a.ingest else {}
        with_bundles = a.with_bundles if a.command == "eval" else not a.without_bundles
        made = engine.kept(engine.evaluate(cases, store, with_bundles, a.bundle_max_tokens))
        report = engine.kept(evaluation.report(made))
        if a.command == "eval" and not a.json:
            parts = rendering.sections(report, made, base, old, a.baseline, a.details)
            print((rendering.markdown if a.markdown else rendering.text)(parts))
            return 0
        if a.command == "eval":
            rows = [{"outcomes": _dicts(made), "report": _dicts(report), "comparison": _dicts(evaluation.comparison(report, base)) if base is not None else None}]
        else:
            state = files.worktree(a.worktree) if a.worktree else None
            verdict = _dicts(evaluation.validation_status(report, evaluation.comparison(report, base) if base is not None else None))[0]
            asked = spark.createDataFrame([(f"{i:04d}", q) for i, q in enumerate(a.smoke)], "qid string, raw_query string")
            smoke = _dicts(engine.search(asked, store, 3)[0].drop("breakdown").orderBy("qid", "rank")) if a.smoke else []
            told |= {"smoke_queries": {q: [r for r in smoke if r["qid"] == f"{i:04d}"] for i, q in enumerate(a.smoke)}} if a.smoke else {}
            rows = [verdict | {"worktree": state} | told | ({"stats": _stats(argparse.Namespace(limit=5), store)[0], "outcomes": _dicts(made)} if a.json else {})]
            _emit(rows, a.json)
            return int(verdict["status"] == "NON_GREEN" or bool(state and state["is_git_repo"] and not state["clean"] and not a.allow_dirty))
    _emit(rows, a.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())

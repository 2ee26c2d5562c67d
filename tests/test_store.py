import json

from pyspark.sql import functions as F

from sparrowdex.operators import diagnostics as G
from sparrowdex.operators.parsing import markdown
from sparrowdex.plans.store import Store, ingest
from sparrowdex.streaming.ingest import follow


def files(spark, **texts):
    return spark.createDataFrame([(f"{k}.md", t, None) for k, t in texts.items()], "source_path string, raw string, modified timestamp")


ONE = "# One\n\nThe first page has a paragraph of several words in it."
TWO = "# Two\n\nThe second page has a paragraph of several words too.\n\n## Part\n\nAnd it has a second part with more words in it."


def paths(store):
    return sorted(r.source_path for r in store.read("documents").collect())


def test_writes_replace_or_upsert(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.version() is None
    assert s.read("chunks").count() == 0
    assert ingest(s, *markdown(files(spark, a=ONE, b=TWO))) == {"documents": 2, "sections": 3, "chunks": 3}
    first = s.version()
    assert ingest(s, *markdown(files(spark, b=ONE, c=TWO)), append=True) == {"documents": 3, "sections": 4, "chunks": 4}
    assert paths(s) == ["a.md", "b.md", "c.md"]
    assert s.version() != first
    again = ingest(s, *markdown(files(spark, b=ONE, c=TWO)), append=True)
    assert again == {"documents": 3, "sections": 4, "chunks": 4}
    assert s.read("chunks").where("metadata.source_path = 'b.md'").head().content.startswith("Heading: One")
    assert ingest(s, *markdown(files(spark, z=ONE)))["documents"] == 1
    assert paths(s) == ["z.md"]
    assert s.index().postings.where("term = 'paragraph'").count() == 1


def test_the_stored_index_is_the_built_one(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from sparrowdex.operators import index
    from sparrowdex.operators.profile import profile
    from sparrowdex.plans import store as module

    monkeypatch.setattr(module, "BUCKET", 20)
    s = Store(spark, str(tmp_path / "store"))
    ingest(s, *markdown(files(spark, a=ONE, b=TWO)))
    stored, built = s.index(), index.build(s.read("chunks"))
    assert stored.buckets > 1
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for t in ("postings", "terms", "corpus"):
        assert rows(getattr(stored, t).drop("bucket")) == rows(getattr(built, t)), t
    p = profile(spark.createDataFrame([("q", "first paragraph of text"), ("none", "zzz")], "qid string, raw_query string"))
    plan = index.plans(p, F.col("tokens"), F.col("expanded"), F.col("normalized"))
    assert rows(index.bm25(stored, plan)) == rows(index.bm25(built, plan))
    asked = stored.of(spark.createDataFrame([("paragraph",)], "term string"))
    assert {r.bucket for r in asked.select("bucket").distinct().collect()} <= {index.bucket("paragraph", stored.buckets)}
    assert "PartitionFilters: [isnotnull(bucket" in asked._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [bucket" in asked._jdf.queryExecution().executedPlan().toString()


def test_diagnostics(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    ingest(s, *markdown(files(spark, a=ONE, b=TWO, c=ONE, empty="")))
    t = [s.read(x) for x in ("documents", "sections", "chunks")]
    o = G.overview(*t).head()
    assert (o.documents, o.sections, o.chunks) == (4, 4, 4)
    assert [tuple(r) for r in G.chunks_per_document(*t).collect()] == [("b.md", "Two", 2), ("a.md", "One", 1), ("c.md", "One", 1), ("empty.md", "empty", 0)]
    largest = G.largest_chunks(*t, limit=2).collect()
    assert largest[0].token_count >= largest[1].token_count
    assert G.small_chunks(*t, most=1000).count() == 4
    (d,) = G.duplicate_chunks(*t).collect()
    assert (d.duplicate_count, d.sample_source_path) == (2, "a.md")
    assert tuple(G.source_counts(*t).head()) == ("repo_markdown", "devdocs_repo", 4, 4, 4)
    doc = t[0].where("source_path = 'b.md'").head()
    r = G.inspect_document(*t, doc.id).head()
    assert [x.section_title for x in r.sections] == ["Two", "Part"]
    assert r.chunk_count == 2
    c = t[2].head()
    assert G.inspect_chunk(*t, c.id).head().chunk_id == c.id
    assert G.inspect_chunk(*t, "none").count() == G.inspect_document(*t, "none").count() == 0
    empty = [x.limit(0) for x in t]
    assert tuple(G.overview(*empty).head()) == (0, 0, 0, 0.0)


def test_a_stream_of_files_is_upserted(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    s = Store(spark, str(tmp_path / "store"))

    def land(name, *rows):
        (landing / name).write_text("\n".join(json.dumps({"source_path": p, "raw": t, "modified": m}) for p, t, m in rows))

    def run():
        q = follow(spark, str(landing), s, str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None

    land("1.json", ("a.md", ONE, "2024-01-01T00:00:00Z"), ("a.md", TWO, "2024-01-02T00:00:00Z"), ("b.md", ONE, "2024-01-01T00:00:00Z"))
    run()
    assert s.read("documents").select("source_path", "title").orderBy("source_path").collect() == [("a.md", "Two"), ("b.md", "One")]
    land("2.json", ("b.md", TWO, "2024-01-03T00:00:00Z"), ("c.md", ONE, "2024-01-03T00:00:00Z"))
    run()
    assert paths(s) == ["a.md", "b.md", "c.md"]
    assert s.read("documents").where(F.col("source_path") == "b.md").head().title == "Two"

import json

import pytest

from sparrowdex.__main__ import main
from sparrowdex.functions import text as T
from sparrowdex.sources.files import worktree

PAGE = "# Settings\n\nThe settings of the tool are kept in `db/settings.php` and read when a page is shown to a user of the site.\n\n## Reading\n\nA setting is read by its name, and the default value is used where there is none in the database of the site."


def run(capsys, spark, *argv):
    code = main(list(map(str, argv)), spark)
    return code, capsys.readouterr().out


def test_from_files_to_a_verdict(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "settings.md").write_text(PAGE)
    store = ["--store", tmp_path / "store", "--json"]
    assert json.loads(run(capsys, spark, "ingest", tmp_path / "docs", *store, "--tokenizer", "words")[1]) == {"documents": 1, "sections": 2, "chunks": 2}
    assert json.loads(run(capsys, spark, "ingest", tmp_path / "docs", *store, "--append")[1]) == {"documents": 1, "sections": 2, "chunks": 2}
    stats = json.loads(run(capsys, spark, "stats", *store)[1])
    assert (stats["overview"]["chunks"], stats["sources"][0]["source_name"]) == (2, "devdocs_repo")
    contract = json.loads(run(capsys, spark, "query", "read a setting", *store, "--json-contract")[1])
    assert contract["results"][0]["source"]["path"] == "settings.md"
    chunk = contract["results"][0]["content"]["sections"][0]["id"]
    assert run(capsys, spark, "inspect-chunk", chunk, *store)[0] == 0
    assert run(capsys, spark, "inspect-chunk", "none", *store)[0] == 1
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "a", "query": "read a setting", "preferred_document_paths": ["settings.md"]}]))
    assert "strong_passes: 1" in run(capsys, spark, "eval", tmp_path / "cases.json", "--store", tmp_path / "store")[1]
    code, out = run(capsys, spark, "verify", tmp_path / "cases.json", *store)
    verdict = json.loads(out)
    assert (verdict["baseline_status"], verdict["misses"]) == ("not_compared", 0)
    assert code == int(verdict["status"] == "NON_GREEN")

    # a run as the baseline of the next, on other files
    cases = [{"id": "a", "query": "read a setting", "preferred_document_paths": ["settings.md"], "bucket": "one"}, {"id": "b", "query": "zzz", "bucket": "two"}]
    (tmp_path / "cases.json").write_text(json.dumps(cases[:1]))
    (tmp_path / "old.json").write_text(run(capsys, spark, "eval", tmp_path / "cases.json", *store, "--with-bundles")[1])
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    shown = run(capsys, spark, "eval", tmp_path / "cases.json", "--store", tmp_path / "store", "--with-bundles", "--baseline", tmp_path / "old.json", "--details")[1]
    assert "  bucket two: status=added" in shown
    assert "  retrieval misses: current=1.000 baseline=0.000 delta=1.000" in shown
    assert "  MISS b: zzz" in shown
    assert "    ranking_diagnostic: There are no results to order." in shown
    marked = run(capsys, spark, "eval", tmp_path / "cases.json", "--store", tmp_path / "store", "--markdown", "--with-bundles", "--baseline", tmp_path / "old.json")[1]
    assert "## Differences" in marked
    assert "| two | 1 | 0 | 0 | 1 | 0.000 |" in marked
    code, out = run(capsys, spark, "verify", tmp_path / "cases.json", "--store", tmp_path / "other", "--json", "--ingest", tmp_path / "docs", "--smoke", "default value", "--smoke", "zzz", "--without-bundles")
    payload = json.loads(out)
    assert (code, payload["status"], payload["ingest"]["documents"], payload["stats"]["overview"]["documents"]) == (1, "NON_GREEN", 1, 1)
    assert [len(v) > 0 for v in payload["smoke_queries"].values()] == [True, False]


def test_unknown_tokenizers_are_errors():
    with pytest.raises(ValueError, match="no tokenizer"):
        T.tokenizer("other")


def test_worktree(tmp_path):
    assert worktree(str(tmp_path)) == {"is_git_repo": False, "clean": None, "status_lines": [], "commit": None}

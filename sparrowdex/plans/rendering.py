"""Reports of evaluations for people: the same sections as text or as markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import evaluation as E

DIMENSIONS = {"bucket": "Buckets", "expected_source": "Expected sources", "query_style": "Query styles", "concept": "Concepts"}
COUNTS = ("total_queries", "strong_passes", "weak_passes", "misses")
BUNDLES = ("complete", "partial", "insufficient")
#: What is told of a case, and what only with details.
CASE = ("bucket", "query_style", "concept_id", "expected_source_name", "matched_result_rank", "matched_result_path", "matched_result_source_name", "matched_rule_type", "matched_on", "bundle_grade", "bundle_path", "bundle_source_name", "bundle_token_count", "bundle_selection_strategy", "failure_summary")
DETAILS = ("preferred_result_rank", "preferred_result_path", "preferred_source_rank", "ranking_diagnostic", "bundle_diagnostic")


@dataclass
class Section:
    """A title and rows: what each is about, and its fields by name.  ``closing``: only text reports have it."""

    title: str
    rows: list[tuple[str, dict[str, object]]]
    closing: bool = False


def _shown(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.3f}"
    return ", ".join(map(_shown, value)) or "-" if isinstance(value, list | tuple) else str(value)


def sections(report: DataFrame, outcomes: DataFrame | None = None, baseline: DataFrame | None = None, baseline_outcomes: DataFrame | None = None, baseline_path: str | None = None, details: bool = False) -> list[Section]:
    """A report's totals, groups, bundles and confusions, what has changed since the baseline's report, and its cases.

    Everything collected here is a report: as many rows as there are groups and cases.
    """
    rows = {d: sorted((r for r in report.collect() if r.dimension == d), key=lambda r: r.label) for d in ("overall", *DIMENSIONS)} if report is not None else {}
    total = rows["overall"][0] if rows["overall"] else None
    if total is None:
        return [Section("Totals", [(c, {"": 0}) for c in COUNTS])]
    rates = [f"top_{k}_{g}_pass_rate" for k in (1, 3, 5) for g in ("strong", "weak")]
    out = [Section("Totals", [(c, {"": total[c]}) for c in (*COUNTS, *rates)])]
    if total.bundles_evaluated:
        out.append(Section("Bundles", [(c, {"": total[c]}) for g in BUNDLES for c in (g, f"{g}_rate")]))
    if baseline is not None:
        out += _changes(report, baseline, outcomes, baseline_outcomes, baseline_path)
    for d, title in DIMENSIONS.items():
        if rows[d]:
            out.append(Section(title, [(r.label, {c: r[c] for c in (*COUNTS, "top_1_strong_pass_rate")}) for r in rows[d]]))
    if outcomes is None:
        return out
    if total.bundles_evaluated:
        graded = sorted(E.bundle_report(outcomes).collect(), key=lambda r: (r.dimension, r.label))
        for d in ("bucket", "expected_source"):
            out.append(Section(f"Bundles by {d}", [(r.label, {c: r[c] for c in ("total_evaluated", *BUNDLES, "complete_rate")}) for r in graded if r.dimension == d]))
    confused = sorted(E.source_confusions(outcomes).collect(), key=lambda r: r.case_id)
    if confused:
        out.append(Section("Source confusions", [(r.case_id, {c: r[c] for c in ("expected_source_name", "matched_result_source_name", "bundle_source_names", "grade", "bundle_grade")}) for r in confused]))
    cases = sorted(outcomes.collect(), key=lambda r: r.case_id)
    names = [c for c in (*CASE, *(DETAILS if details else ())) if c in outcomes.columns]
    out.append(Section("Cases", [(f"{r.grade} {r.case_id}: {r.query}", {c: r[c] for c in names if r[c] not in (None, [])}) for r in cases], closing=True))
    return out


def _changes(report: DataFrame, baseline: DataFrame, outcomes: DataFrame | None, before: DataFrame | None, path: str | None) -> list[Section]:
    """The verdict on each family of metrics, the overall differences, and the groups and cases that changed."""
    found = sorted(E.comparison(report, baseline).collect(), key=lambda r: (r.dimension, r.label, r.metric_family))
    verdict = {r.metric_family: r.status for r in found if r.dimension == "overall"}
    out = [Section("Baseline", [("baseline", {"": path}), *((f"{k} status", {"": verdict[k]}) for k in ("all", "retrieval", "bundle") if k in verdict)])]
    deltas = sorted(E.metric_deltas(report, baseline).where("dimension = 'overall'").collect(), key=lambda r: (r.metric_family, r.metric))
    out.append(Section("Differences", [(f"{r.metric_family} {r.metric}", {c: r[c] for c in ("current", "baseline", "delta")}) for r in deltas]))
    for family in ("retrieval", "bundle"):
        moved = [(f"{r.dimension} {r.label}", {"status": r.status}) for r in found if r.metric_family == family and r.dimension != "overall" and r.status != "unchanged"]
        if moved:
            out.append(Section(f"Changed groups, {family}", moved))
    if outcomes is not None and before is not None:
        cases = sorted(E.case_changes(outcomes, before).collect(), key=lambda r: r.case_id)
        if cases:
            out.append(Section("Changed cases", [(r.case_id, {c: r[c] for c in ("retrieval_from", "retrieval_to", "bundle_from", "bundle_to")}) for r in cases]))
    return out


def text(parts: list[Section]) -> str:
    """Sections as indented lines; a row without field names is ``name: value``."""
    lines = []
    for s in parts:
        lines.append(f"{s.title}:")
        for label, fields in s.rows:
            if list(fields) == [""]:
                lines.append(f"  {label}: {_shown(fields[''])}")
            elif s.closing:
                lines += [f"  {label}", *(f"    {k}: {_shown(v)}" for k, v in fields.items())]
            else:
                lines.append(f"  {label}: " + " ".join(f"{k}={_shown(v)}" for k, v in fields.items()))
        lines.append("")
    return "\n".join(lines).rstrip("\n")


def markdown(parts: list[Section], title: str = "Evaluation") -> str:
    """Sections as lists of values and tables of groups, without the cases."""
    cell = lambda x: _shown(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}"]
    for s in parts:
        if s.closing or not s.rows:
            continue
        lines += ["", f"## {s.title}", ""]
        names = list(s.rows[0][1])
        if names == [""]:
            lines += [f"- {label}: `{cell(fields[''])}`" for label, fields in s.rows]
        else:
            lines += ["| | " + " | ".join(names) + " |", "|-" * (len(names) + 1) + "|", *("| " + " | ".join([cell(label), *(cell(fields[n]) for n in names)]) + " |" for label, fields in s.rows)]
    return "\n".join(lines)

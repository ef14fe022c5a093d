"""Reports of one plot: collected rows to JSON, Markdown or text. Numbers are rounded here and nowhere else."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import functions as F

from groveline.plans import rules
from groveline.plans.profile import Profile

#: Gaps that Markdown lists; the others are counted.
LISTED = 20
RAMP = " .:-=+*#%@&"


def rounded(value: Any, places: int) -> Any:
    """To ``places``; what isn't finite is absent."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    return round(value, places) if math.isfinite(value) else None


def number(value: Any, places: int = 2) -> str:
    value = rounded(value, places)
    return "n/a" if value is None else str(value) if isinstance(value, (int, str)) else f"{value:.{places}f}"


def compared(a: float, b: float, places: int = 2) -> tuple[str, str]:
    """Both numbers with as many places, 12 at most, as it takes to print unequal ones differently."""
    for k in range(places, 13):
        x, y = f"{a:.{k}f}", f"{b:.{k}f}"
        if a == b or x != y:
            break
    return x, y


@dataclass
class Report:
    """What an inspection of one plot found; a block that is None was not looked at and is left out."""

    plot_id: Any
    area_ha: float
    source: str  # field, detected or none
    findings: list[dict]
    metrics: dict
    profile: Profile = field(default_factory=Profile)
    canopy: dict | None = None
    gaps: list[dict] | None = None
    match: dict | None = None

    def counts(self) -> dict[str, int]:
        return {name: sum(f["severity"] == k for f in self.findings) for k, name in enumerate(rules.SEVERITIES)}

    def worst(self) -> int:
        return max((f["severity"] for f in self.findings), default=rules.INFO)

    def as_dict(self) -> dict:
        findings = [{"code": f["code"], "severity": rules.SEVERITIES[f["severity"]], "title": f["title"], "detail": detail(f), "subject": f["subject"], "value": rounded(f["value"], 4), "threshold": rounded(f["threshold"], 4)} for f in self.findings]
        out = {"plot_id": self.plot_id, "area_ha": rounded(self.area_ha, 4), "metrics_source": self.source, "summary": {"finding_count": len(findings), "max_severity": rules.SEVERITIES[self.worst()], "counts": self.counts()},
               "metrics": {k: rounded(v, 4) for k, v in self.metrics.items()}, "canopy": {k: rounded(v, 4) for k, v in (self.canopy or {}).items()}, "findings": findings, "config": asdict(self.profile)}
        if self.match is not None:
            out["match"] = {k: rounded(v, 4 if k in ("recall", "precision", "f1") else 3) for k, v in self.match.items()}
        if self.gaps is not None:
            out["gaps"] = [{k: rounded(v, 2) for k, v in g.items()} for g in self.gaps]
        return out


def detail(f: dict) -> str:
    if f["value"] is None:
        return f["title"]
    if f["threshold"] is None:
        return f"{f['title']}: {number(f['value'])}"
    value, limit = compared(f["value"], f["threshold"])
    return f"{f['title']}: {value}, limit {limit}"


def to_json(report: Report) -> str:
    return json.dumps(report.as_dict(), indent=2, allow_nan=False, ensure_ascii=False, default=str)


def _cell(text: Any) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def _table(rows: list[tuple], head: tuple) -> list[str]:
    return [f"| {' | '.join(head)} |", f"|{' --- |' * len(head)}", *(f"| {' | '.join(map(_cell, r))} |" for r in rows)]


def findings_table(findings: list[dict]) -> str:
    return "\n".join(_table([(f["code"], rules.SEVERITIES[f["severity"]], f["subject"], detail(f)) for f in findings], ("Code", "Severity", "Subject", "Detail"))) if findings else "No findings."


def to_markdown(report: Report, map_text: str | None = None) -> str:
    out = [f"# Inspection of {report.plot_id}", "", f"Area {number(report.area_ha, 4)} ha; stems: {report.source}.", "", "## Findings", "", findings_table(report.findings), "", "## Stand", ""]
    out += _table([(k, number(v)) for k, v in report.metrics.items()], ("Metric", "Value"))
    if report.canopy:
        out += ["", "## Canopy", "", *_table([(k, number(v, 4)) for k, v in report.canopy.items()], ("Measure", "Value"))]
    if report.gaps is not None:
        out += ["", "## Gaps", "", *_table([(g["gap_id"], number(g["area"]), number(g.get("width")), "yes" if g["touches_edge"] else "no") for g in report.gaps[:LISTED]], ("Gap", "Area", "Width", "Edge"))]
        if len(report.gaps) > LISTED:
            out += ["", f"{len(report.gaps) - LISTED} smaller gaps are not listed."]
    if report.match is not None:
        out += ["", "## Detection against the field", "", *_table([(k, number(v, 3)) for k, v in report.match.items()], ("Measure", "Value"))]
    return "\n".join(out + (["", "## Map", "", "```", map_text, "```"] if map_text else [])) + "\n"


def to_text(report: Report, map_text: str | None = None) -> str:
    counts = ", ".join(f"{n} {k}" for k, n in report.counts().items() if n) or "no findings"
    lines = [f"{report.plot_id}: {counts}", f"area {number(report.area_ha, 4)} ha, stems {report.source}", *(f"{k}: {number(v)}" for k, v in report.metrics.items())]
    lines += [f"[{rules.SEVERITIES[f['severity']]}] {f['code']} {f['subject']}: {detail(f)}" for f in report.findings]
    return "\n".join(lines + ([map_text] if map_text else [])) + "\n"


def collect(ctx: rules.Context, plot_id: Any, source: str = "field") -> Report:
    """The report of one plot of a context."""
    own = lambda df, key="plot_id": [r.asDict() for r in df.filter(F.col(key) == plot_id).collect()]
    area = own(ctx.plots)[0]["area_ha"]
    findings = sorted(own(rules.inspect(ctx)), key=lambda f: (-f["severity"], f["code"], f["subject"]))
    metrics = [{k: v for k, v in m.items() if k not in ("plot_id", "area_ha")} for m in own(ctx.metrics)] if ctx.metrics is not None else []
    canopy = gaps = None
    if ctx.cells is not None and ctx.rasters is not None:
        from groveline.operators import raster

        seen = raster.valid(ctx.cells).filter(F.col("raster_id") == plot_id)
        if not seen.isEmpty():
            canopy = {k: v for r in raster.canopy(seen, ctx.profile.canopy_threshold).collect() for k, v in r.asDict().items() if k != "raster_id"}
            cells = ctx.cells.filter(F.col("raster_id") == plot_id)
            found = raster.gaps(cells, ctx.rasters, ctx.profile.canopy_threshold, ctx.profile.min_gap_area, min_width=ctx.profile.min_gap_width, with_width=True)
            gaps = sorted(({k: v for k, v in r.asDict().items() if k != "raster_id"} for r in found.collect()), key=lambda g: g["gap_id"])
    match = own(ctx.match)[0] if ctx.match is not None and own(ctx.match) else None
    match = {k: v for k, v in match.items() if k != "plot_id"} if match else None
    return Report(plot_id, area, source if metrics else "none", findings, metrics[0] if metrics else {}, ctx.profile, canopy, gaps, match)


def ascii_map(values: list[list[float | None]], width: int = 72, ramp: str = RAMP, markers: dict[tuple[int, int], str] | None = None, aspect: float = 2.0) -> str:
    """Rows of characters, low to high, each the highest of its block of cells; ``markers`` by cell; a legend below."""
    nrows, ncols = len(values), len(values[0])
    if width < 1 or not ramp:
        raise ValueError("a map needs a width and a ramp")
    step = max(1.0, ncols / width)
    tall = step * aspect
    seen = [v for row in values for v in row if v is not None]
    low, high = (min(seen), max(seen)) if seen else (0.0, 0.0)
    lines = []
    for i in range(max(1, math.ceil(nrows / tall))):
        rows = range(int(i * tall), max(int(i * tall) + 1, min(nrows, int((i + 1) * tall))))
        line = ""
        for j in range(max(1, math.ceil(ncols / step))):
            cols = range(int(j * step), max(int(j * step) + 1, min(ncols, int((j + 1) * step))))
            mark = next((markers[r, c] for r in rows for c in cols if (r, c) in markers), None) if markers else None
            block = [values[r][c] for r in rows for c in cols if r < nrows and c < ncols and values[r][c] is not None]
            line += mark or ("?" if not block else ramp[min(len(ramp) - 1, int((max(block) - low) / (high - low) * len(ramp)))] if high > low else ramp[0])
        lines.append(line)
    return "\n".join([*lines, f"{number(low)} {ramp} {number(high)}, ? no data"])


def crown_markers(crowns: list[dict], mark: str = "^") -> dict[tuple[int, int], str]:
    return {(c["top_row"], c["top_col"]): mark for c in crowns}

"""Text and HTML reports from small, already aggregated frames."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

#: rows that a report shows; a longer frame says how many more it has
ROWS = 1000


def table_rows(frame: DataFrame, rows: int = ROWS) -> tuple[list[str], list[tuple], int]:
    """(columns, rows shown, rows not shown); reports are for aggregates, not for data."""
    got = [tuple(r) for r in frame.limit(rows + 1).collect()]
    more = frame.count() - rows if len(got) > rows else 0
    return frame.columns, got[:rows], more


def text_table(frame: DataFrame) -> str:
    columns, rows, more = table_rows(frame)
    cells = [[str(c) for c in columns], *([("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:], *([f"... {more} more rows"] if more else [])])


def html_table(frame: DataFrame, bar: str | None = None) -> str:
    """A table; ``bar`` names a column drawn as bars relative to its largest value."""
    columns, rows, more = table_rows(frame)
    top = max((float(r[columns.index(bar)] or 0) for r in rows), default=0) if bar else 0
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns) + ("<th></th>" if bar else "")
    body = []
    for r in rows:
        cells = "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r)
        if bar:
            share = 100 * float(r[columns.index(bar)] or 0) / top if top else 0
            cells += f'<td><div style="background:#4a7;height:10px;width:{share:.1f}px"></div></td>'
        body.append(f"<tr>{cells}</tr>")
    return f"<table><tr>{head}</tr>{''.join(body)}</table>" + (f"<p>{more} more rows</p>" if more else "")


def html_page(title: str, sections: dict[str, str]) -> str:
    parts = "".join(f"<h2>{html.escape(k)}</h2>{v}" for k, v in sections.items())
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{parts}'


def binned(frame: DataFrame, column: str, bins: int = ROWS) -> DataFrame:
    """Counts or means of a per-position frame in at most ``bins`` steps of equal width (1 for most reads)."""
    from pyspark.sql import functions as F

    top = frame.agg(F.max(column)).first()[0] or 0
    step = top // bins + 1
    if step == 1:
        return frame.orderBy(column)
    sums = [(F.sum if c in ("reads", "count") else F.avg)(c).alias(c) for c in frame.columns if c != column]
    return frame.groupBy((F.floor(F.col(column) / step) * step).alias(column)).agg(*sums).orderBy(column)


def quality_report(reads: DataFrame) -> str:
    """Read quality as one page of eight sections."""
    from ..operators import qc

    seqs, quals = reads.where("seq <> ''"), reads.where("length(qual) > 0")
    return html_page(
        "Read quality",
        {
            "Totals": html_table(qc.totals(reads)),
            "Bases": html_table(qc.base_percent(seqs)),
            "Lengths": html_table(binned(qc.length_histogram(seqs), "length"), "reads"),
            "GC": html_table(qc.gc_histogram(seqs).orderBy("gc"), "reads"),
            "Mean quality": html_table(qc.read_quality(quals).orderBy("mean_quality"), "reads"),
            "Quality by position": html_table(binned(qc.per_base_quality(quals), "position"), "mean"),
            "Frequent sequences": html_table(qc.overrepresented(seqs)),
            "Adapters": html_table(qc.adapter_content(seqs), "pct"),
        },
    )


def samples_report(results: DataFrame) -> str:
    """Many samples on one page: rankings, wins, scores by sample, group and conversion."""
    from ..operators import evaluate

    aligners = sorted(r[0] for r in results.select("aligner").distinct().where("aligner is not null").limit(ROWS).collect())
    good = results.where("aligner is not null")
    return html_page(
        "Samples",
        {
            "Overall": html_table(evaluate.overall_ranking(good).orderBy("rank"), "mean_f1"),
            "Wins": html_table(evaluate.sample_wins(good).orderBy("aligner"), "wins"),
            "Best of each sample": html_table(evaluate.best_per(good, "sample").select("sample", "aligner", "f1_score").orderBy("sample"), "f1_score"),
            "F1 by sample": html_table(evaluate.pivot_scores(good, aligners).orderBy("sample")),
            "By group": html_table(evaluate.rank_by(good, "grp").orderBy("grp", "rank"), "mean_f1"),
            "By conversion": html_table(evaluate.rank_by(good, "conversion").orderBy("conversion", "rank"), "mean_f1"),
            "All results": html_table(results.orderBy("sample", "aligner")),
        },
    )

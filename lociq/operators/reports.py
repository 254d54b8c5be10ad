"""Reports of small aggregated tables: text, JSON, CSV or HTML."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a report takes; it is for aggregates, and a longer table is an error, not cut.
LONGEST = 10_000


class Report:
    """Sections, each a table of a title."""

    def __init__(self, title: str) -> None:
        self.title = title
        self.sections: list[tuple[str, list[str], list[tuple]]] = []

    def add(self, name: str, rows: DataFrame) -> Report:
        found = rows.limit(LONGEST + 1).collect()
        if len(found) > LONGEST:
            raise ValueError(f"{name} has over {LONGEST} rows; aggregate it first")
        self.sections.append((name, rows.columns, [tuple(r) for r in found]))
        return self

    def render(self, form: str = "text") -> str:
        return {"text": self._text, "json": self._json, "csv": self._csv, "html": self._html}[form]()

    def _text(self) -> str:
        out = [self.title, "=" * len(self.title)]
        for name, columns, rows in self.sections:
            cells = [columns, *([str(v) for v in row] for row in rows)]
            widths = [max(len(c[k]) for c in cells) for k in range(len(columns))]
            out += ["", name, "-" * len(name), *("  ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip() for row in cells)]
        return "\n".join(out)

    def _json(self) -> str:
        return json.dumps({"title": self.title, "sections": {n: [dict(zip(c, r)) for r in rows] for n, c, rows in self.sections}}, default=str)

    def _csv(self) -> str:
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        for name, columns, rows in self.sections:
            writer.writerow(["section", *columns])
            writer.writerows([name, *row] for row in rows)
        return out.getvalue()

    def _html(self) -> str:
        cell = lambda tag, v: f"<{tag}>{html.escape(str(v))}</{tag}>"
        row = lambda tag, values: "<tr>" + "".join(cell(tag, v) for v in values) + "</tr>"
        tables = "".join(f"<h2>{html.escape(n)}</h2><table>{row('th', c)}{''.join(row('td', r) for r in rows)}</table>" for n, c, rows in self.sections)
        return f"<h1>{html.escape(self.title)}</h1>{tables}"


def bars(counts: DataFrame, label: str, n: str, width: int = 40) -> DataFrame:
    """Rows (label, bar): a bar of # for each count of a small table, the largest ``width`` long."""
    sized = counts.withColumn("_most", F.greatest(F.max(n).over(Window.partitionBy(F.lit(1))), F.lit(1)))
    return sized.select(label, F.repeat(F.lit("#"), F.expr(f"cast({n} * {width} div _most as int)")).alias("bar"))


def tree_lines(places: DataFrame, depth: str, name: str, n: str) -> DataFrame:
    """Rows (line): each node after two spaces for each step below the root, with its count."""
    return places.select(F.concat(F.repeat(F.lit("  "), F.col(depth).cast("int")), F.col(name), F.lit(" ("), F.col(n).cast("string"), F.lit(")")).alias("line"))

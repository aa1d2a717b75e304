"""Report and bill-of-materials sinks. Rows are written by Spark; only aggregated reports are rendered on the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 1000


def write_components(components: DataFrame, path: str) -> None:
    """JSON lines of components(component), written by every task."""
    components.select(F.col("component").alias("value")).write.mode("overwrite").text(path)


def write_bill_of_materials(components: DataFrame, project: str, path: str) -> None:
    """A CycloneDX 1.5 document in two parts, each JSON lines: header (one line) and components (one a component, written by every task).

    Joined as header + components they are the document; no task holds it whole.
    """
    spark = components.sparkSession
    head = {"bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "metadata": {"component": {"type": "application", "name": project}}}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    write_components(components, f"{path}/components")


def report(tables: dict[str, DataFrame], top: int = 25) -> dict[str, str]:
    """json, md and html of named result tables, of each the first `top` rows as it is ordered (at most REPORT_ROWS)."""
    top = min(max(top, 1), REPORT_ROWS)
    data = {name: (df.columns, [tuple(r) for r in df.limit(top).collect()]) for name, df in tables.items()}
    as_json = json.dumps({n: [dict(zip(c, r, strict=True)) for r in rows] for n, (c, rows) in data.items()}, default=str, ensure_ascii=False, indent=1)
    md, page = [], []
    for name, (cols, rows) in data.items():
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
        md += [f"## {name}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""]
        head = "".join(f"<th>{html.escape(c)}</th>" for c in cols)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        page.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return {"json": as_json, "md": "\n".join(md), "html": "<!doctype html><meta charset=utf-8>" + "".join(page)}

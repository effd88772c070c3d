"""Sinks: Parquet, tables, CSV with a header even when empty, JSON, reports, lead packages, keyed state."""

from __future__ import annotations

import html
import json
import shutil
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    """CSV parts with a header; an empty frame writes a part that is the header alone."""
    out = df.select(*columns) if columns else df
    if out.isEmpty():
        header = ",".join(out.columns)
        out.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        out.write.mode("overwrite").option("header", True).csv(path)


def write_json(value: Mapping | Sequence, path: str) -> None:
    """A small driver-side document: sorted keys, two blanks of indent."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2, default=str) + "\n")


def summary(df: DataFrame) -> dict:
    """The single row of an aggregate as a dictionary."""
    row = df.limit(1).collect()
    return row[0].asDict(recursive=True) if row else {}


def lead_packages(parts: Mapping[str, DataFrame], leads: DataFrame, root: str, levels: Sequence[str] = ("HIGH", "CRITICAL")) -> None:
    """Each part's rows of the leads of these levels, in folders by lead: ``root/part/lead_id=...``."""
    chosen = leads.where(F.col("priority_level").isin(*levels)).select("lead_id").distinct()
    for name, frame in parts.items():
        frame.join(chosen, "lead_id", "left_semi").repartition("lead_id").write.mode("overwrite").partitionBy("lead_id").option("header", True).csv(f"{root}/{name}")


def report(df: DataFrame, order: Sequence, n: int = 25, title: str = "Leads") -> dict[str, str]:
    """The first ``n`` rows as JSON, Markdown and HTML text."""
    rows = [{k: v for k, v in r.asDict().items()} for r in df.orderBy(*order).limit(n).collect()]
    head = df.columns
    cell = lambda v: "" if v is None else str(v)
    md = [f"# {title}", "", "| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    md += ["| " + " | ".join(cell(r[c]).replace("|", "\\|").replace("\n", " ") for c in head) + " |" for r in rows]
    table = "".join("<tr>" + "".join(f"<td>{html.escape(cell(r[c]))}</td>" for c in head) + "</tr>" for r in rows)
    page = f"<h1>{html.escape(title)}</h1><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in head)}</tr>{table}</table>"
    return {"json": json.dumps(rows, indent=2, sort_keys=True, default=str), "md": "\n".join(md) + "\n", "html": page}


def reset(root: str, names: Sequence[str]) -> list[str]:
    """Removes the named files and folders under ``root``; names that lead out of it are refused."""
    base, gone = Path(root).resolve(), []
    for name in names:
        path = (base / name).resolve()
        if base not in path.parents:
            raise ValueError(f"outside the workspace: {name}")
        if path.is_dir():
            shutil.rmtree(path)
            gone.append(name)
        elif path.exists():
            path.unlink()
            gone.append(name)
    return gone


def first_filled_frame(*frames: DataFrame) -> DataFrame:
    """The first frame that has rows, or the last."""
    return next((f for f in frames[:-1] if not f.isEmpty()), frames[-1])

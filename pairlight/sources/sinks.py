"""Writing results: CSV, JSON lines, JSON documents, Markdown, figures, run logs."""

from __future__ import annotations

import csv
import json
import logging
import shutil
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tables up to this size become one local file.
ONE_FILE_BYTES = 1 << 30


def out_path(path: str | Path, root: str | Path | None = None) -> Path:
    """The path, taken from ``root`` where relative, with its folder made."""
    p = Path(path)
    p = p if p.is_absolute() or root is None else Path(root) / p
    p.parent.mkdir(parents=True, exist_ok=True)
    return p


def _cell(v: Any) -> Any:
    if v is None:
        return ""
    return json.dumps(v) if isinstance(v, list | dict) else v


def write_csv(df: DataFrame, path: str | Path, columns: Sequence[str] | None = None) -> Path:
    """One CSV file: columns in name order, or in the given order. No rows and no order: one bare newline.

    Rows pass through the driver one partition at a time, so the file may be larger than its memory; see ``write_parts``
    for tables that should be written by the executors.
    """
    p = out_path(path)
    names = list(columns or sorted(df.columns))
    rows = df.select(*names).toLocalIterator()
    first = next(rows, None)
    with p.open("w", newline="", encoding="utf-8") as f:
        if first is None and columns is None:
            f.write("\n")
            return p
        w = csv.writer(f, lineterminator="\n")
        w.writerow(names)
        if first is not None:
            w.writerow([_cell(v) for v in first])
            w.writerows([_cell(v) for v in r] for r in rows)
    return p


def write_parts(df: DataFrame, path: str, kind: str = "parquet", columns: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> str:
    """A folder of files, written by the executors: parquet, csv (with header) or json."""
    rows = df.select(*columns) if columns else df
    writer = rows.write.mode("overwrite").partitionBy(*partition_by) if partition_by else rows.write.mode("overwrite")
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).format(kind).save(path)
    return path


def write_rows(df: DataFrame, path: str | Path, kind: str = "csv", columns: Sequence[str] | None = None) -> str:
    """A table with a row per pair, result or trajectory, under one file name: the executors write a folder of parts, which
    are joined into the file where the storage is local and the whole is at most ``ONE_FILE_BYTES``. A larger table, or one
    on shared storage, stays the folder of parts, which all readers take as well. Columns as in ``write_csv``."""
    p = out_path(path) if "://" not in str(path) else str(path)
    names = list(columns or (sorted(df.columns) if kind == "csv" else df.columns))
    rows = df.select(*names)
    if kind == "json":
        rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{p}.parts")
    else:
        rows.select(*[(F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c)).alias(c) for c, t in rows.dtypes]).write.mode("overwrite").option("escape", '"').csv(f"{p}.parts")
    parts = sorted(Path(f"{p}.parts").glob("part-*")) if isinstance(p, Path) else []
    if not parts or sum(f.stat().st_size for f in parts) > ONE_FILE_BYTES:
        return f"{p}.parts"
    with p.open("wb") as out:
        if kind == "csv":
            out.write((",".join(names) + "\n").encode())
        for f in parts:
            with f.open("rb") as part:
                shutil.copyfileobj(part, out)
    shutil.rmtree(f"{p}.parts")
    return str(p)


def write_jsonl(df: DataFrame, path: str | Path) -> Path:
    """One object a line, keys in column order, nulls kept."""
    p = out_path(path)
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")
    with p.open("w", encoding="utf-8") as f:
        for r in df.select(line).toLocalIterator():
            f.write(r.line + "\n")
    return p


def write_json(value: Any, path: str | Path) -> Path:
    p = out_path(path)
    p.write_text(json.dumps(value, indent=2, default=str) + "\n", encoding="utf-8")
    return p


def write_text(lines: Sequence[str], path: str | Path) -> Path:
    p = out_path(path)
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return p


def markdown_table(rows: Sequence[dict], columns: Sequence[str], digits: int = 3) -> list[str]:
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else ("yes" if v else "no") if isinstance(v, bool) else "" if v is None else str(v)
    return [f"| {' | '.join(columns)} |", f"|{'|'.join(' --- ' for _ in columns)}|", *[f"| {' | '.join(show(r.get(c)) for c in columns)} |" for r in rows]]


def bar_figure(rows: Sequence[dict], label: str, series: Sequence[str], title: str, path: str | Path) -> Path | None:
    """Grouped bars over a small summary; None where matplotlib is not installed. Missing values are drawn as 0."""
    try:
        import matplotlib
    except ImportError:
        return None
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    p = out_path(path)
    fig, ax = plt.subplots(figsize=(max(6, 0.5 * len(rows)), 4))
    width = 0.8 / max(1, len(series))
    for k, s in enumerate(series):
        ax.bar([i + k * width for i in range(len(rows))], [float(r.get(s) or 0.0) for r in rows], width, label=s)
    ax.set_xticks(range(len(rows)), [str(r[label]) for r in rows], rotation=60, ha="right")
    ax.set_title(title)
    ax.legend()
    fig.tight_layout()
    fig.savefig(p, dpi=160)
    plt.close(fig)
    return p


def run_log(path: str | Path, level: int = logging.INFO) -> logging.Logger:
    """The root logger, to the console and a file."""
    p = out_path(path)
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=[logging.StreamHandler(), logging.FileHandler(p, encoding="utf-8")], force=True)
    return logging.getLogger("pairlight")


def rows_of(df: DataFrame, limit: int = 100_000) -> list[dict]:
    """A summary's rows on the driver; a table beyond ``limit`` rows is refused instead of gathered."""
    got = df.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows are no summary")
    return [r.asDict(recursive=True) for r in got]

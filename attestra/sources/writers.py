"""Sinks: JSONL, reports, appends and an atomic multi-table commit."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_line(df: DataFrame, ordered: bool = False):
    """A row as JSON with nulls kept: keys sorted, or in column order."""
    names = [c for c in df.columns if c != "seq"]
    return F.to_json(F.struct(*(names if ordered else sorted(names))), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, ordered: bool = False, mode: str = "overwrite") -> None:
    """Rows as JSON lines, in the frame's order within each part file."""
    df.select(json_line(df, ordered).alias("value")).write.mode(mode).text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def write_report(report: dict[str, Any], path: str | Path) -> None:
    """One small report, indented and sorted."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def write_dataset(tables: dict[str, DataFrame], directory: str) -> None:
    """A built knowledge graph: entities by id, the rest in build order, a part file each."""
    for name, df in tables.items():
        order = "id" if name == "entities" else "seq"
        write_jsonl(df.orderBy(order).coalesce(1), f"{directory}/{name}.jsonl")


def commit(tables: dict[str, DataFrame], reports: dict[str, dict], target: str, check: Callable[[dict[str, DataFrame]], None], order: dict[str, list[str]]) -> None:
    """All or nothing: write beside the target, read back, check, count, rename; a non-empty target is refused."""
    goal = Path(target)
    if goal.exists() and any(goal.iterdir()):
        raise FileExistsError(f"{target} is not empty")
    goal.parent.mkdir(parents=True, exist_ok=True)
    stage = goal.parent / f".{goal.name}.{uuid.uuid4().hex}"
    try:
        back = {}
        for name, df in tables.items():
            write_jsonl(df.orderBy(*order[name]).drop(*[c for c in order[name] if c.startswith("_")]).coalesce(1), f"{stage}/{name}.jsonl", ordered=True)
            plain = df.drop(*[c for c in order[name] if c.startswith("_")])
            lines = df.sparkSession.read.text(f"{stage}/{name}.jsonl")
            back[name] = lines.select(F.from_json("value", plain.schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
            if lines.count() != df.count():
                raise ValueError(f"{name}: rows differ after reading back")
        check(back)
        for name, report in reports.items():
            write_report(report, stage / f"{name}.json")
        if goal.exists():
            goal.rmdir()
        stage.rename(goal)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def reset(paths: list[str | Path]) -> None:
    """Delete the outputs of an earlier incremental run."""
    for p in map(Path, paths):
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)

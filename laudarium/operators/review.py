"""Reviewing sections: neighbours, previews, jumps; decisions as a log with undo and redo."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import yaml_of
from .decisions import CONTEXT


def near(sections: DataFrame, current: int, reach: int = 4) -> DataFrame:
    """Sections at most `reach` places from the current one."""
    return sections.where(F.abs(F.col("section_n") - current) <= reach).orderBy("section_n")


def preview(sections: DataFrame, text: str = "text", size: int = 40, first: int | None = None) -> DataFrame:
    """Paragraphs cut to their first characters; with first only so many of each section."""
    rows = sections
    if first is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("edition", "section_n").orderBy("page_n", "par_n"))).where(F.col("_k") <= first).drop("_k")
    return rows.withColumn(text, F.substring(text, 1, size))


def document_step(sections: DataFrame, current: int, forward: bool = True) -> DataFrame:
    """One row: the next (or previous) document after the current section; none at the end."""
    side = F.col("section_n") > current if forward else F.col("section_n") < current
    return sections.where(side & (F.col("section_type") == "document")).orderBy(F.asc("section_n") if forward else F.desc("section_n")).limit(1)


@dataclass
class DecisionLog:
    """Decisions in order; undo takes the last back, redo brings it again until something new is said."""

    done: list[dict] = field(default_factory=list)
    undone: list[dict] = field(default_factory=list)

    def add(self, **decision) -> dict:
        self.done.append({k: v for k, v in decision.items() if v is not None})
        self.undone.clear()
        return self.done[-1]

    def pertinence(self, title: str, page: int, status: bool) -> dict:
        return self.add(decision_type="pertinence", pagenum=page, from_title=title, pertinence_status=status)

    def date(self, title: str, page: int, day: int, month: int, year: int) -> dict:
        return self.add(decision_type="date", pagenum=page, from_title=title, date=[day, month, year])

    def kind(self, title: str, page: int, section_type: str) -> dict:
        if section_type not in ("document", "meta"):
            raise ValueError(f"unknown section type {section_type}")
        return self.add(decision_type="type", pagenum=page, from_title=title, section_type=section_type)

    def title(self, title: str, page: int, to_title: str) -> dict:
        return self.add(decision_type="title_form", pagenum=page, from_title=title, to_title=to_title)

    def merge(self, title: str, page: int, preceding: str, following: str) -> dict:
        return self.add(decision_type="merge_sections", pagenum=page, from_title=title, preceding_fragm=preceding[-CONTEXT:], following_fragm=following[:CONTEXT])

    def split(self, page: int, following: str, section_type: str) -> dict:
        if section_type not in ("document", "meta"):
            raise ValueError(f"unknown section type {section_type}")
        return self.add(decision_type="split_sections", pagenum=page, following_fragm=following[:CONTEXT], new_section_type=section_type)

    def undo(self) -> dict | None:
        if not self.done:
            return None
        self.undone.append(self.done.pop())
        return self.undone[-1]

    def redo(self) -> dict | None:
        if not self.undone:
            return None
        self.done.append(self.undone.pop())
        return self.done[-1]

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(yaml_of(self.done) if path.endswith((".yaml", ".yml")) else json.dumps(self.done, ensure_ascii=False, indent=1))

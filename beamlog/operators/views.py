"""Saved queries, dashboards and the shapes their panels take."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.language import Query, QueryError, parse, to_json

MAX_PANELS, CHART_POINTS, CELL_CHARS = 16, 48, 256


@dataclass(frozen=True)
class SavedQuery:
    """Text and AST that must agree; ``revision`` guards against lost updates."""

    id: str
    text: str
    ast: dict
    revision: int = 1

    @staticmethod
    def of(id: str, text: str) -> SavedQuery:
        return SavedQuery(id, text, to_json(parse(text)))

    def query(self) -> Query:
        parsed = parse(self.text)
        if to_json(parsed) != self.ast:
            raise QueryError("text and AST differ")
        return parsed

    def changed(self, text: str, revision: int) -> SavedQuery:
        if revision != self.revision:
            raise ValueError(f"revision {self.revision} is current, not {revision}")
        return SavedQuery(self.id, text, to_json(parse(text)), revision + 1)


@dataclass(frozen=True)
class Panel:
    query_id: str
    presentation: str = "table"


@dataclass(frozen=True)
class Dashboard:
    id: str
    title: str
    panels: tuple[Panel, ...] = field(default_factory=tuple)

    def check(self, saved: dict[str, SavedQuery]) -> None:
        if len(self.panels) > MAX_PANELS:
            raise ValueError(f"{MAX_PANELS} panels at most")
        for p in self.panels:
            query = saved[p.query_id].query()
            if p.presentation not in ("table", "stat", "timeseries"):
                raise ValueError(f"unknown presentation: {p.presentation}")
            if p.presentation == "stat" and not query.summary or p.presentation == "timeseries" and not (query.summary and query.summary.bucket):
                raise ValueError(f"{p.presentation} needs a summary" + (" by window" if p.presentation == "timeseries" else ""))


def export_bundle(dashboards: list[Dashboard], saved: dict[str, SavedQuery]) -> str:
    used = {p.query_id for d in dashboards for p in d.panels}
    return json.dumps({"version": 1, "queries": [asdict(saved[k]) for k in sorted(used)], "dashboards": [asdict(d) for d in dashboards]}, sort_keys=True)


def import_bundle(text: str) -> tuple[list[Dashboard], dict[str, SavedQuery]]:
    data = json.loads(text)
    if data.get("version") != 1:
        raise ValueError("unknown bundle version")
    saved = {q["id"]: SavedQuery(**q) for q in data["queries"]}
    dashboards = [Dashboard(d["id"], d["title"], tuple(Panel(**p) for p in d["panels"])) for d in data["dashboards"]]
    for d in dashboards:
        d.check(saved)
    return dashboards, saved


def chart_points(ranked: DataFrame) -> DataFrame:
    """Up to 48 points of a ranked result: the last column's finite non-negative numbers, labelled by the others."""
    *labels, value = [c for c in ranked.columns if c != "rank"]
    y = F.col(f"`{value}`").cast("double")
    usable = ranked.where((y >= 0) & (y < float("inf")))
    point = usable.select("rank", F.concat_ws(" / ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in labels]).alias("label"), y.alias("y"))
    return point.withColumn("point", F.row_number().over(Window.orderBy("rank")).cast("bigint")).where(F.col("point") <= CHART_POINTS).select("point", "label", "y")


def stat_cell(ranked: DataFrame) -> DataFrame:
    """The first value that is not null, row by row and column by column; at most CELL_CHARS characters of it."""
    columns = [c for c in ranked.columns if c != "rank"]
    cell = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns])
    return ranked.where(cell.isNotNull()).orderBy("rank").limit(1).select(F.left(cell, F.lit(CELL_CHARS)).alias("cell"))

"""Context-aware parameter extraction: groups of patterns in a fixed order, matches that may not overlap, words that must or must not be near.

Which match is taken depends on those taken before it, so a text is read in order: a table function over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D

N = r"(\d+(?:[.,]\d+)?)"
SHAPE = "name string, kind string, value string, unit string, confidence double, start int, stop int, raw string"


@dataclass(frozen=True)
class Group:
    """A parameter's patterns. One of `context` must stand within 100 signs, none of `exclude` within 50."""

    name: str
    patterns: tuple[str, ...]
    unit: str
    priority: int
    context: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    kind: str = ""
    compiled: tuple = field(default=(), compare=False)

    def ready(self) -> Group:
        return Group(self.name, self.patterns, self.unit, self.priority, self.context, self.exclude, self.kind or self.name, tuple(re.compile(p, re.IGNORECASE) for p in self.patterns))


def measured(label: str, units: str, labelled: str = "", behind: bool = True) -> tuple[str, ...]:
    """A number with a unit, after a label, and before one."""
    near = labelled or units
    return (rf"{N}\s*(?:{units})", rf"{label}\s*{N}\s*(?:{near})", *((rf"{N}\s*(?:{near})\s*{label}",) if behind else ()))


#: The groups in the order in which they claim text.
GROUPS = (
    Group("dimensions", (rf"{N}\s*[хx×]\s*{N}\s*[хx×]?\s*{N}?\s*(?:мм|mm|см|cm|м|m)", rf"размер[ы]?\s*{N}\s*[хx×]\s*{N}", rf"габарит[ы]?\s*{N}\s*[хx×]\s*{N}"), "мм", 3, ("размер", "габарит", "длина", "ширина", "высота"), kind="dimension"),
    Group("diameter", (rf"[DdØ]\s*{N}\s*(?:мм|mm)", rf"диаметр\s*{N}\s*(?:мм|mm)", rf"[Ø]\s*{N}", rf"ф\s*{N}\s*(?:мм|mm)"), "мм", 3),
    Group("length", (rf"длина\s*{N}\s*(?:мм|mm|см|cm|м|m)", rf"L\s*{N}\s*(?:мм|mm)", rf"длин[аы]\s*{N}"), "мм", 2),
    Group("width", (rf"ширина\s*{N}\s*(?:мм|mm|см|cm)", rf"шир[инаы]\s*{N}"), "мм", 2),
    Group("height", (rf"высота\s*{N}\s*(?:мм|mm|см|cm)", rf"выс[отаы]\s*{N}"), "мм", 2),
    Group("weight", (rf"{N}\s*(?:кг|kg|г|g|т|t)", rf"вес\s*{N}\s*(?:кг|kg|г|g)", rf"масса\s*{N}\s*(?:кг|kg|г|g)", rf"{N}\s*(?:кг|kg|г|g)\s*вес"), "кг", 3, ("вес", "масса", "тяжелый", "легкий")),
    Group("volume", (rf"{N}\s*(?:л|l|мл|ml|дм3|dm3|см3|cm3)", rf"объем\s*{N}\s*(?:л|l|мл|ml)", rf"емкость\s*{N}\s*(?:л|l|мл|ml)", rf"{N}\s*(?:л|l|мл|ml)\s*объем"), "л", 3, ("объем", "емкость", "вместимость")),
    Group("capacity", measured("емкость", "Ач|Ah|мАч|mAh|Втч|Wh", "Ач|Ah|мАч|mAh"), "Ач", 3, ("емкость", "аккумулятор", "батарея")),
    Group("voltage", measured("напряжение", "В|V|кВ|kV", "В|V"), "В", 3, ("напряжение", "вольт", "электрический")),
    Group("current", measured("ток", "А|A|мА|mA|кА|kA", "А|A"), "А", 3, ("ток", "ампер", "электрический")),
    Group("power", (rf"{N}\s*(?:Вт|W|кВт|kW|МВт|MW)", rf"мощность\s*{N}\s*(?:Вт|W)", rf"{N}\s*(?:Вт|W|кВт|kW)\s*мощность"), "Вт", 3, ("мощность", "ватт", "энергия")),
    Group("frequency", measured("частота", "Гц|Hz|кГц|kHz|МГц|MHz", "Гц|Hz"), "Гц", 2, ("частота", "герц", "радио")),
    Group("pressure", measured("давление", "бар|bar|Па|Pa|кПа|kPa|МПа|MPa|атм|atm", "бар|bar"), "бар", 3, ("давление", "бар", "паскаль")),
    Group("force", measured("сила", "Н|N|кН|kN|МН|MN", "Н|N", behind=False), "Н", 2, ("сила", "ньютон", "тяга")),
    Group("temperature", (*measured("температура", "°C|°F|К|K|градус", "°C|°F"), rf"до\s*[-\-]?{N}\s*(?:°C|°F)", rf"от\s*{N}\s*(?:°C|°F)"), "°C", 2, ("температура", "градус", "мороз", "жара")),
    Group("thread", (rf"[Мм]\s*{N}\s*[хx×]\s*{N}", rf"резьба\s*[Мм]\s*{N}", rf"болт\s*[Мм]\s*{N}", rf"гайка\s*[Мм]\s*{N}"), "мм", 3, ("резьба", "болт", "гайка", "винт", "крепеж")),
    Group("protection", (r"IP\s*(\d{2})",), "IP", 3, ("защита", "пыль", "влага", "водонепроницаемый")),
    Group("gost", (r"ГОСТ\s*(\d+(?:[-\d]*)?)",), "ГОСТ", 4, ("ГОСТ", "стандарт", "норма", "требование")),
    Group("standard", tuple(rf"{s}\s*(\d+(?:[-\d]*)?)" for s in ("ISO", "EN", "DIN", "ANSI")), "стандарт", 3, ("стандарт", "норма", "требование")),
    Group("quantity", tuple(rf"{N}\s*(?:{u})" for u in ("шт|pcs|штук|piece", "уп|pack|упаковка", "компл|set|набор", "пара|pair", "м|meter|метр")), "шт", 2, ("количество", "штук", "упаковка", "набор")),
    Group("color", (r"(?:цвет|color)\s*([а-яё\w\s]+?)(?:\s|,|$)", r"([а-яё\w\s]+?)\s*(?:цвет|color)", r"(?:окраска|окрашен)\s*([а-яё\w\s]+?)(?:\s|,|$)"), "цвет", 1, ("цвет", "окраска", "краска", "отделка")),
)


def read(text: str, groups: tuple[Group, ...]) -> Iterator[tuple]:
    """The parameters of a text, then its materials, brands and functions, in the order in which they are found."""
    low, taken = text.lower(), []
    for g in groups:
        for pattern in g.compiled:
            for m in pattern.finditer(text):
                a, b = m.span()
                if any(a < y and x < b for x, y in taken):
                    continue
                near = low[max(0, a - 50) : b + 50]
                if any(w.lower() in near for w in g.exclude):
                    continue
                if g.context and not any(w.lower() in low[max(0, a - 100) : b + 100] for w in g.context):
                    continue
                values = [v.replace(",", ".").strip() for v in m.groups() if v]
                if not values:
                    continue
                hits = sum(w.lower() in near for w in g.context)
                yield g.name, g.kind, "x".join(values), g.unit, round(min(1.0, 0.6 + 0.1 * g.priority + 0.1 * hits), 6), a, b, m.group(0)
                taken.append((a, b))
    for kind, table, sure in (("material", D.MATERIAL_WORDS, 0.8), ("function", D.FUNCTION_WORDS, 0.7)):
        for value, words in table.items():
            if word := next((w for w in words if w in low), None):
                yield kind, kind, value, "", sure, low.find(word), low.find(word) + len(word), word
    for brand in D.KNOWN_BRANDS:
        if brand in low:
            yield "brand", "brand", brand, "", 0.9, low.find(brand), low.find(brand) + len(brand), brand


def extracted(df: DataFrame, id_col: str, text_col: str, groups: tuple[Group, ...] = GROUPS) -> DataFrame:
    """(id, name, kind, value, unit, confidence, start, stop, raw) for each parameter; several numbers of a match are joined by 'x'. Texts
    that are null have none. Confidence is .5 + .1 of the priority + .1 for each context word within 50 signs + .1 for a value, at most 1."""

    def run(batches):
        ready = tuple(g.ready() for g in groups)
        for b in batches:
            rows = [(i, *p) for i, t in zip(b["id"], b["text"], strict=True) if t for p in read(t, ready)]
            yield pd.DataFrame(rows, columns=["id", "name", "kind", "value", "unit", "confidence", "start", "stop", "raw"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, {SHAPE}")


def to_json(params: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, json): each item's parameters as a JSON array of objects, in the order of their place."""
    one = F.struct("start", "name", "kind", "value", "unit", "confidence", "stop", "raw")
    return params.groupBy(id_col).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))


def from_json(stored: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows that to_json was given."""
    parsed = stored.select(id_col, F.explode(F.from_json("json", f"array<struct<{SHAPE.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>")).alias("p"))
    return parsed.select(id_col, "p.*")


def with_parameters(df: DataFrame, id_col: str, text_col: str, out_col: str = "parameters") -> DataFrame:
    """df with an array of (name, value, unit, confidence), empty where nothing is found."""
    listed = extracted(df, id_col, text_col).groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "name", "value", "unit", "confidence"))).alias(out_col))
    empty = F.array().cast("array<struct<start:int,name:string,value:string,unit:string,confidence:double>>")
    return df.drop(out_col).join(listed, F.col(id_col) == F.col("_id"), "left").drop("_id").withColumn(out_col, F.coalesce(out_col, empty))

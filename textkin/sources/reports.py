"""Reports of search results (qid, id, score, rank): frames of figures, and their JSON, CSV, HTML and workbook forms."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workbook

LABELS = (("excellent", 0.8), ("good", 0.6), ("fair", 0.4))
#: The best and worst so many queries, and so many results of a query, are shown.
SHOWN, DETAIL = 10, 20


def frames(results: DataFrame, queries: DataFrame | None = None) -> dict[str, DataFrame]:
    """summary, statistics, by_rank, by_query, best, worst and detail; with queries(qid), also those without results."""
    s = F.col("score")
    label = F.when(s >= LABELS[0][1], LABELS[0][0]).when(s >= LABELS[1][1], LABELS[1][0]).when(s >= LABELS[2][1], LABELS[2][0]).otherwise("poor")
    by_query = results.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.avg("score").alias("mean"), F.max_by("id", F.struct(s, -F.col("rank"))).alias("best_id"))
    out = {
        "summary": results.agg(F.count("*").alias("n"), F.countDistinct("qid").alias("queries"), F.avg("score").alias("mean"), F.max("score").alias("most"), F.min("score").alias("least"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.5) & (s < 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low")),
        "statistics": results.agg(F.avg("score").alias("mean"), F.percentile("score", 0.5).alias("median"), F.stddev_samp("score").alias("std"), F.percentile("score", 0.25).alias("q25"), F.percentile("score", 0.75).alias("q75")),
        "by_rank": results.groupBy("rank").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).orderBy("rank"),
        "by_query": by_query,
        "best": by_query.orderBy(F.col("mean").desc(), "qid").limit(SHOWN),
        "worst": by_query.orderBy("mean", "qid").limit(SHOWN),
        "detail": results.where(F.col("rank") <= DETAIL).withColumn("label", label),
    }
    if queries is not None:
        out["without_results"] = queries.select("qid").join(results, "qid", "left_anti")
    return out


SMALL = ("summary", "statistics", "best", "worst")


def write_json(report: dict[str, DataFrame], path: str) -> None:
    """Each frame as a folder of JSON lines under path."""
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_csv(report: dict[str, DataFrame], path: str, names: tuple[str, ...] = ("summary", "by_query")) -> None:
    for name in names:
        report[name].write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def as_html(report: dict[str, DataFrame], title: str = "Search report") -> str:
    """The frames of fixed size as one page."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name in SMALL:
        df = report[name]
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.4f}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{rows}</table>")
    return "\n".join(parts)


def as_json(report: dict[str, DataFrame]) -> str:
    return json.dumps({n: [r.asDict() for r in report[n].collect()] for n in SMALL}, ensure_ascii=False, default=str)


def write_workbook(report: dict[str, DataFrame], path: str, most: int = workbook.MOST, metadata: dict[str, str] | None = None) -> None:
    """Results, figures and metadata as sheets."""
    spark = report["summary"].sparkSession
    sheets = {n: report[n] for n in ("detail", "summary", "statistics", "by_rank")}
    if metadata:
        sheets["metadata"] = spark.createDataFrame(sorted(metadata.items()), "key string, value string")
    workbook.write(sheets, path, most, "score")

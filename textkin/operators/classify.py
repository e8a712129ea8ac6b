"""Rule-based categories: shares of keywords and patterns found in a text. The rules are data and can be replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D

#: Scores this near the greatest one count as equal; the category of the smallest priority number then wins.
BAND, LEAST = 0.1, 0.01
#: Words that make a category nearly sure, and how sure.
SURE = {"средства_защиты": (("ледоход", "шипы", "противоскользящ"), 0.95), "химия": (("сольвент", "растворитель"), 0.9), "металлопрокат": (("швеллер", "уголок", "балка"), 0.9)}


class Rules:
    """Keywords (found anywhere in the lower-case text), patterns and priorities of categories."""

    def __init__(self, keywords=None, patterns=None, priority=None, default: str = D.DEFAULT_CATEGORY):
        self.keywords = {k: tuple(dict.fromkeys(v)) for k, v in (D.CATEGORY_KEYWORDS if keywords is None else keywords).items()}
        self.patterns = dict(D.CATEGORY_PATTERNS if patterns is None else patterns)
        self.priority = dict(D.CATEGORY_PRIORITY if priority is None else priority)
        self.default = default

    def with_keywords(self, category: str, words) -> Rules:
        return Rules(self.keywords | {category: (*self.keywords.get(category, ()), *words)}, self.patterns, self.priority, self.default)

    def hits(self, text: Column, category: str) -> Column:
        """The category's keywords that the text holds, in their order."""
        return F.filter(F.array(*map(F.lit, self.keywords[category])), lambda w: F.contains(text, w))

    def share(self, text: Column, category: str) -> Column:
        return F.size(self.hits(text, category)) / len(self.keywords[category])

    def score(self, text: Column, category: str) -> Column:
        """.7 of the share of keywords + .3 of the share of patterns found."""
        score = 0.7 * self.share(text, category)
        for p in (ps := self.patterns.get(category, ())):
            score = score + F.when(F.concat(F.lit(" "), text).rlike(rf"[^\p{{L}}\p{{N}}_](?:{p})"), 0.3 / len(ps)).otherwise(0.0)
        return score


def classified(df: DataFrame, text_col: str, rules: Rules | None = None) -> DataFrame:
    """df with category, confidence, validation (from the category's keywords in the text), matched_keywords and alternatives (the three
    categories of the greatest keyword shares, ties by name). Null texts have the default category and confidence 0."""
    rules = rules or Rules()
    text = F.trim(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    named = F.array(*(F.struct(F.lit(c).alias("category"), F.round(rules.score(text, c), 12).alias("score"), F.lit(rules.priority.get(c, 999)).alias("priority"), F.round(rules.share(text, c), 12).alias("share")) for c in rules.keywords))
    out = df.withColumn("_all", F.filter(named, lambda x: (x["score"] > 0) | (x["share"] > 0)))
    most = F.array_max(F.transform("_all", lambda x: x["score"]))
    near = F.filter("_all", lambda x: (x["score"] > 0) & (F.abs(x["score"] - F.col("_most")) < BAND))
    best = F.array_min(F.transform(near, lambda x: F.struct(x["priority"].alias("p"), (-x["score"]).alias("s"), x["category"].alias("c"))))
    out = out.withColumn("_most", most).withColumn("_best", best)
    sure = -F.col("_best")["s"] >= LEAST
    out = out.withColumn("category", F.when(sure, F.col("_best")["c"]).otherwise(rules.default)).withColumn("confidence", F.when(sure, -F.col("_best")["s"]).otherwise(0.0))
    out = out.withColumns({"category": F.coalesce("category", F.lit(rules.default)), "confidence": F.coalesce("confidence", F.lit(0.0))})
    matched = F.array().cast("array<string>")
    validation = F.lit(0.3)
    for c in rules.keywords:
        own, hits = F.col("category") == c, rules.hits(text, c)
        words, how = SURE.get(c, ((), 0.0))
        value = F.least(F.lit(0.85), 0.5 + F.size(hits) / len(rules.keywords[c]) * 0.5)
        if words:
            value = F.when(text.rlike("|".join(words)), how).otherwise(value)
        matched = F.when(own, hits).otherwise(matched)
        validation = F.when(own & (F.size(hits) > 0), value).otherwise(validation)
    by_share = F.array_sort(F.transform(F.filter("_all", lambda x: x["share"] > 0), lambda x: F.struct((-x["share"]).alias("s"), x["category"].alias("c"))))
    out = out.withColumns({"validation": validation, "matched_keywords": matched, "alternatives": F.transform(F.slice(by_share, 1, 3), lambda x: x["c"])})
    return out.withColumn("final_confidence", F.least("confidence", "validation")).drop("_all", "_most", "_best")

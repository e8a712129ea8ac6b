"""Similarity scores of two names as column expressions: parameters, brands, categories, functions, and the scores made of them.

All of them stay inside the JVM but the four string ratios, which come as columns from functions.fuzzy."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import fuzzy
from ..sources.shared import written

TOKEN = r"[\p{L}\p{N}_]+"
#: The sizes that count as key parameters, and the eight patterns of parameters, the first of two numbers.
SIZES = r"[Мм][0-9]+[хx][0-9]+|[0-9]+[тt]|[0-9]+[Ww]|[0-9]+[Аа]"
PAIR = r"([0-9]+)\s*[хx]\s*([0-9]+)"
SINGLES = (r"([0-9]+)\s*[тt]", r"([0-9]+)\s*[Ww]", r"([0-9]+)\s*[Аа]", r"([0-9]+)\s*[Vv]", r"([0-9]+)\s*[кг]", r"([0-9]+)\s*[л]", r"([0-9]+)\s*[мм]")
#: Weights of the pair and of the first four single patterns in the advanced comparison.
PARAM_WEIGHTS = (0.3, 0.25, 0.2, 0.15, 0.1)
DUPLICATE_WEIGHTS = {"fuzzy": 0.8, "semantic": 0.7, "parameter": 0.6, "brand": 0.5}
ANALOG_WEIGHTS = {"semantic": 0.45, "fuzzy": 0.40, "parameter": 0.30, "brand": 0.10, "category": 0.15, "functional": 0.1}
#: What the weights are multiplied by where both items are technical; the functional one becomes TECHNICAL_FUNCTIONAL.
TECHNICAL_BOOST = {"semantic": 0.8, "fuzzy": 0.8, "parameter": 1.5, "brand": 1.2, "category": 1.1}
TECHNICAL_FUNCTIONAL = 0.15
CONFIDENCE_WEIGHTS = {"semantic": 0.2, "fuzzy": 0.2, "parameter": 0.25, "brand": 0.15, "category": 0.1, "functional": 0.1}


def found(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def tokens(x: Column, pattern: str) -> Column:
    """The tokens of x that the pattern matches as a whole."""
    return F.filter(found(x, TOKEN), lambda w: w.rlike(f"^(?:{pattern})$"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def flag(condition: Column, value: float = 1.0) -> Column:
    return F.when(condition, value).otherwise(0.0)


def key_parameters(x: Column, y: Column) -> Column:
    """.5 for a common GOST number, .3 for a common size, .2 for a common word of three or more letters."""
    gost = F.arrays_overlap(found(F.upper(x), r"ГОСТ\s*[0-9]+[-0-9]*"), found(F.upper(y), r"ГОСТ\s*[0-9]+[-0-9]*"))
    size = F.arrays_overlap(found(x, SIZES), found(y, SIZES))
    word = F.arrays_overlap(tokens(x, "[A-Za-zА-Яа-я]{3,}"), tokens(y, "[A-Za-zА-Яа-я]{3,}"))
    return flag(gost, 0.5) + flag(size, 0.3) + flag(word, 0.2)


def brands_in(x: Column) -> Column:
    known = F.array(*map(F.lit, D.KNOWN_BRANDS))
    return F.filter(known, lambda b: F.contains(F.lower(x), b))


def brand_similarity(x: Column, y: Column) -> Column:
    return flag(F.arrays_overlap(brands_in(x), brands_in(y)))


def brand_similarity_advanced(brand_x: Column, brand_y: Column, x: Column, y: Column) -> Column:
    """1 for an equal brand field or a common known brand, .8 for brands of one group."""
    bx, by = brands_in(x), brands_in(y)
    grouped = [F.arrays_overlap(bx, F.array(*map(F.lit, g))) & F.arrays_overlap(by, F.array(*map(F.lit, g))) for g in D.BRAND_GROUPS.values()]
    same = F.coalesce((brand_x == brand_y) & (brand_x != ""), F.lit(False))
    return F.when(same | F.arrays_overlap(bx, by), 1.0).when(reduce(lambda a, b: a | b, grouped), 0.8).otherwise(0.0)


def pair_values(x: Column) -> Column:
    return F.transform(F.arrays_zip(found(x, PAIR, 1).alias("a"), found(x, PAIR, 2).alias("b")), lambda p: F.concat_ws("x", p["a"], p["b"]))


def parameter_similarity(x: Column, y: Column) -> Column:
    """Jaccard of the values that the eight patterns find."""
    values = lambda t: F.array_distinct(F.flatten(F.array(pair_values(t), *(found(t, p, 1) for p in SINGLES))))
    return jaccard(values(x), values(y))


def parameter_similarity_advanced(x: Column, y: Column) -> Column:
    """The weighted mean of the Jaccards of those patterns that both names match."""
    sides = [(F.array_distinct(pair_values(x)), F.array_distinct(pair_values(y)))]
    sides += [(F.array_distinct(found(x, p, 1)), F.array_distinct(found(y, p, 1))) for p in SINGLES[:4]]
    both = [(F.size(a) > 0) & (F.size(b) > 0) for a, b in sides]
    weight = reduce(add, [flag(c, w) for c, w in zip(both, PARAM_WEIGHTS, strict=True)])
    total = reduce(add, [F.when(c, jaccard(a, b) * w).otherwise(0.0) for c, (a, b), w in zip(both, sides, PARAM_WEIGHTS, strict=True)])
    return F.when(weight > 0, total / weight).otherwise(0.0)


def category_similarity(x: Column, y: Column) -> Column:
    near = reduce(lambda a, b: a | b, [((x == k) & y.isin(*v)) | ((y == k) & x.isin(*v)) for k, v in D.SIMILAR_CATEGORIES.items()])
    return F.when(F.coalesce(x, F.lit("")).eqNullSafe("") | F.coalesce(y, F.lit("")).eqNullSafe(""), 0.0).when(x == y, 1.0).when(near, 0.7).otherwise(0.0)


def functional_groups(x: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.lower(x).rlike("|".join(words)), F.lit(name)) for name, words in D.FUNCTIONAL_GROUPS.items())))


def functional_similarity(x: Column, y: Column) -> Column:
    return jaccard(functional_groups(x), functional_groups(y))


def is_technical(x: Column) -> Column:
    return F.lower(x).rlike("|".join(D.TECHNICAL_WORDS))


#: (pattern of lower-case text, boost where both sides match it); together at most .3.
BOOSTS = ((r"гост", 0.1), (r"ip[0-9]{2}", 0.1), (r"м[0-9]+[хx][0-9]+", 0.1), (r"[0-9]+ ?(мм|кг|бар|шт)", 0.05))


def technical_boost(x: Column, y: Column) -> Column:
    return F.least(F.lit(0.3), reduce(add, [flag(F.lower(x).rlike(p) & F.lower(y).rlike(p), w) for p, w in BOOSTS]))


def key_term_score(query: Column, document: Column) -> Column:
    """The share of the query's distinct words (Latin or Russian letters alone) that the document has."""
    q, d = (F.array_distinct(tokens(F.lower(t), "[а-яёa-z]+")) for t in (query, document))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def numeric_penalty(query: Column, document: Column) -> Column:
    """Up to .5 for texts that share numbers, the more the fewer words they share."""
    shared = F.arrays_overlap(tokens(query, "[0-9]+"), tokens(document, "[0-9]+"))
    return F.when(shared, (1 - key_term_score(query, document)) * 0.5).otherwise(0.0)


def enhanced_semantic(semantic: Column, lexical: Column, query: Column, document: Column) -> Column:
    """.6 semantic + .3 lexical + .1 key terms, less up to .7 of the numeric penalty."""
    score = 0.6 * semantic + 0.3 * lexical + 0.1 * key_term_score(query, document)
    return F.least(F.lit(1.0), score * (1 - numeric_penalty(query, document) * 0.7))


def improved(fuzzy_score: Column, semantic: Column, query: Column, document: Column, category_q: Column, category_d: Column, brand_q: Column, brand_d: Column) -> Column:
    """.6 fuzzy + .4 semantic, then in turn: x .7 for unlike categories; + .05 a shared token up to .3, or x .5 without one; + .15 for
    an equal brand or x .9 for another; + .1 of the lesser score if both engines found it. At most 1. Missing scores are null."""
    f, s = F.coalesce(fuzzy_score, F.lit(0.0)), F.coalesce(semantic, F.lit(0.0))
    words = lambda t: F.array_distinct(F.filter(found(F.lower(t), TOKEN), lambda w: F.length(w) >= 3))
    score = 0.6 * f + 0.4 * s
    score = score * F.when((category_q != "") & (category_d != "") & (category_q != category_d), 0.7).otherwise(1.0)
    shared = F.size(F.array_intersect(words(query), words(document)))
    score = F.when(shared < 1, score * 0.5).otherwise(score + F.least(F.lit(0.3), shared * 0.05))
    known = (brand_q != "") & (brand_d != "")
    score = F.when(known & (F.lower(brand_q) == F.lower(brand_d)), score + 0.15).when(known, score * 0.9).otherwise(score)
    return F.least(F.lit(1.0), score + F.when((f > 0) & (s > 0), 0.1 * F.least(f, s)).otherwise(0.0))


RATIOS = {"ratio": fuzzy.ratio, "partial": fuzzy.partial_ratio, "token_sort": fuzzy.token_sort_ratio, "token_set": fuzzy.token_set_ratio}


def with_ratios(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """pairs with the four string ratios of lower-cased x and y, from 0 to 1."""
    return pairs.withColumns({k: fuzzy.kernel(f)(F.lower(x), F.lower(y)) / 100 for k, f in RATIOS.items()})


def duplicates(pairs: DataFrame, least: float = 0.45) -> DataFrame:
    """pairs(a, b, x, y, semantic) with duplicate_type and score: 'exact' for names equal but for case and outer blanks, 'parameter_exact'
    from key parameters of .9 on, else the weighted mean of fuzzy, semantic, parameter and brand scores, named 'hybrid_' by the greatest
    of the four from `least` on (ties: in that order), 'semantic' from .4 on, else null with score 0."""
    x, y = F.col("x"), F.col("y")
    out = with_ratios(pairs).withColumns(
        {
            "fuzzy": 0.3 * F.col("ratio") + 0.2 * F.col("partial") + 0.3 * F.col("token_sort") + 0.2 * F.col("token_set"),
            "parameter": parameter_similarity(x, y),
            "brand": brand_similarity(x, y),
            "key_parameters": key_parameters(x, y),
        }
    )
    weighted = reduce(add, [F.col(k) * w for k, w in DUPLICATE_WEIGHTS.items()]) / sum(DUPLICATE_WEIGHTS.values())
    top = F.greatest(*DUPLICATE_WEIGHTS)
    dominant = reduce(lambda acc, k: acc.when(F.col(k) == top, k), [*DUPLICATE_WEIGHTS][1:], F.when(F.col("fuzzy") == top, "fuzzy"))
    exact = F.trim(F.lower(x)) == F.trim(F.lower(y))
    kind = F.when(exact, "exact").when(F.col("key_parameters") >= 0.9, "parameter_exact").when(F.col("weighted") >= least, F.concat(F.lit("hybrid_"), dominant)).when(F.col("weighted") >= 0.4, "semantic")
    score = F.when(exact, 1.0).when(F.col("key_parameters") >= 0.9, F.col("key_parameters")).when(F.col("weighted") >= 0.4, F.col("weighted")).otherwise(0.0)
    return out.withColumn("weighted", weighted).withColumn("duplicate_type", kind).withColumn("score", score)


def analogs(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, x, y, category_x, category_y, brand_x, brand_y, semantic) with similarity, confidence and analog_type: six components
    by weights that shift towards parameters where both items are technical."""
    x, y = F.col("x"), F.col("y")
    out = with_ratios(pairs).withColumns(
        {
            "fuzzy": 0.25 * (F.col("ratio") + F.col("partial") + F.col("token_sort") + F.col("token_set")),
            "parameter": parameter_similarity_advanced(x, y),
            "brand": brand_similarity_advanced(F.col("brand_x"), F.col("brand_y"), x, y),
            "category": category_similarity(F.col("category_x"), F.col("category_y")),
            "functional": functional_similarity(x, y),
            "technical": is_technical(x) & is_technical(y),
        }
    )
    boosted = {k: w * TECHNICAL_BOOST.get(k, 1.0) for k, w in ANALOG_WEIGHTS.items()} | {"functional": TECHNICAL_FUNCTIONAL}
    mean = lambda weights: reduce(add, [F.col(k) * w for k, w in weights.items()]) / sum(weights.values())
    similarity = F.when(F.col("technical"), mean(boosted)).otherwise(mean(ANALOG_WEIGHTS))
    out = out.withColumn("similarity", similarity).withColumn("confidence", mean(CONFIDENCE_WEIGHTS))
    s = F.col("similarity")
    return out.withColumn("analog_type", F.when(s >= 0.7, "точный аналог").when(s >= 0.55, "близкий аналог").when(s >= 0.25, "возможный аналог").otherwise("нет аналогов"))


def term_vectors(items: DataFrame, id_col: str, text_col: str, most_words: int = 3) -> DataFrame:
    """(id, vector): a map from 1- to most_words-word terms (words of two or more signs) to unit-length TF-IDF weights."""
    words = F.filter(found(F.lower(F.col(text_col)), TOKEN), lambda w: F.length(w) >= 2)
    df = items.select(F.col(id_col).alias("id"), words.alias("w"))
    # n words give n - k + 1 terms of k words, none if that is under 1
    def grams_of(k: int) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice("w", i + 1, k), " "))
        return F.when(F.size("w") >= k, some).otherwise(F.array().cast("array<string>"))

    grams = [grams_of(k) for k in range(1, most_words + 1)]
    tf = df.select("id", F.explode(F.flatten(F.array(*grams))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = items.agg(F.count("*").alias("n"))  # one row
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    both = raw.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "x"))).alias("vector"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return both.select("id", F.transform_values("vector", lambda k, v: v / F.col("norm")).alias("vector"))


def vector_dot(a: Column, b: Column) -> Column:
    """Of two maps; an item without a vector has 0."""
    return F.coalesce(F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.element_at(b, k), F.lit(0.0))), F.lit(0.0))


def with_semantic(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(a, b) with semantic, the cosine of their term vectors."""
    va, vb = (vectors.select(F.col("id").alias(k), F.col("vector").alias(f"v{k}")) for k in "ab")
    return pairs.join(va, "a", "left").join(vb, "b", "left").withColumn("semantic", vector_dot(F.col("va"), F.col("vb"))).drop("va", "vb")


def main_duplicate_type(types: DataFrame, key: str = "a", type_col: str = "duplicate_type", order: str = "b") -> DataFrame:
    """(key, main_type): of a group's types the one of the greatest priority (exact 3, fuzzy 2, parameter_based and semantic 1, others 0), the first on ties."""
    priority = F.when(F.col(type_col) == "exact", 3).when(F.col(type_col) == "fuzzy", 2).when(F.col(type_col).isin("parameter_based", "semantic"), 1).otherwise(0)
    r = F.row_number().over(Window.partitionBy(key).orderBy(priority.desc(), order))
    return types.withColumn("_r", r).where("_r = 1").select(key, F.col(type_col).alias("main_type"))


def hierarchy_levels(scored: DataFrame, root: str = "root", child: str = "child", score: str = "score", gap: float = 0.1) -> DataFrame:
    """(root, child, score, level): children by falling score; a new level begins where the score differs by over `gap` from the
    head of the level, the first one at 2.

    A root may have any number of children: each round takes the next head of every root, its greatest score that lies over `gap` under the last
    one, so there are as many rounds as levels (six at most for scores of .5 to 1) and none puts a root's children in order."""
    rows = written(scored.select(root, child, F.col(score).alias(score)))
    left, heads = written(rows.select(root, score).distinct()), None
    while True:
        new = written(left.groupBy(root).agg(F.max(score).alias("head")))
        if heads is not None and new.isEmpty():
            break
        heads = new if heads is None else heads.union(new)
        left = written(left.join(new, root).where(F.col("head") - F.col(score) > gap + 1e-12).select(root, score))
    listed = heads.groupBy(root).agg(F.collect_list("head").alias("heads"))
    level = (1 + F.size(F.filter("heads", lambda h: h >= F.col(score)))).alias("level")
    return rows.join(listed, root).select(root, F.col(child).cast("bigint").alias(child), score, level)

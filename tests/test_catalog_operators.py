"""Scores, fusion, classification, units, extraction, indexes, trees and sinks against values worked out by hand or in plain Python."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textkin.functions import fuzzy
from textkin.operators import classify, extract, fusion, index, pairs, scores, trees, units
from textkin.sources import reports, tables, workbook


def one(spark, x, y, column):
    return spark.createDataFrame([(x, y)], "x string, y string").select(column(F.col("x"), F.col("y"))).first()[0]


@pytest.mark.parametrize(
    ("x", "y", "want"),
    [("Болт М10х50 ГОСТ 7798-70", "болт м10х50 гост 7798-70", 0.5), ("Болт М10х50 ГОСТ 7798-70", "Болт М10х50 ГОСТ 7798-70 цинк", 1.0), ("Кран 25т", "Кран 25т", 0.5), ("AB 12", "AB 12", 0.0)],
)
def test_key_parameters(spark, x, y, want):
    assert one(spark, x, y, scores.key_parameters) == pytest.approx(want)


def test_brands_and_parameters(spark):
    assert one(spark, "Дрель Makita 18V", "дрель MAKITA", scores.brand_similarity) == 1.0
    assert one(spark, "Дрель Makita", "Дрель Bosch", scores.brand_similarity) == 0.0
    advanced = lambda bx, by: lambda x, y: scores.brand_similarity_advanced(F.lit(bx), F.lit(by), x, y)
    assert one(spark, "Смартфон Huawei", "Смартфон Honor", advanced("", "")) == 0.8
    assert one(spark, "a", "b", advanced("X", "X")) == 1.0 and one(spark, "a", "b", advanced("", "")) == 0.0
    # 10x50, and 50 alone before a letter of [мм]? no: the sets are {10x50} and {10x50, 8} with 8 before т
    assert one(spark, "М10х50", "М10х50 8т", scores.parameter_similarity) == pytest.approx(0.5)
    assert one(spark, "М10х50 16А", "М10х50 25А", scores.parameter_similarity_advanced) == pytest.approx(0.3 / 0.45)
    assert one(spark, "", "М10х50", scores.parameter_similarity) == 0.0


def test_category_function_and_boost(spark):
    assert one(spark, "крепеж", "гайки", scores.category_similarity) == 0.7 and one(spark, "крепеж", "крепеж", scores.category_similarity) == 1.0 and one(spark, "", "", scores.category_similarity) == 0.0
    assert one(spark, "Болт и кран", "Гайка", scores.functional_similarity) == pytest.approx(0.5)
    assert one(spark, "Болт М10х50 ГОСТ 1 100 шт", "болт м8х20 гост 2 5 шт", scores.technical_boost) == pytest.approx(0.25)


def test_semantic_terms(spark):
    assert one(spark, "болт стальной 10", "болт медный 10", scores.key_term_score) == pytest.approx(0.5)
    assert one(spark, "болт стальной 10", "болт медный 10", scores.numeric_penalty) == pytest.approx(0.25)
    assert one(spark, "болт 10", "болт 11", scores.numeric_penalty) == 0.0
    got = one(spark, "болт стальной 10", "болт медный 10", lambda x, y: scores.enhanced_semantic(F.lit(0.9), F.lit(0.5), x, y))
    assert got == pytest.approx((0.54 + 0.15 + 0.05) * (1 - 0.25 * 0.7))
    plain = lambda **k: one(spark, "болт стальной", "болт медный", lambda x, y: scores.improved(*(F.lit(v) for v in (k.get("f"), k.get("s"))), x, y, F.lit(k.get("a", "")), F.lit(k.get("b", "")), F.lit(k.get("p", "")), F.lit(k.get("q", ""))))
    assert plain(f=0.5, s=0.8) == pytest.approx(0.62 + 0.05 + 0.05)
    assert plain(f=0.5, s=0.8, a="x", b="y") == pytest.approx(0.62 * 0.7 + 0.05 + 0.05)
    assert plain(f=0.5, s=0.8, p="Z", q="z") == pytest.approx(0.62 + 0.05 + 0.15 + 0.05) and plain(f=0.5, s=0.8, p="Z", q="y") == pytest.approx(0.67 * 0.9 + 0.05)


def test_duplicate_and_analog_scores(spark):
    rows = [(1, 2, "Болт М10", " болт м10", 1.0), (1, 3, "Болт М10х50 ГОСТ 1-2 цинк", "Болт М10х50 ГОСТ 1-2", 0.5), (1, 4, "Дрель Makita 18V", "Пила Makita 18V", 0.3), (1, 5, "abc", "xyz", 0.0)]
    got = {r.b: r for r in scores.duplicates(spark.createDataFrame(rows, "a long, b long, x string, y string, semantic double")).collect()}
    assert (got[2].duplicate_type, got[2].score) == ("exact", 1.0) and (got[3].duplicate_type, got[3].score) == ("parameter_exact", 1.0)
    k = [f(rows[2][2].lower(), rows[2][3].lower()) / 100 for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio)]
    mixed = 0.3 * k[0] + 0.2 * k[1] + 0.3 * k[2] + 0.2 * k[3]
    assert got[4].score == pytest.approx((0.8 * mixed + 0.7 * 0.3 + 0.6 * 1.0 + 0.5 * 1.0) / 2.6) and got[4].duplicate_type == "hybrid_parameter"
    assert got[5].duplicate_type is None and got[5].score == 0.0
    types = scores.main_duplicate_type(spark.createDataFrame([(1, 2, "semantic"), (1, 3, "exact"), (2, 3, "hybrid_fuzzy"), (2, 4, "hybrid_brand")], "a long, b long, duplicate_type string"))
    assert {r.a: r.main_type for r in types.collect()} == {1: "exact", 2: "hybrid_fuzzy"}
    a = spark.createDataFrame([(1, 2, "Автомат 16А", "Автомат 25А", "электрика", "освещение", "", "", 0.5)], "a long, b long, x string, y string, category_x string, category_y string, brand_x string, brand_y string, semantic double")
    r = scores.analogs(a).first()
    k = [f("автомат 16а", "автомат 25а") / 100 for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio)]
    parts = {"semantic": 0.5, "fuzzy": sum(k) / 4, "parameter": 0.0, "brand": 0.0, "category": 0.7, "functional": 1.0}
    w = {"semantic": 0.36, "fuzzy": 0.32, "parameter": 0.45, "brand": 0.12, "category": 0.165, "functional": 0.15}
    assert r.similarity == pytest.approx(sum(parts[c] * w[c] for c in w) / sum(w.values()))
    assert r.confidence == pytest.approx((0.2 * 0.5 + 0.2 * sum(k) / 4 + 0.1 * 0.7 + 0.1 * 1.0))


def test_hierarchy_levels_break_at_the_head(spark):
    rows = [(1, c, s) for c, s in enumerate((0.95, 0.9, 0.86, 0.84, 0.7, 0.65))]
    got = {r.child: r.level for r in scores.hierarchy_levels(spark.createDataFrame(rows, "root long, child long, score double")).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 3, 4: 4, 5: 4}


def test_hierarchy_levels_of_large_clusters(spark, tmp_path):
    """More children than any list shows: all have a level, as the fold over them in order tells."""
    from textkin.plans import catalog

    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(base)] + [" ".join([*base, *(f"n{i}x{k}" for k in range(1 + i % 13))]) for i in range(90)] + ["single"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.child: (r.root, r.score, r.level) for r in catalog.queries()["hierarchy_levels"](spark, str(tmp_path)).collect()}
    want, level, head = {}, 1, 9.0
    for s, i in sorted((-20 / (21 + i % 13), i + 1) for i in range(90)):
        if head + s > 0.1 + 1e-12:
            level, head = level + 1, -s
        want[i] = (0, pytest.approx(-s, abs=1e-6), level)
    assert got == want and len(want) == 90 and level == 5
    assert scores.hierarchy_levels(spark.createDataFrame([], "root long, child long, score double")).count() == 0


def test_cluster_distances_are_of_whole_texts(spark, tmp_path):
    from textkin.plans import catalog

    start = " ".join(f"word{i}" for i in range(40))
    texts = [f"{start} end", f"{start} end and a good deal more", f"{start} Ende, other signs {'z' * 90}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: (r.root, r.ratio) for r in catalog.queries()["cluster_distances"](spark, str(tmp_path)).collect()}
    common = len(start) + 4
    assert len(start) > 200 and got == {i: (0, pytest.approx(200 * n / (len(texts[0]) + len(texts[i])), abs=1e-6)) for i, n in ((1, common), (2, common - 1))}


def test_fusion(spark):
    shape = "qid long, id long, score double, rank long"
    f = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.6, 2), (1, 3, 0.3, 3)], shape)
    s = spark.createDataFrame([(1, 2, 0.8, 1), (1, 4, 0.5, 2), (1, 1, 0.3, 3)], shape)
    of = lambda df: {r.id: r.score for r in df.collect()}
    assert of(fusion.weighted_sum(f, s)) == pytest.approx({1: 0.36, 2: 0.24 + 0.48 + 0.06, 4: 0.3})
    assert of(fusion.rank_fusion(f, s)) == pytest.approx({1: 1 / 61 + 1 / 63, 2: 1 / 62 + 1 / 61, 3: 1 / 63, 4: 1 / 62})
    assert of(fusion.cascade(f, s)) == pytest.approx({2: 0.8, 1: 0.72, 4: 0.5})
    assert of(fusion.simple(f, s)) == pytest.approx({1: 0.36 + 0.18 + 0.1, 2: 0.24 + 0.48 + 0.1, 3: 0.12, 4: 0.3})
    assert of(fusion.facade(f, s)) == pytest.approx({1: 0.9, 2: 0.8})
    cf, cs = 0.6 * 3 / 20 + 0.4 * 0.6, 0.6 * 3 / 20 + 0.4 * 1.6 / 3
    assert {r.engine: r.confidence for r in fusion.confidences({"f": f, "s": s}).collect()} == pytest.approx({"f": cf, "s": cs})
    assert of(fusion.confidence_based({"f": f, "s": s})) == pytest.approx({1: 0.9, 2: 0.6, 3: 0.3, 4: 0.5})  # f is surer
    assert of(fusion.consensus({"f": f, "s": s}, {"f": 1.0, "s": 1.0})) == pytest.approx({2: (0.6 * cf + 0.8 * cs) / 2 + 0.1})  # the others are under .3


def test_classify(spark):
    rules = classify.Rules({"a": ("болт", "гайка"), "b": ("кран", "труба", "насос", "фильтр")}, {"b": (r"кран\s+[0-9]+",)}, {"a": 2, "b": 1})
    rows = [(1, "Болт и гайка"), (2, "Кран 10"), (3, "Болт"), (4, "другое"), (5, None), (6, "болт, кран и труба")]
    got = {r.id: r for r in classify.classified(spark.createDataFrame(rows, "id long, t string"), "t", rules).collect()}
    assert (got[1].category, got[1].confidence) == ("a", pytest.approx(0.7)) and (got[2].category, got[2].confidence) == ("b", pytest.approx(0.7 / 4 + 0.3))
    assert got[4].category == got[5].category == "общие_товары" and got[4].confidence == 0.0
    # equal scores: the smaller priority number wins, as does one within .1
    assert got[6].category == "b" and got[6].confidence == pytest.approx(0.35) and got[6].alternatives == ["a", "b"] and got[6].matched_keywords == ["кран", "труба"]
    assert got[1].validation == pytest.approx(0.85) and got[4].validation == pytest.approx(0.3) and got[1].final_confidence == pytest.approx(0.7)


UNITS = [
    ("Насос 10 м³/ч давление 6 бар", "Насос 10.0м³/ч давление 6.0 бар"), ("Бак 10 атм", "Бак 10.0атм"), ("Труба 1/2", "Труба frac_1-2"), ("Редуктор 40:1", "Редуктор ratio_40-1"), ("Печь 0-1000°C", "Печь range_0-1000-c"),
    ("Лист 245х10,03мм", 'Лист dims=[245.0,10.03] unit="мм"'), ("Короб 10х20х30 см", 'Короб dims=[10.0,20.0,30.0] unit="см"'), ("Трубка 0,05\"", "Трубка 0.05 дюйм"), ("костюм 170/176 рост", "костюм size_170-176 рост"), ("Сталь 12Х18Н10Т 5мм", "Сталь 12Х18Н10Т 5.0 мм"),
    ("Кабель 1,50 кВт", "Кабель 1.5 кВт"), ("", ""), (None, ""),
]


def test_units(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(UNITS)], "id int, t string")
    got = {r.id: r for r in units.units_processed(df, "t").collect()}
    assert [got[i].processed for i in range(len(UNITS))] == [y for _, y in UNITS]
    assert [(p.kind, p.value, p.unit) for p in got[0].parameters][:2] == [("составная_единица", 10.0, "м³/ч"), ("давление", 6.0, "бар")]
    assert [(p.kind, p.value) for p in got[3].parameters] == [("соотношение", 40.0)] and [p.value for p in got[2].parameters] == [0.5]


def test_codes_and_terms(spark):
    df = spark.createDataFrame([(0, "ГОСТ 7798-70 ОСТ 12-3- DN50 PN 16"), (1, "Мотор 1,5 кВт"), (2, "круглый 50 мм"), (3, "вес 10 кг"), (4, None)], "id int, t string")
    got = {r.id: [tuple(c) for c in r.codes] for r in units.tech_codes(df, "t").collect()}
    assert got[0] == [("стандарт", "ГОСТ 7798-70"), ("стандарт", "ГОСТ 12-3"), ("размерный_код", "DN50"), ("размерный_код", "PN16")]
    assert got[1] == [("мощностной_код", "1.5кВт")] and got[2] == [] and got[3] == [("технический_параметр", "10кг")] and got[4] == []
    df = spark.createDataFrame([(0, "Штуцерный узел 10 шт"), (1, "штуцер-гайка чугунная"), (2, "")], "id int, t string")
    got = {r.id: (r.normalized, r.terms) for r in units.technical_terms(df, "t").collect()}
    assert got == {0: ("штуцер узел 10 штука", ["Штуцерный -> штуцер", "шт -> штука"]), 1: ("штуцер-гайка чугун", ["штуцер-гайка -> штуцер-гайка", "чугунная -> чугун"]), 2: ("", [])}


def test_extraction_claims_text_in_order(spark):
    df = spark.createDataFrame([(1, "Болт М10х50 резьба ГОСТ 7798 стандарт"), (2, "вес 5 кг"), (3, None), (4, "16 А")], "id long, t string")
    got = extract.extracted(df, "id", "t")
    rows = {(r.id, r.name): (r.value, r.confidence) for r in got.collect()}
    assert rows[1, "thread"][0] == "10x50" and rows[1, "gost"] == ("7798", 1.0) and rows[2, "weight"] == ("5", pytest.approx(1.0)) and (1, "dimensions") not in rows
    assert rows[1, "function"][0] == "крепление" and not any(i in (3, 4) for i, _ in rows)  # amperes need a word about current nearby
    back = extract.from_json(extract.to_json(got))
    assert sorted(map(str, back.select(got.columns).collect())) == sorted(map(str, got.collect()))
    assert {r.id: len(r.parameters) for r in extract.with_parameters(df, "id", "t").collect()}[3] == 0


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red bolt ten", "a"), (2, "red nut", "b"), (3, "blue bolt", "a"), (4, None, "a"), (None, "x", "a"), (5, "red red bolt", "b")], "id long, text string, cat string")
    t = index.build(docs, "id", "text", str(tmp_path / "i"), "cat")
    q = spark.createDataFrame([(1, "red bolt"), (2, "blu"), (3, "zzz"), (4, "")], "qid long, text string")
    ask = lambda m, **k: {(r.qid, r.id): r.score for r in index.search(t, q, m, **k).collect()}
    assert set(ask("exact")) == {(1, 1), (1, 5)} and set(ask("partial")) == {(1, 2), (1, 3)} and set(ask("prefix")) == {(2, 3)} and set(ask("substring")) == {(1, 1), (1, 5), (2, 3)}
    assert ask("jaccard", least=0.5) == pytest.approx({(1, 1): 0.666667, (1, 5): 1.0}) and set(ask("lsh")) <= {(1, 1), (1, 5)} and (1, 5) in ask("lsh")
    assert ask("inverted")[1, 2] == 0.5 and set(ask("fts")) == {(1, 1), (1, 5)}
    assert {k for k in ask("fallback") if k[0] == 2} == {(2, 3)}
    idf = {w: np.log(5 + 1) - np.log(1 + n) + 1 for w, n in (("red", 3), ("bolt", 3), ("ten", 1))}
    v = lambda c: np.array([c.count(w) * idf[w] for w in ("red", "bolt", "ten")])
    a, b = v(["red", "bolt"]), v(["red", "bolt", "ten"])
    assert ask("tfidf")[1, 1] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-6)
    with pytest.raises(ValueError):
        index.search(t, q, "none")
    again = index.load(spark, str(tmp_path / "i"))
    assert index.statistics(again)["items"] == 5 and {r.id for r in index.similar(again, spark.createDataFrame([(1,)], "id long")).collect()} == {2, 3, 5}
    new = index.update(spark.createDataFrame([(2, "green nut", "b"), (1, "red bolt ten", "a"), (9, "new", "b")], docs.schema), "id", "text", str(tmp_path / "i"), "v2", "cat")
    assert {r.id: r.text for r in new["items"].collect()}[2] == "green nut" and new["items"].count() == 6


def test_cells_find_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    got = {}
    for r in index.CellIndex(df).search(df.where("id % 20 = 0"), 10, 10).collect():
        got.setdefault(r.qid, set()).add(r.id)
    near = {i: set(np.argsort(-np.where(np.arange(1500) == i, -9, x @ x[i]))[:10].tolist()) for i in range(0, 1500, 20)}
    assert np.mean([len(near[i] & got.get(i, set())) / 10 for i in near]) >= 0.9


def test_lsh_recall(spark, tmp_path):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(5000)}" for _ in range(40)] for _ in range(60)]
    texts = [" ".join(b) for b in base] + [" ".join(b[: 40 - k] + [f"n{rng.randrange(9999)}" for _ in range(k)]) for b in base for k in (2, 5, 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    t = index.build(df, "id", "text", str(tmp_path / "l"))
    q = df.select(F.col("id").alias("qid"), "text")
    exact, near = ({(r.qid, r.id) for r in index.search(t, q, m, 50).collect()} for m in ("jaccard", "lsh"))
    assert near <= exact and len(near) >= 0.95 * len(exact)


def test_jaccard_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    sets = [frozenset(f"t{min(int(rng.paretovariate(0.7)), 300)}" for _ in range(rng.randint(1, 30))) for _ in range(150)]
    sets += [frozenset(list(s)[: max(1, len(s) - 2)] + ["x"]) for s in sets[:60]]
    sets = list(dict.fromkeys(sets))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "class_id long, terms array<string>")
    for least in (0.2, 0.5, 0.8):
        want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12}
        assert {(r.a, r.b) for r in pairs.jaccard_pairs(df, least).collect()} == want


def test_trees(spark):
    # a triangle with a tail, and a pair
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.6), (2, 3, 0.4), (3, 4, 0.75), (8, 9, 0.5)], "a long, b long, score double")
    roots = {r.component: (r.root, r.weight) for r in trees.tree_roots(edges).collect()}
    assert roots[1] == (3, pytest.approx(0.4 * 3 + 0.3 * 1.75 / 3 + 0.3 * 1.75)) and roots[8][0] == 8
    got = {(r.root, r.node): (r.parent, r.level, r.kind) for r in trees.trees(edges).collect()}
    assert got == {(3, 3): (None, 0, "root"), (3, 4): (3, 1, "exact"), (3, 1): (3, 1, "close"), (3, 2): (3, 1, "possible"), (8, 8): (None, 0, "root"), (8, 9): (8, 1, "close")}
    members = spark.createDataFrame([(1, 1, "red bolt big"), (1, 2, "red bolt"), (1, 3, "red nut"), (2, 7, "one")], "cluster long, id long, name string")
    assert {r.cluster: r.root for r in trees.representatives(members).collect()} == {1: 3, 2: 7}
    h = [(r.root, r.child, round(r.score, 6), r.rank) for r in trees.hierarchy(members, 0.3).collect()]
    assert h == [(3, 2, 0.333333, 1)]
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, c array<double>")
    p = spark.createDataFrame([(1, [2.0, 1.0]), (2, [0.0, 3.0]), (3, [-1.0, -1.0])], "id long, e array<double>")
    assert {r.id: r.label for r in trees.assign_to_centroids(p, c, 0.0).collect()} == {1: 0, 2: 1}


def test_workbook_and_loader(spark, tmp_path):
    df = spark.createDataFrame([(1, "Болт <1> & \"2\"", 0.5, True, [1, 2]), (2, None, 0.7, False, None)], "id long, name string, score double, ok boolean, l array<int>")
    workbook.write({"results": df, "more": df.select("id")}, str(tmp_path / "w.xlsx"), 1, "score")
    sheets = workbook.unpack((tmp_path / "w.xlsx").read_bytes())
    assert sheets["results"] == [["id", "name", "score", "ok", "l"], [2.0, None, 0.7, False]] and sheets["more"][1] == [1.0]
    workbook.write({"results": df.drop("l")}, str(tmp_path / "all.xlsx"))
    assert [tuple(r) for r in tables.load_catalog(spark, str(tmp_path / "all.xlsx")).collect()] == [("1", "Болт <1> & \"2\"", "0.5", "True"), ("2", None, "0.7", "False")]
    (tmp_path / "c.csv").write_bytes("Код;Наименование\n1;Болт, сталь\n".encode("cp1251"))
    assert tables.sniffed(spark, str(tmp_path / "c.csv")) == ("windows-1251", ";")
    assert tables.load_catalog(spark, str(tmp_path / "c.csv")).first().asDict() == {"Код": "1", "Наименование": "Болт, сталь"}
    assert tables.load_catalog(spark, str(tmp_path / "none.csv"), schema="a string").count() == 0 and tables.load_catalog(spark, [{"a": 1}]).first().a == 1 and tables.load_catalog(spark, df) is df
    assert tables.input_kind(["Код", "Raw_Name", "Normalized_Name", "x", "y"], {"k": ("x", "y")}) == "k" and tables.input_kind(["x", "y"], {"k": ("x",)}) is None
    for v in ("9", "10"):
        tables.save_version(df.select("id").withColumn("v", F.lit(v)), str(tmp_path / "v"), v)
    assert tables.latest_version(spark, str(tmp_path / "v")).first().v == "10"
    old, new = (spark.createDataFrame(rows, "k long, version int, x string") for rows in ([(1, 1, "a"), (2, 2, "b")], [(1, 1, "c"), (3, 1, "d")]))
    assert {r.k: r.x for r in tables.upsert(old, new, "k", "version").collect()} == {1: "c", 2: "b", 3: "d"}
    params = extract.extracted(spark.createDataFrame([(1, "вес 5 кг")], "id long, t string"), "id", "t")
    tables.save_parameters(params, str(tmp_path / "p"), "1")
    assert sorted(map(str, tables.load_parameters(spark, str(tmp_path / "p"), "1").select(params.columns).collect())) == sorted(map(str, params.collect()))


def test_reports(spark, tmp_path):
    results = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.5, 2), (2, 3, 0.3, 1)], "qid long, id long, score double, rank int")
    report = reports.frames(results, spark.createDataFrame([(1,), (2,), (3,)], "qid long"))
    assert report["summary"].first().asDict() == {"n": 3, "queries": 2, "mean": pytest.approx(1.7 / 3), "most": 0.9, "least": 0.3, "high": 1, "medium": 1, "low": 1}
    assert [r.qid for r in report["without_results"].collect()] == [3] and report["statistics"].first().median == 0.5
    page = reports.as_html(report, "a < b")
    assert "a &lt; b" in page and page.count("<table>") == 4 and '"summary"' in reports.as_json(report)
    reports.write_json(report, str(tmp_path / "j"))
    reports.write_csv(report, str(tmp_path / "c"))
    reports.write_workbook(report, str(tmp_path / "r.xlsx"), metadata={"by": "test"})
    assert spark.read.json(str(tmp_path / "j" / "detail")).count() == 3 and re.search("detail|summary", str(list(workbook.unpack((tmp_path / "r.xlsx").read_bytes()))))


def test_stream_answers(spark, tmp_path):
    from textkin.streaming import events

    t = index.build(spark.createDataFrame([(1, "red bolt"), (2, "blue nut")], "id long, text string"), "id", "text", str(tmp_path / "i"))
    spark.createDataFrame([(1, "bolt"), (2, " "), (3, "zzz")], "qid long, text string").write.parquet(str(tmp_path / "in"))
    got = events.answered(spark, spark.readStream.schema("qid long, text string").parquet(str(tmp_path / "in")), t).collect()
    assert sorted((r.qid, r.kind, r.id) for r in got if r.id) == [(1, "RESULT", 1)] and {r.qid: r.kind for r in got if not r.id} == {1: "UPDATE", 2: "ERROR", 3: "UPDATE"}


def test_minhash_pairs_in_small_pieces(spark, monkeypatch, tmp_path):
    """Near all pairs down to the threshold, with their true scores between classes of equal words; sets not asked for meet only those that are."""
    from textkin.operators import minhash
    from textkin.plans import catalog

    rng = random.Random(11)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice((8, 40, 120)))] for _ in range(120)]
    texts = [" ".join(b) for b in base] + [" ".join(b[: int(len(b) * 0.78)] + [f"n{rng.randrange(9999)}" for _ in range(int(len(b) * 0.21))]) for b in base * 3] + [" ".join(reversed(b)) for b in base[:20]] + [None, "", "."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, value in (("DEALT", 50), ("LOOKED", 1100), ("MET", 500), ("COMPARED", 300), ("CHECKED", 90)):
        monkeypatch.setattr(pairs, name, value)
    monkeypatch.setattr(minhash, "SIGNED", 33)
    monkeypatch.setattr(minhash, "HELD", 900)
    terms = {}
    for i, t in enumerate(texts):
        if w := frozenset((t or "").replace(".", "").split()):
            terms.setdefault(w, i)
    want = {(a, b): len(x & y) / len(x | y) for (x, a), (y, b) in itertools.combinations(terms.items(), 2) if len(x & y) >= 0.6 * len(x | y) - 1e-12}
    got = {(r.a, r.b): r.score for r in catalog.queries()["minhash_lsh"](spark, str(tmp_path)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.999 * len(want) and len(want) > 300 and all(got[k] == pytest.approx(want[k]) for k in got)
    sets = spark.createDataFrame([(i, sorted(w)) for w, i in terms.items()], "id long, terms array<string>").select("id", F.transform("terms", lambda t: F.xxhash64(t)).alias("h"))
    some = {(r.a, r.b) for r in minhash.candidates(minhash.signed(sets).withColumn("asked", F.col("id") % 5 == 0), 0.6, 7).collect()}
    assert some >= {(a, b) for a, b in got if a % 5 == 0 or b % 5 == 0} and all(a < b and (a % 5 == 0 or b % 5 == 0) for a, b in some)


@pytest.mark.parametrize("head", [0, 6])
def test_nearest_texts_equal_brute_force(spark, monkeypatch, head):
    """In small pieces: copies, ties, texts without words, repeated and missing ids, a query near nothing; no plan joins the texts by word."""
    from textkin.operators import tfidf

    rng = random.Random(13)
    texts = [(i, " ".join(f"w{min(int(rng.paretovariate(0.6)), 60)}" for _ in range(rng.choice((1, 4, 20))))) for i in range(70)]
    texts += [(i + 70, t) for i, t in texts[:25]] + [(100, None), (105, ""), (110, "alone Alone"), (None, "w1 w2"), (None, "w3"), (115, "w1 w1 w5"), (115, "w7"), (120, "w1")]
    for name, value in (("HEAD", head), ("BLOCK", 9), ("PIECE", 5), ("COUNTED", 11), ("SETTLED", 7)):
        monkeypatch.setattr(tfidf, name, value)
    tf = {}
    for i, t in texts:
        for w in (t or "").lower().split():
            tf.setdefault(i, {}).setdefault(w, 0)
            tf[i][w] += 1
    df = {w: sum(w in t for t in tf.values()) for t in tf.values() for w in t}
    raw = {i: {w: c * (np.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in t.items()} for i, t in tf.items() if i is not None}
    unit = {i: {w: x / sum(y * y for y in t.values()) ** 0.5 for w, x in t.items()} for i, t in raw.items()}
    want = {}
    for q in unit:
        if q % 5 == 0:
            near = sorted((-round(sum(x * unit[i][w] for w, x in unit[q].items() if w in unit[i]), 6), i) for i in unit if unit[q].keys() & unit[i].keys())
            want |= {(q, i, r): pytest.approx(-s, abs=2e-6) for r, (s, i) in enumerate(near[:4], 1)}
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(r.qid, r.id, r["rank"]): r.score for r in tfidf.nearest_texts(df, index.words(F.col("text")), F.expr("id % 5 = 0"), 4).collect()}
    assert got == want and (110, 110, 1) in got


def test_lsh_of_copies_needs_bands_alone(spark, monkeypatch, tmp_path):
    """The k best are those of the exact search, ties and copies by id, queries that are items or not; nothing is stored that it doesn't read."""
    from textkin.operators import minhash

    rng = random.Random(21)
    base = [[f"w{rng.randrange(900)}" for _ in range(30)] for _ in range(12)]
    texts = [" ".join(rng.sample(base[i % 12], 30 - i % 4)) for i in range(90)] + [" ".join(base[0])] * 9 + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    q = df.where("id % 7 = 0").selectExpr("id AS qid", "text").union(spark.createDataFrame([(900 + i, " ".join([*b[:27], "x"])) for i, b in enumerate(base)] + [(990, None), (991, "two"), (992, "ONE one")], "qid long, text string"))
    monkeypatch.setattr(minhash, "HELD", 300)
    monkeypatch.setattr(pairs, "CHECKED", 9)
    t = index.build(df, "id", "text", str(tmp_path / "b"), only=("bands",))
    whole = index.build(df, "id", "text", str(tmp_path / "w"))
    assert sorted(t) == ["bands", "items"] == sorted(p.name for p in (tmp_path / "b").iterdir())
    for k in (3, 50):
        want, got = (sorted(map(tuple, index.search(x, q, m, k).collect())) for x, m in ((whole, "jaccard"), (t, "lsh")))
        assert got == want and len(want) > 2 * k

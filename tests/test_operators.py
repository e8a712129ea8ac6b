"""Operators against brute force, hand-computed values and edge cases."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textkin.functions import dictionaries as D
from textkin.functions import fuzzy
from textkin.operators import graph, pairs
from textkin.sources import tables
from textkin.streaming import events


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcё ", max_size=20), st.text("abcё ", max_size=20))
def test_lcs(a, b):
    assert fuzzy.lcs_length(a, b) == slow_lcs(a, b)


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (fuzzy.ratio, "abcd", "abcd", 100.0),
        (fuzzy.ratio, "abcd", "bd", 200 * 2 / 6),
        (fuzzy.ratio, "", "", 100.0),
        (fuzzy.partial_ratio, "болт", "стальной болт м10", 100.0),
        (fuzzy.token_sort_ratio, "болт м10", "м10 болт", 100.0),
        (fuzzy.token_set_ratio, "болт м10", "болт м10 стальной", 100.0),
        (fuzzy.blocks_ratio, "ab", "ab", 1.0),
    ],
)
def test_kernels(f, a, b, want):
    assert f(a, b) == pytest.approx(want)


def sets_of(spark, texts):
    return pairs.token_sets(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_jaccard_pairs(spark, threshold):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(60)] + ["", None, "a a a", "A"]
    reps = pairs.classes(sets_of(spark, texts))
    terms = {r.class_id: set(r.terms) for r in reps.collect()}
    want = {(a, b): len(terms[a] & terms[b]) / len(terms[a] | terms[b]) for a, b in itertools.combinations(sorted(terms), 2)}
    got = {(r.a, r.b): r.score for r in pairs.jaccard_pairs(reps, threshold).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold - 1e-12})


def test_greedy_groups_are_not_transitive(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 9), (8, 9)], "a long, b long")
    assert sorted(map(tuple, pairs.greedy_groups(chain).collect())) == [(1, 2), (3, 4), (7, 9)]


def slow_groups(nodes, alike):
    taken, out = set(), []
    for a in sorted(nodes):
        if a not in taken:
            new = [b for b in nodes if b > a and b not in taken and alike(a, b)]
            taken.update(new)
            out += [(a, b) for b in new]
    return sorted(out)


def test_greedy_groups_belong_to_the_least_main(spark):
    # 3 turns out a main after 4 does, and comes before it
    late = [(1, 2), (2, 3), (3, 5), (4, 5)]
    assert sorted(map(tuple, pairs.greedy_groups(spark.createDataFrame(late, "a long, b long")).collect())) == [(1, 2), (3, 5)]
    rng = random.Random(14)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    got = pairs.greedy_groups(spark.createDataFrame(sorted(edges), "a long, b long"))
    assert sorted(map(tuple, got.collect())) == slow_groups(range(60), lambda a, b: (a, b) in edges)
    assert pairs.greedy_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(spark, path):
    """documents of near and exact copies, texts without words and missing ones; (id, words) of those with words."""
    rng = random.Random(15)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(20)] for _ in range(12)]
    texts = [" ".join(rng.sample(b, rng.choice((13, 16, 20)))) for b in base for _ in range(5)] + [" ".join(reversed(b)) for b in base[:4] for _ in range(2)] + ["alone", "Alone.", None, "", "...", "other"]
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return {i: frozenset(t.lower().replace(".", "").split()) for i, t in enumerate(texts) if t and t.strip(".")}


def test_dup_groups_hold_copies(spark, tmp_path):
    from textkin.plans import catalog

    words = near_texts(spark, tmp_path)
    want = slow_groups(list(words), lambda a, b: len(words[a] & words[b]) >= 0.6 * len(words[a] | words[b]) - 1e-9)
    assert sorted(map(tuple, catalog.queries()["dup_groups"](spark, str(tmp_path)).collect())) == want and any(words[a] == words[b] for a, b in want)


def test_best_match_may_be_a_copy(spark, tmp_path):
    from textkin.plans import catalog

    words = near_texts(spark, tmp_path)
    want = {}
    for a in words:
        alike = [(-len(words[a] & words[b]) / len(words[a] | words[b]), b) for b in words if b != a]
        score, b = min(alike)
        if -score >= 0.6 - 1e-9:
            want[a] = (b, round(-score, 6), 1)
    got = {r.id: (r.other, r.score, r["rank"]) for r in catalog.queries()["best_jaccard_match"](spark, str(tmp_path)).collect()}
    assert got == want and {s for _, s, _ in want.values()} > {1.0}


def test_components_and_dbscan(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (6, 7), (7, 8), (3, 9)], "a long, b long").selectExpr("least(a,b) a", "greatest(a,b) b")
    assert dict(map(tuple, graph.connected_components(edges).collect())) == {2: 1, 3: 1, 9: 1, 6: 5, 7: 5, 8: 5}
    items = spark.range(1, 11).withColumnRenamed("id", "item")
    got = {r.id: (r.label, r.is_noise) for r in graph.dbscan(items, "item", edges, 3).collect()}
    assert got[9] == (1, False) and got[5] == (6, False) and got[4] == (-1, True) and got[1] == (1, False)


def test_near_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(40, 8)), rng.normal(size=(1, 8)) + 0.1 * rng.normal(size=(40, 8))])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for least in (0.5, 0.9):
        want = {(a, b) for a, b in itertools.combinations(range(len(x)), 2) if u[a] @ u[b] >= least}
        got = [(r.a, r.b) for r in graph.near_vectors(df, "id", "v", least, pivots=7).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bfs(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (2, 4, 0.8), (3, 4, 0.9)], "a long, b long, score double")
    got = {r.node: (r.parent, r.level) for r in graph.bfs_levels(edges, spark.createDataFrame([(1,)], "root long")).collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (1, 1), 4: (3, 2)}


def test_token_bucket(spark):
    df = spark.sql("SELECT 1L AS user_id, id AS event_id, timestamp_seconds(id) AS ts FROM range(6)")
    got = [r.allowed for r in events.token_bucket(df, "user_id", 2, 0.5).orderBy("event_id").collect()]
    want, tokens, last = [], 2.0, 0
    for t in range(6):
        tokens = min(2.0, tokens + (t - last) * 0.5)
        last = t
        want.append(tokens >= 1)
        tokens -= tokens >= 1
    assert got == want


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "Болт", 1), (2, "Гайка", 2)], "id long, name string, v int")
    tables.save(df, f"{tmp_path}/c.csv", "csv")
    back = tables.load_catalog(spark, f"{tmp_path}/c.csv")
    assert back.count() == 2 and tables.name_column(back.columns) == "name" and tables.valid(back, ["id"]) and not tables.valid(back, ["x"])
    with pytest.raises(ValueError):
        tables.load_catalog(spark, "a.bin")
    tables.save_version(df, f"{tmp_path}/v", "1")
    tables.save_version(df.limit(1), f"{tmp_path}/v", "2")
    assert tables.latest_version(spark, f"{tmp_path}/v").count() == 1
    new = spark.createDataFrame([(2, "Гайка м", 3)], "id long, name string, v int")
    assert {r.id: r.name for r in tables.upsert(df, new, "id", "v").collect()} == {1: "Болт", 2: "Гайка м"}


def test_parameters_of_known_names(spark):
    from textkin.plans import catalog

    rows = catalog.queries()["extract_params"](spark, "/root/testdata/sf0.001").where("id < 0").collect()
    got = {(D.NAMES[-r.id - 1], r.pname): (r.value, r.unit) for r in rows}
    assert got["Болт М10х50 оцинкованный ГОСТ 7798-70", "gost"][0] == "гост 7798-70"
    assert got["Болт М10х50 оцинкованный ГОСТ 7798-70", "metric_thread"][0] == "10х50"
    assert got["Автомат 16 А 220 В", "current_direct"] == ("16", "а")
    # a value of one sign counts as a false match
    assert ("Насос давление 6 бар 1.5 кВт", "pressure") not in got and got["Насос давление 6 бар 1.5 кВт", "power_kw"] == ("1.5", "квт")
    assert got["Бак 25кг30л", "weight_volume_combined"] == ("25", "кг") and got["Бак 25кг30л", "volume_l"] == ("30", "л")
    assert got["Аккумулятор 2000 мач (2000mah)", "battery_capacity_mah"] == ("2000", "мач")
    assert got["Труба диаметр 50 мм длина 3 м", "diameter"] == ("50", "мм")


def test_specific_query_prefers_shared_words(spark):
    from textkin.plans import catalog

    rows = catalog.queries()["classify"](spark, "/root/testdata/sf0.001").where("id < 0").collect()
    got = {D.NAMES[-r.id - 1]: r.category for r in rows}
    assert got["Ледоход проф 10"] == "средства_защиты" and got["Болт м10х50 стальной"] == "крепеж" and got[""] == D.DEFAULT_CATEGORY


def test_every_noise_point_gets_members_of_near_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    axes = np.eye(8)
    points = [(10 * c + i, axes[c] + 0.05 * rng.standard_normal(8), c, False) for c in range(5) for i in range(7)]
    points += [(100 + i, axes[i % 5] + 0.9 * axes[(i + 1) % 5], -1, True) for i in range(10)]
    points += [(200, axes[7], -1, True)]  # near no cluster
    vectors = spark.createDataFrame([(i, [float(x) for x in e]) for i, e, _, _ in points], "id long, e array<double>")
    labels = spark.createDataFrame([(i, c, n) for i, _, c, n in points], "id long, label long, is_noise boolean")
    got = {(r.id, r.rank): r.other for r in graph.noise_analogs(vectors, labels).collect()}
    unit = {i: e / np.linalg.norm(e) for i, e, _, _ in points}
    mean = {c: np.mean([unit[i] for i, _, k, _ in points if k == c], axis=0) for c in range(5)}
    want = {}
    for i, _, _, noise in points:
        if noise:
            near = sorted(((unit[i] @ m / np.linalg.norm(m), c) for c, m in mean.items()), reverse=True)[:3]
            near = {c for cosine, c in near if cosine >= 0.4}
            best = sorted((-(unit[i] @ unit[j]), j) for j, _, c, n in points if not n and c in near)[:5]
            want |= {(i, r): j for r, (_, j) in enumerate(best, 1)}
    assert got == want and {i for i, _ in got} == set(range(100, 110))


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_class_pairs_in_small_pieces(spark, monkeypatch, least):
    """All pairs of classes, whatever a task holds at a time; copies don't come out, sets of very different sizes meet."""
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice((1, 3, 30, 90, 300)))] for _ in range(40)]
    texts = [" ".join(t) for t in base] + [" ".join(t[: int(len(t) * rng.uniform(0.5, 1))] + ["x", "y"][: rng.randint(0, 2)]) for t in base * 2] + [" ".join(reversed(t)) for t in base[:20]]
    for name, value in (("DEALT", 7), ("HELD", 50), ("LOOKED", 11), ("MET", 5), ("COMPARED", 3), ("CHECKED", 9)):
        monkeypatch.setattr(pairs, name, value)
    known = pairs.keyed(sets_of(spark, texts))
    got = [(r.a, r.b, round(r.score, 9)) for r in pairs.class_pairs(known, pairs.class_names(known), least).collect()]
    terms = {}
    for i, t in enumerate(texts):
        terms.setdefault(frozenset(t.split()), i)
    alike = [(a, b, len(x & y) / len(x | y)) for (x, a), (y, b) in itertools.combinations(terms.items(), 2)]
    assert sorted(got) == sorted((min(a, b), max(a, b), round(s, 9)) for a, b, s in alike if s >= least - 1e-12)


@pytest.mark.parametrize("least, n", [(0.8, 3), (0.9, 4), (0.97, 2), (0.9, 1)])
def test_density_labels_equal_dbscan_of_edges(spark, monkeypatch, least, n):
    """Labels without an edge table, in small pieces, equal those from all edges: several clusters, border points, noise, a missing vector."""
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 5]]) for i in range(90)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90, 120)] + [(120, None), (121, [0.0] * 4)]
    items = spark.createDataFrame(rows, "id long, v array<float>")
    monkeypatch.setattr(graph, "BLOCK", 9)
    monkeypatch.setattr(graph, "PIECE", 20)
    want = graph.dbscan(items, "id", graph.near_vectors(items, "id", "v", least), n)
    assert sorted(map(tuple, graph.density_labels(items, "id", "v", least, n).collect())) == [(i, -1, True) if v is None else r for r, (i, v) in zip(sorted(map(tuple, want.collect())), rows, strict=True)]


def test_density_grid_equals_dbscan_of_each_cell(spark, monkeypatch, tmp_path):
    """Five by four cells in small pieces: clusters, noise, clusters an item by what isn't noise, and the best cell; a missing and a zero vector."""
    from textkin.plans import catalog

    rng = random.Random(16)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in centres[i % 6]]) for i in range(60)] + [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60, 90)] + [(90, None), (91, [0.0] * 5)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(graph, "BLOCK", 9)
    monkeypatch.setattr(graph, "PIECE", 40)
    leasts, numbers, want = (0.75, 0.8, 0.85, 0.9, 0.95), (2, 3, 4, 5), {}
    pairs_at = {(r.a, r.b): r.cosine for r in graph.near_vectors(items, "vec_id", "embedding", leasts[0]).collect()}
    near = {least: {i: {a + b - i for (a, b), c in pairs_at.items() if c >= least and i in (a, b)} for i, _ in rows} for least in leasts}
    for least in leasts:
        for n in numbers:
            cores = {i for i, met in near[least].items() if len(met) + 1 >= n}
            left, clusters = set(cores), 0
            while left:
                clusters, front = clusters + 1, {left.pop()}
                while front:
                    front = set().union(*(near[least][i] for i in front)) & left
                    left -= front
            noise = sum(i not in cores and not near[least][i] & cores for i in near[least]) / len(rows)
            want[least, n] = (clusters, pytest.approx(noise), pytest.approx(clusters / len(rows) * (1 - noise)))
    got = graph.density_grid(items, "vec_id", "embedding", leasts, numbers, (0.99, 2)).collect()
    assert {(r.least_cosine, r.min_samples): (r.clusters, r.noise, r.quality) for r in got} == want and len(got) == 20
    best = max(got, key=lambda r: (r.quality, r.least_cosine, -r.min_samples))
    assert [r for r in got if r.chosen] == [best] and len({r.clusters for r in got}) > 5
    apart = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], items.schema)
    apart.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, catalog.queries()["dbscan_grid"](spark, str(tmp_path)).collect()))
    assert len(got) == 21 and [r for r in got if r[5]] == [(0.7, 2, 0, 1.0, 0.0, True)] and {r[2:5] for r in got} == {(0, 1.0, 0.0)}


def test_nearest_equals_brute_force(spark, monkeypatch):
    """Exact in small pieces, with ties, a zero vector and fewer vectors than asked for."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(60, [0.0] * 3), (61, [1.0, 2.0, 2.0]), (62, [2.0, 4.0, 4.0]), (63, None)]
    monkeypatch.setattr(graph, "BLOCK", 7)
    monkeypatch.setattr(graph, "PIECE", 9)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    known = [(i, v) for i, v in rows if v and any(v)]
    for k in (4, 99):
        want = {(q, i, r) for q, a in known if q % 3 == 1 for r, (_, i) in enumerate(sorted((-round(cosine(a, b), 6), i) for i, b in known if i != q)[:k], 1)}
        assert {(r.qid, r.id, r["rank"]) for r in graph.nearest(df, df.where("id % 3 = 1"), k).collect()} == want


def test_cluster_search_equals_brute_force(spark, monkeypatch, tmp_path):
    """Every twentieth vector's analogs among all, in small pieces, from labels and cosines of all pairs; clusters, noise, copies, a missing vector."""
    import numpy as np

    from textkin.plans import catalog

    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 6))
    vectors = [*(centres[i % 6] + 0.3 * rng.normal(size=6) for i in range(150)), *rng.normal(size=(60, 6)), *[centres[0]] * 12]
    rows = [(i, [*map(float, v), 0.0], 0) for i, v in enumerate(vectors)] + [(240, None, 0), (260, [0.0] * 7, 0)]
    rows += [(i, [0.0] * 5 + [x, 1.0], 0) for i, x in ((280, 0.0), (281, 0.1))]  # a pair of its own: noise with a neighbour
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(graph, "BLOCK", 9)
    monkeypatch.setattr(graph, "PIECE", 60)
    least, most = 0.9, 10
    edges = {(r.a, r.b): r.cosine for r in graph.near_vectors(df, "vec_id", "embedding", least).collect()}
    edges |= {(b, a): c for (a, b), c in edges.items()}
    v = df.selectExpr("vec_id AS id", "embedding AS v")
    with monkeypatch.context() as m:
        m.setattr(graph, "PIECE", 4)
        near = {(r.qid, r.id): round(r.score, 9) for r in graph.neighbours(v, v.where("id % 20 = 0"), least).collect()}
    assert near == {(a, b): pytest.approx(c, abs=1e-6) for (a, b), c in edges.items() if a % 20 == 0}
    labels = graph.dbscan(df, "vec_id", spark.createDataFrame([(a, b) for a, b in edges if a < b], "a long, b long"), 3)
    given = {}
    for r in graph.noise_analogs(df.selectExpr("vec_id AS id", "embedding AS e"), labels).collect():
        given.setdefault(r.id, {})[r.other] = r.score
    of, want = {r.id: (r.label, r.is_noise) for r in labels.collect()}, set()
    for q in range(0, 300, 20):
        if q not in of:
            continue
        near = {b: c for (a, b), c in edges.items() if a == q}
        own = {b: c for b, c in near.items() if not of[q][1] and of[b][0] == of[q][0]}
        set_by = {b: c for b, c in given.get(q, {}).items() if c >= least}
        rest = sorted((-round(c, 6), b) for b, c in near.items() if b not in own and b not in set_by)[: max(0, most - len(own) - len(set_by))]
        want |= {(q, b, round(c, 5), "cluster") for b, c in own.items()} | {(q, b, round(c, 5), "assigned") for b, c in set_by.items()} | {(q, b, round(-c, 5), "global") for c, b in rest}
    got = catalog.queries()["cluster_search"](spark, str(tmp_path), least, most).collect()
    assert sorted((r.id, r.other, r.origin) for r in got) == sorted((q, b, o) for q, b, _, o in want) and {o for *_, o in want} >= {"cluster", "global"}
    score = {(q, b): s for q, b, s, _ in want}
    assert all(abs(r.score - score[r.id, r.other]) < 2e-5 for r in got)
    for q in {r.id for r in got}:
        assert [r.other for r in sorted((r for r in got if r.id == q), key=lambda r: r["rank"])] == [r.other for r in sorted((r for r in got if r.id == q), key=lambda r: (-r.score, r.other))]

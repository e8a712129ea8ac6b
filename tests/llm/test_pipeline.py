"""The pipeline's stages against plain versions of them."""

import itertools
import random
from collections import Counter

import corpus_pipeline as P
from textkin.llm import line_rules, quality_model, simhash
from textkin.llm.common import bucket_of, connected_components, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "mix_sources", "bpe_tokens"]
    first = written(P.quality_rules(spark, docs, SF))
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in line_rules.op9_line_rules(spark, SF).where("kept").collect()}
    second = written(P.quality_classifier(spark, first, SF))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {r.doc_id for r in first.where(bucket_of(first.doc_id) == 2).collect()}
    kept = {r.doc_id for r in second.collect()}
    assert second.columns == columns and sum(labels.get(i) == 1 and i not in kept for i in held) <= 1
    third = written(P.near_dedup(spark, second, SF))
    rows = {r.doc_id: set(simhash.shingle_hashes(r.text.encode(), P.SHINGLE).tolist()) for r in second.collect()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(rows), 2):
        if len(rows[a] & rows[b]) >= P.SIMILARITY * len(rows[a] | rows[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == sorted({find(i) for i in rows})
    fourth = written(P.mix_sources(spark, third, SF))
    assert fourth.columns == columns and 0 < fourth.count()
    assert max(Counter(r.doc_id for r in fourth.collect()).values()) <= P.MAX_EPOCHS
    last = P.bpe_tokens(spark, fourth, SF)
    assert last.count() == fourth.count() and last.where("n_tokens <> size(token_ids)").count() == 0
    assert P.run(spark, SF).count() == fourth.count()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(300, 300)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{101 + i: 100 for i in range(30)}}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert quality_model.ACCEPT == 0.7


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, group = [], []
    for g in range(30):
        base = [word() for _ in range(rng.choice([60, 400]))]
        for k in range(4):  # itself, an exact copy, and copies with one changed word in sixty
            copy = list(base)
            if k >= 2:
                for at in range(k, len(base), 60 * 4):
                    copy[at] = word()
            texts.append(" ".join(copy))
            group.append(g)
    found = simhash.wide_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 4 * g for i, g in enumerate(group)}


def test_near_dedup_is_exact_in_template_groups_and_short_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for g in range(6):  # templates with own words at the end: similarities around 0.8
        base = [word() for _ in range(80)]
        for own in (2, 7, 8, 9, 10, 11, 12):
            texts += [" ".join(base + [word() for _ in range(own)]) for _ in range(8)]
    for _ in range(60):  # 4 and 5 shingles, 4 in common: 0.8
        short = [word() for _ in range(9)]
        texts += [" ".join(short), " ".join(short[:8])]
    texts += ["", " ", None, "one", "ONE", "one two"]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = simhash.wide_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: find(i) for i in range(len(texts))}

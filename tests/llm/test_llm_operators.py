"""The operators against brute force, the library they must equal, held-out accuracy, and edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textkin.llm import bpe, language, line_rules, mixing, quality_model, revisits, sharding, simhash, token_counts, weighted_sampling

SF = "/root/testdata/sf0.001"
EXTRA = "CAST(1 AS INT) AS kept, 'x' AS fp, 2.0 AS score, 'y' AS component_id, 3 AS shard, 'z' AS token_ids, 4 AS epoch, 5 AS rank, 'q' AS host, 6 AS n_words"
LONG = " ".join(f"word{i % 977} tail" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, "a b c d e f g h i j k", "en", "s"), (1, "a b c d e f g h i j k", "en", "s"), (2, "a b c d e f g h i j k", "en", None), (3, None, "de", "s"), (4, "", None, "s"), (None, "one two three four five six seven eight nine ten eleven", "fr", "t"), (None, None, None, None), (5, LONG, "en", "s"), (6, " \n\t ", "es", "s"), (7, "Überall ßß", "de", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *EXTRA.split(", "))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# 1


def brute_components(fps):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def brute_fingerprint(text, k=3):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: brute_fingerprint(t) for i, t in text.items()}
    root = brute_components(set(fp.values()))
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fp.items()}


@pytest.mark.parametrize(("radius", "parts"), [(3, 4), (3, 3), (3, 2), (5, 4), (0, 1)])
def test_pigeonhole_loses_no_link(spark, radius, parts):
    rng = random.Random(radius + parts)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:  # a dense ball and strangers
        x = centre if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {frozenset(map(signed, p)) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= radius}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    assert {frozenset((r.a, r.b)) for r in simhash.links(df, radius, parts).collect()} == want


def test_allocation_is_cheapest():
    rng = np.random.default_rng(0)
    costs = rng.random((3, 20, 5))
    got = simhash.allocate(costs)
    for q in range(20):
        best = min(sum(costs[i, q, u] for i, u in enumerate(us)) for us in itertools.product(range(5), repeat=3) if sum(us) == 4)
        assert got[q].sum() == 4 and sum(costs[i, q, u] for i, u in enumerate(got[q])) == pytest.approx(best)


def test_simhash_edges(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and not simhash.near_duplicates(empty).count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {3}
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "7", "None"]


# 2


@pytest.mark.parametrize("run", [2, 4096])
def test_separator_scan(spark, run, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN", run)
    rng = random.Random(run)
    blocks, want = [], {}
    for f in range(6):
        lengths = [rng.choice([0, 1, 3, 50, 200]) for _ in range(12)]
        ids = [x for n in lengths for x in [7] * n + [9]] + [7] * (f * 3)
        want[f"f{f}"] = lengths + ([f * 3] if f else [])
        size = rng.choice([1, 5, 16])
        blocks += [(f"f{f}", k, np.array(ids[at : at + size], "<u2").tobytes()) for k, at in enumerate(range(0, len(ids), size))]
    got = token_counts.count_tokens(spark.createDataFrame(blocks, "file string, block long, data binary"), 9).collect()
    for f, lengths in want.items():
        own = sorted((r.block, r.place if r.place >= 0 else 1 << 30, r.n_tokens) for r in got if r.file == f)
        assert [n for *_, n in own] == lengths
    assert token_counts.count_tokens(spark.createDataFrame([], "file string, block long, data binary"), 9).count() == 0
    assert token_counts.count_tokens(spark.createDataFrame([("e", 0, None)], "file string, block long, data binary"), 9).count() == 0


def test_flat_files(spark, tmp_path):
    np.array([1, 2, 9, 9, 5], "<u2").tofile(tmp_path / "a.bin")
    blocks = token_counts.read_blocks(spark, str(tmp_path), block_tokens=2)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(blocks, 9).collect()) == [0, 1, 2]


def test_token_counts_of_documents(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in token_counts.op2_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: len(e.encode_ordinary(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# 3


def test_revisits(spark):
    shape = "record_id long, url string, ts long, record_type string, etag string, last_modified long, headers map<string,string>, payload string, block string"
    rows = [
        (1, "http://www.A.com/x/", 10, "response", "e1", None, {"server": "s", "date": "d1", "content-length": "5"}, "p", "b"),
        (2, "https://a.com/x#f", 20, "response", "e2", 7, {"server": "s2"}, None, "b"),
        (3, "http://a.com:80/x?ref=q", 30, "revisit", 'W/e2', None, {"Date": "d3", "date": "d3", "content-length": "0"}, None, "b"),
        (4, "http://a.com/x", 20, "revisit", "e1", None, None, None, "b"),
        (5, "http://a.com/x", 10, "revisit", "e1", None, None, None, "b"),
        (6, "http://a.com/x", 99999, "revisit", None, 8, None, None, "b"),
        (7, "http://a.com/x", 99999, "revisit", None, None, None, None, "b"),
        (8, None, 5, "revisit", "e", None, None, None, "b"),
        (9, "http://a.com/x", None, "revisit", "e", None, None, None, "b"),
        (10, "http://a.com/x", 99999, "revisit", None, 7, None, None, "b"),
    ]
    df = spark.createDataFrame(rows, shape)
    for block in (4, 1024, 10**6):
        got = {r.record_id: r for r in revisits.resolve(df, block).collect()}
        assert {k: (r.outcome, r.refers_to) for k, r in got.items()} == {3: ("resolved", 2), 4: ("resolved", 1), 5: ("no response", None), 6: ("changed", None), 7: ("no validator", None), 8: ("no response", None), 9: ("no response", None), 10: ("resolved", 2)}
        assert got[3].merged_headers == {"server": "s2", "Date": "d3", "date": "d3"}
        assert got[4].merged_headers == {"server": "s", "date": "d1", "content-length": "5"}
    assert revisits.resolve(df.limit(0)).count() == 0


def test_resolved_revisits_have_the_payload(spark):
    shape = "record_id long, url string, ts long, record_type string, etag string, last_modified long, headers map<string,string>, payload string"
    rows = [(1, "http://a.com/x", 10, "response", "e1", None, {}, "first"), (2, "http://a.com/x", 50, "response", "e2", None, {}, "second"), (3, "http://a.com/y", 5, "response", "e3", None, {}, None)]
    rows += [(10 + i, "http://a.com/x", 20 + i, "revisit", "e1", None, {}, "not this") for i in range(20)]
    rows += [(40, "http://a.com/x", 60, "revisit", "e2", None, {}, None), (41, "http://a.com/x", 60, "revisit", "e1", None, {}, "nor this"), (42, "http://a.com/y", 60, "revisit", "e3", None, {}, "nor this")]
    got = revisits.resolve(spark.createDataFrame(rows + [rows[0], rows[3]], shape)).collect()
    want = {**{10 + i: "first" for i in range(20)}, 40: "second", 41: None, 42: None}
    assert len(got) == 24 and all(r.payload == want[r.record_id] for r in got) and {r.record_id for r in got} == set(want)
    # the query's lengths are those of payloads, whatever the headers say
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html or "" for r in pages.collect()}
    captures = revisits.captures_of(pages).withColumn("headers", F.create_map(F.lit("content-length"), F.lit("-1")))
    found = [r for r in revisits.resolve(captures).collect() if r.outcome == "resolved"]
    assert found and all(r.payload == html[r.refers_to // 2] for r in found)


def test_revisits_equal_sql(spark):
    import harness

    harness.compare(spark, revisits.op3_revisits, revisits.OP3_SQL, SF)


# 4


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards(spark, odd, empty):
    rows = sharding.op4_histogram_shards(spark, SF).collect()
    check_shards(rows, 24)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" for r in rows)
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    assert len(total) == 24 and max(total.values()) - min(total.values()) <= 2 * max(r.size for r in rows)
    for df in (odd.withColumn("k", F.col("doc_id")), empty.withColumn("k", F.col("doc_id"))):
        out = sharding.histogram_shards(df.withColumn("size", F.length("text").cast("long")), 5, "k", "size")
        assert out.count() == df.count()
        check_shards(out.collect(), 5)


def test_splitters_of_one_hot_key(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5L ELSE id << 40 END AS key", "1L AS size")
    cuts = sharding.splitters(df, 8, 0.001)
    assert cuts == sorted(cuts) and len(cuts) == 7
    assert sharding.histogram_shards(df, 8, "key", "size").groupBy("shard").count().count() >= 5


# 5


def test_weighted_sampling_estimates_jaccard():
    rng = random.Random(5)
    sampler, errors = weighted_sampling.Sampler(), []
    for _ in range(60):
        a = [rng.choice("abcdefghijklmnopqrst") for _ in range(60)]
        b = a[: rng.randrange(61)] + [rng.choice("uvwxyzabc") for _ in range(20)]
        x, y = Counter(a), Counter(b)
        errors.append(weighted_sampling.likeness(sampler.signature(" ".join(a)), sampler.signature(" ".join(b))) - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def test_forgetting_changes_nothing(monkeypatch):
    want = weighted_sampling.Sampler().signature(LONG)
    monkeypatch.setattr(weighted_sampling, "CACHED_TERMS", 100)
    assert (weighted_sampling.Sampler().signature(LONG) == want).all()


def test_compared(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = dict(sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True))
    ids = list(text)
    sampler = weighted_sampling.Sampler()
    for parts in (1 << 30, 40_000):
        weighted_sampling.RANGE_BYTES, old = parts, weighted_sampling.RANGE_BYTES
        try:
            got = {r.doc_id: r for r in weighted_sampling.compared(docs).collect()}
        finally:
            weighted_sampling.RANGE_BYTES = old
        assert set(got) == set(ids)
        for k, i in enumerate(ids):
            following = text[ids[(k + 1) % len(ids)]]
            cut = len(text[i]) // 3
            changed = text[i][: len(text[i]) - cut] + following[:cut]
            assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(text[i])
            assert got[i].fingerprint == weighted_sampling.written_out(sampler.signature(text[i])) and got[i].near_next == weighted_sampling.likeness(sampler.signature(text[i]), sampler.signature(following))
    rows = weighted_sampling.compared(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 for r in rows)
    assert weighted_sampling.compared(empty).count() == 0 and weighted_sampling.compared(odd.where("doc_id = 7")).first().near_next == 1.0


# 6


def test_language(spark, odd, empty):
    held = {r.doc_id: r for r in language.op6_language(spark, SF).collect()}
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in held.items())
    mine = [r for r in held.values() if r.held_out]
    assert np.mean([want[r.doc_id] == r.lang_pred for r in mine]) >= 0.9
    model = language.fit(odd)
    rows = language.identify(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and sum(r.lang_pred == "und" for r in rows) == 4
    none = language.fit(empty)
    assert {r.lang_pred for r in language.identify(odd, none, ["doc_id"]).collect()} == {"und"} and language.identify(empty, model, ["doc_id"]).count() == 0


# 7


def test_spread():
    assert mixing.spread(100, [(1, 10), (1, 1000), (2, 1000)]) == pytest.approx([10, 30, 60])
    assert mixing.spread(100, [(1, 10), (1, 20)]) == pytest.approx([10, 20])
    assert mixing.spread(0, [(1, 10)]) == [0] and mixing.spread(10, []) == []
    plan = mixing.budgets([(("a", "x"), 10.0), (("a", "y"), 1000.0), (("b", "x"), 1000.0)], lambda n: 1.0, 200, 1)
    assert plan == pytest.approx({("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100})  # a sibling takes the shortage, not the other domain


def test_mix_equals_brute_force(spark):
    got = Counter((r.doc_id, r.epoch) for r in mixing.op7_mixing(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("domain", mixing.domain_of(F.col("source"))).collect()
    leaves = {}
    for r in docs:
        leaves.setdefault((r.domain, r.lang, r.source), []).append((r.doc_id, len(r.text.split())))
    sizes = {k: sum(n for _, n in v) for k, v in leaves.items()}
    plan = mixing.budgets([(k, float(n)) for k, n in sizes.items()], mixing.target_weight, 0.5 * sum(sizes.values()), 2)
    want = Counter()
    for k, v in leaves.items():
        for e in range(2):
            left, before = plan[k] - e * sizes[k], 0
            for i, n in sorted(v, key=lambda x: hashlib.md5(f"42:{e}:{x[0]}".encode()).hexdigest()):
                if left > 1e-9 and before + n / 2 <= left:
                    want[i, e] += 1
                before += n
    assert got == want


def test_mix_edges(spark, odd, empty):
    for df in (odd, empty):
        sized = df.withColumn("domain", F.lit("d")).withColumn("n_tokens", F.length("text"))
        out = mixing.mix(sized, mixing.target_weight, 1.0, 1)
        # the leaves (null language, s), (null, null) and (de, s) hold no token
        assert out.count() == max(0, df.count() - 3)


# 8


def test_bpe_equals_the_library(spark, odd, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), bpe.RankBPE(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    rng = random.Random(8)
    signs = "abcdeABC 'sSd\n\t12٣é É Σσς İ ß ﬁ 中文 नमस्ते 😀 <|endoftext|> don't — # ! ??   "
    texts = ["", " ", LONG[:5000], "x" * 3000, "ab" * 400 + "é" * 300, "<|startoftext|><|endoftext|>x", "é É"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.op8_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert rows[r.doc_id].n_tokens == len(ids) and rows[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    out = bpe.encode(odd, P.path("word_bpe_49k.json"), decoded_col="decoded")
    assert out.count() == odd.count() and out.where("text IS NULL").first().decoded == "" and bpe.encode(empty, P.path("word_bpe_49k.json")).count() == 0


def test_both_merge_orders_agree():
    import public_tokenizers as P

    own = bpe.RankBPE(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.choice(own.inner) for _ in range(rng.randint(0, 60))]
        assert own.merge_short(list(ids)) == own.merge_long(list(ids))


# 9


def test_line_rules_equal_sql(spark):
    import harness

    harness.compare(spark, line_rules.op9_line_rules, line_rules.OP9_SQL, SF)


def test_line_rules_remove_boilerplate(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"Shared footer line number one\n{own(i)}", "h") for i in range(20)]
    rows += [(100 + i, f"Shared  FOOTER line number one\nw{i}", "h") for i in range(20)]  # nothing else left
    rows += [(200 + i, f"Shared footer line number one\n{own(i)}", f"h{i}") for i in range(3)]
    rows += [(300 + i, own(7) + "\nthe same text in forty rows", "h") for i in range(40)]  # copies count once
    got = {r.id: r for r in line_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 5 for i in range(20)) and not any(got[100 + i].kept for i in range(20))
    assert all(got[200 + i].n_removed_words == 0 for i in range(3)) and all(got[300 + i].kept and not got[300 + i].n_removed_words for i in range(40))


def test_line_rules_return_texts_without_boilerplate(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"Intro {own(i)}\n\n Shared  FOOTER line\tnumber one\r\nlast  line of {i}\n", "h") for i in range(20)]
    rows += [(100 + i, f"Shared footer line number one\n{own(i)}", f"h{i}") for i in range(3)]  # not boilerplate there
    rows += [rows[0], (None, rows[1][1], "h"), (None, rows[1][1], "h")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in line_rules.filtered(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    left = lambda i: f"Intro {own(i)}\n\nlast  line of {i}\n"
    assert got == sorted([(i, left(i)) for i in range(20)] + [(100 + i, f"Shared footer line number one\n{own(i)}") for i in range(3)] + [(0, left(0)), (-1, left(1)), (-1, left(1))])


def test_line_rules_edges(spark, odd, empty):
    rows = line_rules.verdicts(odd).collect()
    assert len(rows) == odd.count() and line_rules.verdicts(empty).count() == 0
    assert sum(r.n_words == 0 for r in rows) == 4 and next(r for r in rows if r.id == 5).base_failed
    kept = line_rules.filtered(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "None"]


# 10


def test_quality(spark, odd, empty):
    rows = quality_model.op10_quality_model(spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    held = rows[rows.held_out].join(labels, how="inner")
    assert (held.predicted == held.quality).mean() >= 0.85 and (rows.predicted == (rows.score >= 0.7)).all() and rows.score.between(0, 1).all()
    one = spark.createDataFrame([(1, 1), (2, 1), (5, 0), (None, 1), (7, None), (1, 1)], "doc_id long, quality int")
    for df in (odd, empty):
        for known in (one, one.limit(0)):
            assert quality_model.scored(df, quality_model.fit(df, known)).count() == df.count()


def test_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (400, 5)).astype(np.float32), rng.normal(-1, 1, (400, 5)).astype(np.float32)
    model = quality_model.train(good[:200], np.concatenate([good[200:], bad]), 1 / 3)
    assert (model.score(good[200:]) >= 0.5).mean() > 0.85 and (model.score(bad) < 0.5).mean() > 0.9
    assert pd.notna(quality_model.share_like(good[:200], np.concatenate([good[200:], bad])))


def test_header_names_have_no_case(spark):
    shape = "record_id long, url string, ts long, record_type string, etag string, last_modified long, headers map<string,string>, payload string"
    rows = [(1, "a.com/x", 1, "response", "e", None, {"Date": "old", "Server": "s", "Content-Length": "5"}, "p"), (2, "a.com/x", 2, "revisit", "e", None, {"date": "new", "Server": "t"}, None), (3, "a.com/x", 3, "revisit", "e", None, None, None)]
    got = {r.record_id: r.merged_headers for r in revisits.resolve(spark.createDataFrame(rows, shape)).collect()}
    assert got == {2: {"date": "new", "Server": "s", "Content-Length": "5"}, 3: {"Date": "old", "Server": "s", "Content-Length": "5"}}


def test_shards_of_narrow_keys_are_many_ranges(spark):
    df = spark.range(200_000).selectExpr("id AS k", "1L AS size")
    out = sharding.histogram_shards(df, 4, "k", "size")
    assert out.groupBy("shard").count().count() == 4
    check_shards(out.collect(), 4)


def test_shards_equal_a_plain_sort(spark):
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(62), rng.randint(1, 500)) for i in range(3000)]
    got = {r.id: (r.shard, r.slot) for r in sharding.histogram_shards(spark.createDataFrame(rows, "id long, k long, size long"), 7, "k", "size", 1e-9).collect()}
    total, below, want = sum(r[2] for r in rows), 0, Counter()
    for i, _, size in sorted(rows, key=lambda r: r[1]):
        assert abs(got[i][0] - min(6, below * 7 // total)) <= 1  # a row that crosses a target may lie on either side
        assert got[i][1] == want[got[i][0]]
        want[got[i][0]] += 1
        below += size


def test_mix_keeps_other_columns_of_its_outputs_names(spark):
    df = spark.createDataFrame([(i, "d", "en", "s", 10, f"e{i}") for i in range(20)] + [(None, "d", "en", "s", 10, f"n{i}") for i in range(20)], "doc_id long, domain string, lang string, source string, n_tokens long, epoch string")
    out = mixing.mix(df, lambda n: 1.0, 0.5, 1, out=("_e", "_b", "_t"))
    rows = out.collect()
    assert len(rows) == 20 and {r.epoch[0] for r in rows} <= {"e", "n"} and sorted(r._t for r in rows) == list(range(0, 200, 10))
    assert sorted(map(str, rows)) == sorted(map(str, out.collect()))


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        good = rng.normal(1.5, 1, (1500, 4)).astype(np.float32)
        web = np.concatenate([rng.normal(1.5, 1, (int(1000 * share), 4)), rng.normal(-1.5, 1, (1000 - int(1000 * share), 4))]).astype(np.float32)
        assert abs(quality_model.share_like(good, web[rng.permutation(1000)]) - share) < 0.07


def test_samples_are_bounded_under_repeated_ids(spark):
    df = spark.range(50_000).selectExpr("CAST(1 AS BIGINT) AS doc_id", "'same text' AS text", "1 AS quality")
    assert quality_model.lowest(df.select("doc_id", "text"), ["doc_id", "text"], 100, 50_000).count() <= 1
    assert language.fit(df.withColumn("lang", F.lit("en"))).langs in (["en"], [])


def test_sampling_equals_a_plain_version():
    from xxhash import xxh64_intdigest

    def mix64(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    text = "a b b c c c d d d d e f g a A"
    words = Counter(text.lower().split())
    sampler = weighted_sampling.Sampler()
    got = sampler.signature(text)
    for draw in range(0, 64, 7):
        best = None
        for w, n in words.items():
            h = xxh64_intdigest(w.encode(), 7)
            bits = [mix64(h ^ mix64((1 + kind * 64 + draw) * 0x9E3779B97F4A7C15 % 2**64 + 42)) for kind in range(3)]
            high, low = ([((b >> 32) + 0.5) / 2**32 for b in bits], [((b & 0xFFFFFFFF) + 0.5) / 2**32 for b in bits])
            r, c, beta = -np.log(high[0]) - np.log(low[0]), -np.log(high[1]) - np.log(low[1]), high[2]
            t = int(np.floor(np.log(n) / r + beta))
            a = np.log(c) - r * (t - beta + 1)
            if best is None or a < best[0]:
                best = (a, mix64(h ^ (t % 2**64) * 0x9E3779B97F4A7C15 % 2**64) & 0xFFFF)
        assert best[1] == got[draw]

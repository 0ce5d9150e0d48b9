"""Resampling, sharding and spelling variants against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crestline.llm import importance, sharding, variants
from crestline.llm.queries import QUERIES
from crestline.llm.shared import scratch, table, written

SF = "/root/testdata/sf0.001"
CLASHES = "size slot shard piece place rank score weight word n i h run segment before text_crc32 t eligible".split()
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    long = " ".join(f"word{k % 977} and Ähnliche" for k in range(60_000))
    rows = [(1, "The quick brown fox. " * 9), (1, "The quick brown fox. " * 9), (1, "another text " * 12), (2, None), (3, ""), (4, " \n\t "), (5, "12345 !!!"), (6, long), (None, "null id and text " * 10), (None, None), (8, "\U0001f600 \x00 日本語 текст"), (9, "z" * 3_000_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


# --- resampling


def features_of(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def expected(rows, target, longest=1, buckets=10_000, least_words=20, share=10):
    of = {k: features_of(x, longest) for k, x in rows.items()}
    at = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(at(w) for _, f in of.values() for w in f), Counter(at(w) for x in target for w in features_of(x, longest)[1])
    alls, allt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets)))) for b in s}
    out = {}
    for k, (words, f) in of.items():
        weight = sum(gain[at(w)] for w in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
        out[k] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)]
    order = sorted((k for k, v in out.items() if v[4] >= least_words), key=lambda k: (-out[k][2], k))
    for r, k in enumerate(order[: share * len(order) // 100], 1):
        out[k][3] = r
    return {k: tuple(v[:4]) for k, v in out.items()}


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_brute_force(spark, docs, texts, longest, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 100)  # n-grams cross the borders of chunks
    bench = table(spark, SF, "benchmark")
    want = expected(texts, [r["text"] for r in bench.collect()], longest)
    found = importance.resampled(docs.repartition(5), bench, longest=longest).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize(("segment_rows", "share"), [(40, 10), (7, 100), (1, 37), (10**6, 50)])
def test_ranks_with_ties_and_repeats(spark, segment_rows, share):
    """A score and an id that a third of all rows share, and ids that are null, over many segments."""
    rows = spark.range(3_000).repartition(6).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 40).alias("score"), (F.col("id") % 10 != 2).alias("eligible"))
    runs = rows.select("doc_id", F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), "score", "eligible").sortWithinPartitions(*importance.in_order()[:3])
    runs = written(runs.withColumn("place", F.monotonically_increasing_id()), "test-runs")
    got = importance.ranked(runs, (share, 100), segment_rows).collect()
    want = sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in runs.where("eligible").collect())
    ranks = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranks] == [*range(1, share * len(want) // 100 + 1)]
    assert [r[1:] for r in ranks] == want[: len(ranks)] and len(got) == 3_000


def test_segments_are_even(spark):
    runs = spark.range(20_000).repartition(7).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("score"), F.lit(True).alias("eligible")).sortWithinPartitions("doc_id")
    runs = written(runs.withColumn("place", F.monotonically_increasing_id()), "test-runs")
    sizes = [r["count"] for r in importance.segment(runs, importance.splitters(runs, 20_000, 20)).groupBy("segment").count().collect()]
    assert len(sizes) >= 18 and max(sizes) < 1.5 * 20_000 / 20


def test_resampling_odd(spark, odd):
    bench = table(spark, SF, "benchmark")
    found = importance.resampled(odd, bench, share=(50, 100)).collect()
    assert len(found) == odd.count() and sorted(r["rank"] for r in found if r["rank"]) == [1, 2]
    assert {r["n_features"] for r in found if r["doc_id"] in (2, 3, 4)} == {0} and next(r for r in found if r["doc_id"] == 9)["n_features"] == 1
    assert importance.resampled(odd.where("false"), bench).count() == 0
    assert importance.resampled(odd, bench.where("false")).count() == odd.count()
    assert importance.resampled(odd.where("doc_id is null"), bench, share=(100, 100), least_words=0).where("rank is null").count() == 0


# --- sharding


def test_shards_are_even_and_gapless(docs):
    spark = docs.sparkSession
    got = sharding.balanced(docs, scratch(spark, "test-map"), 4).collect()
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert max(loads.values()) < 1.02 * sum(loads.values()) / 4 and len(got) == len(texts)
    for k in range(4):
        assert sorted(r["place_in_shard"] for r in got if r["shard"] == k) == [*range(sum(r["shard"] == k for r in got))]


def test_versions_move_little_and_growing_fills_the_new_shard(docs):
    spark = docs.sparkSession
    path = scratch(spark, "test-map")
    records = sharding.measured(docs, slots=64)
    records = records.withColumn("piece", sharding.pieces_of(records, 4))
    sharding.publish(sharding.even_map(spark, 4, 64), path, 1)
    two = sharding.rebalance(records, path, 1, 4)
    three = sharding.rebalance(records, path, 2, 5, grown=True)
    maps = [{(r["slot"], r["piece"]): r["shard"] for r in sharding.at_version(spark, path, v).collect()} for v in (1, 2, 3)]
    assert {s for s, _ in maps[0]} == {s for s, _ in maps[2]} == {*range(64)} and two.count() == three.count() == 64
    assert 0 < sum(maps[1][k] != maps[0][k] for k in maps[0]) < 48
    moved = [k for k in maps[1] if maps[2][k] != maps[1][k]]
    assert moved and all(maps[2][k] == 4 for k in moved)
    loads = Counter()
    for r in sharding.assigned(records, three).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.2 * sum(loads.values()) / 5
    same = sharding.sharded(docs, sharding.at_version(spark, path, 2), slots=64)
    assert {r["doc_id"]: r["shard"] for r in same.collect()} == {r["doc_id"]: maps[1][(zlib.crc32(str(r["doc_id"]).encode()) % 64, 0)] for r in docs.select("doc_id").collect()}


def test_an_id_of_a_third_of_all_rows_is_split(spark):
    docs = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("ab "), 40).alias("text"))
    got = sharding.balanced(docs, scratch(spark, "test-map"), 8).collect()
    loads = Counter(r["shard"] for r in got)
    assert len(got) == 3_000 and len(loads) == 8 and max(loads.values()) < 1.05 * 3_000 / 8
    assert len({(r["shard"], r["place_in_shard"]) for r in got}) == 3_000


def test_sharding_odd(spark, odd):
    got = sharding.balanced(odd, scratch(spark, "test-map"), 3).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1} and all(r["shard"] in (0, 1, 2) for r in got)
    path = scratch(spark, "test-map")
    assert sharding.balanced(odd.where("false"), path, 3).count() == 0 and sharding.at_version(spark, path, 2).count() == sharding.SLOTS
    out = sharding.sharded(odd, sharding.at_version(spark, path, 2))
    assert out.columns == [c for c in odd.columns if c != "shard"] + ["shard"] and out.where("shard is null").count() == 0


# --- spelling variants


def near(words):
    by = {}
    for w in words:
        for k in range(len(w)):
            by.setdefault((k, w[:k] + w[k + 1 :], len(w)), set()).add(w)
    out = {w: set() for w in words}
    for v in by.values():
        for w in v:
            out[w] |= v - {w}
    for w in words:
        for k in range(len(w)):
            if (d := w[:k] + w[k + 1 :]) in out:
                out[w].add(d)
                out[d].add(w)
    return out


def expected_words(rows, slip=199, least=5, letters=6):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(UPPER)):
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= letters
    return {w: k for w, k in n.items() if k >= least}


@pytest.mark.parametrize("slip", [199, 3])
def test_variants_equal_brute_force(docs, texts, slip):
    n = expected_words(texts.items(), slip)
    of, form = near(n), {}
    for w, v in of.items():
        best = min(v, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.grouped(docs, slip=slip).collect()}
    assert got == {w: (n[w], len(of[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}
    assert any(form.values())


def test_words_with_repeated_letters_and_anagrams(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "abaaaa", "listen", "silent", "silens", "listens", "listenz", "éléments", "élément", "elements", "élémentß"]
    got = {(r["word"], r["other"]) for r in variants.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert got == {(w, x) for w, v in near(words).items() for x in v}


def test_roots_follow_long_chains(spark):
    got = variants.rooted(spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(21)], "word string, form string")).collect()
    assert {(r["word"], r["root"]) for r in got} == {(f"w{k}", "w21") for k in range(21)}


def test_variants_odd(odd):
    got = {r["word"]: r for r in variants.grouped(odd).collect()}
    assert got["another"]["n"] == 12 and "ähnliche" not in got and "Ähnliche" in got
    assert variants.grouped(odd.where("false")).count() == 0 and variants.grouped(odd.where("text is null")).count() == 0


def test_queries_have_the_columns_of_their_contracts(spark):
    assert {"doc_id", "n_features", "weight", "score", "rank"} <= {*QUERIES["op11_importance"](spark, SF).columns}
    got = QUERIES["op12_sharding"](spark, SF)
    assert {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= {*got.columns} and got.where("law <> 'bytes' or grown_shard is not null").count() == 0
    assert {"word", "form", "root", "n", "n_near", "form_n"} <= {*QUERIES["op13_spelling_variants"](spark, SF).columns}

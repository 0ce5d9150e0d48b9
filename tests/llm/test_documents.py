"""Operators on documents against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crestline.llm import components, decontam, langid, mixing, pii, quality_pu, quality_rules, simhash, token_output
from crestline.llm.queries import tokenizer_path
from crestline.llm.shared import id_remainder, scratch, table

SF = "/root/testdata/sf0.001"
CLASHES = "fp weight mix keep found part tokens score component_id i n w l t same near items start end entity term value word words".split()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and further columns whose names the operators use."""
    long = " ".join(f"word{k % 977} and" for k in range(60_000))
    rows = [
        (1, "The quick brown fox and the lazy dog met bob@example.com there.", "en", "a", 5), (1, "The quick brown fox and the lazy dog met bob@example.com there.", "en", "a", 5),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   \n\t ", None, "b", 5), (5, "12345 !!! ---", "de", None, 3), (6, long, "en", "b", len(long)), (None, "null id and text", "en", "b", 1), (7, "x", "de", "a", 1), (8, "\U0001f600 \x00 日本語 текст", None, None, 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


# --- language identification


def test_language_held_out(docs):
    model = langid.train(docs.where(id_remainder(F.col("doc_id")) != 0))
    got = docs.where(id_remainder(F.col("doc_id")) == 0).select("lang", langid.predict(F.col("text"), model, docs).alias("p")).select("lang", "p.*").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_backs_off_by_order(spark):
    rows = spark.createDataFrame([("the cat sat there", "en")] * 3 + [("der hund steht dort", "de")] * 3, "text string, lang string")
    model = langid.train(rows)
    assert model.langs == ["de", "en"] and "cat" in model.words and "cats" not in model.words
    scorer = langid._Scorer(model)
    scorer.learn({"cats", "hunde", "щ"})
    row = lambda w: scorer.table[scorer.rows[w]]
    assert row("cats").argmax() == 1 and row("hunde").argmax() == 0 and scorer.rows["щ"] == 0
    # the row of an unseen word is the mean over its longest known n-grams
    grams = [g for g in ("\x02cat", "cats", "ats\x03") if g in model.grams]
    assert np.allclose(row("cats"), model.shares(np.array([model.grams[g] for g in grams])).mean(axis=0))


def plain_language(labelled, texts, prior=50.0):
    """(language, score) of each text by plain dictionaries: words of up to 40 letters, n-grams of every run."""
    runs = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = [{} for _ in range(5)]  # words, then n-grams by order
    for text, lang in labelled:
        for w in runs(text):
            if len(w) <= 40:
                counts[0].setdefault(w, {}).setdefault(lang, 0)
                counts[0][w][lang] += 1
            padded = f"\x02{w}\x03"
            for n in (1, 2, 3, 4):
                for k in range(len(padded) - n + 1):
                    of = counts[n].setdefault(padded[k : k + n], {})
                    of[lang] = of.get(lang, 0) + 1
    langs = sorted({x for _, x in labelled})
    total = [{x: sum(of.get(x, 0) for of in c.values()) for x in langs} for c in counts]

    def share(o, key):
        pooled = sum(counts[o][key].values()) / sum(total[o].values())
        return np.array([np.log((counts[o][key].get(x, 0) + prior * pooled) / (total[o][x] + prior)) for x in langs])

    def row(w, padded):
        if w in counts[0]:
            return share(0, w)
        for n in (4, 3, 2, 1):
            if known := [g for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) in counts[n] and g not in ("\x02", "\x03")]:
                return np.mean([share(n, g) for g in known], axis=0)
        return np.zeros(len(langs))

    out = []
    for text in texts:
        rows = []
        for w in runs(text or ""):
            padded = f"\x02{w}\x03"
            rows += [row(w, padded)] if len(w) <= 40 else [row(None, padded[k : k + 40]) for k in range(0, len(padded) - 3, 37)]
        if not rows:
            out.append(("und", 0.0))
            continue
        z = np.sum(rows, axis=0) * min(len(rows), 20) / len(rows)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        out.append((langs[int(p.argmax())], float(p.max())))
    return out


def test_language_scores_equal_brute_force(spark, texts):
    rng = random.Random(11)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    labelled = [(f"the cat {run('abcxyz', 90)} sat there again", "en"), ("der hund steht dort a", "de"), (f"le chat {run('klmnop', 41)} est là", "fr"), ("the the the dog", "en"), (run("qrstuv", 200), "fr")]
    asked = ["the cats of there", "hunde stehen", run("abcxyz", 120), run("qrstuv", 77) + " the", "x", "", None, "123", "là-bas", labelled[0][0], "щ", "der " * 50]
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(labelled)], "doc_id long, text string, lang string")
    model = langid.train(rows)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k long, text string")
    got = [r["p"] for r in df.select("k", langid.predict(F.col("text"), model, df).alias("p")).orderBy("k").collect()]
    for (lang, score), g, t in zip(plain_language(labelled, asked), got, asked, strict=True):
        assert g["score"] == pytest.approx(score, abs=1e-9), t
        assert g["lang_pred"] == lang or score < 0.5, t


def test_more_new_words_than_a_worker_keeps():
    """Words learned before a reset of the store are still known after it."""
    kept = {(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}", f"l{k % 200}"): 1 for k in range(3_000)}
    model = langid._model(kept, {("a", f"l{k}"): 1 for k in range(200)})
    scorer = langid._Scorer(model)
    known, names = [w for w, _ in kept], [f"a{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}b" for k in range(12_000)]
    alone = langid._Scorer(model).score(" ".join(known[:50] + names[:9_000]))
    scorer.score(" ".join(names))
    assert scorer.used > scorer.limit and scorer.score(" ".join(known[:50] + names[:9_000])) == alone


def test_rows_without_id_are_held_out_or_not(odd):
    assert odd.where(id_remainder(F.col("doc_id")).isNull()).count() == 0


def test_every_language_has_a_model(spark):
    rows = spark.createDataFrame([(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} same", f"l{k:03d}") for k in range(230)], "doc_id long, text string, lang string")
    assert len(langid.train(rows).langs) == 230


def test_language_odd(odd, none):
    model = langid.train(odd)
    got = {r["doc_id"]: r["p"] for r in odd.select("doc_id", langid.predict(F.col("text"), model, odd).alias("p")).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4, 5)) and got[1]["lang_pred"] == "en"
    assert none.select(langid.predict(F.col("text"), langid.train(none), none)).count() == 0
    assert odd.select(langid.predict(F.col("text"), langid.train(none), odd).alias("p")).where("p.lang_pred <> 'und'").count() == 0


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = list(prints)
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_near_duplicates_equal_brute_force(docs, texts):
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = plain_components(prints)
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.fingerprint_hex(F.col("fp"))).collect()
    assert {r["doc_id"]: (r["hex"], r["component_id"]) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in texts}


def test_pairs_equal_brute_force_in_dense_groups(spark):
    rng = random.Random(1)
    bases = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = {b for base in bases for _ in range(60) for b in [base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))})]}
    signed = sorted(map(simhash.signed, fps))
    pairs = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in pairs} == want and len(pairs) == len(want)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(2)
    rows = [(simhash.signed(rng.getrandbits(64)), simhash.signed(rng.getrandbits(64))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", simhash.embedding(F.col("a")).alias("ea"), simhash.embedding(F.col("b")).alias("eb"))
    counts = lambda x: [(x >> (2 * k) & 3).bit_count() for k in range(32)]
    for r in df.collect():
        a, b = r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)
        manhattan = sum(abs(p - q) for p, q in zip(counts(a), counts(b), strict=True))
        assert ((r["ea"] ^ r["eb"]) & (2**64 - 1)).bit_count() == manhattan <= (a ^ b).bit_count()


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (201, 200), (202, 201)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components.connected(links).collect()}
    assert got == dict.fromkeys(range(41), 0) | {200: 200, 201: 200, 202: 200}


def test_rows_without_id_or_with_a_repeated_one(spark, monkeypatch):
    """Fingerprints are the nodes: one that only rows without id have links others, and a repeated id joins nothing."""
    prints = {"a": 0, "b": 7, "c": 63, "d": simhash.signed(0xFFFFFFFF00000000), "e": 1 << 40}
    monkeypatch.setattr(simhash, "fingerprint", lambda text, df, n=3, seed=42: F.element_at(F.create_map(*[F.lit(x) for k, v in prints.items() for x in (k, v)]), text))
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (9, "d"), (9, "e"), (None, "d")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1), (0, 7, 1), (3, 63, 1), (9, prints["d"], 9), (0, prints["d"], 9), (9, 1 << 40, 1)], key=str)


def test_simhash_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    empty = [r for r in got if r["doc_id"] in (2, 3, 4)]
    assert all(r["fp"] == 0 and r["component_id"] == 2 for r in empty)
    assert [r["component_id"] for r in got if r["doc_id"] == 1] == [1, 1]
    assert simhash.near_duplicates(none).count() == 0
    long = odd.where("doc_id = 6").first()["text"]
    assert simhash.fingerprint_of(long) == plain_fingerprint(long)


# --- quality


def test_base_counts_equal_the_definition(docs, texts):
    def windows(words):
        seen = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        return len({k + j for k, x in enumerate(seen) if seen.count(x) > 1 for j in range(3)})

    refs = quality_rules.references(docs)
    got = {r["doc_id"]: r["r"] for r in docs.select("doc_id", quality_rules.judged(F.col("text"), docs, refs).alias("r")).collect()}
    for k, t in list(texts.items())[:60]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        if len(words) < 1500:
            assert r["n_repeat_words"] == windows(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))


def test_rules_keep_good_and_drop_bad(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    refs = quality_rules.references(docs)
    got = docs.select("doc_id", quality_rules.judged(F.col("text"), docs, refs).alias("r")).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("not r.base_failed").collect()
    good, bad = [r["r"]["kept"] for r in got if r["quality"] == 1], [r["r"]["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_divergence():
    p, q = np.array([1.0, 0, 0]), np.array([0, 0.5, 0.5])
    assert quality_rules.divergence(p, p) == 0 and quality_rules.divergence(p, q) == pytest.approx(1.0)


def test_rules_odd(odd, none):
    refs = quality_rules.references(odd)
    got = {r["doc_id"]: r["r"] for r in odd.select("doc_id", quality_rules.judged(F.col("text"), odd, refs).alias("r")).collect()}
    assert all(got[k]["n_words"] == 0 and got[k]["base_failed"] and not got[k]["kept"] for k in (2, 3, 4))
    assert quality_rules.references(none) == {} and none.select(quality_rules.judged(F.col("text"), none, {})).count() == 0


def test_pu_held_out(spark, docs):
    bigger = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    held = id_remainder(F.col("doc_id")) == 0
    model = quality_pu.train(bigger.where(~held), labels)
    assert 0.6 < model.prior < 0.99
    got = bigger.where(held).select("doc_id", quality_pu.scored(F.col("text"), model, bigger).alias("s")).join(labels, "doc_id").collect()
    good, bad = [r["s"] for r in got if r["quality"] == 1], [r["s"] for r in got if r["quality"] == 0]
    assert np.mean(np.array(good) >= 0.3) > 0.95 and np.mean(np.array(bad) >= 0.3) < 0.5
    assert all(0 <= s <= 1 for s in good + bad)


def test_pu_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    pos = rng.normal(2, 1, 4_000)
    unl = np.concatenate([rng.normal(2, 1, 2_800), rng.normal(-2, 1, 1_200)])
    assert quality_pu.estimate_prior(pos, unl) == pytest.approx(0.7, abs=0.06)


def test_sample_is_bounded_and_holds_many_texts(spark):
    """Nine tenths are one text: the driver gets no more rows than asked for, and the other texts are not lost to it."""
    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 > 0, F.lit("the same text again")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    for most in (50, 500):
        x = quality_pu._sample(rows, most)
        assert 0.8 * most <= len(x) <= most
    alike = spark.range(3_000).select(F.lit(None).cast("long").alias("id"), F.lit("x").alias("text"))
    assert len(quality_pu._sample(alike, 100)) <= 100


def test_pu_risk_equals_the_definition():
    """The fitted weights are where numeric gradients of the non-negative unbiased risk, written out anew, vanish."""
    rng = np.random.default_rng(5)
    pos, unl = rng.normal(1, 1, (300, 3)), np.vstack([rng.normal(1, 1, (200, 3)), rng.normal(-1, 1, (400, 3))])
    w, b = quality_pu._descend(pos, unl, 1 / 3, True, steps=4_000, rate=0.01)
    loss = lambda z: np.log1p(np.exp(-z)).mean()

    def risk(t):
        zp, zu = pos @ t[:3] + t[3], unl @ t[:3] + t[3]
        negative = loss(-zu) - loss(-zp) / 3
        return loss(zp) / 3 + max(0.0, negative) + 0.5e-4 * (t[:3] ** 2).sum()

    best = np.append(w, b)
    near = [risk(best + 0.2 * rng.normal(size=4)) for _ in range(300)]
    assert risk(best) <= min(near) + 2e-3


def test_pu_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    for model in (quality_pu.train(odd, labels), quality_pu.train(none, labels), quality_pu.train(odd, labels.where("false"))):
        got = odd.select(quality_pu.scored(F.col("text"), model, odd).alias("s")).collect()
        assert len(got) == odd.count() and all(0 <= r["s"] <= 1 for r in got)
    assert none.select(quality_pu.scored(F.col("text"), model, none)).count() == 0


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.c", "x a@b.com_d@e.fr y", "@a.b a@ a@b a@b. a@b..c", "1.2.3.4 1.2.3.4.5 256.1.1.1 0001.2.3.255", "1.2.3 4.5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1111x4111111111111111", "+1 (743) 555-3824", "+12-34 +1234567890123456", "1 2 3 4",
    "é\U0001f600 a@b.co +49 30 1234567 é", "9" * 3000, "a" * 5000, "+1" + " " * 100 + "2", "4111 1111 1111 1112", "1.1.1.1@x.y", "a.b+c%d@sub-x.example.org.", "5500 0000 0000 0004 4111 1111 1111 1111", "", None,
]


def test_base_spans_equal_the_patterns(spark, docs, texts):
    rng = random.Random(4)
    made = ["".join(rng.choice(["1", "2", "55", ".", "-", " ", "+", "@", "a", "é", "(", "4111111111111111", "x.y", "_"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate([*HARD, *made])]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", pii.joined(pii.spans(F.coalesce("text", F.lit("")))).alias("s")).collect()}
    for k, t in rows + [(k + 10_000, t) for k, t in texts.items()]:
        assert got[k] == ",".join(plain_spans(t)), repr(t)


def test_telling_terms(spark):
    """A rare word that comes with an entity alone gives it away; a common one doesn't."""
    rows = [(k, f"number {k} was sent to zorblax bob@x.com yesterday by post") for k in range(4)] + [(k, f"number {k} was sent yesterday by post to nobody at all") for k in range(4, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["found"], r["terms"]) for r in pii.all_spans(df).collect()}
    for k, text in rows:
        terms = [text[t["start"] : t["end"]] for t in out[k][1]]
        assert terms == (["zorblax"] if k < 4 else [])
    clean = {r["doc_id"]: r["text_clean"] for r in pii.sanitised(df).collect()}
    assert clean[0] == "number 0 was sent to [TERM] [EMAIL] yesterday by post" and clean[10] == rows[10][1]
    assert {r["text_clean"] for r in pii.sanitised(df.where("doc_id = 1"), remove=True).collect()} == {"number 1 was sent to zorblax  yesterday by post"}


def plain_terms(rows, least_support=3, disclosure=0.8):
    """Spans of telling terms by the definition: df over documents, PMI against the entity's information, every whole word."""
    import math

    word = re.compile(r"[^\W\d_]{2,}")
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    has_term = {k: {w.lower() for w in word.findall(t)} for k, t in rows}
    has_entity = {k: {m[0].lower() for m in email.finditer(t)} for k, t in rows}
    n, telling = len(rows), set()
    for e in set().union(*has_entity.values()):
        de = sum(e in x for x in has_entity.values())
        for t in set().union(*(has_term[k] for k in has_term if e in has_entity[k])):
            both, dt = sum(e in has_entity[k] and t in has_term[k] for k in has_term), sum(t in x for x in has_term.values())
            if de >= least_support and both >= least_support and n > de and math.log2(n * both / (de * dt)) >= disclosure * math.log2(n / de) - 1e-12:
                telling.add(t)
    out = {}
    for k, t in rows:
        base = [m.span() for m in email.finditer(t)]
        out[k] = [m.span() for m in word.finditer(t) if m[0].lower() in telling and not any(a < m.end() and m.start() < b for a, b in base)]
    return out


def test_terms_equal_brute_force(spark):
    """Terms far from the mention, in documents without it, in capitals; entities in many documents and in few."""
    rng = random.Random(12)
    common, rare = [f"common{chr(97 + k)}" for k in range(12)], [f"rare{chr(97 + k)}" for k in range(10)]
    rows = []
    for k in range(90):
        words = [rng.choice(common) for _ in range(30)]
        if k % 9 == 0:
            words[3], words[25] = rare[0].upper(), "bob@x.com"
        if k % 3 == 0:
            words[7], words[20] = rare[1], "ann@y.org"
        if k in (1, 10, 19, 28):
            words[0] = rare[0] if k == 1 else rare[2]
        if k in (2, 5):
            words[1], words[2] = rare[3], "two@z.net"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_terms(rows)
    got = {r["doc_id"]: [(t["start"], t["end"]) for t in r["terms"]] for r in pii.all_spans(df).collect()}
    assert got == want and want[1] and want[0] and not want[2] and not want[10]


def test_sanitised_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "to a@b.co", "x", "y", "z"), (None, "to a@b.co", "x", "y", "z")], "doc_id long, text string, _id string, _same string, _spans string")
    assert sorted(map(str, pii.sanitised(df).collect())) == sorted(str(r) for r in df.withColumn("text_clean", F.lit("to [EMAIL]")).collect())


def test_pii_odd(odd, none):
    got = pii.all_spans(odd).collect()
    assert len(got) == odd.count() and sum(len(r["found"]) for r in got) == 2
    assert pii.all_spans(none).count() == 0
    clean = pii.sanitised(odd)
    assert clean.count() == odd.count() and clean.where("doc_id = 2").first()["text_clean"] == ""


def test_many_matches_in_one_text(spark):
    """Candidates, spans and terms by the ten thousand."""
    numbers = " ".join(f"word{k}" for k in range(60_000))
    mails = " ".join(f"a{k}@b.co mail" for k in range(60_000))
    rows = [(1, numbers), (2, mails), *[(k, "zorblax c@d.org zorblax") for k in (3, 4, 5)], (6, "zorblax again " * 40_000), *[(k, "other text") for k in range(7, 60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.all_spans(df).collect()}
    assert not got[1]["found"] and [(s["start"], s["end"]) for s in got[2]["found"]] == [m.span() for m in re.finditer(r"a[0-9]+@b\.co", mails)]
    assert [(s["start"], s["end"]) for s in got[6]["terms"]] == [(14 * k, 14 * k + 7) for k in range(40_000)]
    clean = {r["doc_id"]: r["text_clean"] for r in pii.sanitised(df).collect()}
    assert clean[1] == numbers and clean[2] == " ".join(["[EMAIL] mail"] * 60_000) and clean[6] == "[TERM] again " * 40_000
    assert time.time() - began < 120


def test_sanitised_over_pieces_and_overlaps(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 7)
    text = "é" * 30 + " a.b@c.de 4111 1111 1111 1111, +1 202 555 0175 1.2.3.4 " + "日" * 20 + "\n1.2.3.4\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitised(df).first()["text_clean"] == "é" * 30 + " [EMAIL] [CARD], [PHONE] " + "日" * 20 + "\n[IP]\n"


def test_pii_digest(spark):
    text = "mail a@b.co or 1.2.3.4"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = df.select(F.sha2(pii.joined(pii.spans(F.col("text"))), 256).alias("h")).first()["h"]
    assert got == hashlib.sha256(b"email:5:11,ip:15:22").hexdigest()


# --- decontamination


def plain_distance(item, words):
    """Least edit distance of the item to any part of the words."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for k, x in enumerate(item, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != w)))
        row = new
        best = min(best, row[-1])
    return best


def test_verification_is_exact():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(30)]
    item = [rng.choice(vocabulary) for _ in range(25)]
    index = decontam.Index([(1, " ".join(item))])
    for _ in range(200):
        part = item[:]
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(part))
            part[k : k + rng.randrange(2)] = [rng.choice([*vocabulary, "zz"])] * rng.randrange(2)
        words = [rng.choice(vocabulary) for _ in range(40)] + part + [rng.choice(vocabulary) for _ in range(40)]
        seq = np.array([index.vocab.get(w, 0) for w in words])
        low, high = max(0, 40 - 2 * index.edits[0] - 2), 40 + 25 + 2 * index.edits[0] + 2
        assert index.best(0, seq, 40)[0] == plain_distance(item, words[low:high])


def test_recall_of_edited_passages_and_no_false_ones(spark, texts):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    index, rng = decontam.Index(items), random.Random(7)
    hosts, found, total = [decontam.words_of(t) for t in texts.values()], 0, 0
    for k, text in items * 3:
        words = decontam.words_of(text)
        for _ in range(int(0.2 * len(words))):
            j = rng.randrange(len(words))
            words[j : j + rng.randrange(2)] = ["qq"] * rng.randrange(2)
        host = rng.choice(hosts)[:200]
        at = rng.randrange(len(host) + 1)
        got = index.matches([" ".join(host[:at] + words + host[at:])])[0]
        total += 1
        found += any(m["item_id"] == k for m in got)
    assert found / total >= 0.9
    clean = [t for t in list(texts.values())[:80]]
    for t, got in zip(clean, index.matches(clean), strict=True):
        words = decontam.words_of(t)
        for k, text in items:
            item = decontam.words_of(text)
            exact = len(words) < 700 and plain_distance(item, words) <= int(0.2 * len(item))
            if len(words) < 700:
                assert exact == any(m["item_id"] == k for m in got)


def with_edits(words, kind, rng, vocabulary):
    """The words with edits at exactly a fifth of their places."""
    out = words[:]
    places = rng.sample(range(len(words)), len(words) // 5)
    for k in sorted(places, reverse=True):
        how = rng.choice(["delete", "insert", "replace"]) if kind == "mix" else kind
        out[k : k + (how != "insert")] = [] if how == "delete" else [rng.choice([*vocabulary, "qq"])]
    return out


@pytest.mark.parametrize("kind", ["delete", "insert", "replace", "mix"])
@pytest.mark.parametrize("length", [15, 30, 50, 100, 200, 400])
def test_recall_at_the_limit(length, kind):
    rng = random.Random(length)
    vocabulary = [f"v{k}" for k in range(3_000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(length))) for k in range(20)]
    index, found = decontam.Index(items), 0
    for k, text in items:
        host = [rng.choice(vocabulary) for _ in range(60)]
        found += any(m["item_id"] == k for m in index.matches([" ".join(host[:30] + with_edits(text.split(), kind, rng, vocabulary) + host[30:])])[0])
    assert found >= 18


def test_decontamination_odd(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "the quick brown fox and the lazy dog"), (2, None), (3, ""), (None, "null id and text"), (4, "word1")], "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["f"]] for r in odd.select("doc_id", decontam.leaked(odd, benchmark).alias("f")).collect()}
    assert got[1] == [1] and got[6] == [4] and got[2] == got[3] == got[8] == []
    assert decontam.decontaminated(odd, benchmark.where("false")).count() == odd.count()
    assert decontam.decontaminated(none, benchmark).count() == 0
    blocks = odd.select("doc_id", decontam.leaked(odd, benchmark, block_items=2).alias("f")).collect()
    assert {r["doc_id"]: sorted(x["item_id"] for x in r["f"]) for r in blocks} == got


# --- mixing


def test_raking_meets_its_targets(spark):
    rng = random.Random(8)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", rng.randrange(1, 500)) for a in range(4) for b in range(3) for c in range(2)], "source string, lang string, topic string, tokens long")
    targets = {"source": [("s0", 0.4), ("s1", 0.3), ("s2", 0.2), ("s3", 0.1)], "lang": [("l0", 0.5), ("l1", 0.25), ("l2", 0.25)], "topic": [("t0", 0.35), ("t1", 0.65)]}
    fitted = mixing.rake(cells, {m: spark.createDataFrame(v, f"{m} string, target double") for m, v in targets.items()}).collect()
    total = sum(r["tokens"] for r in fitted)
    for m, v in targets.items():
        for name, share in v:
            assert sum(r["tokens"] * r["weight"] for r in fitted if r[m] == name) / total == pytest.approx(share, abs=1e-5)


def test_calibration_spends_the_budget(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100, 5.0), ("b", "x", "t", 300, 1.0), ("c", "x", "t", 600, 0.2)], "source string, lang string, topic string, tokens long, weight double")
    for share in (0.1, 0.3, 0.6):
        got = mixing.calibrated(cells, share).collect()
        assert sum(r["tokens"] * r["keep"] for r in got) == pytest.approx(1_000 * share) and max(r["keep"] for r in got) <= 1


def test_calibration_equals_bisection(spark):
    rng = random.Random(3)
    rows = [(f"s{k}", "x", "t", rng.randrange(0, 900), rng.choice([0.0, 1e-4, rng.random(), 5 * rng.random(), 80.0])) for k in range(400)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, weight double")
    total, reach = sum(r[3] for r in rows), sum(r[3] for r in rows if r[4] > 0)
    for share in (0.01, 0.2, 0.5, 0.75, 0.99):
        low, high = 0.0, 1e6
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(r[3] * min(1.0, c * r[4]) for r in rows) <= share * total else (low, c)
        got = {r["source"]: r["keep"] for r in mixing.calibrated(cells, share).collect()}
        assert sum(r[3] * got[r[0]] for r in rows) == pytest.approx(min(share * total, reach), rel=1e-6)
        if share * total < reach:
            assert all(got[r[0]] == pytest.approx(min(1.0, low * r[4]), rel=1e-5, abs=1e-9) for r in rows)


def test_mixture_equals_brute_force(docs):
    """Raking and calibration of the given documents, redone in pandas."""
    got = mixing.mixed(docs, 0.5).select("doc_id", "mix.*").toPandas()
    cells = got.groupby(["source", "lang", "topic"]).tokens.sum().reset_index()
    powers, total = {"source": 0.5, "lang": 0.7, "topic": 0.7}, cells.tokens.sum()
    want = {m: (s := cells.groupby(m).tokens.sum() ** p) / s.sum() for m, p in powers.items()}
    cells["w"] = 1.0
    for _ in range(300):
        for m in powers:
            now = (cells.tokens * cells.w).groupby(cells[m]).transform("sum")
            cells["w"] = np.where(now > 0, cells.w * cells[m].map(want[m]) * total / now.where(now > 0, 1), 0.0)
    low, high = 0.0, 1e6
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if (cells.tokens * np.minimum(1, c * cells.w)).sum() <= 0.5 * total else (low, c)
    both = got.merge(cells[["source", "lang", "topic", "w"]], on=["source", "lang", "topic"])
    some = both[both.tokens > 0]
    assert np.allclose(some.weight, some.w, rtol=1e-3, atol=1e-6) and np.allclose(some.keep, np.minimum(1, low * some.w), rtol=1e-3, atol=1e-6)


def test_targets_out_of_reach_are_warned_of(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.8), ("z", 0.1)], "lang string, target double")}
    with pytest.warns(UserWarning) as said:
        mixing.rake(cells, targets, rounds=2)
    assert any("can't all be met" in str(w.message) for w in said) and any("classes of lang" in str(w.message) for w in said)


def test_mixture_is_calibrated(docs):
    got = mixing.mixed(docs, 0.5).select("doc_id", "mix.*").toPandas()
    assert len(got) == docs.count() and abs((got.tokens * got.keep).sum() / got.tokens.sum() - 0.5) < 1e-6
    flat = (got.tokens * got.weight).groupby(got.source).sum()
    seen = got.tokens.groupby(got.source).sum() ** 0.5
    assert np.allclose(flat / flat.sum(), seen / seen.sum(), atol=1e-4)
    again = mixing.mixed(docs.repartition(7), 0.5).select("doc_id", "mix.*").toPandas()
    assert set(again[again.sampled].doc_id) == set(got[got.sampled].doc_id)


def test_mixing_odd(odd, none):
    out = mixing.mixed(odd, 0.5)
    assert out.count() == odd.count() and out.columns == [c for c in odd.columns if c != "mix"] + ["mix"]
    assert {r["mix"]["source"] for r in out.where("doc_id = 2").collect()} == {"?"}
    clash = mixing.mixed(odd.withColumn("_mix_keys", F.lit("mine")).withColumn("_MIX_CELL", F.lit("mine too")), 0.5)
    assert {(r["_mix_keys"], r["_MIX_CELL"]) for r in clash.collect()} == {("mine", "mine too")}
    assert mixing.mixed(none).count() == 0


# --- token files


def plain_ids(texts, special_as_text=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = special_as_text
    return [[*x.ids, 2] for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(9)
    made = ["".join(rng.choice(["a", "B", "'s", "1", " ", " ", "\n", "\t", ".", "é", "'", ",", "\r", " ", "word", "日", "\0"]) for _ in range(rng.randrange(1, 14))) for _ in range(3_000)]
    encoder = token_output.Encoder(tokenizer_path())
    encoder.KEPT = 500
    for k in range(0, len(made), 250):
        part = made[k : k + 250]
        assert [np.frombuffer(x, "<u4").tolist() + [2] for x in encoder.encode(part)] == plain_ids(part)


@pytest.mark.parametrize("as_text", [False, True])
def test_strings_of_special_tokens(as_text):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "some words <|endoftext|> and <|endoftext|><|endoftext|> more", "<|endoftext", "plain words", ""]
    got = token_output.Encoder(tokenizer_path(), as_text).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() + [2] for x in got] == plain_ids(texts, as_text)
    assert (50256 in np.frombuffer(got[0], "<u4")) != as_text


def test_token_files_round_trip(spark, docs, texts):
    path = scratch(spark, "test-tokens")
    token_output.write_tokens(docs, path, tokenizer_path(), partitions=5)
    back = token_output.read_tokens(spark, path)
    got = {r["doc_id"]: r for r in token_output.token_digest(back).collect()}
    start = 0
    for k, ids in zip(sorted(texts), plain_ids([texts[k] for k in sorted(texts)]), strict=True):
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    lengths = token_output.offsets(back)
    assert {(r["doc_id"], r["start"], r["n_tokens"]) for r in lengths.collect()} == {(k, r["start"], r["n_tokens"]) for k, r in got.items()}
    scan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in scan


def test_token_files_layout(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = scratch(spark, "test-layout")
    token_output.write_tokens(docs, path, tokenizer_path(), partitions=2)
    meta = pq.ParquetFile(glob.glob(f"{path.removeprefix('file://')}/part-*.parquet")[0]).metadata
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    ids = next(c for n, c in columns.items() if n.startswith("tokens"))
    assert ids.has_dictionary_page and ids.has_column_index and ids.has_offset_index
    assert any("DELTA" in e for c in columns.values() for e in c.encodings) or columns["doc_id"].has_dictionary_page


def test_token_files_odd(spark, odd, none):
    path = scratch(spark, "test-odd")
    rows = odd.where("doc_id is not null")
    token_output.write_tokens(rows, path, tokenizer_path(), partitions=3)
    got = token_output.token_digest(token_output.read_tokens(spark, path)).collect()
    assert len(got) == rows.count() and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {1}
    path = scratch(spark, "test-none")
    token_output.write_tokens(none, path, tokenizer_path(), partitions=3)
    assert token_output.token_digest(token_output.read_tokens(spark, path)).count() == 0


def test_token_places_of_repeated_and_missing_ids(spark):
    """Both functions agree with the ids' place in the files, end to end, for ids that repeat or are null."""
    rows = spark.createDataFrame([(5, "b b b b b"), (5, "a"), (None, "no id here at all"), (None, None), (3, "three, 3."), (5, "a"), (9, "\0odd\0 text")], "doc_id long, text string")
    path = scratch(spark, "test-places")
    token_output.write_tokens(rows, path, tokenizer_path(), partitions=3)
    back = token_output.read_tokens(spark, path)
    digest, lengths = token_output.token_digest(back).collect(), token_output.offsets(back).collect()
    assert sorted(map(str, ((r["doc_id"], r["start"], r["n_tokens"]) for r in digest))) == sorted(map(str, map(tuple, lengths)))
    flat = [i for r in sorted(back.collect(), key=lambda r: (r["part"], r["at"])) for i in r["tokens"]]
    for r in digest:
        assert zlib.crc32(np.array(flat[r["start"] : r["start"] + r["n_tokens"]], "<u4").tobytes()) == r["ids_crc32"]
    order = sorted(digest, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None, None, 3, 5, 5, 5, 9] and sum(r["n_tokens"] for r in order) == len(flat)
    ids = {tuple(x) for x in plain_ids([r["text"] or "" for r in rows.collect()])}
    assert {tuple(flat[r["start"] : r["start"] + r["n_tokens"]]) for r in digest} == ids


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    encoder, t = token_output.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.by_chunks
    texts = ["Hello  there, World's end.", "", "x\ny"]
    assert encoder.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]

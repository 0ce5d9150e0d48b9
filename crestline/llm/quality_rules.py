"""Quality rules by distribution divergence.

Each language's reference is a histogram of character classes and one of its most common words,
counted over all documents. A document is held against the nearest reference by Jensen-Shannon
distance (base 2, 0 to 1). Short texts are guarded: under least_words or least_chars the
divergence gives no verdict, and above that the allowance for sampling, which falls with the
length, is added to the limit. Counting rules that need no reference (base_failed) come first.

A null text counts as empty: no words, base_failed, not kept. Repeated rows give equal results.
Documents without a language form the class ``?``, which has a reference of its own. An empty
table gives an empty result. Columns of the input other than the text and language are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.profile import CLASSES, base_counts, class_counts, words_of
from crestline.llm.shared import short_batches, written

#: Common words of a reference.
COMMON = 60
#: Words of a task that are counted before they are handed on.
HELD = 300_000
LEAST_WORDS, LEAST_CHARS = 50, 200
#: Limits of the two distances, before the allowance for short texts.
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.47
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, judged boolean, kept boolean"
STRIPPED = b".,;:!?\"'()[]"


def _bare(word: bytes) -> bytes:
    return word.strip(STRIPPED).lower()


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """Language -> (class shares, common words by place, their shares and that of the rest), from all documents.

    Tasks count words on their own before the shuffle; what comes back is COMMON words a language,
    for every language of the table.
    """
    short_batches(docs.sparkSession)

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def handed() -> pd.DataFrame:
            rows = [(k, -1, w, n) for k, c in words.items() for w, n in c.items()] + [(k, j, b"", int(n)) for k, v in classes.items() for j, n in enumerate(v) if n]
            words.clear()
            classes.clear()
            return pd.DataFrame(rows, columns=["l", "class", "w", "n"])

        for p in parts:
            for x, k in zip(p["text"], p["l"], strict=True):
                words.setdefault(k, Counter()).update(words_of(x))
                classes[k] = classes.get(k, 0) + class_counts(x)
            if sum(map(len, words.values())) > HELD:
                yield handed()
        yield handed()

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("?")).alias("l"))
    bare = F.lower(F.btrim(F.col("w").cast("string"), F.lit(STRIPPED.decode()))).cast("binary")
    counts = rows.mapInPandas(counted, "l string, class int, w binary, n long").select("l", "class", bare.alias("w"), "n").groupBy("l", "class", "w").agg(F.sum("n").alias("n"))
    is_class = F.col("class") >= 0
    counts = written(counts.where(is_class | (F.octet_length("w") > 0)), "word-counts")
    totals = counts.where(~is_class).groupBy("l").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "l").collect()
    # the most common words of each task's share first, so that no language's vocabulary is sorted in one place
    near = Window.partitionBy("l", F.spark_partition_id()).orderBy(F.desc("n"), "w")
    top = counts.where(~is_class).withColumn("r", F.row_number().over(near)).where(F.col("r") <= COMMON).drop("r")
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON)
    got: dict[str, dict[bytes, int]] = {}
    for x in top.select("l", "w", "n").collect():
        got.setdefault(x["l"], {})[bytes(x["w"])] = x["n"]
    shares: dict[str, np.ndarray] = {}
    for x in counts.where(is_class).collect():
        shares.setdefault(x["l"], np.zeros(len(CLASSES)))[x["class"]] = x["n"]
    out = {}
    for row in totals:
        of = got[row["l"]]
        common = {w: k for k, w in enumerate(sorted(of, key=lambda w: (-of[w], w)))}
        n = np.array([*(of[w] for w in common), 0.0])
        n[-1] = row["total"] - n.sum()
        c = shares[row["l"]]
        out[row["l"]] = (c / c.sum(), common, n / n.sum())
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits."""
    m = (p + q) / 2

    def half(x: np.ndarray) -> float:
        k = x > 0
        return float((x[k] * np.log2(x[k] / m[k])).sum())

    return max(0.0, (half(p) + half(q)) / 2)


def judge(text: str | None, refs: dict, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> tuple:
    """The fields of RESULT for one whole text."""
    text = text or ""
    words = words_of(text)
    base = base_counts(text, words)
    failed = base[0] < LEAST_WORDS or 100 * base[4] > 50 * base[0]
    if failed or not refs or len(text) < LEAST_CHARS:
        return (*base, failed, None, None, False, not failed)
    classes = class_counts(text)
    shares = classes / classes.sum()
    times = Counter(map(_bare, words))
    times.pop(b"", None)
    n = sum(times.values())
    if n < LEAST_WORDS:
        return (*base, failed, None, None, False, True)
    best = None
    for ref, common, expected in refs.values():
        found = np.zeros(len(expected))
        for w, k in common.items():
            found[k] = times.get(w, 0)
        found[-1] = n - found.sum()
        # the mean divergence of a sample of this length from its own source is about (bins - 1) / (8 n ln 2) bits
        of_class = max(0.0, divergence(shares, ref) - (len(ref) - 1) / (8 * len(text) * np.log(2))) ** 0.5
        of_word = max(0.0, divergence(found / n, expected) - (len(expected) - 1) / (8 * n * np.log(2))) ** 0.5
        if best is None or max(of_class / class_limit, of_word / word_limit) < max(best[0] / class_limit, best[1] / word_limit):
            best = of_class, of_word
    return (*base, failed, *best, True, best[0] <= class_limit and best[1] <= word_limit)


def judged(text: Column, docs: DataFrame, refs: dict, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> Column:
    """struct of RESULT for whole texts; the references are broadcast: COMMON words and the classes of each language."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(refs)
    names = [x.split(" ")[0] for x in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def rules(part: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(x, shared.value, class_limit, word_limit) for x in part], columns=names)

    return rules(text)

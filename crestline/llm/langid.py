"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that no training text holds
falls back to the longest order of character n-grams (4, 3, 2, 1) of which it has a known one.

Nulls, empty texts and texts without letters give ``und`` with score 0. Repeated rows give equal
results; ties go to the first language in alphabetical order. An empty table gives an empty
result, a table without labelled rows gives ``und`` everywhere. A run of more than LONGEST_WORD
letters counts as several unseen words. Columns of the input other than the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crestline.llm.shared import drawn, short_batches

ORDERS = (4, 3, 2, 1)
LETTERS = re.compile(r"[^\W\d_]+")
#: A longer run of letters isn't a word that can be known: it is judged piece by piece, by the n-grams of all of it.
LONGEST_WORD = 40
#: Weight, in occurrences, of all languages' shares in those of one.
PRIOR = 50.0
#: Mark the ends of a word; alone they say nothing.
EDGES = ("\x02", "\x03")
#: Begins the name of a piece of a long run, which carries its own marks of the run's ends.
PIECE = "\0"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def pieces_of(run: str) -> list[str]:
    """A long run in pieces that overlap by three letters, so that each n-gram of four lies in one of them."""
    padded, step = f"\x02{run}\x03", LONGEST_WORD - ORDERS[0] + 1
    return [PIECE + padded[k : k + LONGEST_WORD] for k in range(0, max(1, len(padded) - ORDERS[0] + 1), step)]


@dataclass
class LangModel:
    """Counts of words and, by order, n-grams in each language, as rows of a sparse table, with what turns them into log shares."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    first: np.ndarray  # row -> its first entry
    lang: np.ndarray  # entry -> language
    count: np.ndarray  # entry -> occurrences
    order: np.ndarray  # row -> 0 for words, else the n-gram's length
    pooled: np.ndarray  # row -> share in all languages, within its order
    total: np.ndarray  # (order, language) -> occurrences

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """Log shares of rows in each language; those of one language, within words or an order of n-grams, lean on those of all, so that one with little text isn't favoured."""
        out = np.repeat(PRIOR * self.pooled[rows][:, None], len(self.langs), axis=1)
        n = self.first[rows + 1] - self.first[rows]
        entry = np.repeat(self.first[rows] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        np.add.at(out, (np.repeat(np.arange(len(rows)), n), self.lang[entry]), self.count[entry])
        return np.log(out / (self.total[self.order[rows]] + PRIOR))

    def known_grams(self, word: str) -> list[int]:
        """Rows of an unseen word's known n-grams, of the longest order that has any."""
        padded = word[1:] if word[0] == PIECE else f"\x02{word}\x03"
        for n in ORDERS:
            found = [self.grams[g] for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) in self.grams and g not in EDGES]
            if found:
                return found
        return []


def _ngrams(piece: Column, first: Column, n: int) -> Column:
    """All n-grams of a piece; a later piece of a run leaves out those that lie in the overlap with the one before."""
    begin = F.when(first, 1).otherwise(1 + ORDERS[0] - n)
    places = F.when(F.length(piece) - n + 1 >= begin, F.sequence(begin, F.length(piece) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.substring(piece, k, F.lit(n)))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 20_000, words_per_lang: int = 40_000, grams_per_lang: int = 12_000, id_col: str = "doc_id") -> LangModel:
    """Fits the model on about max_docs labelled rows, drawn by a hash of id and text.

    A language's model holds its words_per_lang most frequent words and, of each order, its
    grams_per_lang most frequent n-grams; every language of the sample has one. Counts are made by
    Spark, over whole texts.
    """
    name = F.col(id_col) if id_col in labelled.columns else F.lit(None)
    rows = labelled.select(name.alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    rows = drawn(rows, max_docs, "i", "t").drop("_draw", "i")
    rows = rows.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism))
    runs = rows.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), 1)).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    counts = runs.persist()
    order = Window.partitionBy("l").orderBy(F.desc("n"), "w")
    top_words = counts.where(F.length("w") <= LONGEST_WORD).withColumn("r", F.row_number().over(order)).where(F.col("r") <= words_per_lang)
    kept = {(r["w"], r["l"]): r["n"] for r in top_words.select("w", "l", "n").toLocalIterator()}
    padded, step = F.concat(F.lit("\x02"), F.col("w"), F.lit("\x03")), LONGEST_WORD - ORDERS[0] + 1
    # a word with its marks may be two longer than a piece of a long run; it stays whole
    cut = F.when(F.length("w") <= LONGEST_WORD, F.array(padded)).otherwise(F.regexp_extract_all(padded, F.lit(f"(?=(.{{1,{LONGEST_WORD}}})).{{1,{step}}}"), 1))
    pieces = counts.select("l", "n", F.posexplode(cut).alias("k", "p"))
    every = F.flatten(F.array(*[_ngrams(F.col("p"), F.col("k") == 0, n) for n in ORDERS]))
    grams = pieces.select("l", "n", F.explode(every).alias("g")).groupBy("l", "g").agg(F.sum("n").alias("n")).withColumn("o", F.length("g"))
    top_grams = grams.withColumn("r", F.row_number().over(Window.partitionBy("l", "o").orderBy(F.desc("n"), "g"))).where(F.col("r") <= grams_per_lang)
    got = {(r["g"], r["l"]): r["n"] for r in top_grams.select("g", "l", "n").toLocalIterator()}
    counts.unpersist()
    return _model(kept, got)


def _model(kept: dict, got: dict) -> LangModel:
    langs = sorted({x for _, x in kept} | {x for _, x in got})
    at = {x: k for k, x in enumerate(langs)}
    words = {w: k for k, w in enumerate(dict.fromkeys(w for w, _ in kept))}
    grams = {g: k + len(words) for k, g in enumerate(dict.fromkeys(g for g, _ in got))}
    entries = sorted([(words[w], at[x], n) for (w, x), n in kept.items()] + [(grams[g], at[x], n) for (g, x), n in got.items()])
    row, lang, count = (np.array(x, np.int64) for x in (zip(*entries, strict=True) if entries else ([], [], [])))
    n_rows = len(words) + len(grams)
    order = np.array([0] * len(words) + [len(g) for g in grams], np.int64)
    total = np.zeros((1 + max(ORDERS), len(langs)))
    np.add.at(total, (order[row], lang), count)
    pooled = np.bincount(row, count, n_rows) / np.maximum(1, total.sum(axis=1))[order] if n_rows else np.zeros(0)
    return LangModel(langs, words, grams, np.concatenate([[0], np.bincount(row, minlength=n_rows).cumsum()]).astype(np.int64), lang, count, order, pooled, total)


class _Scorer:
    """Scores words of one model; the rows of words met are kept, up to a bound."""

    CELLS = 1_600_000

    def __init__(self, model: LangModel):
        self.model = model
        self.limit = max(1_000, self.CELLS // max(1, len(model.langs)))
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.table, self.used = np.zeros((1_000, len(self.model.langs))), 1  # row 0 is that of words of which nothing is known

    def learn(self, words: set[str]) -> None:
        """Makes the rows of words; of a piece of a text, all are learned after a reset, however many."""
        of = {w: [k] if (k := self.model.words.get(w)) is not None else self.model.known_grams(w) for w in words}
        some = {w: g for w, g in of.items() if g}
        self.rows.update(dict.fromkeys(of.keys() - some.keys(), 0))
        if not some:
            return
        sizes = np.fromiter(map(len, some.values()), np.int64, len(some))
        used, of_row = np.unique(np.fromiter(chain.from_iterable(some.values()), np.int64, sizes.sum()), return_inverse=True)
        means = np.add.reduceat(self.model.shares(used)[of_row], np.concatenate([[0], sizes.cumsum()[:-1]]), axis=0) / sizes[:, None]
        while self.used + len(means) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(means)] = means
        self.rows.update(zip(some, range(self.used, self.used + len(means)), strict=True))
        self.used += len(means)

    def score(self, text: str | None) -> tuple[str, float]:
        langs, seen, total = self.model.langs, 0, np.zeros(len(self.model.langs))
        if not text or not any(any(map(str.isalpha, m[0])) for m in LETTERS.finditer(text)):  # fractions and the like are no letters
            return "und", 0.0
        found = (m[0] for m in LETTERS.finditer(text.lower()))
        while words := list(islice(found, 100_000)):
            if max(map(len, words)) > LONGEST_WORD:
                words = [p for w in words for p in (pieces_of(w) if len(w) > LONGEST_WORD else (w,))]
            missing = set(words).difference(self.rows)
            if missing and self.used > self.limit:
                self.reset()
                missing = set(words)
            if missing:
                self.learn(missing)
            total += self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
            seen += len(words)
        if not seen or not langs:
            return "und", 0.0
        z = total * (min(seen, 20) / seen)
        z = np.exp(z - z.max())
        best = int(z.argmax())
        return langs[best], float(z[best] / z.sum())


def predict(text: Column, model: LangModel, df: DataFrame) -> Column:
    """struct(lang_pred, score) of whole texts. The model is broadcast; train() bounds its size."""
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value)
        for part in parts:
            yield pd.DataFrame([scorer.score(x) for x in part], columns=["lang_pred", "score"])

    return scored(text)

"""Spelling variants by PartEnum signatures of letter multisets.

A word's letters, the first a, the second a and so on as different elements, are a binary vector.
An inserted or deleted letter changes the vector in one place, a replaced one in two. Vectors at a
Hamming distance of at most k agree in all but k of any number of parts, so a signature for every
choice of the parts less k (partition and enumerate) finds all of them by equal keys: k = 2 for
words of one length, k = 1 for lengths that differ by one. Signatures are made for different
vectors, not words; the Hamming distance, then the edit distance of the words, decide.

Each word takes the most frequent near word as its form if that is dominant; following forms gives
its root. A null text has no words; a null id counts as the empty string. Repeated rows count each.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.shared import written

RUN = r"[A-Za-zÀ-ÿ]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, DOMINANT = 6, 5, 5
#: One run of how many, by a hash of document and run, loses a letter.
SLIP = 199
#: Parts of a vector for words of one length, and for lengths that differ by one.
PARTS_SAME, PARTS_NEXT = 5, 3


def counted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of all documents: words of enough letters that occur often enough, pre-aggregated before the shuffle."""
    runs = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run")).where(F.length("run") >= least_letters)
    h = F.crc32(F.concat("i", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters_of(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def elements(letters: Column) -> Column:
    """The elements of a multiset, written as a string of sorted letters: each letter with its number."""
    one = F.split(letters, "")
    return F.transform(one, lambda x, k: F.concat(x, (k + 2 - F.array_position(one, x)).cast("string")))


def signatures(vector: Column, parts: int, k: int) -> Column:
    """A hash for every choice of the parts less k; equal vectors in those parts have equal ones."""

    def part_of(p: int) -> Column:
        return F.array_join(F.filter(vector, lambda e: F.crc32(e.cast("binary")) % parts == p), "")

    part = [part_of(p) for p in range(parts)]
    return F.array(*[F.xxhash64(F.lit(c), *[part[p] for p in chosen]) for c, chosen in enumerate(combinations(range(parts), parts - k))])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(a, b): letters of all pairs at a Hamming distance of 1 (b has one letter more) or 2 (equal lengths, a < b), each once."""
    rows = vectors.select("letters", F.length("letters").alias("size"), elements(F.col("letters")).alias("vector"))
    same = rows.select("letters", "size", "vector", F.explode(signatures(F.col("vector"), PARTS_SAME, 2)).alias("s"))
    a, b = same.alias("a"), same.alias("b")
    alike = F.size(F.array_intersect("a.vector", "b.vector"))
    twos = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.letters") < F.col("b.letters")) & (alike == F.col("a.size") - 1))
    following = rows.select("letters", "size", "vector", F.explode(signatures(F.col("vector"), PARTS_NEXT, 1)).alias("s"))
    a, b = following.alias("a"), following.alias("b")
    ones = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.size") + 1 == F.col("b.size")) & (alike == F.col("a.size")))
    return twos.unionAll(ones).select(F.col("a.letters").alias("a"), F.col("b.letters").alias("b")).distinct()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words at an edit distance of 1.

    Words at distance 1 agree in their first or their last half, which spares most comparisons. A
    replaced letter is another letter, so anagrams, whose vectors are equal, are never near.
    """
    held = written(words.select("word", "n", letters_of(F.col("word")).alias("letters")), "words")
    pairs = written(near_vectors(held.select("letters").distinct()), "near-vectors")
    a = held.select(F.col("word").alias("word"), F.col("n").alias("n"), F.col("letters").alias("a"))
    b = held.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("letters").alias("b"))
    half = F.floor(F.least(F.length("word"), F.length("other")) / 2).cast("int")
    ends = (F.left("word", half) == F.left("other", half)) | (F.right("word", half) == F.right("other", half))
    one_way = pairs.join(a, "a").join(b, (pairs["b"] == b["b"]) & ends & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")
    one_way = written(one_way, "near-words")
    return one_way.unionAll(one_way.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form: the end of the chain of forms.

    Pointers are doubled until none changes; as a form is at least DOMINANT times as frequent, a
    chain has fewer than log(largest n) members and a few rounds do.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not at.where("moved").count():
            return at.select("word", "root")
        at = at.select("word", "root")


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", dominant: int = DOMINANT, **how) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = written(counted(docs, id_col, text, **how), "vocabulary")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.max("other_n").alias("most"), F.min(F.struct((-F.col("other_n")).alias("r"), "other")).alias("first"))
    marked = words.join(near, "word", "left").withColumn("has", F.col("most") >= dominant * F.col("n"))
    marked = written(marked.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("first.other")).alias("form"), F.when(F.col("has"), F.col("most")).alias("form_n")), "forms")
    roots = rooted(marked.where("form is not null"))
    return marked.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

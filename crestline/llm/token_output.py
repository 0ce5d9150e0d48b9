"""Token ids as Parquet list columns.

The file format is a folder of Parquet files, one range of doc_id each, rows in ascending order:

    doc_id long, n_tokens int, part int, at long, tokens array<int>

part being the range and at the ids of the range's documents before, written with format version 2: dictionary pages for columns of few values, delta encoding for
integers beyond them, row groups of a set size and page indexes, so that a reader can fetch the
lengths without the ids, or the ids of a few documents without the others' pages.

Null texts count as empty and give only the end id. Rows that repeat a doc_id stay apart, in the
order of their texts, and rows without one come first; each has its own place. An empty table gives an empty folder of the same schema; other columns are
not read.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.shared import new_folder, short_batches, whole_file

SCHEMA = "doc_id long, n_tokens int, part int, at long, tokens array<int>"
LAYOUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("part", pa.int32()), ("at", pa.int64()), ("tokens", pa.list_(pa.field("element", pa.int32())))])
#: Ids have few values and a dictionary; the other columns are stored as differences.
FORMAT = {"version": "2.6", "data_page_version": "2.0", "compression": "zstd", "use_dictionary": ["tokens.list.element"], "column_encoding": dict.fromkeys(("doc_id", "n_tokens", "part", "at"), "DELTA_BINARY_PACKED"), "write_page_index": True, "data_page_size": 256 << 10, "max_rows_per_page": 2000, "dictionary_pagesize_limit": 256 << 10}
ROW_GROUP = 32 << 20
#: Characters of text that are encoded at once, so that equal chunks are looked up once and unseen ones are met in bulk.
CHARS_AT_ONCE = 4 << 20

# The byte-level pre-tokenizer's published pattern, for texts of the characters below U+0250 only.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\t-\r \u0085 "
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Texts with other characters are encoded whole.
PLAIN = re.compile("[\t-\r -ɏ‐-‧‰-›]*")


#: What keeps a text from falling into chunks at single spaces and line ends.
UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\v", "\f", "\r", "\u0085", "\u00a0", "\0")


#: Marks that are a pre-token of their own after a word at the end of a chunk.
MARKS = tuple(".,;:!?")


def _even(text: str) -> bool:
    return not (text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, UNEVEN)))


#: Bytes that byte-level vocabularies write as themselves; the others are written as characters from U+0100 on, in order.
ITSELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
WRITTEN = np.array([*range(0x100)], "<u4")
WRITTEN[[x for x in range(0x100) if x not in ITSELF]] = 0x100 + np.arange(0x100 - len(ITSELF))
SPACE_MARK = chr(WRITTEN[0x20])


def _written(pieces: list[str]) -> list[str]:
    """Pre-tokens in the characters of a byte-level vocabulary; NUL stands between them meanwhile, so none may hold one."""
    codes = WRITTEN.copy()
    codes[0] = 0
    return codes[np.frombuffer("\0".join(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\0")


class Encoder:
    """Little-endian 32-bit ids of whole texts.

    The tokenizer never merges across pre-tokens, so what it made of a chunk of text is kept and
    looked up when the chunk comes again. A chunk is what lies between spaces, with the space (or
    the line end) before it; new chunks are cut into pre-tokens, which the tokenizer's model
    encodes. Two generations are kept: what isn't met while the younger fills up is forgotten. A
    tokenizer of another kind than byte-level pair merges encodes every text whole.
    """

    KEPT = 300_000

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        shape = json.loads(self.tokenizer.to_str())
        #: Strings that the tokenizer takes as one token; texts that hold one are encoded whole.
        added = [re.escape(t["content"]) for t in shape["added_tokens"] if not (special_as_text and t["special"])]
        self.added = re.compile("|".join(added)) if added else None
        cut, model = shape["pre_tokenizer"] or {}, shape["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.by_chunks = model["type"] == "BPE" and plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and shape["normalizer"] is None
        #: The same merges without a store of words, as known chunks are kept here.
        self.merge = BPE(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], cache_capacity=0).tokenize if self.by_chunks else None
        self.names = [i.to_bytes(4, "little") for i in range(1 + max(model["vocab"].values()))] if self.by_chunks else []
        #: Chunks by what follows their space; those without one begin with \0 or the line end.
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens without NUL, written as characters of the vocabulary."""
        merge, name = self.merge, self.names.__getitem__
        return [b"".join([name(t.id) for t in merge(p)]) for p in pieces]

    def _learn_pieces(self, pieces: set[str]) -> None:
        """Keeps pre-tokens, each as a chunk of its own."""
        of = {self._key(p): p for p in pieces}
        new = self._unknown(of)
        odd = [k for k in new if "\0" in of[k]]
        self.chunks.update(zip(odd, self._whole([of[k] for k in odd]), strict=True))
        if new := [k for k in new if "\0" not in of[k]] if odd else new:
            self.chunks.update(zip(new, self._merged(_written([of[k] for k in new])), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        """Keeps words of letters with a space before them."""
        if words:
            self.chunks.update(zip(words, self._merged([SPACE_MARK + w for w in _written(words)]), strict=True))

    @staticmethod
    def _key(piece: str) -> str:
        return piece[1:] if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else "\0" + piece

    def _not_old(self, keys: list[str]) -> list[str]:
        """Those keys that the older generation hasn't; the others are taken over from it."""
        if not self.old:
            return keys
        ids = [*map(self.old.get, keys)]
        self.chunks.update([(k, i) for k, i in zip(keys, ids, strict=True) if i is not None])
        return [k for k, i in zip(keys, ids, strict=True) if i is None]

    def _unknown(self, keys: Iterable[str]) -> list[str]:
        """Those keys that neither generation has."""
        return self._not_old([k for k in keys if k not in self.chunks])

    def _in_pieces(self, texts: list[str]) -> list[bytes]:
        """By pre-tokens, for texts of the known characters."""
        cut = [PRE_TOKEN.findall(x) for x in texts]
        self._learn_pieces({p for pieces in cut for p in pieces})
        known, key = self.chunks, self._key
        return [b"".join([known[key(p)] for p in pieces]) for pieces in cut]

    def _learn(self, chunks: list[str]) -> None:
        """Keeps chunks; most are a spaced word, or one and a mark."""
        words, marked, rest = set(), [], []
        for c in chunks:
            if c.isalpha():
                words.add(c)
            elif c[-1:] in MARKS and c[:-1].isalpha():
                marked.append(c)
            else:
                rest.append(c)
        words.update([c[:-1] for c in marked])
        self._learn_words(self._unknown(words))
        first = {"\0": "", "\n": "\n"}
        cut = [PRE_TOKEN.findall(first[c[0]] + c[1:] if c[0] in first else " " + c) for c in rest]
        self._learn_pieces({p for pieces in cut for p in pieces}.union(MARKS))
        known, key = self.chunks, self._key
        ends = {m: known[key(m)] for m in MARKS}
        self.chunks.update([(c, known[c[:-1]] + ends[c[-1]]) for c in marked])
        self.chunks.update([(c, b"".join([known[key(p)] for p in pieces])) for c, pieces in zip(rest, cut, strict=True)])

    def _in_chunks(self, texts: list[str]) -> list[bytes]:
        """By chunks, for texts whose white space is single as well. Equal chunks of the texts are looked up once."""
        if not texts:
            return []
        lists = pc.split_pattern(pc.replace_substring(pa.array(["\0" + x for x in texts], pa.large_string()), "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))
        chunks = joined[0].as_py().split(" ")
        ids = [*map(self.chunks.get, chunks)]
        if missing := [c for c, i in zip(chunks, ids, strict=True) if i is None]:
            self._learn(self._not_old(missing))
            ids = [self.chunks[c] if i is None else i for c, i in zip(chunks, ids, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        kept = pa.LargeListArray.from_arrays(np.concatenate([[0], sizes.cumsum()]), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        flat = kept.take(coded.indices).flatten().to_numpy().tobytes()
        upto = np.concatenate([[0], sizes[coded.indices.to_numpy()].cumsum()])[lists.offsets.to_numpy()]
        ends = (4 * upto).tolist()
        return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunks:
            return self._whole(texts)
        if len(self.chunks) > self.KEPT:
            self.old, self.chunks = self.chunks, {}
        out: list = [b""] * len(texts)
        kinds: dict[str, list[int]] = {"whole": [], "pieces": [], "chunks": []}
        for k, x in enumerate(texts):
            kinds["whole" if not PLAIN.fullmatch(x) or self.added and self.added.search(x) else "chunks" if x and _even(x) else "pieces"].append(k)
        gc.disable()  # nothing here makes a cycle, and the collector would go over millions of strings again and again
        try:
            for kind, how in (("whole", self._whole), ("pieces", self._in_pieces), ("chunks", self._in_chunks)):
                for k, ids in zip(kinds[kind], how([texts[k] for k in kinds[kind]]), strict=True):
                    out[k] = ids
        finally:
            gc.enable()
        return out


@lru_cache(maxsize=1)
def encoder(path: str, special_as_text: bool) -> Encoder:
    """A worker's encoder; what it has learned serves its later tasks too."""
    return Encoder(path, special_as_text)


def _encoded(parts: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, part: int, special_as_text: bool) -> Iterator[pa.Table]:
    """Rows of the file format, about CHARS_AT_ONCE characters of text at a time."""
    known, end, before = encoder(tokenizer, special_as_text), np.array([end_id], "<u4").tobytes(), 0
    doc_ids, texts, chars = [], [], 0
    for p in chain(parts, [None]):
        if p is not None:
            more = p.column("text").to_pylist()
            doc_ids.append(p.column("doc_id"))
            texts += more
            chars += sum(map(len, more))
        if not texts or p is not None and chars < CHARS_AT_ONCE:
            continue
        ids = [x + end for x in known.encode(texts)]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.concatenate([[0], n.cumsum()])
        lists = pa.LargeListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(ids), "<i4"))).cast(LAYOUT.field("tokens").type)
        yield pa.table([pa.chunked_array(doc_ids).combine_chunks(), pa.array(n.astype(np.int32)), pa.array(np.full(len(n), part, np.int32)), pa.array(at[:-1] + before), lists], schema=LAYOUT)
        before += int(at[-1])
        doc_ids, texts, chars = [], [], 0


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text", partitions: int | None = None, special_as_text: bool = False) -> int:
    """Encodes whole texts in ascending doc_id order, writes the format described above and returns the number of rows.

    Strings of special tokens in a text become their ids, as the tokenizers library has it, or are
    ordinary text with special_as_text.

    The texts are dealt by ranges of doc_id, in one shuffle, before they are encoded. Tasks write
    their columns as they are, without a detour by rows. A task writes under a name of its own and
    renames the file when it is whole, so one that is repeated after a loss, or runs twice, leaves
    one file of the same rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, rows = TaskContext.get().partitionId(), [], 0
        with whole_file(f"{path}/part-{part:05d}.parquet") as out, pq.ParquetWriter(out, LAYOUT, **FORMAT) as file:
            for some in chain(_encoded(parts, tokenizer, end_id, part, special_as_text), [None]):
                if some is not None:
                    held.append(some)
                    rows += some.num_rows
                if held and (some is None or sum(x.nbytes for x in held) >= ROW_GROUP):
                    whole = pa.concat_tables(held)
                    file.write_table(whole, row_group_size=whole.num_rows)
                    held = []
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    new_folder(path)
    return rows.mapInArrow(write, "rows long").agg(F.sum("rows")).first()[0] or 0


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The table as written; select doc_id and n_tokens alone and the ids aren't read."""
    return spark.read.schema(SCHEMA).parquet(path)


def _placed(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows with start, the number of ids of all documents before: those of earlier ranges and those of the range's earlier rows."""
    # one row for each range that was written; their number is that of the writing tasks
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = parts.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("at")).withColumn("n_tokens", F.col("n_tokens").cast("long"))


def offsets(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, from the lengths alone: the files' ids aren't read."""
    return _placed(tokens.select("doc_id", "part", "at", "n_tokens"), tokens).select("doc_id", "start", "n_tokens")


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the ids read back."""
    short_batches(tokens.sparkSession)

    @F.arrow_udf("long")
    def crc(part: pa.Array) -> pa.Array:
        flat, at = part.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at, at[1:], strict=False)], pa.int64())

    marked = tokens.select("doc_id", "part", "at", "n_tokens", crc("tokens").alias("ids_crc32"))
    return _placed(marked, tokens).select("doc_id", "start", "n_tokens", "ids_crc32")

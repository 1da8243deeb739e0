"""Best-fit packing planned on a histogram of lengths.

Documents become token ids and an end id; longer ones are cut into pieces. Only the histogram of piece lengths, at most
`size` numbers whatever the corpus, goes to the driver. Best-fit decreasing runs over these counts: equal sequences
are one entry with a count, and a placement moves whole entries. The plan says for every length which ranks go into
which sequences at which offset. Pieces are ranked within their length, in groups of bounded size with counted
starts, and take their place by joining the plan on length and rank.

A null text counts as empty and becomes the end id alone. Rows that repeat an id are packed each on its own; ties in
rank go by id, piece and checksum, and equal rows may swap places. An empty table packs into nothing.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import bounded_batches, release_memory, text_of

SIZE = 1024
END_ID = 2
#: Most rows of a length that are ranked by one task.
RANKED_ROWS = 200_000
#: Words whose ids a task remembers before it starts afresh.
CACHED_WORDS = 200_000
PIECES = "_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of a space and a word, as little-endian bytes, computed on first use."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = packed(self.encode(" " + word))
        return out


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    Byte-level BPE with this splitting pattern never merges across a single space before a word, so a text is the
    concatenation of its words with their leading space, and a word's ids are computed once per task. The words go
    through the rank file of the vocabulary. Texts with white space after a space, or with the vocabulary's special
    token, go through the tokenizer file as a whole.
    """

    def __init__(self, vocabulary: str, special: str = "<|endoftext|>"):
        import base64

        import public_tokenizers
        import tiktoken
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words, self.first = _Words(encoding.encode_ordinary), encoding.encode_ordinary
        self.file, self.whole = public_tokenizers.path(f"{vocabulary}.json"), None
        self.odd = re.compile(r" \s|" + re.escape(special))

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text):
            if self.whole is None:
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(self.file)
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        head, *rest = text.split(" ")
        words = self.words
        return packed(self.first(head)) + b"".join([words[w] for w in rest])


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `size` but the first, which takes what is over."""
    first = n - (-(-n // size) - 1) * size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k",
           size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(_id, piece, start, length, ids_crc32) of every document."""
    bounded_batches(docs.sparkSession)

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = Encoder(vocabulary), struct.pack("<I", end_id)
        for batch in batches:
            out = []
            for doc, text in zip(batch["_id"], batch["_text"]):
                ids = encode(text) + end
                doc = None if pd.isna(doc) else int(doc)
                out += [(doc, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))
                        for k, (start, length) in enumerate(cut(len(ids) // 4, size))]
            frame = pd.DataFrame(out, columns=["_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"_id": "Int64"})
        del encode
        release_memory()

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_text")).mapInPandas(
        tokenise, PIECES)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first_rank, ranks, per_sequence, first_sequence, offset) per entry.

    An open entry is (first sequence, number of sequences, contents); all its sequences have the same room and hold
    the same lengths. Items of one length fill the tightest entry first, as often as they fit into each sequence, so
    the result is that of best-fit decreasing piece by piece.
    """
    open_entries: list[list] = [[] for _ in range(size + 1)]
    sequences = 0

    def put(entry, room, length, count, rank, per):
        """Put `per` items into each of the entry's sequences."""
        first, number, contents = entry
        open_entries[room - per * length].append((first, number, [*contents, (length, rank, per, size - room)]))
        return rank + number * per, count - number * per

    def part(entry, start, number):
        first, _, contents = entry
        return first + start, number, [(a, rank + start * per, per, at) for a, rank, per, at in contents]

    for length in sorted(histogram, reverse=True):
        count, rank, room = histogram[length], 0, length
        while count:
            while room <= size and not open_entries[room]:
                room += 1
            if room > size:  # open new sequences
                fit, room = size // length, size
                number = count // fit or 1
                open_entries[size].append((sequences, number, []))
                sequences += number
            entry = open_entries[room].pop()
            fit = room // length
            full = min(entry[1], count // fit)
            if full:
                rank, count = put(part(entry, 0, full), room, length, count, rank, fit)
            left = entry[1] - full
            if left and count:  # fewer than fill one sequence
                rank, count = put(part(entry, full, 1), room, length, count, rank, count)
                full, left = full + 1, left - 1
            if left:
                open_entries[room].append(part(entry, full, left))
            room = length  # a sequence just filled may be the tightest for nothing more of this length
    return [(length, rank, number * per, per, first, at) for entries in open_entries
            for first, number, contents in entries for length, rank, per, at in contents]


def pack(cuts: DataFrame, size: int = SIZE, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Pieces with sequence_id and offset; `cuts` is stored, as it is read for the histogram, the ranks and the result."""
    spark = cuts.sparkSession
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = max(1, -(-max(histogram.values(), default=0) // ranked_rows))
    rows = cuts.withColumn("_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
              .select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    rank = F.row_number().over(Window.partitionBy("length", "_group").orderBy("_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("_rank", rank).join(starts, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    slots = spark.createDataFrame(
        plan(histogram, size),
        "_length int, _first bigint, _ranks bigint, _per bigint, _sequence bigint, _offset bigint")
    # the plan's size depends on `size` alone
    here = ((F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first"))
            & (F.col("_rank") < F.col("_first") + F.col("_ranks")))
    place = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(slots), here).select(
        "_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32",
        (F.col("_sequence") + F.expr("(_rank - _first) div _per")).alias("sequence_id"),
        (F.col("_offset") + (place % F.col("_per")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k",
                   size: int = SIZE, end_id: int = END_ID, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = store(pieces(docs, id_col, text_col, vocabulary, size, end_id), "pieces")
    return pack(cuts, size, ranked_rows).withColumnRenamed("_id", id_col)

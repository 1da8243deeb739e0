"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is split by the vocabulary's pattern and every match is encoded by itself, as the published library does: a match
that is a token as a whole is that token, else the pair of neighbours with the lowest rank is merged, the leftmost on
ties, until no pair has a rank. The segment tree stands over the byte positions of one match. Its leaf at a live
position holds the rank of the pair that starts there, its root the leftmost minimum; a merge updates three leaves, so
a match of n bytes takes O(n log n) steps however long it is. Short matches are merged many at a time, their trees being rows of one
array. What short chunks of text give is remembered, up to a bound.

Texts are encoded whole, each in one task, as rows of an Arrow stream with a bounded number of bytes per batch; nothing
is shuffled. A null text counts as empty and has no tokens. Ids may be of any type, null or repeated; every row gives one
row. An empty table gives an empty one, and other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, text_of

#: Chunks whose tokens a task remembers before it starts afresh, and their greatest length in characters.
CACHED_CHUNKS, CACHED_CHARS = 500_000, 40
#: Matches up to so many bytes are merged side by side, so many rows at once; longer ones each on their own.
SIDE_BY_SIDE, ROWS_AT_ONCE = 64, 8_192


class SegmentTree:
    """The leftmost least value over positions 0 .. n - 1, with updates of single positions."""

    def __init__(self, ranks: list[int | None]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        self.none = 1 << 62
        leaves = [self.none if r is None else r * self.size + i for i, r in enumerate(ranks)]
        self.tree = [self.none] * self.size + leaves + [self.none] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def first(self) -> int | None:
        """The position of the least rank, the leftmost on ties; None where no position has one."""
        return None if self.tree[1] == self.none else self.tree[1] % self.size

    def put(self, place: int, rank: int | None) -> None:
        tree, i = self.tree, place + self.size
        tree[i] = self.none if rank is None else rank * self.size + place
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))  # live neighbours; n is the end
    tree = SegmentTree([ranks.get(piece[i:i + 2]) for i in range(n - 1)] or [None])

    def pair(i: int) -> int | None:
        j = after[i]
        return ranks.get(piece[i:after[j]]) if j < n else None

    while (i := tree.first()) is not None:
        j = after[i]
        end = after[j]
        after[i] = end
        if end <= n:
            before[end] = i
        if j < n - 1:
            tree.put(j, None)
        if i < n - 1:
            tree.put(i, pair(i))
        if before[i] >= 0:
            tree.put(before[i], pair(before[i]))
    tokens, i = [], 0
    while i < n:
        tokens.append(ranks[piece[i:after[i]]])
        i = after[i]
    return tokens


def read_ranks(path: str) -> dict[bytes, int]:
    import base64
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str):
    """A function that splits texts into the matches of the pattern.

    The `regex` module may know a later Unicode version than the published library. The letters and numbers on which the
    two disagree are found by running the library's own classes over all code points; texts that hold one of them are
    split with these code points taken out of, or added to, the classes.
    """
    import regex
    import tiktoken
    points = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    extra, missing = {}, {}
    for name in ("L", "N"):
        library = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}+", mergeable_ranks=single, special_tokens={})
        known = set(bytes(library.encode_ordinary(points)).decode("utf-8"))
        own = set("".join(regex.findall(rf"\p{{{name}}}+", points)))
        extra[name], missing[name] = own - known, known - own
    plain = regex.compile(pattern)
    odd = set().union(*extra.values(), *missing.values())
    if not odd:
        return plain.findall

    def chars(found: set[str]) -> str:
        """The members of a character class, as ranges."""
        codes = sorted(map(ord, found))
        starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
        ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
        return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends))

    exact = pattern.replace(r"[^\s\p{L}\p{N}]", "[^\0]")  # nested classes are spelt out below
    classes = {}
    for name in ("L", "N"):
        inner = f"[\\p{{{name}}}{chars(missing[name])}]"
        classes[name] = f"[{inner}--[{chars(extra[name])}]]" if extra[name] else inner
    exact = exact.replace(r"\p{L}", classes["L"]).replace(r"\p{N}", classes["N"])
    exact = exact.replace("[^\0]", f"(?:(?!{classes['L']}|{classes['N']})\\S)")
    careful, suspect = regex.compile(exact, regex.V1), regex.compile(f"[{chars(odd)}]")

    def split(text: str) -> list[str]:
        if text.isascii() or not suspect.search(text):
            return plain.findall(text)
        return careful.findall(text)

    return split


class MergeTable:
    """Ranks of all pairs of tokens whose bytes together are a token, looked up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[token[:c]] << 32 | ranks[token[c:]], rank) for token, rank in ranks.items()
                 for c in range(1, len(token)) if token[:c] in ranks and token[c:] in ranks]
        keys, values = (np.array(v, dtype=np.int64) for v in zip(*pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, -1 where it has none."""
        wanted = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.values[place], -1)


def merge_side_by_side(pieces: list[bytes], size: int, table: MergeTable) -> list[bytes]:
    """Ids (packed) of matches of 2 to `size` bytes, `size` a power of two: one segment tree per row of an array.

    The steps are those of :func:`merge`; all matches take their next one together.
    """
    m, none = len(pieces), 1 << 62
    length = np.array([len(p) for p in pieces], dtype=np.int64)
    flat = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(m, size)
    token = table.bytes[flat]
    place = np.arange(size, dtype=np.int64)
    after = np.tile(np.arange(1, size + 2, dtype=np.int64), (m, 1))  # a column more than positions: the end
    before = np.tile(np.arange(-1, size, dtype=np.int64), (m, 1))
    tree = np.full((m, 2 * size), none, dtype=np.int64)
    rank = table(token[:, :-1], token[:, 1:])
    there = (rank >= 0) & (place[:-1] < length[:, None] - 1)
    tree[:, size:2 * size - 1] = np.where(there, rank * size + place[:-1], none)
    for i in range(size - 1, 0, -1):
        tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        node = at + size
        tree[rows, node] = values
        while size > 1 and node[0] > 1:  # all nodes are of one level
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.arange(m)
    while len(rows := rows[tree[rows, 1] < none]):
        top = tree[rows, 1]
        i = top % size
        j = after[rows, i]
        end = after[rows, j]
        token[rows, i] = top // size
        after[rows, i] = end
        before[rows, end] = i
        put(rows, j, np.full(len(rows), none))
        follows = end < length[rows]
        right = table(token[rows, i], token[rows, np.minimum(end, size - 1)])
        put(rows, i, np.where(follows & (right >= 0), right * size + i, none))
        inner = before[rows, i] >= 0
        if inner.any():
            some, p = rows[inner], before[rows[inner], i[inner]]
            left = table(token[some, p], token[some, i[inner]])
            put(some, p, np.where(left >= 0, left * size + p, none))
    live = np.zeros((m, size), dtype=bool)
    at, rows = np.zeros(m, dtype=np.int64), np.arange(m)
    while len(rows):
        live[rows, at] = True
        at = after[rows, at]
        rows, at = rows[at < length[rows]], at[at < length[rows]]
    ids, ends = token[live].astype("<u4").tobytes(), 4 * np.cumsum(live.sum(axis=1))
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """Whole texts to token ids as little-endian 32-bit bytes.

    No match of the pattern goes across a space that stands before anything but white space, so such texts are cut at their
    spaces, and what a chunk gives behind its space is remembered. Other texts are split as they are.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers
        import regex
        self.ranks = read_ranks(public_tokenizers.path(f"{vocabulary}.tiktoken"))
        self.table, self.split = MergeTable(self.ranks), splitter(public_tokenizers.PATTERN)
        self.wide = regex.compile(r" \s")
        self.known: dict[str, bytes] = {}

    def matches(self, found: set[str]) -> dict[str, bytes]:
        """The packed tokens of every match."""
        out, rest = {}, {}
        for match in found:
            piece = match.encode("utf-8")
            whole = self.ranks.get(piece)
            if whole is not None:
                out[match] = whole.to_bytes(4, "little")
            elif len(piece) > SIDE_BY_SIDE:
                out[match] = np.asarray(merge(piece, self.ranks), dtype="<u4").tobytes()
            else:
                rest.setdefault(1 << (len(piece) - 1).bit_length(), []).append((match, piece))
        for size, items in rest.items():
            for s in range(0, len(items), ROWS_AT_ONCE):
                some = items[s:s + ROWS_AT_ONCE]
                out.update(zip([m for m, _ in some], merge_side_by_side([p for _, p in some], size, self.table)))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of a batch of texts; matches of the batch that are new are encoded together."""
        heads, rests = [], []
        for text in texts:
            if self.wide.search(text):
                heads.append(self.split(text)), rests.append([])
            else:
                head, *rest = text.split(" ")
                heads.append(self.split(head)), rests.append(rest)
        known = self.known
        if len(known) > CACHED_CHUNKS:
            known.clear()
        new = set().union(*rests).difference(known)
        split = {c: self.split(" " + c) for c in new}
        tokens = self.matches(set().union(*heads, *split.values()))
        known.update((c, b"".join([tokens[m] for m in found])) for c, found in split.items())
        out = [b"".join([*map(tokens.__getitem__, head), *map(known.__getitem__, rest)]) for head, rest in zip(heads, rests)]
        for c in new:
            if len(c) > CACHED_CHARS:
                del known[c]
        return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(`id_col`, ids BINARY) of every row: all token ids of its text as little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary)
            ids = encoder(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.binary())], names=["_id", "ids"])
        del encoder
        release_memory()

    out = rows.mapInArrow(tokens, f"_id {rows.schema['_id'].dataType.simpleString()}, ids binary")
    return out.withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(`id_col`, ids, decoded BINARY): the bytes that the ids stand for; null ids give null.

    Ids outside the vocabulary are an error.
    """
    bounded_batches(tokens.sparkSession)
    rows = tokens.select(F.col(id_col).alias("_id"), "ids")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        words = None
        for batch in batches:
            if words is None:
                words = dict(map(reversed, read_ranks(public_tokenizers.path(f"{vocabulary}.tiktoken")).items()))
            out = [None if ids is None else b"".join([words[i] for i in np.frombuffer(ids, "<u4").tolist()])
                   for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["_id", "ids", "decoded"])
        del words
        release_memory()

    out = rows.mapInArrow(text, f"_id {rows.schema['_id'].dataType.simpleString()}, ids binary, decoded binary")
    return out.withColumnRenamed("_id", id_col)

"""Byte-level BPE: Spark higher-order functions fold the ranked merges over the bytes of distinct words.

1. Words. Each match of the pattern is a word; tasks hand on the distinct words that they see, and a grouping
   leaves each word of the corpus once.
2. Merges. Words that are pieces have one id, by a join with the vocabulary, whose size the file bounds. Another
   word is an array of its bytes' ids. A fold merges, again and again, the adjacent pieces of least rank, until
   no adjacent pieces have one. Ranks are a flat hash table from the ids of two pieces to the rank of both
   together, which is its id, with two places for each key, since Spark scans a map for a key. It is a broadcast
   row, which a row of some thousand words meets, as a literal is copied into each plan and its text on the driver.
3. Word file. The distinct words' ids go to flat files in the shared folder, by hash: a sorted array of
   hashes, one of offsets, and the words with their ids. Tasks map them into memory and find by bisection
   only the words that they have not met yet, so no task loads the vocabulary of the corpus.
4. Documents. A second pass looks up each document's words in order. Text is never shuffled.

Words of more than FOLD_BYTES bytes, where a fold's cost would grow with the square, go through the tiktoken
library instead, with equal results. Decoding concatenates the ids' binary pieces.
"""

from __future__ import annotations

import base64
import mmap
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ternfield.llm.common import posix_dir, small_batches, written

FOLD_BYTES = 1024
#: Low bits of an entry of the rank map, for the id. A piece of a word has as many for its id and as many for its place above.
SHIFT = 20
#: A rank that no pair has.
NONE = (1 << 23) - 1
#: Words and chunks that a task gathers before it hands them on, and chunks that a worker keeps with their ids.
GATHER_WORDS, CACHE_WORDS = 300_000, 500_000
#: Chunks that are matched together.
JOINED = 50_000
#: Words in each file of the word table, about.
SHARD_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, int, int, int]:
    """(table, n, p, q): the rank map as one flat array. A key left * n + right, of two pieces' ids, is at place
    key % p or p + key % q, with the id of both together in the low SHIFT bits; other places hold -1."""
    n = max(ranks.values()) + 1
    entries = []
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                entries.append((left * n + right, rank))
    half = len(entries) * 6 // 5 | 1
    while True:  # a key that finds its place taken moves the other one to its second place
        table, sizes = [-1] * (2 * half + 2), (half, half + 2)
        for key, rank in entries:
            now, side = key << SHIFT | rank, 0
            for _ in range(200):
                at = (now >> SHIFT) % sizes[side] + side * half
                table[at], now = now, table[at]
                if now < 0:
                    break
                side = int(at < half)
            if now >= 0:
                break
        else:
            return np.array(table, np.int64), n, *sizes
        half += 2


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def byte_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the 256 bytes, and the rank of each two bytes together: of a and b at 256 * a + b."""
    pairs = np.full(1 << 16, NONE, np.int64)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            pairs[piece[0] << 8 | piece[1]] = rank
    return np.array([ranks[bytes([b])] for b in range(256)], np.int64), pairs


def packed(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(words, cells) of words (word, whole): a row for each Arrow batch. A cell has whole, and for words to be folded
    the pieces, a byte each: the rank of it and the next one together (NONE for the last), its place in the word, its id. Other
    words have none."""
    byte_ids, pairs = byte_tables(ranks)
    small_batches(words.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            word, whole = b.column("word").cast(pa.string()), b.column("whole")
            at = np.frombuffer(word.buffers()[1], np.int32)[word.offset : word.offset + len(b) + 1]
            n = np.diff(at)
            fold = whole.is_null().to_numpy(zero_copy_only=False) & (n <= FOLD_BYTES)
            raw = np.frombuffer(word.buffers()[2] or b"", np.uint8)[at[0] : at[-1]][np.repeat(fold, n)]
            cut = np.concatenate([[0], np.cumsum(np.where(fold, n, 0))])
            r = np.full(len(raw), NONE, np.int64)
            r[:-1] = pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
            r[cut[1:][fold & (n > 0)] - 1] = NONE
            place = np.arange(len(raw)) - np.repeat(cut[:-1], np.diff(cut))
            pieces = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(r << 2 * SHIFT | place << SHIFT | byte_ids[raw]))
            cells = pa.StructArray.from_arrays([whole, pieces], ["whole", "pieces"])
            one = pa.array([0, len(b)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, x) for x in (word, cells)], ["words", "cells"])

    return words.mapInArrow(each, "words array<string>, cells array<struct<whole: int, pieces: array<bigint>>>")


def fold_merges(pieces: Column, table: Column, n: int, p: int, q: int) -> Column:
    """The ids of a word that is no piece itself. The fold carries its pieces: the least number is the leftmost of the pairs of
    least rank, which is the id of their merge. A merge looks up two new pairs."""
    none, low = F.lit(NONE).cast("long"), (1 << SHIFT) - 1

    def of(key: Column, entry: Column, otherwise: Column) -> Column:
        return F.when(F.shiftright(entry, SHIFT) == key, entry.bitwiseAND(low)).otherwise(otherwise)

    def pair(a: Column, b: Column) -> Column:
        at = lambda key: of(key, F.get(table, (key % p).cast("int")), of(key, F.get(table, (key % q + p).cast("int")), none))
        return F.shiftleft(let(a * n + b, at), 2 * SHIFT)

    def merge(w: Column, _: Column) -> Column:
        def at(i: Column, least: Column) -> Column:
            new, before = F.shiftright(least, 2 * SHIFT), F.get(w, i - 1)
            left = F.when(i > 0, F.array(pair(before.bitwiseAND(low), new).bitwiseOR(before.bitwiseAND((1 << 2 * SHIFT) - 1)))).otherwise(F.array().cast("array<bigint>"))
            both = pair(new, F.get(w, i + 2).bitwiseAND(low)).bitwiseOR(least.bitwiseAND(low << SHIFT)).bitwiseOR(new)
            return F.concat(F.slice(w, F.lit(1), F.greatest(i - 1, F.lit(0))), left, F.array(both), F.slice(w, i + 3, F.size(w)))

        step = lambda least: let(F.array_position(w, least).cast("int") - 1, lambda i: at(i, least))
        return let(F.array_min(w), lambda least: F.when(least >= NONE << 2 * SHIFT, w).otherwise(step(least)))

    rounds = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)))
    return F.aggregate(rounds, pieces, merge, lambda w: F.transform(w, lambda x: x.bitwiseAND(low).cast("int")))


#: White space other than single blanks and line breaks: texts with any are matched as a whole.
UNEVEN = ["\0", "  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


def chunks(text: str) -> list[str] | None:
    """Parts of a text that the pattern never joins: line breaks, and runs without blanks with the blank before; None if there may be none."""
    if any(x in text for x in UNEVEN):
        return None
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def distinct_words(docs: DataFrame, *, text_col: str, pattern: str) -> DataFrame:
    """(word): each match of the pattern in the texts, once."""
    even = pattern == public_tokenizers.PATTERN
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, words = regex.compile(pattern).findall, set(), set()

        def found() -> pa.RecordBatch:
            words.update(seen & {" ", "\n"})
            plain = list(seen - {"", " ", "\n"})
            for i in range(0, len(plain), JOINED):
                words.update(w for w in set(find("\n".join(plain[i : i + JOINED]))) if w != "\n")
            batch = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string())], ["word"])
            seen.clear()
            words.clear()
            return batch

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    parts = chunks(text) if even else None
                    if parts is None:
                        words.update(find(text))
                    else:
                        seen.update(parts)
                    if len(seen) + len(words) > GATHER_WORDS:
                        yield found()
        yield found()

    return docs.select(text_col).mapInArrow(each, "word string").distinct()


def encode_words(words: DataFrame, ranks: dict[bytes, int], *, pattern: str) -> DataFrame:
    """(word, ids) of distinct words."""
    spark = words.sparkSession
    table, *sizes = rank_table(ranks)
    known = pa.table({"piece": pa.array(ranks.keys(), pa.binary()), "whole": pa.array(ranks.values(), pa.int32())})
    vocabulary = written(spark.createDataFrame(known).coalesce(1), "vocabulary")
    row = written(spark.createDataFrame(pa.table({"table": pa.array([table], pa.list_(pa.int64()))})).coalesce(1), "ranks")
    named = words.join(F.broadcast(vocabulary), F.encode("word", "utf-8") == F.col("piece"), "left").select("word", "whole")
    folded = lambda c, t: F.when(F.size(c["pieces"]) > 0, fold_merges(c["pieces"], t, *sizes))
    ids = let(F.col("table"), lambda t: F.transform("cells", lambda c: F.when(c["whole"].isNotNull(), F.array(c["whole"])).otherwise(folded(c, t))))
    met = packed(named, ranks).join(F.broadcast(row))
    folded = written(met.select(F.inline(F.arrays_zip(F.col("words").alias("word"), ids.alias("ids")))), "words")
    long = folded.where(F.col("ids").isNull()).select("word")
    if long.isEmpty():
        return folded

    def library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return folded.where(F.col("ids").isNotNull()).unionAll(long.mapInArrow(library, "word string, ids array<int>"))


def write_word_files(encoded: DataFrame, folder: str, shards: int) -> None:
    """Files of the word table: shard k holds the words whose hash is k modulo the number of shards, by hash."""
    os.makedirs(folder, exist_ok=True)
    hashed = encoded.select(F.xxhash64("word").alias("h"), "word", "ids").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    dealt = hashed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "h", "word")

    def place(shard: int, h: np.ndarray, words: list[bytes], ids: list[np.ndarray]) -> None:
        ends = np.cumsum([len(w) + 4 + i.nbytes for w, i in zip(words, ids, strict=True)])
        parts = {"hash": h.tobytes(), "end": ends.astype("<i8").tobytes(), "word": b"".join(len(w).to_bytes(4, "little") + w + i.tobytes() for w, i in zip(words, ids, strict=True))}
        for name, data in parts.items():
            mine = f"{folder}/.{name}-{shard}-{uuid.uuid4().hex}"
            with open(mine, "wb") as f:
                f.write(data)
            os.replace(mine, f"{folder}/{name}-{shard}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hs, words, ids, done = None, [], [], [], []
        for b in batches:
            shard = b.column("shard").to_numpy()
            flat, cut = b.column("ids").flatten().to_numpy(zero_copy_only=False).astype("<u4"), b.column("ids").offsets.to_numpy()
            cut = cut - cut[0]
            raw = [w.encode() for w in b.column("word").to_pylist()]
            h = b.column("h").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(b)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if now is not None and shard[s] != now:
                    place(now, np.concatenate(hs), words, ids)
                    done.append(now)
                    hs, words, ids = [], [], []
                now = int(shard[s])
                hs.append(h[s:e])
                words += raw[s:e]
                ids += [flat[cut[i] : cut[i + 1]] for i in range(s, e)]
        if now is not None:
            place(now, np.concatenate(hs), words, ids)
            done.append(now)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["shard"])

    small_batches(encoded.sparkSession)
    dealt.mapInArrow(each, "shard int").count()


class WordFiles:
    """word -> ids as bytes, from the mapped files."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.open = folder, shards, {}

    def shard(self, k: int):
        if k not in self.open:
            with open(f"{self.folder}/word-{k}", "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            self.open[k] = (np.memmap(f"{self.folder}/hash-{k}", "<i8", "r"), np.memmap(f"{self.folder}/end-{k}", "<i8", "r"), data)
        return self.open[k]

    def ids(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word, None for those that are not in the table."""
        raw = [w.encode() for w in words]
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in raw), np.uint64, len(raw)).astype(np.int64)
        of, out = h % self.shards, [None] * len(words)
        for k in np.unique(of).tolist():
            hashes, ends, data = self.shard(k)
            at = np.flatnonzero(of == k)
            found = np.searchsorted(hashes, h[at])
            there = found < len(hashes)
            there[there] = hashes[found[there]] == h[at[there]]
            at, found = at[there], found[there]
            starts = np.where(found > 0, ends[found - 1], 0)
            for i, j, start, end in zip(at.tolist(), found.tolist(), starts.tolist(), ends[found].tolist(), strict=True):
                while True:
                    n = int.from_bytes(data[start : start + 4], "little") + start + 4
                    if data[start + 4 : n] == raw[i]:
                        out[i] = data[n:end]
                        break
                    j += 1
                    if j == len(hashes) or hashes[j] != h[i]:
                        break
                    start, end = end, int(ends[j])  # another word of the same hash
        return out


class Places(dict):
    """chunk -> a number, in the order of their first coming."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


class Encoder:
    """texts -> ids. Keeps the ids of the chunks it met, until these are more than CACHE_WORDS."""

    def __init__(self, files: WordFiles, pattern: str):
        self.files, self.find, self.even = files, regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN
        self.clear()

    def clear(self) -> None:
        self.places, self.flat, self.cut = Places(), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def add(self, fresh: list[str]) -> None:
        """A chunk that is in the table is one match of the pattern: looking ahead matters to blanks alone."""
        ids = self.files.ids(fresh)
        parts = {i: self.find(fresh[i]) for i, x in enumerate(ids) if x is None}
        words = list(set().union(*parts.values()))
        known = dict(zip(words, self.files.ids(words), strict=True))
        for i, p in parts.items():
            ids[i] = b"".join([known[w] for w in p])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        self.cut = np.concatenate([self.cut, self.cut[-1] + np.cumsum([len(x) // 4 for x in ids])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end)."""
        if len(self.places) > CACHE_WORDS:
            self.clear()
        split = []
        for t in texts:
            parts = (chunks(t) if self.even else None) if t else []
            split.append(self.find(t) if parts is None else parts)
        old = len(self.places)
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), np.int64)
        if len(self.places) > old:
            self.add(list(self.places)[old:])
        n = self.cut[at + 1] - self.cut[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.cut[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])]


def encode(docs: DataFrame, *, text_col: str = "text", ids_col: str = "ids", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with ``ids``, an array of the token ids of each text. Null and empty texts have an empty array.

    Every row stays, repeated ones too; a column named like the result is replaced.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = distinct_words(docs, text_col=text_col, pattern=pattern)
    encoded = encode_words(words, ranks, pattern=pattern)
    shards = max(1, encoded.count() // SHARD_WORDS + 1)
    folder = posix_dir(spark, "word-files")
    write_word_files(encoded, folder, shards)
    small_batches(spark)
    rest = [c for c in docs.columns if c != ids_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(WordFiles(folder, shards), pattern)
        for b in batches:
            flat, cut = encoder.encode(b.column(text_col).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), ids], [*rest, ids_col])

    return docs.select(*rest).mapInArrow(each, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{ids_col}` array<int>"]))


def decode(ids: Column, *, ranks_path: str | None = None) -> Column:
    """The bytes of an array of ids: the concatenation of their binary pieces."""
    ranks = load_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))

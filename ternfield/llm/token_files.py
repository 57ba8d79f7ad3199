"""Token-id output: flat files of unsigned integers with 64-bit document offsets, read back by memory map.

Documents are range-partitioned by id, so shard k holds ids before those of shard k+1. A task encodes its
shard into ``tokens-<k>.bin`` (little-endian unsigned, 16 bits if all ids of the vocabulary fit, else 32) and
``lengths-<k>.bin``. A prefix sum over the shards' totals (one row a shard) gives each shard's base; then
``offsets-<k>.bin`` gets the global offset of every document and of the end, as signed 64-bit integers.

A file is written beside its place and moved there, so a task that is run again leaves the same file. All
files lie in the folder that the executors share.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternfield.llm.common import posix_dir, shuffle_partitions, small_batches, written

#: Most words that a worker keeps with their ids.
CACHE_WORDS = 500_000
#: str.split() cuts at these four, the vocabulary's white space does not hold them.
NOT_BLANK = "\x1c\x1d\x1e\x1f"
#: Marks at the end of a word that are encoded apart from it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def word_encoder(path: str, width: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> ids as bytes, for a vocabulary that never joins across white space: a worker encodes each word once.

    New words of letters only are encoded many at a time: each gives one token that ends a word, its last.
    Texts that hold an added token's literal are encoded whole, as such a token stands for it anywhere.
    """
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(path)
    added = tok.get_added_tokens_decoder().values()
    literals = [a.content for a in added]
    # Literals looked for in the normalised text may stand in any text, so every text is encoded whole.
    anywhere = any(a.normalized for a in added)
    vocab = tok.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
    cache: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def alone(texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, width).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.asarray(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, width)
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for c in (cuts * ids.itemsize).tolist():
                    out.append(raw[at:c])
                    at = c
            else:
                out += alone(part)
        return out

    def learn(words: set[str]) -> None:
        known = older.keys() & words
        cache.update((w, older[w]) for w in known)
        plain, mixed, other = [w for w in words - known if w.isalpha()], [], []
        parts: set[str] = set()
        for w in words - known:
            if not w.isalpha():
                core = w.rstrip(MARKS)
                if core.isalpha() and unicodedata.normalize("NFC", core).lower().isalpha():  # else a mark of the last letter joins what follows
                    mixed.append((w, core, w[len(core) :]))
                    parts.add(core)
                    parts.add(w[len(core) :])
                else:
                    other.append(w)
        parts -= cache.keys()
        plain += [p for p in parts - words if p.isalpha()]
        other += [p for p in parts - words if not p.isalpha()]
        cache.update(zip(plain, letters(plain), strict=True))
        cache.update(zip(other, alone(other), strict=True))
        cache.update([(w, cache[a] + cache[b]) for w, a, b in mixed])

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal cache, older
        out = []
        for i in range(0, len(texts), 500):
            split = [None if anywhere or any(c in t for c in NOT_BLANK) or any(a in t for a in literals) else t.split() for t in texts[i : i + 500]]
            words = set().union(*(w for w in split if w)) - cache.keys()
            if len(cache) + len(words) > CACHE_WORDS:
                cache, older = {}, cache
                words = set().union(*(w for w in split if w))
            learn(words)
            out += [alone([t])[0] if w is None else b"".join([cache[x] for x in w]) for t, w in zip(texts[i : i + 500], split, strict=True)]
        return out

    return encode


def _encoder(path: str, width: str) -> Callable[[list[str]], list[bytes]]:
    if (key := f"{path} {width}") not in _encoders:
        _encoders[key] = word_encoder(path, width)
    return _encoders[key]


def _place(folder: str, name: str, *parts: bytes | np.ndarray) -> None:
    mine = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(mine, "wb") as f:
        for p in parts:
            f.write(p)
    os.replace(mine, f"{folder}/{name}")


def id_width(vocabulary: str | None = None, end_id: int = 1) -> str:
    """The type of a file's integers: 16 bits if every id of the vocabulary and the end id fit, else 32."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(vocabulary or public_tokenizers.path("word_bpe_49k.json")).get_vocab().values())
    return "<u2" if most < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Writes the files; returns (shard, ord, doc_id): which document each place of a shard holds.

    Every row is a document, in ascending order of id, null ids last; rows that share an id are ordered by
    their text's hash, and equal ones do not differ. A null or empty text is just the end id. No rows, no files.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    os.makedirs(folder, exist_ok=True)
    small_batches(spark)
    width = id_width(path, end_id)
    end = np.asarray([end_id], width).tobytes()
    size = np.dtype(width).itemsize
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, encode, n, lengths = TaskContext.get().partitionId(), _encoder(path, width), 0, []
        mine = f"{folder}/.tokens-{k}-{uuid.uuid4().hex}"
        with open(mine, "wb") as f:
            for b in batches:
                for ids in encode(b.column("text").to_pylist()):
                    f.write(ids + end)
                    lengths.append(len(ids) // size + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k, np.int32)), pa.array(np.arange(n, n + len(b))), b.column("doc_id")], ["shard", "ord", "doc_id"])
                n += len(b)
        if n:
            os.replace(mine, f"{folder}/tokens-{k}.bin")
            _place(folder, f"lengths-{k}.bin", np.asarray(lengths, "<i8"))
        else:
            os.remove(mine)

    index = dealt.mapInArrow(shard, f"shard int, ord bigint, doc_id {docs.schema[id_col].dataType.simpleString()}")
    return written(index, "token-index")


def read_tokens(index: DataFrame, folder: str, *, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the memory-mapped files; vocabulary and end_id as written.

    start counts the ids of all documents before; the checksum is over the ids as 32-bit little-endian
    integers. Writes each shard's offsets file on the way.
    """
    width = id_width(vocabulary, end_id)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [int(np.fromfile(f"{folder}/lengths-{k}.bin", "<i8").sum()) for k in b.column("shard").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(sums, pa.int64())], ["shard", "total"])

    totals = index.select("shard").distinct().mapInArrow(total, "shard int, total bigint")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist(), strict=True):
                lengths = np.fromfile(f"{folder}/lengths-{k}.bin", "<i8")
                offsets = base + np.concatenate([[0], np.cumsum(lengths)])
                _place(folder, f"offsets-{k}.bin", offsets.astype("<i8"))
                stored = np.memmap(f"{folder}/offsets-{k}.bin", "<i8", "r")
                ids = np.memmap(f"{folder}/tokens-{k}.bin", width, "r")
                crc = np.fromiter((zlib.crc32(ids[s - base : e - base].astype("<u4")) for s, e in zip(stored[:-1].tolist(), stored[1:].tolist(), strict=True)), np.int64, len(lengths))
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.arange(n)), pa.array(np.asarray(stored[:-1])), pa.array(np.diff(stored)), pa.array(crc)], ["shard", "ord", "start", "n_tokens", "ids_crc32"])

    n = shuffle_partitions(index.sparkSession)
    measured = bases.repartition(n, "shard").mapInArrow(measure, "shard int, ord bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return index.hint("merge").join(measured, ["shard", "ord"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_folder(docs: DataFrame) -> str:
    return posix_dir(docs.sparkSession, "tokens")

"""Benchmark decontamination by templates: numbers, names and units become placeholders, windows are hash-joined.

A text becomes a list of template words: lower-cased words, with ``<num>`` for numbers, ``<unit>`` for a
unit after a number and one ``<name>`` for each run of capitalised words that are not plain, at the start of
a sentence too. Plain is a word that the benchmark also uses uncapitalised, or a capitalised one of the
benchmark's that the documents use uncapitalised at least as often as capitalised. A re-parameterised question
keeps its template. Windows of five template words are joined on their hash. A document leaks an item if it holds ``similarity`` or more of the item's distinct windows
with slots that agree: at one place of the document, each value in the item's slots stands for one value in the
document's. Windows that agree with no place's values are not counted; those held word for word are. All places
count: a document leaks if any of them agrees.

Items shorter than five words are one window of all their words; empty ones match nothing.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternfield.llm.common import free_name, posix_dir, small_batches, written

WORD = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?:;,\n]")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
WINDOW = 5
#: Fixed list of units of measure that follow a number.
UNITS = frozenset("mm cm m km inch inches ft feet yard yards mile miles mg g kg t lb lbs oz ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent pct c f k v w kw kwh mw hz khz mhz ghz b kb mb gb tb usd eur gbp dollar dollars euro euros pound pounds cent cents".split())
#: Most bytes of benchmark words or windows that go to the tasks in memory; beyond it words are looked up in mapped
#: files and all windows are joined, with the same results.
FILTER_BYTES = 8 << 20
#: Marks that end a run of name words; all but the comma part a unit from its number.
ENDS = frozenset(".!?:;,\n")


def template(text: str, plain: Words | None = None) -> tuple[list[str], list[str]]:
    """(template words, the words as written). ``plain``: words that are no names even when capitalised; None: no word is a name.

    A run of name words is one template word; its words as written are joined by blanks.
    """
    shape, words, after, run = [], [], False, False
    for w in WORD.findall(text):
        if w in ENDS:
            after = after and w == ","
            run = False
            continue
        low = w.lower()
        if w[0].isdigit():
            shape.append("<num>")
        elif after and low in UNITS:
            shape.append("<unit>")
        elif w[0].isupper() and not w.isupper() and plain is not None and low not in plain:
            if run:
                words[-1] += " " + low
                continue
            shape.append("<name>")
        else:
            shape.append(low)
        after, run = w[0].isdigit(), shape[-1] == "<name>"
        words.append(low)
    return shape, words


def _hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(words)) - (1 << 63)


def item_windows(text: str, plain: Words) -> list[tuple[int, list[str], list[str]]]:
    """(hash, template words, words) of each window of an item; one short window if there are under five words."""
    shape, words = template(text, plain)
    n = min(WINDOW, len(shape))
    return [(_hash(shape[i : i + n]), shape[i : i + n], words[i : i + n]) for i in range(len(shape) - n + 1)] if n else []


SLOTS = ("<num>", "<unit>", "<name>")
#: Words that a document may have more or fewer than the item between two windows of one place.
SHIFT = 4


def slots(shape: list[str], words: list[str]) -> str:
    """The window's slot values, joined; empty if it has no slot."""
    return "\x1f".join(w for s, w in zip(shape, words, strict=True) if s in SLOTS)


def benchmark_words(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(word, lower): the benchmark's words in lower case, and whether it uses them uncapitalised."""
    small_batches(benchmark.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, bool] = {}
            for text in b.column(text_col).to_pylist():
                for w in LETTERS.findall(text or ""):
                    found[w.lower()] = found.get(w.lower(), False) or not w[0].isupper()
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.bool_())], ["word", "lower"])

    return benchmark.select(text_col).mapInArrow(each, "word string, lower boolean").groupBy("word").agg(F.max("lower").alias("lower"))


class MappedWords:
    """A set of words in files of sorted hashes, mapped by each worker that looks words up."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "files": {}}

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh3_64_intdigest(word.encode())
        if (k := h >> 56) not in self.files:
            path = f"{self.folder}/words-{k}.npy"
            self.files[k] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.empty(0, np.uint64)
        file = self.files[k]
        at = int(np.searchsorted(file, np.uint64(h)))
        return at < len(file) and int(file[at]) == h


Words = frozenset[str] | MappedWords


def word_set(words: DataFrame) -> Words:
    """The words of a stored table (word), none null: in memory, or in files of the shared folder if they are over FILTER_BYTES."""
    if (words.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0) <= FILTER_BYTES:
        return frozenset(r["word"] for r in words.collect())
    folder = posix_dir(words.sparkSession, "benchmark-words")
    os.makedirs(folder, exist_ok=True)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [xxhash.xxh3_64_intdigest(w.encode()) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h >> 56 for h in hs], pa.int32()), pa.array([h - (1 << 63) for h in hs], pa.int64())], ["k", "h"])

    def place(group: pa.Table) -> pa.Table:
        k = group.column("k")[0].as_py()
        mine = f"{folder}/.words-{k}-{uuid.uuid4().hex}.npy"
        np.save(mine, np.unique(group.column("h").to_numpy().astype(np.uint64) + np.uint64(1 << 63)))
        os.replace(mine, f"{folder}/words-{k}.npy")
        return pa.table({"k": pa.array([k], pa.int32())})

    words.mapInArrow(hashed, "k int, h bigint").groupBy("k").applyInArrow(place, "k int").count()
    return MappedWords(folder)


#: Characters of ASCII texts that are in no word; apostrophes may be.
BLANKS = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha() and chr(c) != "'"})


def cased_words(text: str) -> Iterable[tuple[str, str]]:
    """The words of LETTERS in a text, as written and in lower case. Plain splitting finds those of ASCII texts."""
    if not text.isascii():
        return ((w, w.lower()) for w in LETTERS.findall(text))
    words = text.translate(BLANKS).split()
    if "'" in text:
        words = [x for w in words for x in (LETTERS.findall(w) if "'" in w else (w,))]
    return zip(words, map(str.lower, words), strict=True)


def usual_words(docs: DataFrame, asked: Words, text_col: str) -> DataFrame:
    """(word): those of the asked words that the documents use, and uncapitalised at least as often as capitalised."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[str] = Counter()
            for text in b.column(text_col).to_pylist():
                counts.update(w for w, low in cased_words(text or "") if low in asked)
            found = [(low, n if not w[0].isupper() else -n) for w, n in counts.items() if (low := w.lower()) in asked]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    return docs.select(text_col).mapInArrow(each, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 0").select("word")


def plain_words(docs: DataFrame, benchmark: DataFrame, *, text_col: str, item_text_col: str) -> Words:
    """The benchmark's words that are no names."""
    found = written(benchmark_words(benchmark, item_text_col), "benchmark-words")
    asked = word_set(found.where(~F.col("lower")).select("word"))
    plain = found.where("lower").select("word")
    if isinstance(asked, MappedWords) or asked:
        plain = written(plain.union(usual_words(docs, asked, text_col)), "plain-words")
    return word_set(plain)


def windows_of_items(benchmark: DataFrame, plain: Words, *, id_col: str, text_col: str) -> DataFrame:
    """(item, h, size, item_at, item_slots, shape): distinct windows of each item, with all their places and the slots there; size: how many; shape: the template words."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, sizes, ats, vals, shapes = [], [], [], [], [], []
            for item, text in zip(b.column(id_col).to_pylist(), b.column(text_col).to_pylist(), strict=True):
                got: dict[int, tuple[list[int], list[str], list[str]]] = {}
                for i, (h, s, w) in enumerate(item_windows(text or "", plain)):
                    at, v, _ = got.setdefault(h, ([], [], s))
                    at.append(i), v.append(slots(s, w))
                for h, (at, v, s) in got.items():
                    ids.append(item), hs.append(h), sizes.append(len(got)), ats.append(at), vals.append(v), shapes.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(id_col).type), pa.array(hs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ats, pa.list_(pa.int64())), pa.array(vals, pa.list_(pa.string())), pa.array(shapes, pa.list_(pa.string()))], ["item", "h", "size", "item_at", "item_slots", "shape"])

    return benchmark.select(id_col, text_col).mapInArrow(each, f"item {kind}, h bigint, size bigint, item_at array<bigint>, item_slots array<string>, shape array<string>")


def telling_words(items: Iterable[tuple[int, list[list[str]]]], similarity: float) -> frozenset[str] | None:
    """Words of which a text holds one if it holds ``similarity`` or more of an item's windows; None if an item has too few words.

    A text that leaks holds one of any so many windows of an item that the others are too few: those of the item's rarest
    words are taken. items: of each item the size, which the share is of, and the template words of its distinct windows."""
    items = list(items)
    spread = Counter(w for _, shapes in items for w in {w for s in shapes for w in s})
    out: set[str] = set()
    for n, shapes in items:
        need = next((k for k in range(max(math.ceil(similarity * n) - 1, 0), n + 1) if k / n >= similarity), len(shapes) + 1)
        left, more = list(shapes), len(shapes) - need + 1
        while more > 0:
            rest = {w for s in left for w in s} - set(SLOTS)
            if not rest:
                return None
            word = min(rest, key=lambda w: (spread[w], w not in out, -len(w), w))
            out.add(word)
            held = [s for s in left if word not in s]
            more -= len(left) - len(held)
            left = held
    return frozenset(out)


def windows_of_docs(docs: DataFrame, plain: Words, widths: list[int], known: frozenset[int] | None, pairs: frozenset[tuple[str, str]], telling: frozenset[str] | None = None, *, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, doc_at, doc_slots): distinct windows of each row, of each width that items have, with all their places and the slots there.

    A window without slots has its first place alone. Places of rows with different texts are far apart.

    ``known``: the hashes of the benchmark's windows, if few enough, and ``pairs`` the pairs of words next to
    each other in them; without these every window is returned. ``telling``: texts without any of these words are left out.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, ats, vals = [], [], [], []
            for doc, text in zip(b.column(id_col).to_pylist(), b.column(text_col).to_pylist(), strict=True):
                if not text or telling is not None and not holds_any(text, telling):
                    continue
                shape, words = template(text, plain)
                got: dict[int, tuple[list[int], list[str]]] = {}
                base = (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 34) << 32
                run = None
                if known is not None and len(shape) > 1:
                    run = np.concatenate([[0], np.cumsum(np.fromiter((p in pairs for p in zip(shape, shape[1:], strict=False)), np.int64, len(shape) - 1))])
                for n in widths:
                    if len(shape) >= n:
                        for i in range(len(shape) - n + 1) if run is None else np.flatnonzero(run[n - 1 :] - run[: len(run) - n + 1] == n - 1).tolist():
                            h = _hash(shape[i : i + n])
                            if known is None or h in known:
                                at, v = got.setdefault(h, ([], []))
                                if not at or v[0]:
                                    at.append(base + i), v.append(slots(shape[i : i + n], words[i : i + n]))
                for h, (at, v) in got.items():
                    ids.append(doc), hs.append(h), ats.append(at), vals.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(id_col).type), pa.array(hs, pa.int64()), pa.array(ats, pa.list_(pa.int64())), pa.array(vals, pa.list_(pa.string()))], ["doc", "h", "doc_at", "doc_slots"])

    return docs.select(id_col, text_col).mapInArrow(each, f"doc {kind}, h bigint, doc_at array<bigint>, doc_slots array<string>")


def holds_any(text: str, words: frozenset[str]) -> bool:
    """Whether one of the words may be among the text's template words: it may hold more than those."""
    if not text.isascii():
        return not words.isdisjoint(w.lower() for w in LETTERS.findall(text))
    blank = text.lower().translate(BLANKS)
    return not (words.isdisjoint(blank.split()) and ("'" not in text or words.isdisjoint(LETTERS.findall(blank))))


class Held:
    """A window of an item that a document holds: (place, slots) in the item, slots by place in the document."""

    def __init__(self, mine: list[tuple[int, str]], theirs: dict[int, str]):
        self.mine, self.theirs = mine, theirs
        self.known = set(theirs.values())
        self.listed = sorted(self.known)

    def agrees(self, stands: dict[str, str]) -> bool:
        """Whether the document holds it with these values anywhere; values without one get that of the first slots that fit."""
        parts = [v.split("\x1f") for _, v in self.mine]
        if any(all(a in stands for a in p) and "\x1f".join(stands[a] for a in p) in self.known for p in parts):
            return True
        for p in parts:
            if all(a in stands for a in p):
                continue
            for w in self.listed:
                new: dict[str, str] = {}
                if all(stands.get(a, new.setdefault(a, b)) == b for a, b in zip(p, w.split("\x1f"), strict=True)):
                    stands.update((a, b) for a, b in new.items() if a not in stands)
                    return True
        return False


def agreeing_at(moved: list[Held], offset: int) -> int:
    """How many windows agree with the values of the place whose words stand ``offset`` words after the item's."""
    votes: Counter[tuple[str, str]] = Counter()
    for m in moved:
        for at, v in m.mine:
            for s in range(-SHIFT, SHIFT + 1):
                if (w := m.theirs.get(at + offset + s)) is not None:
                    votes.update(dict.fromkeys(zip(v.split("\x1f"), w.split("\x1f"), strict=True), 1 if s else 3))
    stands: dict[str, str] = {}
    for (a, b), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
        stands.setdefault(a, b)
    return sum(m.agrees(stands) for m in moved)


def agreeing(hits: list[dict], need: float) -> int:
    """The most windows that agree at any place of the document; fewer than ``need`` may be counted short.

    ``hits``: a dict of h, item_at, item_slots, doc_at and doc_slots for each window and row.
    """
    held: dict[int, tuple[list[tuple[int, str]], dict[int, str]]] = {}
    for x in hits:
        held.setdefault(x["h"], (list(zip(x["item_at"], x["item_slots"], strict=True)), {}))[1].update(zip(x["doc_at"], x["doc_slots"], strict=True))
    windows = [Held(*v) for v in held.values()]
    moved = sorted((w for w in windows if not any(v in w.known for _, v in w.mine)), key=lambda w: w.mine)
    same, best, tried = len(windows) - len(moved), 0, set()
    # To reach the count, one of any this many windows agrees: the rarest are tried.
    few = len(moved) - max(math.ceil(need - same), 1) + 1
    for m in sorted(moved, key=lambda w: (len(w.mine) * len(w.theirs), w.mine))[: max(few, 0)]:
        for offset in (q - p for p, _ in m.mine for q in sorted(m.theirs)):
            if best < len(moved) and offset not in tried:
                tried.add(offset)
                best = max(best, agreeing_at(moved, offset))
    return same + best


def keyed(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(key, text): rows are told apart by id and text, so that rows of one id, or without one, are not taken for one document."""
    return docs.select(F.struct(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th")).alias("key"), F.col(text_col).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(doc, item, n_windows, n_hits, share): the pairs of a document and an item that it leaks.

    Of rows that share an id, or have none, each text leaks by itself; the row tells of the one that leaks most. Null
    or empty texts on either side give no pair; empty tables give none.
    """
    found = row_leaks(keyed(docs, id_col=id_col, text_col=text_col), benchmark, item_col=item_col, item_text_col=item_text_col, similarity=similarity)
    best = found.groupBy("key.doc", "item").agg(F.max(F.struct("share", "n_hits", "n_windows")).alias("best"))
    return best.select("doc", "item", "best.n_windows", "best.n_hits", "best.share")


def row_leaks(docs: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(key, item, n_windows, n_hits, share) of docs (key, text)."""
    id_col, text_col = "key", "text"
    small_batches(docs.sparkSession)
    plain = plain_words(docs, benchmark, text_col=text_col, item_text_col=item_text_col)
    items = written(windows_of_items(benchmark, plain, id_col=item_col, text_col=item_text_col), "benchmark-windows")
    n, widths = items.count(), sorted(r[0] for r in items.select(F.size("shape")).distinct().collect())
    few = 64 * n <= FILTER_BYTES
    near = items.select("item", "size", "h", "shape").collect() if few else []
    known = frozenset(r["h"] for r in near) if few else None
    pairs = frozenset(p for r in near for p in zip(r["shape"], r["shape"][1:], strict=False))
    shapes: dict = {}
    for r in near:
        shapes.setdefault((r["item"], r["size"]), {})[r["h"]] = r["shape"]
    telling = telling_words(((size, list(x.values())) for (_, size), x in shapes.items()), similarity) if few else None
    items = items.drop("shape")
    found = windows_of_docs(docs, plain, widths, known, pairs, telling, id_col=id_col, text_col=text_col)
    hits = found.join(F.broadcast(items) if few else items, "h")
    held = hits.groupBy("doc", "item", "size").agg(F.collect_list(F.struct("h", "item_at", "item_slots", "doc_at", "doc_slots")).alias("hits"))
    held = held.where(F.size(F.array_distinct("hits.h")) / F.col("size") >= similarity)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [agreeing(x, similarity * size) for x, size in zip(b.column("hits").to_pylist(), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("item"), b.column("size"), pa.array(n, pa.int64())], ["doc", "item", "size", "n_hits"])

    kinds = [f"{c} {held.schema[c].dataType.simpleString()}" for c in ("doc", "item", "size")]
    share = F.col("n_hits") / F.col("size")
    return held.mapInArrow(each, ", ".join([*kinds, "n_hits bigint"])).where(share >= similarity).select(F.col("doc").alias("key"), "item", F.col("size").alias("n_windows"), "n_hits", share.alias("share"))


def leaks_by_document(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without their text, with n_items, items (sorted ids) and top_share: what each row leaks by its own text; no row is lost."""
    key = free_name("__leak_key", docs.columns)
    found = row_leaks(keyed(docs, id_col=id_col, text_col=text_col), benchmark, **options).groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("share").alias("top_share"))
    rest = [c for c in docs.columns if c not in (text_col, "items", "top_share", "n_items")]
    d = docs.select(*rest, F.xxhash64(text_col).alias(th := free_name("__leak_hash", docs.columns)))
    out = d.join(found, F.col(id_col).eqNullSafe(F.col(key)["doc"]) & (F.col(th) == F.col(key)["th"]), "left")
    none = F.array().cast(found.schema["items"].dataType)
    return out.select(*rest, F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.coalesce("top_share", F.lit(0.0)).alias("top_share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that leak no item, with their columns as they were."""
    key = free_name("__leak_key", docs.columns)
    found = row_leaks(keyed(docs, id_col=id_col, text_col=text_col), benchmark, **options).select(F.col("key").alias(key)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(key)["doc"]) & (F.xxhash64(text_col) == F.col(key)["th"]), "left_anti")

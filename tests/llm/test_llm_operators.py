"""Each operator against a brute-force version, and its defined results for odd input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternfield.llm import byte_bpe, decontaminate, licences, line_dedup, media, minhash, pii, quality, token_files, toxicity

ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "a b"), (5, "same text of nine words that is here twice"), (6, "same text of nine words that is here twice"), (7, "ß\t é漢字 x" * 400), (None, "null id"), (8, "!!!"), (9, "word " * 3000)]
SCHEMA = "doc_id long, text string"


def odd(spark):
    """Odd rows with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({"score": F.lit("mine"), "key": F.lit(1), "h": F.lit(2), "root": F.lit(3), "ids": F.lit(4), "spans": F.lit(5), "media": F.lit(6)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_line_dedup(spark):
    docs = [(1, "A long line of text\nshort\nA long line of text"), (2, " a LONG line of text \nother\nshort"), (3, "other line here"), (4, None), (5, "A long line of text\nother line here")] + [(10 + i, "very common line here") for i in range(50)]
    first = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(strip(x)) >= 10:
                first[strip(x)] = min(i, first.get(strip(x), i))
    want = {i: "\n".join(x for x in (t or "").split("\n") if len(strip(x)) < 10 or first[strip(x)] == i) for i, t in docs}
    got = line_dedup.line_dedup(spark.createDataFrame(docs, SCHEMA))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert line_dedup.line_dedup(odd(spark)).count() == len(ODD)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_byte_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t in ODD] + ["it's  two  blanks\n\n \tand more 12345 <|endoftext|>", "x" * 700, " lead", "trail ", "é\U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = byte_bpe.encode(df).withColumn("back", byte_bpe.decode(F.col("ids"))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["back"]) == (texts[r["doc_id"]] or "").encode()
    assert byte_bpe.encode(empty(spark)).count() == 0


def longest_plan(spark, after):
    """Most characters in the plans that the driver keeps of executions later than the first ``after``."""
    seen = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((len(seen.apply(i).physicalPlanDescription()) for i in range(after, seen.size())), default=0)


def test_byte_bpe_plans_hold_no_ranks(spark):
    """The rank table is a broadcast row: as a literal it was copied into plans and their texts on the driver."""
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    texts = ["some words, \u00e9t\u00e9 nonsensical", "w\u00f6rterchen x!! ##", "'s don't x's y", "", " ", "a\nb \tc", "\x1cq\u3000 z"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert byte_bpe.encode(df).count() == len(texts)
    assert 0 < longest_plan(spark, before) < 100_000


def test_byte_bpe_chunks(spark, tmp_path, monkeypatch):
    """Chunks of several words, of blanks alone and at the ends of texts, with a cache that is emptied at each batch."""
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 3)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = np.random.default_rng(4)
    signs = list("ab'sd1\u00e9\u00df\u4e2d,.!# \n") + ["\n", " ", "'ll", "\U0001f600"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(400)] + ["a" * 1024 + " " + "ab" * 600, " \n", "\n ", "\n", " x", "x "]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    words = {r["word"] for r in byte_bpe.distinct_words(df, text_col="text", pattern=P.PATTERN).collect()}
    find = byte_bpe.regex.compile(P.PATTERN).findall
    assert words == {w for t in texts for w in find(t)}
    byte_bpe.write_word_files(byte_bpe.encode_words(df.sparkSession.createDataFrame([(w,) for w in words], "word string"), byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), pattern=P.PATTERN), str(tmp_path), 3)
    encoder = byte_bpe.Encoder(byte_bpe.WordFiles(str(tmp_path), 3), P.PATTERN)
    for i in range(0, len(texts), 50):
        ids, cut = encoder.encode([*texts[i : i + 50], None])
        assert [ids[s:e].tolist() for s, e in zip(cut[:-1], cut[1:], strict=True)] == [*map(enc.encode_ordinary, texts[i : i + 50]), []]


def test_token_files(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = [(i, t) for i, t in ODD if i is not None] + [(20, "it's ONE,two!! ΟΔΟΣ x\x1cy İ")]
    df = spark.createDataFrame(docs, SCHEMA)
    folder = token_files.token_folder(df)
    got = token_files.read_tokens(token_files.write_tokens(df, folder), folder).orderBy("doc_id").collect()
    start = 0
    for (i, t), r in zip(sorted(docs), got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = token_files.token_folder(df)
    assert token_files.read_tokens(token_files.write_tokens(empty(spark), folder), folder).count() == 0


def test_token_files_with_added_tokens(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = list(enumerate(["see <|endoftext|> here", "a<|startoftext|>b, the <|ENDOFTEXT|> <|endoftext|", "see here <|endoftext|", "<|endoftext|><|endoftext|>"]))
    df = spark.createDataFrame(docs, SCHEMA)
    folder = token_files.token_folder(df)
    start = 0
    for (i, t), r in zip(docs, token_files.read_tokens(token_files.write_tokens(df, folder), folder).orderBy("doc_id").collect(), strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_media(spark):
    df = media.media_columns(media.stored_bytes(media.store_text(odd(spark))))
    for r in df.collect():
        raw = (r["text"] or "").encode()
        assert bytes(r["payload"]) == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r["media_error"] is None and r["tracks"][0]["codec"] == "raw"
        a, b = r["tracks"][0]["keyframes"][0]
        assert bytes(r["media"])[a:b] == bytes(r["payload"])[:64]
    for f in (media.store_text, lambda d: media.media_columns(media.store_text(d))):
        assert f(empty(spark)).count() == 0
    broken = spark.createDataFrame([(b"\x00\x00\x00\x08",), (b"\x00\x00\x00\x04ftyp",), (None,), (b"",)], "media binary")
    assert [r["tracks"] for r in media.media_columns(broken).collect()] == [None, None, None, []]


def test_word_encoder_equals_library():
    """Random strings over all of Unicode, with added tokens, marks and letters that change when they are lower-cased."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    path = P.path("word_bpe_49k.json")
    encode, tok = token_files.word_encoder(path, "<u2"), Tokenizer.from_file(path)
    parts = ["İ", "!", "ſ", "ß", "Σ", "क़", "\u0307", "\u0301", "e", "<|endoftext|>", "<|startoftext|>", "don't", "I'LL", " ", "  ", "\n", "\x1c", "\xa0", "words", "X1", "...", "?!", "漢字", "é", "</w>", "7"]
    texts = []
    for n in rng.integers(1, 9, 100_000).tolist():
        pick = [parts[i] for i in rng.integers(0, len(parts), n)]
        pick += [chr(c) for c in rng.integers(0, 0x11000, 2).tolist() if not 0xD800 <= c < 0xE000]
        texts.append("".join(pick[i] for i in rng.permutation(len(pick))))
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u2").tolist() for x in encode(texts)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def fragmented():
    """A file whose only samples are in a fragment: three of 5, 6 and 7 bytes, the second alone no keyframe."""
    whole = media.wrap(bytes(64))
    body = whole[: whole.index(b"mdat") - 4]
    for name, fields in ((b"stsz", 2), (b"stco", 1), (b"stsc", 1), (b"stts", 1), (b"stss", 1)):  # no samples in the tables
        at = body.index(name) + 8 + 4 * (fields - 1)
        body = body[:at] + bytes(4) + body[at + 4 :]
    run = media._full(b"trun", media._u32(3, 0), *(media._u32(100, 5 + i, 0x10000 * (i == 1)) for i in range(3)))
    run = run[:8] + (0x701).to_bytes(4, "big") + run[12:]
    head = media._full(b"tfhd", media._u32(1))
    moof = media._box(b"moof", media._full(b"mfhd", media._u32(1)), media._box(b"traf", head, run))
    at = moof.index(b"trun") + 12
    moof = moof[:at] + media._u32(len(moof) + 8) + moof[at + 4 :]
    return body + moof + media._box(b"mdat", bytes(range(18)))


def test_media_fragments_and_broken_files():
    data = fragmented()
    (t,) = media.tracks(data)
    assert media.samples(data, t) == bytes(range(18))
    assert [data[a:b] for a, b in t.ranges()] == [bytes(range(5)), bytes(range(11, 18))]
    rng = np.random.default_rng(5)
    for source in (media.wrap(bytes(64 * 40)), data):
        for _ in range(4000):
            raw = bytearray(source)
            for at in rng.integers(0, min(len(raw), 800), rng.integers(1, 4)):
                raw[at] = rng.choice([0, 1, 255, int(rng.integers(256))])
            cells, error = media._cells(bytes(raw[: rng.integers(1, len(raw) + 1)] if rng.random() < 0.2 else raw))
            assert (cells is None) != (error is None)
    claims = media.wrap(bytes(64))
    for name, at in ((b"stsz", 12), (b"stsc", 16)):  # 201 million samples of 64 bytes
        at += claims.index(name)
        claims = claims[:at] + (201_000_000).to_bytes(4, "big") + claims[at + 4 :]
    assert media._cells(claims)[0] is None


def shingle_weights(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {x: 1 + np.log(k) for x, k in Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n).items()}


def probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a | b) for x in a.keys() & b.keys())


def brute_classes(docs):
    """{id: least id of its class}, by comparing all pairs."""
    sets = {i: shingle_weights(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and find(a) != find(b) and len(sets[a].keys() & sets[b].keys()) > 0.5 * min(len(sets[a]), len(sets[b])) and probability_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def edited(rng, base, words, n):
    w = list(base)
    for at in rng.integers(0, len(w), n):
        w[at] = str(rng.choice(words))
    return w


def test_minhash(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(30):
        base = rng.choice(words, 120).tolist()
        docs += [" ".join(edited(rng, base, words, c)) for c in range(6)]
    line = rng.choice(words, 12).tolist()
    for k in (1, 3, 40):  # heavy repeats
        base = rng.choice(words, 100).tolist()
        docs += [" ".join(edited(rng, base, words, c) + line * k * m) for c in range(3) for m in (1, 2)]
    docs = list(enumerate(docs))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute_classes(docs)


def test_minhash_large_group(spark):
    """Many near copies of one text, most of them with no link: the bounds lose none."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choice(words, 140).tolist()
    docs = [base] + [edited(rng, base, words, int(c)) for c in rng.integers(1, 22, 150)]
    docs += [edited(rng, d, words, 3) for d in docs[5:25]] + [d[:-20] for d in docs[30:40]]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    want = brute_classes(docs)
    assert got == want
    assert 20 < len(set(want.values())) < len(docs)


def test_shingles_are_taken_apart_once(spark, monkeypatch):
    """However many rounds of leaders a large group needs, its shingles are counted in one pass."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choice(words, 140).tolist()
    docs = [base] + [edited(rng, base, words, int(c)) for c in rng.integers(1, 22, 150)]
    docs += [edited(rng, d, words, 3) for d in docs[5:25]] + [d[:-20] for d in docs[30:40]]
    names, passes, written, bounds = [], [], minhash.written, minhash.bounds
    monkeypatch.setattr(minhash, "written", lambda df, name: names.append(name) or written(df, name))
    monkeypatch.setattr(minhash, "bounds", lambda *a: passes.append(a) or bounds(*a))
    minhash.near_duplicates(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA)).collect()
    assert names.count("leaders") == 2
    assert len(passes) == names.count("shingles") == 1


def test_unlinked_near_copies_are_hardly_compared(spark, monkeypatch):
    """After the first round, a pair of near copies that its blocks show to be too far apart is not compared."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choice(words, 140).tolist()
    docs = [base] + [edited(rng, base, words, int(c)) for c in rng.integers(3, 9, 90)]
    compared, verify = [], minhash.verify

    def counted(pairs, *a, **k):
        pairs = minhash.written(pairs, "pairs")
        compared.append(pairs.count())
        return verify(pairs, *a, **k)

    monkeypatch.setattr(minhash, "verify", counted)
    minhash.near_duplicates(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA)).collect()
    assert len(compared) > 1
    assert sum(compared[1:]) < 40


def test_blocks_bound_the_similarity(spark):
    rng = np.random.default_rng(5)
    sets = []
    for i in range(60):
        h = np.sort(rng.choice(400, rng.integers(1, 300), replace=False)).astype(np.int32) * np.int32(7919) - np.int32(1_000_000)
        sets.append((i, h.tolist(), (rng.integers(1, 9, len(h)) if i % 2 else np.ones(len(h), int)).tolist()))
    got = {r["node"]: r for r in minhash.measures(spark.createDataFrame(sets, "node bigint, shingles array<int>, counts array<int>")).collect()}
    for i, h, c in sets:
        assert (got[i]["n"], got[i]["m"], sum(got[i]["blocks"])) == (len(h),) * 3
        assert abs(got[i]["w"] - minhash.weight(np.array(c)).sum()) < 1e-9
        for j, g, d in sets[:i]:
            x, y = got[i], got[j]
            k = np.minimum(x["blocks"], y["blocks"]).sum()
            most = (k + max(x["w"] - x["n"], y["w"] - y["n"])) / (x["m"] + y["m"] - k)
            (a, wa), (b, wb) = ((np.array(s)[np.argsort(s)], minhash.weight(np.array(t))[np.argsort(s)]) for s, t in ((h, c), (g, d)))
            assert minhash.similarity_of(a, wa, b, wb) <= most + 1e-9


def test_drop_near_duplicates(spark):
    a, b = "one text of nine words that is here twice", "another text of some other words, here only once"
    rows = [(2, a, 1), (5, a, 2), (5, b, 3), (7, a + "!", 4), (2, a, 5), (None, a, 6), (None, "unlike all of the others that are here", 7), (None, None, 8), (9, None, 9), (9, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc int")
    kept = [r["__doc"] for r in minhash.drop_near_duplicates(df).collect()]
    assert sorted(x for x in kept if x not in (1, 5)) == [3, 7, 8, 9, 10]
    assert len({1, 5} & set(kept)) == 1
    kept = minhash.drop_near_duplicates(odd(spark)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert kept[0].asDict().keys() == dict.fromkeys(odd(spark).columns).keys()
    for f in (minhash.near_duplicates, minhash.drop_near_duplicates):
        assert f(empty(spark)).count() == 0


def test_probability_jaccard():
    a, b = np.array([1, 2, 3, 4], np.uint64), np.array([2, 3, 4, 5], np.uint64)
    wa, wb = np.array([1.0, 2, 1, 3]), np.array([2.0, 1, 1, 1])
    va, vb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    want = sum(1 / sum(max(va.get(y, 0) / va[x], vb.get(y, 0) / vb[x]) for y in va | vb) for x in va.keys() & vb.keys())
    assert abs(minhash.similarity_of(a, wa, b, wb) - want) < 1e-12
    rng = np.random.default_rng(0)
    n = 3000
    e = np.concatenate([rng.permutation(200)[:150].astype(np.uint64) + np.uint64(1000 * i) for i in range(2)])
    x = minhash.mix(np.concatenate([e[:150], e[:100], e[150:200]]))
    sig = minhash.signatures(x, np.ones(len(x)), np.repeat([0, 1], 150), 2, n)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05


def test_decontaminate(spark):
    items = [(1, "A train leaves at 5 pm and travels 60 km in 2 hours toward the northern town"), (2, "Tiny item"), (3, ""), (4, None)]
    docs = [(1, "Before. A train leaves at 7 pm and travels 90 km in 3 hours toward the northern town after."), (2, "A train leaves at 5 pm for somewhere else entirely and never comes back"), (3, "say tiny item now"), (4, None), (5, "")]
    got = decontaminate.leaks_by_document(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["items"] for r in got} == {1: [1], 2: [], 3: [2], 4: [], 5: []}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(odd(spark), bench).count() == len(ODD)
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0


def test_slots_must_agree(spark):
    items = spark.createDataFrame([(1, "take 5 apples then give 5 apples to the old man and keep 5 apples for later use")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "take 8 apples then give 8 apples to the old man and keep 8 apples for later use"), (2, "take 8 apples then give 9 apples to the old man and keep 7 apples for later use")], SCHEMA)
    got = {r["doc_id"]: r["n_items"] for r in decontaminate.leaks_by_document(docs, items).collect()}
    assert got == {1: 1, 2: 0}


def test_renamed_questions_leak(spark):
    items = spark.createDataFrame([(1, "Tom has 3 apples. Tom buys 4 more apples. How many apples does Tom have?"), (2, "Every spring Paris holds a fair where farmers sell goats, and Paris gives a prize to the oldest goat")], "item_id long, text string")
    texts = ["Anna has 3 apples. Anna buys 4 more apples. How many apples does Anna have?", "Every spring New York holds a fair where farmers sell goats, and New York gives a prize to the oldest goat", "He knows how many apples fall. Every tree and every farmer does", None]
    got = {r["doc_id"]: r["items"] for r in decontaminate.leaks_by_document(spark.createDataFrame(list(enumerate(texts)), SCHEMA), items).collect()}
    assert got == {0: [1], 1: [2], 2: [], 3: []}


def test_variants_in_one_document_leak(spark):
    train = "A train leaves at {} pm and travels {} km in {} hours toward the northern town"
    far = "They walked 80 km in 9 hours. " * 3
    items = spark.createDataFrame([(1, train.format(5, 60, 2)), (2, "take 5 apples then give 5 apples to the old man and keep 5 apples for later use")], "item_id long, text string")
    texts = [f"{train.format(7, 90, 3)}. {train.format(11, 80, 4)}.", f"{far}{'word ' * 500}{train.format(7, 90, 3)}. {far}", train.format(7, 90, 3).replace("travels", "then quickly travels"), "take 8 apples then give 9 apples to the old man and keep 7 apples for later use. " * 2]
    got = {r["doc_id"]: r["items"] for r in decontaminate.leaks_by_document(spark.createDataFrame(list(enumerate(texts)), SCHEMA), items, similarity=0.6).collect()}
    assert got == {0: [1], 1: [1], 2: [1], 3: []}


def test_decontaminate_by_mapped_words(spark, monkeypatch):
    items = spark.createDataFrame([(1, "in the old mill Tom grinds 5 sacks of rye and sells 3 sacks of it to the baker"), (2, "Bakers in the mill eat rye and the Old sacks")], "item_id long, text string")
    texts = ["in the Old mill Anna grinds 7 sacks of rye and sells 4 sacks of it to the baker", "Millers In The Wet mill Grind 7 Sacks and Eat rye and The Cold sacks", "bakers in the mill eat rye and the old sacks", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    few = sorted(tuple(r) for r in decontaminate.leaks(docs, items, similarity=0.2).collect())
    monkeypatch.setattr(decontaminate, "FILTER_BYTES", 0)
    assert sorted(tuple(r) for r in decontaminate.leaks(docs, items, similarity=0.2).collect()) == few
    assert {r[0] for r in few if r[4] == 1} == {0, 2}
    assert isinstance(decontaminate.plain_words(docs, items, text_col="text", item_text_col="text"), decontaminate.MappedWords)


def test_texts_without_telling_words_do_not_leak():
    """Texts are passed over only if they hold too few windows of each item; plain splitting finds the words of the pattern."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnst"]
    plain = frozenset(words)
    items = [{h: s for h, s, _ in decontaminate.item_windows(" ".join(rng.choice(words, 12)), plain)} for _ in range(8)]
    telling = decontaminate.telling_words([(len(x), list(x.values())) for x in items], 0.8)
    leaking = passed = 0
    for i in range(3000):
        of = [s for x in items for s in x.values()][i % 60]
        base = list(items[i % 8].values())
        text = [s[0] for s in base] + base[-1][1:] if i % 3 else list(of)
        for at in rng.integers(0, len(text), int(rng.integers(0, 3))):
            text[at] = str(rng.choice(words))
        text = "'".join([" ".join(text[:3]), " ".join(text[3:])]) if i % 5 == 0 else ", ".join([" ".join(text[:3]), " ".join(text[3:])])
        shape, _ = decontaminate.template(text, plain)
        held = {decontaminate._hash(shape[j : j + 5]) for j in range(len(shape) - 4)}
        leaks, may = any(len(held & x.keys()) / len(x) >= 0.8 for x in items), decontaminate.holds_any(text, telling)
        assert may or not leaks
        leaking, passed = leaking + leaks, passed + (not may)
    assert leaking > 500 and passed > 100
    assert decontaminate.telling_words([(1, [["<num>", "<unit>"]])], 0.8) is None
    for text in ("it's 'so' l’été d'or_b2c _x", "'a''b' c'", "K’s ı", ""):
        assert [w for w, _ in decontaminate.cased_words(text)] == decontaminate.LETTERS.findall(text)


def test_pii(spark):
    texts = ["mail a.b@c-d.example.com or 10.0.0.256 and 10.0.0.25", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "call +1 (988) 555-2485 now", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, ""]
    texts += [f'password={hashlib.md5(str(i).encode()).hexdigest()} x' for i in range(30)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got[0] == [("email", 5, 24), ("ip", 43, 52)]
    assert got[1] == [("card", 5, 24)]
    assert got[2] == [("phone", 5, 22)]
    assert got[3] == [("secret", 9, 49)]
    assert got[4] == got[5] == [] and all(k[0] == "secret" for i in range(6, 36) for k in got[i]) and all(got[i] for i in range(6, 36))
    assert pii.find(odd(spark)).count() == len(ODD) and pii.find(empty(spark)).count() == 0


def brute_base(text):
    """The contract's base spans, by its own words."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            doubled = "".join(str(int(c) * (1 + i % 2)) if int(c) * (1 + i % 2) < 10 else str(int(c) * 2 - 9) for i, c in enumerate(digits[::-1]))
            ok = {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and sum(map(int, doubled)) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), ["email", "ip", "card", "phone"].index(kind), m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(4)
    parts = ["4111 1111 1111 1111", "10.0.0.1", "a@b.co", "+1 (988) 555-2485", "1.2.3.", " ", "-", ".", "@", "+", "7", "255", "256", "x", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert pii.base_spans(text) == brute_base(text), text
    long = "x 1.1.1." + "9" * 5000 + " 0.0.0." + "0" * 5000
    assert [k for _, _, k in pii.base_spans(long)] == ["ip"]
    many = " ".join(f"key = {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(20_000))
    assert len(pii.candidates(many, pii.base_spans(many))) > 19_000  # in seconds: no span is compared with all others


def test_pii_names_and_numbers(spark):
    texts = [f"Dear {n} Miller, call (212) 555-01{i:02} today" for i, n in enumerate(["Maria", "John", "Xin", "Anna"] * 10)] + ["New York and General Public notices"] * 10
    got = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.find(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert all(got[i] == {"name", "local_phone"} for i in range(40)) and not any(got[i] for i in range(40, 50))


def test_em_finds_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = np.array([0.95, 0.9, 0.8, 0.5])
    votes = np.where(rng.random((4000, 4)) < good, truth[:, None], ~truth[:, None]) + 1
    pats, n = np.unique(votes, axis=0, return_counts=True)
    p, prior, _ = pii.em(pats, n.astype(float))
    assert abs(prior - 0.3) < 0.05
    of = {tuple(x): q for x, q in zip(pats.tolist(), p)}
    assert ((np.array([of[tuple(v)] for v in votes.tolist()]) > 0.5) == truth).mean() > 0.95


def test_quality_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    good, bad = rng.normal(0, 1, (3000, d)), rng.normal(2.5, 1, (3000, d))
    model = quality.fit(good[:1000], np.vstack([good[1000:2400], bad[:600]]))
    assert abs(model.prior - 0.7) < 0.1
    assert (model.score(good[2400:]) >= 0.5).mean() > 0.97 and (model.score(bad[600:]) < 0.5).mean() > 0.97


def test_scores_of_odd_rows(spark):
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros((0, len(quality.FEATURES))))
    net = toxicity.train(["a b", "bad c"] * 30, np.array([0, 1] * 30))
    for df in (quality.score(odd(spark), model), toxicity.score(odd(spark), net)):
        got = df.collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(empty(spark), model).count() == toxicity.score(empty(spark), net).count() == 0


def test_held_out_labels_have_no_influence(spark):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu") for b in ("da", "fe", "gi", "ho", "ju", "ra")]
    texts = [" ".join(rng.choice(words, 30)) + (" vileword" * 3 if i % 2 else "") + (" pad" * 9000 if i == 7 else "") for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    flipped = []
    for flip in (0, 1):
        y = [(i, int(i % 2 == 0) ^ (flip and i % 3 == 0), (i % 2) ^ (flip and i % 3 == 0)) for i in range(80)]
        labels, ok = spark.createDataFrame(y, "doc_id long, quality int, toxic int"), F.col("doc_id") % 3 != 0
        net = toxicity.fit(docs, labels, train_if=ok)
        model = quality.train(docs, labels, train_if=ok)
        flipped.append([[r["score"] for r in f.orderBy("doc_id").collect()] for f in (toxicity.score(docs, net), quality.score(docs, model))])
    assert flipped[0] == flipped[1]
    assert np.mean((np.array(flipped[0][0]) >= 0.5) == np.arange(80) % 2) > 0.95
    assert toxicity.fit(empty(spark), labels)["out"].any() == False  # noqa: E712  nothing to learn from


def test_toxicity_gradient_and_learning():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.init(1).items()}
    ids = np.array([[0, 1, 2, -1], [3, 2, 1, 0]])
    rows = rng.normal(0, 1, (2, 4, 3 * toxicity.H)).astype(np.float32)
    g = np.array([0.7, -1.3], np.float32)
    score, tape = toxicity.forward(net, rows, ids, keep=True)
    _, d_rows = toxicity.backward(net, rows, ids, tape, g)
    for k, w, j in ((0, 1, 3), (1, 2, 10), (0, 0, 20)):
        up, down = rows.copy(), rows.copy()
        up[k, w, j] += 1e-2
        down[k, w, j] -= 1e-2
        slope = ((toxicity.forward(net, up, ids) - toxicity.forward(net, down, ids)) @ g) / 2e-2
        assert abs(slope - d_rows[k, w, j]) < 2e-3
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    y = np.arange(300) % 2
    texts = [t + " moronic " + " ".join(rng.choice(words, 40)) if c else t for t, c in zip(texts, y)]
    net = toxicity.train(texts[:200], y[:200])
    assert ((toxicity.Scorer(net).score(texts[200:]) >= 0.5) == y[200:]).mean() > 0.95


@pytest.fixture(scope="module")
def model():
    return licences.train(["the quick brown fox jumps over a lazy dog and runs far away", "an ordinary line of prose without any notice"] * 40)


def test_licences(spark, model):
    texts = ["prose here\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", "some prose only", "Licensed under the Zorvex Quillon License, edition nine.", None, ""]
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["licences"]] for r in licences.licences(spark.createDataFrame(list(enumerate(texts)), SCHEMA), model).collect()}
    assert got[0] == [(1, "mit")] and got[1] == [(0, "apache")] and got[2] == got[4] == got[5] == []
    assert all(f == licences.UNKNOWN for _, f in got[3])
    for family, ts in licences.TEMPLATES.items():
        for t in ts:
            assert [x["family"] for x in licences.scan(t, model)] == [family]
    assert licences.licences(odd(spark), model).count() == len(ODD)


def test_licences_that_differ_in_a_word(model):
    for text, family in (("Licensed under CC BY-ND 4.0.", "cc-by-nd"), ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY", "mit"), ("// SPDX-License-Identifier: Apache-2.0", "apache"), ("Released under the Apache License 2.0", "apache"), ("licensed under the GNU Affero General Public License version 3", "agpl")):
        assert [x["family"] for x in licences.scan(text, model)] == [family], text
    rng = np.random.default_rng(9)
    found = [licences.scan(" ".join(licences.invent(rng, licences.words(t))), model) for ts in licences.TEMPLATES.values() for t in ts for _ in range(4)]
    assert np.mean([all(x["family"] == licences.UNKNOWN for x in f) for f in found]) >= 0.9


def test_licences_fit(spark):
    """Learns from the corpus; empty tables and odd rows too."""
    docs = spark.createDataFrame([(i, f"an ordinary line number {i} of prose\nwith a second line {i}") for i in range(40)], SCHEMA)
    for df in (docs, odd(spark), empty(spark)):
        m = licences.fit(df)
        assert [x["family"] for x in licences.scan("Released under the MIT License.", m)] == ["mit"]
    assert licences.licences(empty(spark), m).count() == 0


def test_licences_in_other_forms(model):
    assert [x["family"] for x in licences.scan("prose\nAvailable under CC-BY-SA-4.0.", model)] == ["cc-by-sa"]
    assert [x["family"] for x in licences.scan("Under the BSD 3-Clause", model)] == ["bsd"]
    for family, text in (("mit", licences.TEMPLATES["mit"][2]), ("gpl", licences.TEMPLATES["gpl"][1]), ("bsd", licences.TEMPLATES["bsd"][1].replace(": ", ":\n\n * "))):
        w = text.split(" ")
        wrapped = "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
        got = licences.scan(f"an ordinary line of prose\n\n{wrapped}\n\nthe quick brown fox", model)
        assert [x["family"] for x in got if x["family"] != licences.UNKNOWN] == [family], (family, got)
        assert got[0]["lines"] > 1 and got[0]["share"] >= 0.6

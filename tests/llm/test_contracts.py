"""Registered queries against plain code over the whole smallest tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from ternfield.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"] or "") for r in rows]


def found(spark, name, *columns):
    rows = queries.QUERIES[name](spark, SF).select("doc_id", *columns).collect()
    return sorted(tuple(r) for r in rows)


def test_token_files(spark, texts):
    tok = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want, start = [], 0
    for doc, text in texts:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found(spark, "op4_token_files", "start", "n_tokens", "ids_crc32") == want


def test_byte_bpe(spark, texts):
    ranks = {}
    for line in Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines():
        piece, rank = line.split()
        ranks[base64.b64decode(piece)] = int(rank)
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text in texts:
        ids = enc.encode_ordinary(text)
        want.append((doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode())))
    assert found(spark, "op6_byte_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_media_payloads(spark, texts):
    want = []
    for doc, text in texts:
        raw = text.encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((doc, len(raw), len(full), sha(full), zlib.crc32(full[-64:])))
    assert found(spark, "op8_media_columns", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want


def luhn(digits):
    twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


#: Kind -> its pattern and whether a match is kept.
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.findall("[0-9]", s)) <= 19 and luhn([int(d) for d in re.findall("[0-9]", s)])),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.findall("[0-9]", s)) <= 15),
}


def test_base_spans(spark, texts):
    want = []
    for doc, text in texts:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, (pattern, ok)) in enumerate(BASE.items()) for m in re.finditer(pattern, text) if ok(m.group())]
        n = Counter(s[2] for s in spans)
        want.append((doc, *(n[k] for k in BASE), sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)).encode())))
    assert sum(sum(w[1:5]) for w in want) > 0
    assert found(spark, "op9_pii", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    every = queries.QUERIES["op9_pii"](spark, SF).select("doc_id", "spans").collect()
    have = {r["doc_id"]: set((r["spans"] or "").split(",")) for r in every}
    for doc, text in texts:
        base = {f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, ok) in BASE.items() for m in re.finditer(pattern, text) if ok(m.group())}
        assert base <= have[doc]


def shingle_weights(text):
    words = re.findall(r"\w+", text.lower())
    n = min(5, len(words))
    counts = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else {}
    return {s: 1 + math.log(c) for s, c in counts.items()}


def probability_jaccard(x, y):
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def test_near_duplicate_classes(spark, texts):
    sets = [shingle_weights(t) for _, t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and (sets[i] == sets[j] or probability_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = [(doc, texts[top(i)][0]) for i, (doc, _) in enumerate(texts)]
    assert len({c for _, c in want}) < len(want)
    assert found(spark, "op5_minhash", "class_id") == want

"""Personal data: labelers vote on candidate spans, EM weighs the labelers, a span classifier decides.

1. Candidates. Four base patterns give spans that always stay. Wider patterns give further candidates:
   keys and passwords, telephone numbers without a plus, names of persons (two capitalised words of which the
   first is a known given name or which follow a word that introduces a person).
2. Labelers. On each candidate every labeler says yes, no, or nothing: patterns (shape of the span),
   gazetteers (prefixes of issued keys, numbers that are never issued, given names), contexts (words before).
3. EM. The counts of vote patterns over all documents (at most 3^labelers for each kind, whatever the
   corpus) feed a two-class model of independent labelers: EM gives each kind's prior and each labeler's
   accuracy, and so a probability for every pattern of votes.
4. Classifier. A logistic regression over span features learns these probabilities from a bounded,
   documented number of distinct (kind, votes, features) groups weighted by their counts, and gives the
   final decision for the candidates that are not base spans.

Offsets are code points, end exclusive. A null text is an empty one and has no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternfield.llm.common import small_batches, written

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret", "local_phone", "name")
#: Fixed patterns of the base kinds.
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])")
LOCAL = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
NAME = re.compile(r"(?<![^\W_])(?!(?:Mr|Mrs|Ms|Dr|Prof|Dear|Name|Contact|Patient|Employee|Customer|Signed|Sincerely|Attn|By)\b)[A-Z][a-z]{1,20}(?:\x20[A-Z]\.)?\x20[A-Z][a-z]{1,20}(?![^\W_])")
#: Gazetteer: fixed prefixes of keys as their issuers write them.
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "glpat-")
KEY_WORDS = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential|bearer)\W{0,6}$", re.I)
CALL_WORDS = re.compile(r"(?:phone|tel|call|mobile|cell|fax|whatsapp)\W{0,6}$", re.I)
#: Gazetteer: fixed list of given names.
GIVEN = frozenset(
    "Aaron Adam Alan Albert Alex Alice Amanda Amy Andrea Andrew Angela Ann Anna Anthony Arthur Barbara Benjamin Brian Carl Carlos Carol Catherine "
    "Charles Christine Christopher Daniel David Deborah Dennis Diana Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Frank George "
    "Grace Gregory Hannah Harold Helen Henry Jacob James Jane Janet Jason Jennifer Jessica Joan John Jose Joseph Joshua Juan Judith Julia Karen "
    "Katherine Kenneth Kevin Larry Laura Lisa Louis Margaret Maria Marie Mark Martha Martin Mary Matthew Michael Michelle Monica Nancy Nicole "
    "Nicholas Olivia Pamela Patricia Patrick Paul Peter Philip Rachel Ralph Raymond Rebecca Richard Robert Roger Ronald Rose Ruth Ryan Samuel "
    "Sandra Sara Sarah Scott Sharon Sofia Sophie Stephanie Stephen Steven Susan Teresa Thomas Timothy Victor Victoria Walter William".split()
)
PERSON_WORDS = re.compile(r"(?:\b(?:mr|mrs|ms|dr|prof|dear|name(?:\x20is)?|contact|patient|employee|customer|signed|sincerely|attn|by)\b)[\W_]{1,4}$", re.I)
#: Capitalised words that begin sentences and titles rather than names.
NO_NAME = frozenset("The This That These Those There And But For From With In On At It He She They We You An If When Where Who What How New General Public".split())
LABELERS = ("shape", "mixed", "random", "issued", "context", "assigned")
BEFORE = 24
#: Most groups of equal candidates that the classifier learns from, the most frequent first.
MAX_GROUPS = 20_000


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _part(digits: str) -> bool:
    """Whether the number is at most 255; any count of digits."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ back to the last address or a character that no name has, in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind; failing matches go without retries."""
    out = []
    if "@" in text:
        out += [(s, e, "email") for s, e in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(_part(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _vote(yes: bool, no: bool) -> int:
    return 2 if yes else 1 if no else 0


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, list[float]]]:
    """(start, end, kind, votes, features) of spans outside the base ones that may be personal data."""
    out, taken = [], bytearray(len(text))
    for s, e, _ in base:
        taken[s:e] = b"\1" * (e - s)

    def free(s: int, e: int) -> bool:
        return taken.find(1, s, e) < 0

    def take(s: int, e: int) -> str:
        """What stands before; the span is no longer free."""
        taken[s:e] = b"\1" * (e - s)
        return text[max(0, s - BEFORE) : s]

    for m in SECRET.finditer(text):
        s, e = m.span()
        x = m[0]
        digits = sum(c.isdigit() for c in x)
        if (digits or x.startswith(ISSUED)) and free(s, e):
            before = take(s, e)
            hexed = all(c in "0123456789abcdef" for c in x.lower())
            upper = sum(c.isupper() for c in x)
            turns = sum(a.isdigit() != b.isdigit() for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)
            votes = (
                _vote(hexed or bool(re.fullmatch(r"[A-Z0-9]{16,}", x)), not x.isalnum()),
                _vote(0.1 < digits / len(x) < 0.9, digits <= 1 or digits == len(x)),
                _vote(turns > 0.15, turns < 0.06),
                _vote(x.startswith(ISSUED), False),
                _vote(bool(KEY_WORDS.search(before)), False),
                _vote(bool(re.search(r"[=:][\x20\"']*$", before)), False),
            )
            out.append((s, e, "secret", votes, [digits / len(x), upper / len(x), turns, min(len(x), 64) / 64]))
    for m in LOCAL.finditer(text):
        s, e = m.span()
        if free(s, e):
            before = take(s, e)
            votes = (_vote(m[0][0] == "(" or m[0].count("-") == 2, "." in m[0]), _vote(len({m[0][3], m[0][-5]}) == 1, False), _vote(len({c for c in m[0] if c.isdigit()}) > 4, len({c for c in m[0] if c.isdigit()}) < 3), _vote(issued := all(re.fullmatch("[2-9](?!11)[0-9][0-9]", x) for x in re.findall("[0-9]{3}", m[0])[:2]), not issued), _vote(bool(CALL_WORDS.search(before)), False), _vote(bool(re.search(r"[=:]\x20*$", before)), False))
            out.append((s, e, "local_phone", votes, [0.7, 0.0, 0.2, (e - s) / 64]))
    for m in NAME.finditer(text):
        s, e = m.span()
        first, last = m[0].split(" ")[0], m[0].split(" ")[-1]
        known, introduced = first in GIVEN, bool(PERSON_WORDS.search(text[max(0, s - BEFORE) : s]))
        if (known or introduced) and free(s, e):
            before = take(s, e)
            begins = not before.strip() or before.rstrip()[-1] in ".!?" or before[-1] == "\n"
            votes = (_vote("." in m[0], first == last), _vote(not begins, begins and not introduced), _vote(last not in NO_NAME, first in NO_NAME or last in NO_NAME), _vote(known, False), _vote(introduced, False), _vote(bool(re.search(r"[=:]\x20*[\"']?$", before)), False))
            out.append((s, e, "name", votes, [0.0, 2 / len(m[0]), 0.0, min(len(m[0]), 64) / 64]))
    return [(s, e, k, "".join(map(str, v)), f) for s, e, k, v, f in out]


def _features(kind: str, votes: str, extra: list[float]) -> list[float]:
    """Votes by labeler as -1, 0, 1, the span's measures rounded to tenths, so that equal candidates group."""
    return [(0.0, -1.0, 1.0)[int(v)] for v in votes] + [round(x, 1) for x in extra]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.float64()))]))
SPANS_SQL = "array<struct<start:bigint,end:bigint,kind:string,base:boolean,votes:string,features:array<double>>>"


def label_spans(docs: DataFrame, *, text_col: str = "text", spans_col: str = "candidates") -> DataFrame:
    """docs without their text, with all base spans and all other candidates, their votes and features."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, spans_col)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(text_col).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [{"start": s, "end": e, "kind": k, "base": True, "votes": None, "features": None} for s, e, k in base]
                rows.append(spans + [{"start": s, "end": e, "kind": k, "base": False, "votes": v, "features": _features(k, v, f)} for s, e, k, v, f in candidates(text, base)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(rows, SPANS)], [*rest, spans_col])

    kept = docs.select(*rest, text_col)
    return kept.mapInArrow(each, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{spans_col}` {SPANS_SQL}"]))


def em(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 100, prior: float = 0.5) -> tuple[np.ndarray, float, np.ndarray]:
    """(probability of each pattern, prior, [class, labeler, vote] probabilities) of independent labelers.

    patterns: votes 0 (none), 1 (no), 2 (yes). Starts from the share of yes among the votes cast; each
    probability is smoothed by one row in each cell, so no labeler becomes certain.
    """
    cast, yes = (patterns > 0).sum(1), (patterns == 2).sum(1)
    p = np.clip((yes + 0.5) / (cast + 1), 0.05, 0.95)
    table = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for c, w in ((0, counts * (1 - p)), (1, counts * p)):
            for j in range(patterns.shape[1]):
                table[c, j] = np.bincount(patterns[:, j], w, 3) + 1
        table /= table.sum(2, keepdims=True)
        prior = float((counts * p).sum() + 1) / float(counts.sum() + 2)
        like = np.log([1 - prior, prior])[:, None] + np.log(table[:, np.arange(patterns.shape[1])[None, :], patterns]).sum(2)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p, prior, table


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, *, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression on soft labels by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, w = np.zeros(x.shape[1]), w / w.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + l2 * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1]), grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(labelled: DataFrame, *, spans_col: str = "candidates", max_groups: int = MAX_GROUPS) -> dict[str, list[float]]:
    """kind -> weights of its span classifier. A kind without candidates has none, and none of its spans stay.

    What reaches the driver is one row for each vote pattern and rounded feature vector: at most 3^6 * 11^4,
    of which the ``max_groups`` most frequent are taken for the classifier; EM sees all patterns.
    """
    one = labelled.select(F.explode(spans_col).alias("s")).where(~F.col("s.base")).select("s.kind", "s.votes", "s.features")
    by_votes = one.groupBy("kind", "votes").count().collect()
    groups = one.groupBy("kind", "votes", "features").count().orderBy(F.desc("count"), "kind", "votes", "features").limit(max_groups).collect()
    models = {}
    for kind in EXTRA:
        seen = [r for r in by_votes if r["kind"] == kind]
        if not seen:
            continue
        p, _, _ = em(np.array([[int(v) for v in r["votes"]] for r in seen]), np.array([r["count"] for r in seen], float))
        soft = {r["votes"]: q for r, q in zip(seen, p, strict=True)}
        own = [r for r in groups if r["kind"] == kind]
        x, w = np.array([r["features"] for r in own]), np.array([r["count"] for r in own], float)
        models[kind] = fit_logistic(x, np.array([soft[r["votes"]] for r in own]), w).tolist()
    return models


def find(docs: DataFrame, *, text_col: str = "text", spans_col: str = "spans", threshold: float = 0.5) -> DataFrame:
    """docs without their text, with ``spans``: array of (start, end, kind, base), by start, then kind.

    All base spans, and the candidates that the classifier gives ``threshold`` or more. No row is lost;
    repeated rows get equal spans; a column named like the result is replaced.
    """
    labelled = written(label_spans(docs.drop(spans_col) if spans_col != text_col else docs, text_col=text_col, spans_col="__candidates"), "pii-candidates")
    models = fit(labelled, spans_col="__candidates")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS + EXTRA) for x in (k, i)])

    def keep(s):
        choice = F.lit(False)
        for kind, beta in models.items():
            z = F.lit(beta[-1])
            for i, b in enumerate(beta[:-1]):
                z = z + F.coalesce(F.get(s["features"], i), F.lit(0.0)) * b
            choice = F.when(s["kind"] == kind, 1 / (1 + F.exp(-z)) >= threshold).otherwise(choice)
        return s["base"] | choice

    kept = F.transform(F.filter("__candidates", keep), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    spans = F.transform(F.array_sort(kept), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return labelled.withColumn(spans_col, spans).drop("__candidates")


def joined(spans) -> "F.Column":
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

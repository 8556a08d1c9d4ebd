"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay; wider patterns propose more (written-out and
bracketed addresses, IPv6, national and 00 phone numbers, shorter cards and bank accounts with right
check digits, secrets). Labelers vote on every span: the pattern, a gazetteer of issuers, calling
codes, address ranges, top-level domains and variable names, cue words to the left, and the
characters around or, for secrets, the mix of characters. Strict matches that fail their check are
voted on too, as examples of what isn't personal data; they are never added. Expectation-maximisation
over the counts of vote patterns in the whole corpus estimates each labeler's reliability without any
label; its probabilities train a logistic span classifier that sees no vote, only the shape of a span
and the word before it, and proposed spans that it accepts and that touch no base span are added. A
text is scanned once; the driver sees only counts of vote and feature patterns, whose number is
bounded by the votes and bins, not by the corpus.
"""

from __future__ import annotations

import ipaddress
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: A span is added only at this probability or more: a wrong one costs a clean text more than a missed one a mixed text.
SURE = 0.8
#: state: 1 base, 0 proposed, -1 a strict match that fails its check; v and f: codes of the votes and the features.
SPAN = "struct<kind:int,start:int,end:int,base:boolean,state:int,v:int,f:int>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the look-behind changes nothing but keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MORE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]{1,63})+", re.I)
_SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{2,64} at [A-Za-z0-9-]{2,63}(?: dot [A-Za-z0-9-]{2,63})+", re.I)
_DOT = re.compile(r" dot ", re.I)
_DIGIT = re.compile(r"[0-9]")
#: What every match of _MORE_EMAIL holds.
_AT = re.compile(r"at[\])}]", re.I)
#: Not within a longer run of digit groups.
_NATIONAL = re.compile(r"(?<![\w+.-])(?<![0-9] )(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\(?0[1-9][0-9]{1,4}\)?[ /-][0-9]{3,8}(?:[ -][0-9]{2,6})?|00[1-9][0-9]{0,2}[ ./-]?(?:[0-9][ ./-]?){6,11}[0-9])(?![\w-])(?! [0-9])")
_COLONS = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{4,39}(?![\w:])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAMED = r"(?:api|access|auth|private|secret)[_-]?key|secret|token|passw(?:or)?d|pwd"
_ASSIGNED = re.compile(rf"(?:{_NAMED})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([^\s\"',;<>]{{8,200}})", re.I)
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,200}|sk-[A-Za-z0-9_-]{20,200}|eyJ[A-Za-z0-9_-]{10,2000}\.[A-Za-z0-9_-]{10,2000}\.[A-Za-z0-9_-]{5,2000}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)")
_MAY_BE_SECRET = re.compile(r"(?i:key|secret|token|passw|pwd)|AKIA|gh[pousr]_|xox|sk-|eyJ|-----B")
_TLDS = frozenset("com org net edu gov mil int io co de fr es it nl uk us eu ch at be se no dk fi pl pt br ru cn jp in au ca info biz dev app".split())
_CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "971", "972")
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "22", "23", "24", "25", "26", "27", "35", "36", "38")
_RESERVED = ("0.", "10.", "127.", "169.254.", "192.168.", "224.", "255.")
_CUES = {
    0: (re.compile(r"mail|contact|write|reach|correo|courriel", re.I), re.compile(r"git|ssh|scp|://", re.I)),
    1: (re.compile(r"\bip\b|address|host|server|from|login", re.I), re.compile(r"version|release|section|chapter|\bv\.?$", re.I)),
    2: (re.compile(r"card|visa|master|amex|credit|debit|carte|tarjeta|karte|payment|iban|account|konto", re.I), re.compile(r"isbn|order|serial|invoice|sku|ref", re.I)),
    3: (re.compile(r"phone|tel|call|mobile|cell|fax|whatsapp|contact", re.I), re.compile(r"isbn|order|serial|page|score|price|version", re.I)),
    4: (re.compile(_NAMED, re.I), re.compile(r"example|placeholder|your|changeme|commit|sha1|sha256|md5|checksum", re.I)),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points by kind and start: leftmost non-overlapping matches a kind, failing ones dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _is_ipv6(s: str) -> bool:
    try:
        return len(s.strip(":")) >= 4 and bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def _is_account(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def proposed_spans(text: str) -> list[tuple[int, int, int]]:
    """Wider matches, base ones possibly among them; of secrets the value alone. Of two that touch, the one found first stays:
    addresses, then accounts and cards, then phone numbers, then secrets."""
    rounds: list[list[tuple[int, int, int]]] = [[]]
    if _AT.search(text):
        rounds[0] += [(0, m.start(), m.end()) for m in _MORE_EMAIL.finditer(text)]
    if _DOT.search(text):
        rounds.append([(0, m.start(), m.end()) for m in _SPELLED.finditer(text)])
    if "::" in text or text.count(":") >= 7:
        rounds.append([(1, m.start(), m.end()) for m in _COLONS.finditer(text) if _is_ipv6(m.group())])
    if _DIGIT.search(text):
        rounds.append([(2, m.start(), m.end()) for m in _ACCOUNT.finditer(text) if _is_account(m.group())])
        rounds.append([(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 24 and 13 <= len(d := _digits(m.group())) <= 15 and luhn(d)])
        rounds.append([(3, m.start(), m.end()) for m in _NATIONAL.finditer(text) if 7 <= len(_digits(m.group())) <= 15])
    if _MAY_BE_SECRET.search(text):
        rounds.append([(4, m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)])
        rounds.append([(4, m.start(), m.end()) for m in _PREFIXED.finditer(text)])
    out: list[tuple[int, int, int]] = []
    for found in rounds:
        out += apart_from(found, out) if found else []
    return out


def failing_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches of the strict patterns that fail their check: examples of what isn't personal data."""
    out = [(1, m.start(), m.end()) for m in _IP.finditer(text) if any(len(y := x.lstrip("0")) > 3 or int(y or 0) > 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and not luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if not 8 <= len(_digits(m.group())) <= 15]
    return out


def apart_from(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of spans that touch no base span; each is looked up in the base starts and the furthest end up to there."""
    order = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in order], list(accumulate((e for _, e in order), max))
    return [x for x in spans if not (n := bisect_left(starts, x[2])) or reach[n - 1] <= x[1]]


def _mixed(s: str) -> bool:
    """Letters and digits, and at least three bits of entropy a character."""
    n = [s.count(c) / len(s) for c in set(s)]
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and -sum(p * math.log2(p) for p in n) >= 3


def votes(text: str, kind: int, start: int, end: int, state: int) -> tuple[int, ...]:
    """1 for personal data, -1 against, 0 abstains: pattern, gazetteer, cue words, surroundings or mix."""
    s, d = text[start:end], _digits(text[start:end])
    if kind == 0:
        known = 1 if re.split(r"[.\])} ]", s)[-1].lower() in _TLDS else -1
    elif kind == 1:
        known = -1 if s.startswith(_RESERVED) else 1
    elif kind == 2:
        known = 1 if d.startswith(_ISSUERS) or s[0].isalpha() else -1
    elif kind == 3:
        known = 1 if not s.startswith("+") and d[0] in "023456789" or s.startswith("+") and d.startswith(_CALLING) else -1
    else:
        known = 1 if _PREFIXED.match(s) else 0
    left = text[max(0, start - 40) : start]
    yes, no = (p.search(left) is not None for p in _CUES[kind])
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    last = (1 if _mixed(s) else -1) if kind == 4 else -1 if any(c.isalnum() or c in "=/_#$" for c in around) else 1
    return (state, known, yes - no, last)


#: Bins of the features: kind, length, share of digits, kinds of separator, first of its line, passes its check, word before.
BINS = (len(ALL_KINDS), 5, 5, 4, 2, 2, 32)


def features(text: str, kind: int, start: int, end: int, state: int) -> tuple[int, ...]:
    """Binned shape and context."""
    s = text[start:end]
    n, share = len(s), len(_digits(s)) / max(len(s), 1)
    seps = len(set(s) & set(" -.()+"))
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start])
    word = 1 + zlib.crc32(before[-1].lower().encode()) % 31 if before else 0
    return (kind, min(n // 6, 4), int(share * 4.999), min(seps, 3), int(start == 0 or text[start - 1] == "\n"), int(state >= 0), word)


def _coded(values: tuple[int, ...], bins: tuple[int, ...]) -> int:
    out = 0
    for v, n in zip(values, bins, strict=True):
        out = out * n + v
    return out


def _decoded(codes: np.ndarray, bins: tuple[int, ...]) -> np.ndarray:
    out = []
    for n in reversed(bins):
        out.append(codes % n)
        codes = codes // n
    return np.stack(out[::-1], 1)


def may_hold(text: str) -> bool:
    """False only for texts without any base or proposed span: each needs '@', a digit, a written-out at or dot, the colons of IPv6
    or what a secret begins or is named with."""
    return "@" in text or _DIGIT.search(text) is not None or "::" in text or text.count(":") >= 7 or _AT.search(text) is not None or _DOT.search(text) is not None or _MAY_BE_SECRET.search(text) is not None


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): base, proposed and failing spans with the codes of their votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("state", pa.int32()), ("v", pa.int32()), ("f", pa.int32())]))
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                spans = []
                if may_hold(text):
                    base = base_spans(text)
                    more = apart_from(proposed_spans(text), base)
                    for state, found in ((1, base), (0, more), (-1, apart_from(failing_spans(text), base + more))):
                        for k, s, e in found:
                            v = _coded(tuple(x + 1 for x in votes(text, k, s, e, state)), (3, 3, 3, 3))
                            spans.append({"kind": k, "start": s, "end": e, "base": state == 1, "state": state, "v": v, "f": _coded(features(text, k, s, e, state), BINS)})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind_of)], names=["doc_id", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def em(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """P(personal data) of each vote pattern v (rows x labelers in -1, 0, 1) seen n times; and the labelers' tables
    [class, labeler, vote], the reliabilities. Starts from the majority vote; counts are smoothed by ten votes each of labelers
    that are better than chance, which matters only where votes are few."""
    p = np.clip(0.5 + 0.2 * v.sum(1), 0.05, 0.95)
    at = v + 1
    for _ in range(rounds):
        w = np.stack([n * (1 - p), n * p])
        tables = np.ones((2, v.shape[1], 3)) * np.array([[[6.0, 3.0, 1.0]], [[1.0, 3.0, 6.0]]])
        for c in range(2):
            for j in range(v.shape[1]):
                tables[c, j] += np.bincount(at[:, j], w[c], 3)
        tables /= tables.sum(2, keepdims=True)
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        logs = np.log(prior)[:, None] + np.log(tables)[:, np.arange(v.shape[1]), at].sum(2)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, tables


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant last) for soft labels y seen n times, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _design(f: np.ndarray) -> np.ndarray:
    """Feature codes as rows: kind, scaled bins overall and by kind, and the word before by kind."""
    x = _decoded(f, BINS)
    kind = np.eye(BINS[0])[x[:, 0]]
    shape = x[:, 1:6] / (np.array(BINS[1:6]) - 1)
    word = np.zeros((len(x), BINS[0] * BINS[-1]))
    word[np.arange(len(x)), x[:, 0] * BINS[-1] + x[:, -1]] = 1
    return np.hstack([kind, shape, (kind[:, :, None] * shape[:, None, :2]).reshape(len(x), -1), word])


def label_probabilities(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(kind, v, P(personal data)) from (kind, v, count), by EM kind by kind."""
    out = []
    for kind in sorted({k for k, _, _ in counts}):
        mine = sorted((v, n) for k, v, n in counts if k == kind)
        p, _ = em(_decoded(np.array([v for v, _ in mine]), (3, 3, 3, 3)) - 1, np.array([n for _, n in mine], float))
        out += [(kind, v, float(x)) for (v, _), x in zip(mine, p, strict=True)]
    return out


def accepted_features(sums: list[tuple[int, float, float]], threshold: float = SURE) -> list[int]:
    """The feature codes whose spans the final classifier is sure enough of, from (f, count, summed probability)."""
    if not sums:
        return []
    f, n, p = (np.array(c) for c in zip(*sums, strict=True))
    x = _design(f.astype(int))
    w = fit_logistic(x, p / n, n.astype(float))
    score = 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ w, -30, 30)))
    return sorted(int(c) for c, s in zip(f, score, strict=True) if s >= threshold)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for docs(doc_id, text): base spans and the proposed ones that the classifier accepts, by kind, then start.

    Offsets are code points of the whole text, the end exclusive; kind 4 are secrets. A null text is empty and has no span.
    Repeated rows are scanned each; very long texts are scanned whole; an empty table gives an empty one; other columns are
    not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = materialize(scan(docs))
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.v", "s.f", "s.state").agg(F.count("*").alias("n"))
    seen = materialize(seen)
    votes_seen = seen.groupBy("kind", "v").agg(F.sum("n").alias("n")).collect()  # at most 5 * 81
    known = spark.createDataFrame(label_probabilities([tuple(r) for r in votes_seen]), "kind int, v int, p double")
    sums = seen.join(F.broadcast(known), ["kind", "v"]).groupBy("f").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("p"), F.max(F.col("state") == 0).alias("proposed"))
    rows = sorted(tuple(r) for r in sums.collect())  # at most the product of BINS
    good = set(accepted_features([r[:3] for r in rows]))
    accepted = [f for f, _, _, proposed in rows if proposed and f in good]
    discard(seen)
    good = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<int>")
    kept = F.filter("spans", lambda s: s["base"] | ((s["state"] == 0) & F.array_contains(good, s["f"])))
    return found.select("doc_id", F.array_sort(kept).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> and digest of the base spans, all spans of the four kinds as text; besides, the number of those spans,
    secrets as start:end, their number, and whether there is either."""
    named = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    hidden = F.filter("spans", lambda s: s["kind"] == len(KINDS))

    def joined(spans):
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    secrets = F.array_join(F.transform(hidden, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    more = [F.size(named).cast("long").alias("n_spans"), secrets.alias("secrets"), F.size(hidden).cast("long").alias("n_secrets"), (F.size("spans") > 0).alias("flagged")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(named).alias("spans"), *more)

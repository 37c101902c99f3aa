"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Fixed patterns with their checks give the *base* spans, which always stay. Beside them,
candidate spans are proposed by tighter shapes (numbers that ran together with their
neighbours, national phone numbers, spelled-out addresses) and of one more kind, secrets
(keys and tokens). Labelers vote on every
candidate, for, against or not at all: the base patterns, checksums and ranges
(regular expressions and arithmetic), gazetteers (top-level domains, card issuers,
calling codes), cue words before the span, and shape.

Expectation-maximisation (a two-class Dawid-Skene model with abstentions) estimates
how reliable each labeler is from how they agree over the whole corpus. It needs
only how often each pattern of votes and features occurs, a table bounded by their
combinations and counted by Spark. The posteriors then train a logistic span
classifier on the same table, from the votes and from features of the span and its
surroundings that no labeler looks at, whose verdict adds candidates to the base spans.

Offsets are code points, ends exclusive. Defined results: null text counts as empty
and has no span; candidates that overlap a kept span of their kind are not added;
repeated rows are searched each; with few candidates the priors of the estimate
decide; other columns are ignored. All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that have a fixed pattern.
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.5
ROUNDS = 50
CUE_WINDOW = 40

_ANY = re.compile("[0-9@]")
#: Without one of these, no spelled-out address can match.
_SPELLED = tuple(a + dot + b for dot in ("dot", "DOT") for a in "[(" for b in ")]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a digit run's own start begins the leftmost match, so later digits need no try
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TIGHT = {
    "email": re.compile(
        r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?[\[(]?(?:at|AT)[\])]? ?[A-Za-z0-9-]{1,63} ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,24}(?![A-Za-z])"
    ),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "card": re.compile(
        r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9])"
    ),
    "phone": re.compile(
        r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    ),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,128}(?![A-Za-z0-9+/_-])"),
}

#: Gazetteers and cue words: fixed values, extended by parameter.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es it uk us eu ch at nl be pl ru cn jp br in".split())
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "30", "2")
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 57 61 62 81 82 86 90 91".split())
CUES = {
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "servidor", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "anruf", "appel", "llama"),
    "secret": ("token", "secret", "key", "password", "passwd", "bearer", "auth", "credential"),
}
#: How well-known keys begin, and the lengths of keys in hexadecimal.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "xox", "AIza", "glpat-", "eyJ")
HEX_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
AGAINST = ("version", "license", "licence", "copyright", "isbn", "issn", "rfc", "section", "invoice", "order")

LABELERS = ("base", "check", "gazetteer", "context", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_emails(text: str):
    """Leftmost matches of local@domain, found from the @ signs, in linear time."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and _LOCAL_TAIL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            past = m.end()
        else:
            past = max(past, at + 1)
        at = text.find("@", past)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {k: [] for k in BASE_KINDS}
    if not _ANY.search(text):
        return found
    found["email"] = list(base_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        d = digits_of(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            found["phone"].append(m.span())
    return found


def candidates(text: str, base: dict[str, list[tuple[int, int]]]):
    """(kind, start, end, is base) of all spans to vote on."""
    for kind in BASE_KINDS:
        for a, b in base[kind]:
            yield kind, a, b, True
    spelled = any(x in text for x in _SPELLED)
    if not spelled and not _ANY.search(text):
        return
    for kind in KINDS:
        if kind == "email" and not spelled:
            continue
        # a secret may not be part of what is something else
        taken, k = base[kind] if kind in base else sorted(s for spans in base.values() for s in spans), 0
        for m in _TIGHT[kind].finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or taken[k][0] >= b:
                yield kind, a, b, False


def votes(kind: str, text: str, a: int, b: int, is_base: bool) -> tuple[int, ...]:
    """A vote of each labeler: 1 for, -1 against, 0 none."""
    span, digits = text[a:b], digits_of(text[a:b])
    before = text[max(0, a - CUE_WINDOW) : a].lower()
    check = gazetteer = 0
    if kind == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_ISSUERS) else 0
    elif kind == "ip":
        parts = [int(p[-4:]) for p in span.split(".")]
        check = 1 if max(parts) <= 255 else -1
        gazetteer = -1 if parts[0] == 0 or parts == sorted(set(parts)) and parts[-1] < 20 else 0
    elif kind == "phone":
        check = 1 if 8 <= len(digits) <= 15 else -1
        code = re.match(r"\+([0-9]{1,3})", span)
        if code:
            gazetteer = 1 if any(code[1][:n] in CALLING_CODES for n in (1, 2, 3)) else -1
    elif kind == "secret":
        check = 1 if len(set(span)) >= 10 and len(digits) >= 4 else -1
        hexadecimal = not span.strip("0123456789abcdef") or not span.strip("0123456789ABCDEF")
        gazetteer = 1 if span.startswith(KEY_PREFIXES) or hexadecimal and len(span) in HEX_LENGTHS else 0
    else:
        tail = re.split(r"[^A-Za-z]+", span)[-1].lower()
        gazetteer = 1 if tail in TOP_DOMAINS else 0
        check = 1 if "@" in span else 0
    context = 1 if any(c in before for c in CUES[kind]) else 0
    if any(c in before for c in AGAINST):
        context = -1
    edge = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    shape = 1 if edge and len(span) <= 64 else -1
    if kind == "secret":
        shape = 1 if before.rstrip(" \"'`").endswith(("=", ":")) else 0
    return (1 if is_base else 0, check, gazetteer, context, shape)


#: What the classifier is told besides the votes, and how many values each has.
TRAITS = {"length": 4, "parts": 3, "variety": 3, "front": 4, "company": 3}


def traits(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """Features of a span and its surroundings: its length and number of parts, how many
    characters it is made of, what stands before it, and other digits nearby."""
    span = text[a:b]
    length = sum(len(span) > x for x in (12, 18, 30))
    parts = min(2, len(re.findall(r"[^A-Za-z0-9]+", span)) // 2)
    variety = sum(len(set(span)) > x for x in (6, 10))
    front = text[a - 1] if a else " "
    front = 0 if front.isspace() else 1 if front in "\"'`([<" else 2 if not front.isalnum() else 3
    near = len(digits_of(text[max(0, a - CUE_WINDOW) : a])) + len(digits_of(text[b : b + CUE_WINDOW]))
    return length, parts, variety, front, sum(near > x for x in (0, 12))


def pattern_counts(docs: DataFrame) -> pd.DataFrame:
    """kind, votes v0.., traits f0.. and n: how often each pattern occurs among all candidates.

    The number of rows is bounded by the combinations of their few values."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"].tolist():
                text = text or ""
                for kind, a, b, is_base in candidates(text, base_spans(text)):
                    total[(kind, *votes(kind, text, a, b, is_base), *traits(kind, text, a, b))] += 1
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", *vs, "n"])

    vs = [*(f"v{i}" for i in range(len(LABELERS))), *(f"f{i}" for i in range(len(TRAITS)))]
    return (
        docs.select("text")
        .mapInPandas(count, "kind string, " + ", ".join(f"{v} int" for v in vs) + ", n long")
        .groupBy("kind", *vs)
        .agg(F.sum("n").alias("n"))
        .toPandas()
        .sort_values(["kind", *vs])
        .reset_index(drop=True)
    )


def estimate(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: posterior of each pattern, and P(vote | class) of each
    labeler as an array labeler x class x vote (-1, 0, 1)."""
    posterior = 1 / (1 + np.exp(-1.5 * v.sum(1)))
    for _ in range(ROUNDS):
        likelihood = np.empty((v.shape[1], 2, 3))
        for c, weight in enumerate((1 - posterior, posterior)):
            for k in range(v.shape[1]):
                seen = np.array([(n * weight)[v[:, k] == x].sum() for x in (-1, 0, 1)])
                # a labeler is taken to be better than chance, as a prior of a few votes
                prior = (1.0, 1.0, 3.0) if c else (3.0, 1.0, 1.0)
                likelihood[k, c] = (seen + prior) / (seen + prior).sum()
        share = ((n * posterior).sum() + 1) / (n.sum() + 2)
        logs = np.log(share / (1 - share)) + sum(
            np.log(likelihood[k, 1, v[:, k] + 1] / likelihood[k, 0, v[:, k] + 1]) for k in range(v.shape[1])
        )
        after = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
        if np.abs(after - posterior).max() < 1e-6:
            break
        posterior = after
    return posterior, likelihood


def features(kinds, v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """One, the kind, each vote for and against, a failed check by kind, and the traits."""
    kind = np.array([[k == x for x in KINDS] for k in kinds], float).reshape(-1, len(KINDS))
    own = [f[:, [i]] == np.arange(1, n) for i, n in enumerate(TRAITS.values())]
    return np.hstack([np.ones((len(v), 1)), kind, v == 1, v == -1, kind * (v[:, [1]] == -1), *own])


class Classifier:
    """Logistic regression on vote patterns, fitted to the posteriors."""

    def __init__(self, table: pd.DataFrame | None):
        self.weights = None
        if table is None or not table["n"].sum():
            return
        v = table[[f"v{i}" for i in range(len(LABELERS))]].to_numpy(int)
        f = table[[f"f{i}" for i in range(len(TRAITS))]].to_numpy(int)
        n = table["n"].to_numpy(float)
        posterior, self.reliability = estimate(v, n)
        x, w = features(table["kind"], v, f), n / n.sum()
        self.weights = np.zeros(x.shape[1])
        ridge = 1e-4 * np.eye(x.shape[1])
        for _ in range(30):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            gradient = x.T @ (w * (posterior - p)) - ridge @ self.weights
            hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
            step = np.linalg.solve(hessian, gradient)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def accepts(self, kind: str, vote: tuple[int, ...], trait: tuple[int, ...]) -> bool:
        if self.weights is None:
            return False
        x = features([kind], np.array([vote]), np.array([trait]))
        return bool(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)[0])) >= THRESHOLD)


def find_spans(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans by the fixed patterns), spans (with the added ones), as
    arrays of structs kind, start, stop, sorted by kind and start."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = common.Shared(rows.sparkSession, classifier)
    kind = dict(rows.dtypes)["doc_id"]
    span = "array<struct<kind:string,start:int,stop:int>>"

    def search(batches):
        model, known = held.value, {}
        for batch in batches:
            base_out, all_out = [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                base = base_spans(text)
                kept, extra = [(k, *s) for k in BASE_KINDS for s in base[k]], []
                for k, a, b, is_base in candidates(text, base):
                    if not is_base:
                        key = (k, votes(k, text, a, b, False), traits(k, text, a, b))
                        if key not in known:
                            known[key] = model.accepts(*key)
                        if known[key]:
                            extra.append((k, a, b))
                order = lambda s: (KINDS.index(s[0]), s[1])
                as_rows = lambda ss: [dict(zip(("kind", "start", "stop"), s, strict=True)) for s in sorted(ss, key=order)]
                base_out.append(as_rows(kept))
                all_out.append(as_rows(kept + extra))
            yield batch["doc_id"], [base_out, all_out]

    return common.map_ids(rows, search, f"doc_id {kind}, base {span}, spans {span}")


def number(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = find_spans(docs, Classifier(pattern_counts(docs)))
    text = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )
    return found.select(
        "doc_id",
        *map(number, BASE_KINDS),
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )

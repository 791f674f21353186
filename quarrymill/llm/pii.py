"""PII: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Base spans follow exact patterns and always stay. Wider patterns propose whatever
looks like personal data at all: addresses with their signs spelled out, numbers
in groups, plain runs of digits. On every candidate four labelers vote yes, no or
nothing: the strict form and its check sum (regex), cue words before it that name
its kind or another thing, and tables of what is given out (gazetteer), what touches it (context) and how it is made
up (shape). Votes are counted over the whole corpus by kind, pattern of votes and
features, which is a small table at any size (at most 4 * 81 * 1024 rows); EM on it
estimates each labeler's reliability and each pattern's probability. Those
probabilities train a logistic classifier on features of the span and what stands
around it, the votes themselves not among them. Candidates that it finds likely
become spans of their kind where no base span of any kind is in the way.

All scans read a text once: patterns start only where a run starts and are bounded
otherwise, so time grows with a text's length whatever is in it.

Defined results: null and empty texts have no spans; very long texts, digit runs and
words are read whole; repeated rows and null ids are judged row by row; of wide
candidates that overlap, the first in text order and then in the order of kinds
stays; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that a scan starts a run of characters once: email is found from its sign.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

#: What the labelers judge beyond base spans. The longest parts are those that the kinds' standards allow.
_AT = re.compile(r" ?(?:@|\(at\)|\[at\]|\{at\}) ?|(?<=[A-Za-z0-9]) at (?=[A-Za-z0-9-]{1,63}(?: dot |\(dot\)|\[dot\]))", re.I)
_WIDE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}){1,8}", re.I)
WIDE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.| ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?)[0-9]{1,3}){3}(?![0-9])", re.I),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ._\xa0-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])\(?\+?[0-9]{1,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])|(?<![0-9])[0-9]{7,12}(?![0-9])"),
}
_SPELT = re.compile(r"[(\[{](?:at|dot|\.)[)\]}]| at | dot ", re.I)

# Cue words of the gazetteer, of each kind and of what is none, in the four languages.
CUES = {
    "email": ("contact", "contacto", "correo", "courriel", "e-mail", "email", "kontakt", "mail", "mailto", "nous écrire", "schreiben an", "write to"),
    "ip": ("address", "adresse", "dirección", "host", "ip", "ip address", "rechner", "server", "serveur", "servidor"),
    "card": ("amex", "american express", "card", "carte", "credit", "karte", "kreditkarte", "maestro", "mastercard", "tarjeta", "visa"),
    "phone": ("anrufen", "appeler", "call", "cell", "dial", "fax", "handy", "llamar", "mobile", "móvil", "phone", "portable", "rufnummer", "tel", "telefon", "telefono", "teléfono", "telephone", "téléphone", "whatsapp"),
}
RIVALS = ("article", "chapter", "date", "doi", "id", "invoice", "isbn", "issn", "no", "order", "page", "part", "ref", "section", "serial", "sku", "version", "volume", "year")
_CUE = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b", re.I) for k, v in CUES.items()}
_RIVAL = re.compile(r"\b(?:" + "|".join(RIVALS) + r")\b", re.I)
CUE_CHARS = 24
LIKELY = 0.9
FEATURES = 10

# Numbers and names that are given out. Issuers of cards: first digits from, to, and how many digits there are.
ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)),
    ("3528", "3589", (16,)), ("6011", "6011", (16,)), ("644", "649", (16,)), ("65", "65", (16,)), ("62", "62", (16, 17, 18, 19)), ("50", "50", (14, 15, 16, 17, 18, 19)), ("56", "58", (14, 15, 16, 17, 18, 19)),
)
# Calling codes of one and two digits, and the first two digits of those that have three.
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
CALLING_THREE = ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
# Top-level domains of more than two letters; all of two letters are countries.
TOP_LEVEL = ("aero", "app", "asia", "biz", "blog", "cat", "cloud", "com", "coop", "dev", "edu", "email", "gov", "info", "int", "jobs", "mil", "mobi", "museum", "name", "net", "online", "org", "post", "pro", "shop", "site", "store", "tel", "travel", "xyz")


def digits(span: str) -> str:
    return re.sub(r"[^0-9]", "", span)


def luhn(number: str) -> bool:
    total = sum(map(int, number[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in number[-2::-2])
    return total % 10 == 0


def holds(kind: str, span: str) -> bool:
    """The check that a match of the base pattern must pass."""
    if kind == "ip":
        return all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in span.split("."))
    if kind == "card":
        number = digits(span)
        return 14 <= len(number) <= 19 and luhn(number)
    if kind == "phone":
        return 10 <= len(digits(span)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    r"""What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ finds from left to right, read from each @ to both sides."""
    free = 0
    at = text.find("@")
    while at >= 0:
        name = text[free:at]
        start = free + len(name.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [(kind, *m.span()) for kind in KINDS[1:] if kind != "phone" or "+" in text for m in BASE[kind].finditer(text) if holds(kind, m.group())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _strict(kind: str, span: str) -> bool:
    """Does the span as a whole have its kind's base form, and pass the check?"""
    if kind == "email":
        return list(_emails(span)) == [(0, len(span))]
    return bool(BASE[kind].fullmatch(span)) and holds(kind, span)


def _around(text: str, start: int, end: int) -> tuple[str, bool]:
    """The text before a span, and whether something touches it that makes it part of something longer."""
    before, after = text[max(0, start - CUE_CHARS) : start], text[end : end + 1]
    return before, before[-1:].isalnum() or before[-1:] in tuple(".-+/#=_") or after.isalnum() or after in ("-", "/", "@", "_")


def _made_up(kind: str, span: str) -> bool:
    """Are its parts as a span of its kind has them?"""
    number, groups = digits(span), re.findall(r"[0-9]+", span)
    if kind == "email":
        return bool(re.search(r"[A-Za-z]{2,10}$", span)) and bool(re.search(r"[A-Za-z]", span[: max(1, len(span) // 2)]))
    if kind == "ip":
        return all(len(x) == 1 or x[0] != "0" for x in groups) and all(int(x) <= 255 for x in groups if len(x) < 4)
    if kind == "card":
        return [len(g) for g in groups] in ([4, 4, 4, 4], [4, 6, 5], [16], [15]) and number[:1] in tuple("3456")
    return len(groups) > 1 and 9 <= len(number) <= 13 and len(groups[-1]) >= 3 and len(groups[0]) <= 4


def given_out(kind: str, span: str) -> int:
    """1 if numbers or names like this one are given out to somebody, -1 if not, 0 if the tables can't tell."""
    number = digits(span)
    if kind == "card":
        return 1 if any(low <= number[: len(low)] <= high and len(number) in sizes for low, high, sizes in ISSUERS) else -1
    if kind == "phone":
        code = number[2:] if number.startswith("00") else number
        if not span.lstrip("(").startswith(("+", "00")):
            return 0
        return 1 if code[:1] in CALLING or code[:2] in CALLING or code[:2] in CALLING_THREE else -1
    if kind == "ip":
        first = int(re.match(r"[0-9]*", span)[0][:4] or 0)
        return 1 if 0 < first < 224 and first != 127 else -1
    last = re.search(r"[A-Za-z]*$", span)[0].lower()
    return 1 if len(last) == 2 or last in TOP_LEVEL else -1


def votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """1, 0 or -1 of the regex, gazetteer, context and shape labelers."""
    span = text[start:end]
    before, touched = _around(text, start, end)
    # The strict form can't judge what is spelled out, or a number without the country's code.
    other = _SPELT.search(span) or (kind == "phone" and "+" not in span)
    known = given_out(kind, span)
    cue = -1 if known < 0 else 1 if _CUE[kind].search(before) else -1 if _RIVAL.search(before) else 0
    return [1 if _strict(kind, span) else 0 if other else -1, cue, -1 if touched else 1, 1 if _made_up(kind, span) else -1]


def features(kind: str, text: str, start: int, end: int) -> str:
    """FEATURES signs, 0 or 1, of the span and what stands around it; none of them is a vote of the strict form."""
    span, number = text[start:end], digits(text[start:end])
    before, touched = _around(text, start, end)
    usual = {"email": 6 <= len(span) <= 64, "ip": 4 <= len(number) <= 12, "card": 15 <= len(number) <= 16, "phone": 9 <= len(number) <= 13}[kind]
    checked = {"email": span.count(".") + len(_SPELT.findall(span)) >= 1, "ip": _made_up(kind, span), "card": luhn(number) if number else False, "phone": span.startswith(("+", "00", "(+"))}[kind]
    has = (
        bool(_SPELT.search(span)), bool(re.search(r"[ ()-]", span)), usual, checked, _made_up(kind, span),
        bool(_CUE[kind].search(before)), bool(_RIVAL.search(before)), touched, before[-2:-1] in tuple(":=") or before[-1:] in tuple("(<:"),
        given_out(kind, span) > 0,
    )
    return "".join("1" if x else "0" for x in has)


def _wide_emails(text: str) -> Iterator[tuple[int, int]]:
    for m in _AT.finditer(text):
        name = text[max(0, m.start() - 64) : m.start()]
        start = m.start() - len(name) + len(name.rstrip(_LOCAL))
        if start == m.start() - 64 and start and text[start - 1] in _LOCAL:
            continue  # longer than the name of an address may be
        while start < m.start() and not text[start].isalnum():
            start += 1
        found = _WIDE_DOMAIN.match(text, m.end())
        if start < m.start() and found:
            yield start, found.end()


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and wide matches that no base span overlaps."""
    taken: list[list[int]] = []  # what base spans cover, in order, without overlaps
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    out = list(base)
    for kind in KINDS:
        for a, b in _wide_emails(text) if kind == "email" else (m.span() for m in WIDE[kind].finditer(text)):
            k = bisect.bisect_left(starts, b) - 1
            if k < 0 or taken[k][1] <= a:
                out.append((kind, a, b))
    return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # What a base span needs, and what any candidate needs.
    any_digit, any_mark = re.compile("[0-9@]"), re.compile(r"[0-9@]|[(\[{]at[)\]}]| at ", re.I)
    span = pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "is_base": pa.bool_(), "votes": pa.string(), "features": pa.string()})
    schema = pa.schema({"doc_id": pa.int64(), "base": pa.list_(pa.string()), "found": pa.list_(span)})
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            ids, base, found = [], [], []
            for doc, text in zip(batch.column(0).slice(i, 500).to_pylist(), batch.column(1).slice(i, 500).to_pylist(), strict=True):
                spans = base_spans(text) if text and any_digit.search(text) else []
                rows = candidates(text, spans) if text and any_mark.search(text) else []
                ids.append(doc)
                base.append([f"{k}:{a}:{b}" for k, a, b in spans])
                found.append([{"kind": k, "start": a, "end": b, "is_base": n < len(spans), "votes": ",".join(map(str, votes(k, text, a, b))), "features": features(k, text, a, b)} for n, (k, a, b) in enumerate(rows)])
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "base": base, "found": found}, schema=schema)


def estimate(counts: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that a candidate is personal data, by kind and pattern of votes.

    EM over two classes; each labeler says yes, no or nothing with chances of its
    own in either class. The first guess is the share of yes among the votes.
    """
    out = {}
    for kind in KINDS:
        rows = [(np.array(list(map(int, v.split(",")))), n, v) for k, v, n in counts if k == kind]
        if not rows:
            continue
        vote, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        p = np.clip((vote.sum(axis=1) + 4) / 8, 0.05, 0.95)
        for _ in range(rounds):
            like = []
            for q in (p, 1 - p):
                each = np.stack([((vote == v) * (n * q)[:, None]).sum(axis=0) + 0.5 for v in (-1, 0, 1)]) / ((n * q).sum() + 1.5)
                like.append(np.log(each[vote + 1, np.arange(vote.shape[1])]).sum(axis=1) + np.log((n * q).sum() + 1))
            p = 1 / (1 + np.exp(np.clip(like[1] - like[0], -35, 35)))
        out |= {(kind, r[2]): float(x) for r, x in zip(rows, p, strict=True)}
    return out


def _row(signs: str) -> np.ndarray:
    return np.array([1.0, *map(float, signs)])


def fit(likely: dict[tuple[str, str], float], counts: list[tuple[str, str, str, int]], rounds: int = 800) -> dict[str, np.ndarray]:
    """Logistic weights of each kind over the features, that give the estimated probabilities.

    counts: (kind, votes, features, n). Gradient steps; a pattern weighs as the logarithm of its count.
    """
    out = {}
    for kind in KINDS:
        rows = [(f, likely[kind, v], n) for k, v, f, n in counts if k == kind]
        w = np.zeros(FEATURES + 1)
        if rows:
            x, y, n = np.array([_row(r[0]) for r in rows]), np.array([r[1] for r in rows]), np.log1p(np.array([r[2] for r in rows], float))
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-x @ w))
                w -= 2.0 * (x.T @ (n * (p - y)) / n.sum() + 1e-3 * w)
        out[kind] = w
    return out


def _decide(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], bool] = {}

        def likely(kind: str, signs: str) -> bool:
            if (kind, signs) not in known:
                known[kind, signs] = bool(1 / (1 + np.exp(-_row(signs) @ weights[kind])) >= LIKELY)
            return known[kind, signs]

        for batch in batches:
            out = {x: [] for x in ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")}
            for doc, base, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = [(r["kind"], r["start"], r["end"]) for r in found if r["is_base"]]
                new = [r for r in found if not r["is_base"] and likely(r["kind"], r["features"])]
                added: list[tuple[str, int, int]] = []
                for r in sorted(new, key=lambda r: (r["start"], KINDS.index(r["kind"]))):
                    if not added or added[-1][2] <= r["start"]:
                        added.append((r["kind"], r["start"], r["end"]))
                out["doc_id"].append(doc)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in spans))
                out["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
                out["spans"].append(_listed(spans + added))
                out["n_added"].append(len(added))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema({k: pa.string() if k in ("base_sha256", "spans") else pa.int64() for k in out}))

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = "struct<kind:string,start:bigint,end:bigint,is_base:boolean,votes:string,features:string>"
    found = write_table(rows.mapInArrow(_scan, f"doc_id long, base array<string>, found array<{span}>"), "spans")
    tally = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.features").count().orderBy("kind", "votes", "features")
    counts = [tuple(r) for r in tally.collect()]  # at most 4 kinds, 3**4 patterns of votes, 2**10 of features
    by_votes: dict[tuple[str, str], int] = {}
    for kind, vote, _, n in counts:
        by_votes[kind, vote] = by_votes.get((kind, vote), 0) + n
    weights = fit(estimate([(*k, n) for k, n in by_votes.items()]), counts)
    return found.mapInArrow(_decide(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

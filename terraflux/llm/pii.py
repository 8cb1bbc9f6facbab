"""Personal data: patterns, and a skip-chain conditional random field for repeats.

Patterns find spans of four kinds. They scan in linear time, whatever the text.
The field then labels a document's tokens that carry digits or an "@" with one of
the kinds or none. Pattern spans are evidence; neighbours in the text share a
weak potential; tokens with the same key (their digits from four on, else the
token itself), however far apart, share a strong one. So do a telephone or card
number and whole groups of digits elsewhere that join to a similar number: the same
digits, those left without country or area code (seven at least), or these after
zeros. The name part of an address found is a key too, with digits or without, unless
it names an office (ROLES) rather than a person. The tokens of a key are
tied through one hidden variable rather than pairwise, so a token that occurs n
times costs n factors. Loopy message passing gives each token's most likely label,
which makes labels consistent: a telephone number repeated without its "+1" or in another
form, or the name part of an address alone, is found too.

The potentials are parameters set by hand; the tables hold no labels to learn them
from. They are chosen so that a token can get a kind only through its key, so no
message need be passed where no key joins a pattern's token with another.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, map_rows, table, texts

KINDS = ("email", "ip", "card", "phone")
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[^0-9]+")
_GROUPS = re.compile(r"[0-9]++(?:[\x20().-]{1,2}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
#: Mailbox names of offices and functions (RFC 2142, and usual ones).
ROLES = frozenset("abuse admin contact email ftp hello help hostmaster info mail marketing news newsletter noc noreply no-reply office postmaster press privacy sales security service support team trouble usenet uucp webmaster www".split())
LEAST_DIGITS = 7  # of a telephone number without its codes
_ENDS = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start; leftmost and non-overlapping in each kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        done = 0
        for m in _AT_DOMAIN.finditer(text):
            a = m.start()
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((0, a, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


@dataclass(frozen=True)
class Potentials:
    evidence: float = 12.0  # of a pattern's token for its kind
    none: float = 0.5  # of a token without a partner for no kind
    shape: float = 0.3  # of a token for the kind it looks like
    chain: float = 0.4  # of neighbours for the same label
    skip: float = 4.0  # of tokens with the same or a similar key for the same label
    hub_none: float = 0.1
    rounds: int = 12
    damping: float = 0.5


def _key(token: str) -> str | None:
    digits = _DIGITS.sub("", token)
    if len(digits) >= 4:
        return digits if not any(c.isalpha() for c in token) else token.lower()
    return token.lower() if len(token) >= 5 and digits and any(c.isalpha() for c in token) else None


def _name_key(name: str) -> str | None:
    """Key of the name part of an address."""
    return _key(name) or (name.lower() if len(name) >= 5 and name.lower() not in ROLES else None)


def repeated_numbers(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, str]]]:
    """Groups of digits outside base that are similar to a number of base, leftmost and longest, as
    (start, end, form); and the numbers with that form, as (kind, start, end, form)."""
    whole: dict[str, list[tuple[int, int, int]]] = {}
    for k, a, b in base:
        digits = _DIGITS.sub("", text[a:b]) if k >= 2 else ""
        for cut in range(len(digits) - LEAST_DIGITS + 1 if k == 3 else k == 2):
            whole.setdefault(digits[cut:], []).append((k, a, b))
    if not whole:
        return [], []
    most, taken, at = max(map(len, whole)), sorted((a, b) for _, a, b in base), 0
    found: list[tuple[int, int, str]] = []
    for run in _GROUPS.finditer(text):
        parts: list[list[tuple[int, int]]] = [[]]
        for m in _GROUP.finditer(text, *run.span()):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at < len(taken) and taken[at][0] < m.end():
                parts.append([])
            else:
                parts[-1].append(m.span())
        for groups in parts:
            i = 0
            while i < len(groups):
                joint, best = "", None
                for j in range(i, len(groups)):
                    joint += text[groups[j][0] : groups[j][1]]
                    if len(form := joint.lstrip("0") if joint not in whole else joint) > most:
                        break
                    if form in whole:
                        best = j, form
                if best is None:
                    i += 1
                    continue
                a, b = groups[i][0], groups[best[0]][1]
                if text[a - 1 : a] == "(" and ")" in text[a:b]:
                    a -= 1
                found.append((a, b, best[1]))
                i = best[0] + 1
    return found, [(k, a, b, form) for form in dict.fromkeys(f for _, _, f in found) for k, a, b in whole[form]]


def _shape(token: str, digits: int) -> int:
    """Label that a token's form suggests, 0 for none."""
    if "@" in token:
        return 1
    if token.count(".") == 3 and digits >= 4:
        return 2
    return 3 if 16 <= digits <= 19 else 4 if 7 <= digits <= 15 else 0


def message_passing(unary: np.ndarray, edges: np.ndarray, weight: np.ndarray, p: Potentials) -> np.ndarray:
    """Log beliefs (nodes x labels) after loopy sum-product on equal-label potentials."""
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    gain = np.expm1(np.concatenate([weight, weight]))[:, None]
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), unary.shape[1]))

    def beliefs() -> np.ndarray:
        b = unary.copy()
        np.add.at(b, dst, msg)
        return b

    for _ in range(p.rounds):
        before = beliefs()[src] - msg[back]
        before = np.exp(before - before.max(1, keepdims=True))
        new = np.log(before.sum(1, keepdims=True) + gain * before)
        new -= new.max(1, keepdims=True)
        msg = p.damping * msg + (1 - p.damping) * new
    return beliefs()


def consistent_spans(text: str, base: list[tuple[int, int, int]], p: Potentials | None = None) -> list[tuple[int, int, int]]:
    """The spans that the field adds to a document's pattern spans."""
    p = p or Potentials()
    if not base:
        return []
    by_start = sorted(base, key=lambda s: s[1])
    names = {k for kind, a, b in base if kind == 0 and (k := _name_key(text[a : text.index("@", a)]))}
    tokens: list[tuple[int, int, int, str | None, int]] = []  # start, end, evidence, key, shape
    at = 0
    for m in _TOKEN.finditer(text):
        raw = m.group()
        while at < len(by_start) and by_start[at][2] <= m.start():
            at += 1
        kind = by_start[at][0] + 1 if at < len(by_start) and by_start[at][1] < m.end() else 0
        token = raw.strip(_ENDS)
        if not token or not kind and not any("0" <= c <= "9" for c in token) and "@" not in token and token.lower() not in names:
            continue
        start = m.start() + raw.index(token)
        key = token.lower() if token.lower() in names else _key(token)
        tokens.append((start, start + len(token), kind, key, _shape(token, len(_DIGITS.sub("", token)))))
        if kind == 1 and "@" in token:  # the name part alone may recur
            a = by_start[at][1]
            name = text[a : text.index("@", a)]
            if (k := _name_key(name)) is not None:
                tokens.append((a, a + len(name), kind, k, 0))
    plain = len(tokens)
    repeats, numbers = repeated_numbers(text, base)
    tokens += [(a, b, 0, f"={form}", 0) for a, b, form in repeats]  # a token's key has no "=" and digits alone
    tokens += [(a, b, k + 1, f"={form}", 0) for k, a, b, form in numbers]
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        if t[3] is not None:
            groups.setdefault(t[3], []).append(i)
    shared = [g for g in groups.values() if len(g) > 1]
    if not any(any(tokens[i][2] for i in g) and not all(tokens[i][2] for i in g) for g in shared):
        return []
    unary = np.zeros((len(tokens) + len(shared), len(KINDS) + 1))
    edges, weight = [], []
    partnered = {i for g in shared for i in g}
    for i, (start, _, kind, _, shape) in enumerate(tokens):
        if kind:
            unary[i, kind] = p.evidence
        else:
            unary[i, 0] = 0.0 if i in partnered else p.none
            if shape:
                unary[i, shape] += p.shape if i not in partnered else 0.0
        if 0 < i < plain and start - tokens[i - 1][1] == 1:
            edges.append((i - 1, i))
            weight.append(p.chain)
    for h, g in enumerate(shared, len(tokens)):
        unary[h, 0] = p.hub_none
        for i in g:
            edges.append((i, h))
            weight.append(p.skip)
    label = message_passing(unary, np.array(edges), np.array(weight), p)[: len(tokens)].argmax(1)
    labels = label.tolist()
    whole = sorted((a, b, labels[i] - 1) for i, (a, b, *_) in enumerate(tokens[plain : plain + len(repeats)], plain) if labels[i])
    out: list[tuple[int, int, int]] = []
    at = 0
    for (start, end, kind, _, _), k in zip(tokens[:plain], labels, strict=False):
        if kind or not k:
            continue
        while at < len(whole) and whole[at][1] <= start:
            at += 1
        if at < len(whole) and whole[at][0] < end:  # part of a whole number
            continue
        if out and out[-1][0] == k - 1 and start - out[-1][2] == 1:
            out[-1] = (k - 1, out[-1][1], end)
        else:
            out.append((k - 1, start, end))
    return out + [(k, a, b) for a, b, k in whole]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every row of docs (doc_id, text), in code points, end exclusive.

    Returns doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the pattern
    spans), spans (those and the field's, "kind:start:end" joined by commas) and
    n_added. Null and empty texts have none, repeated rows are each returned, an
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def make():
        def step(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": cols["doc_id"], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": [], "n_added": []}
            for t in cols["text"]:
                t = t or ""
                base = pattern_spans(t)
                more = consistent_spans(t, base)
                for i, k in enumerate(KINDS):
                    out[f"n_{k}"].append(sum(s[0] == i for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + more))
                out["n_added"].append(len(more))
            return out

        return step

    return map_rows(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", make)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(texts(table(spark, sf_dir, "documents")))

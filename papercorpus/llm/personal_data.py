"""Personal data: fixed rules, and a linear-chain conditional random field for other forms.

The rules find emails, IP addresses, payment cards and phone numbers in the forms below.
The field labels words by their shapes and those of their neighbours (B, I of each kind,
or O). It is trained from a small labelled table and finds forms that the rules leave
out, such as phone numbers without a plus sign. What it adds must pass a check of its
kind and overlap nothing that the rules found.

Chains are runs of words within two of a word that holds a digit or an at sign; words
elsewhere are O by definition, as no kind has neither.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship_package

KINDS = ("email", "ip", "card", "phone")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNAL = re.compile(r"[0-9@]")

#: The labelled table, spans as {kind:text}.
LABELLED = """
call me at {phone:(473) 555-8136} after lunch
phone {phone:473-555-8136} or write to {email:ann.lee@mail.example.com} today
my number is {phone:473 555 8136} thanks
tel. {phone:+1 (756) 555-9792} please
reach us on {phone:+44 20 7946 0958} in the week
fax {phone:(020) 7946 0958} for the office
ring {phone:555-0142} at night
mobile {phone:0171 5550123} only
the card {card:4058826588634783} was used
card {card:4058 8265 8863 4783} expires soon
paid with {card:4446-7624-9195-6438} yesterday
charge {card:4446762491956438} now and call {phone:(809) 555-2752} then
host {ip:25.63.122.242} is down
from {ip:10.0.0.1} to {ip:192.168.1.20} and back
server at {ip:51.129.161.191} replied
ping {ip:70.117.73.88} twice
mail {email:opm.13@mail2.example.com} soon
write {email:j_smith+news@example.org} or {email:info@example.net} please
send it to {email:first.last@dept.example.edu} before noon
contact {email:x9@example.com} or {phone:(259) 555-5738} now
token = "3adc290f8f2f06a42b992a8f4e8411a747498777" in the file
password=a9ce335683f9772ddc was set
version 1.2.3 of the tool was built
on 2024-01-15 at 10:30 we met
chapter 12 has 340 pages and 25 tables
in 1998 and 2003 the price was $1,250.00 or 3.5%
order 10482 of 3 items weighs 2.75 kg
the score was 3-2 and then 21-19 in 90 minutes
room 404 on floor 4 holds 60 people
see pages 100-120 and figure 3.2 for details
about 1,000,000 users in 50 states
id 00012345 and serial 9-8-7 were lost
follow @someone and @another42 there
it costs 12 @ 3.50 each
the years 2010 2011 2012 2013 were dry
rows 1 2 3 4 5 6 7 8 9 10 of the table
section 4.1.2 and note 17 say so
x = 3.14159 and y = 2.71828 hold
a ratio of 16:9 at 1920x1080 is fine
call 911 or 112 in need
"""
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
DIMENSIONS = 1 << 12


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def fits(kind: str, text: str) -> bool:
    """Whether a text is right for its kind."""
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in text.split("."))
    digits = digits_of(text)
    return {"card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}.get(kind, True)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the rules find, in order."""
    found, at = [], -1
    if (at := text.find("@")) >= 0:
        free = 0
        while at >= 0:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found.append((start, 0, m.end()))
                free = m.end()
            at = text.find("@", max(at + 1, free))
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if fits(KINDS[kind], m[0])]
    return sorted(found)


def shape(word: str) -> str:
    """Classes of characters with their runs' lengths, up to four of a kind told apart."""
    out, last, run = [], "", 0
    for c in word:
        k = "d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isalpha() else c
        run = run + 1 if k == last else 1
        last = k
        if run <= 4:
            out.append(k)
    return "".join(out)


def features(words: list[str]) -> np.ndarray:
    """Hashed feature numbers of each word, nine a word."""
    shapes = [shape(w) for w in words]
    names = []
    for i, (w, s) in enumerate(zip(words, shapes, strict=True)):
        n = len(digits_of(w))
        names.append([f"s{s}", f"p{shapes[i - 1] if i else '^'}", f"n{shapes[i + 1] if i + 1 < len(words) else '$'}",
                      f"d{min(n, 16)}", f"@{'@' in w}{'.' in w}{'-' in w}", f"k{''.join(sorted(set(s)))}",
                      f"c{w.count('.')}{w.count('-')}", f"l{min(len(w), 20)}", f"e{s[:1]}{s[-1:]}"])
    return np.array([[crc32(f.encode()) % DIMENSIONS for f in row] for row in names], np.int64).reshape(len(words), 9)


def labelled_rows(lines: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """Words and labels of each line of a labelled table."""
    rows = []
    for line in filter(None, lines.split("\n")):
        words, labels = [], []
        for m in re.finditer(r"\{(\w+):([^}]*)\}|([^\s{]+)", line):
            parts = WORD.findall(m[2] or m[3])
            words += parts
            labels += [LABELS.index(f"{'I' if k else 'B'}-{m[1]}") if m[1] else 0 for k in range(len(parts))]
        rows.append((words, labels))
    return rows


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 0.5, decay: float = 0.05):
    """Weights (features x labels) and transitions by gradient ascent on the likelihood."""
    n, longest, k = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    x, y, on = np.zeros((n, longest, 9), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest))
    for r, (words, labels) in enumerate(rows):
        x[r, : len(words)], y[r, : len(words)], on[r, : len(words)] = features(words), labels, 1
    weights, moves = np.zeros((DIMENSIONS, k)), np.zeros((k, k))
    w_sum, m_sum = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    truth = np.eye(k)[y] * on[..., None]

    def soft(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))

    for _ in range(rounds):
        scores = weights[x].sum(2)
        ahead, back = scores.copy(), np.zeros_like(scores)
        for t in range(1, longest):
            ahead[:, t] = np.where(on[:, t, None] > 0, soft(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back[:, t] = np.where(on[:, t + 1, None] > 0, soft(moves + (scores + back)[:, t + 1, None, :], 2), 0)
        total = soft(ahead[:, -1], 1)
        miss = truth - np.exp(ahead + back - total[:, None, None]) * on[..., None]
        g = -decay * weights
        np.add.at(g, x.reshape(-1, 9), np.broadcast_to(miss.reshape(-1, 1, k), (n * longest, 9, k)))
        pairs = np.exp(ahead[:, :-1, :, None] + moves + (scores + back)[:, 1:, None, :] - total[:, None, None, None]) * on[:, 1:, None, None]
        m = np.einsum("nti,ntj->ij", truth[:, :-1] * on[:, 1:, None], truth[:, 1:]) - pairs.sum((0, 1)) - decay * moves
        w_sum += g**2
        m_sum += m**2
        weights += rate * g / np.sqrt(w_sum)
        moves += rate * m / np.sqrt(m_sum)
    return weights.astype(np.float32), moves.astype(np.float32)


def viterbi(chains: list[np.ndarray], weights: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """Best labels of each chain of features; chains of like length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    for at in range(0, len(order), 256):
        part = [i for i in order[at : at + 256] if len(chains[i])]
        if not part:
            continue
        longest, k = max(len(chains[i]) for i in part), moves.shape[0]
        best, back = np.zeros((len(part), k), np.float32), np.zeros((longest, len(part), k), np.int8)
        scores = [weights[chains[i]].sum(1) for i in part]
        size = np.array([len(s) for s in scores])
        for t in range(longest):
            now = np.stack([s[t] if t < len(s) else np.zeros(k, np.float32) for s in scores])
            if t == 0:
                best = now
                continue
            steps = best[:, :, None] + moves
            live = (t < size)[:, None]
            back[t] = np.where(live, steps.argmax(1), np.arange(k))
            best = np.where(live, steps.max(1) + now, best)
        path = np.zeros((longest, len(part)), np.int64)
        path[-1] = best.argmax(1)
        for t in range(longest - 1, 0, -1):
            path[t - 1] = back[t, np.arange(len(part)), path[t]]
        for j, i in enumerate(part):
            out[i] = path[: size[j], j]
    return out


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """Word bounds of each chain of a text, line by line."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        if not SIGNAL.search(text, line.start(), line.end()):
            continue
        words = [m.span() for m in WORD.finditer(text, line.start(), line.end())]
        near = np.zeros(len(words) + 4, bool)
        for i, (a, b) in enumerate(words):
            if SIGNAL.search(text, a, b):
                near[i : i + 5] = True
        chain: list[tuple[int, int]] = []
        for word, keep in zip(words, near[2:], strict=False):
            if keep:
                chain.append(word)
            elif chain:
                out.append(chain)
                chain = []
        if chain:
            out.append(chain)
    return out


def added_spans(text: str, chains: list[list[tuple[int, int]]], labels: list[np.ndarray],
                base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the labels add to ``base``."""
    found: list[tuple[int, int, int]] = []
    for chain, marks in zip(chains, labels, strict=True):
        i = 0
        while i < len(chain):
            if marks[i] % 2 == 1:
                kind, j = (int(marks[i]) - 1) // 2, i + 1
                while j < len(chain) and marks[j] == marks[i] + 1:
                    j += 1
                a, b = chain[i][0], chain[j - 1][1]
                while a < b and text[a] in "\"'<[{":
                    a += 1
                while a < b and text[b - 1] in "\"'>]},.;:!?":
                    b -= 1
                span = text[a:b]
                right = {"email": "@" in span[1:-1], "ip": span.count(".") == 3 and span.replace(".", "").isdigit(),
                         "card": True, "phone": not re.search(r"[^\x20()+./0-9-]", span)}[KINDS[kind]]
                if a < b and right and fits(KINDS[kind], span):
                    found.append((a, kind, b))
                i = j
            else:
                i += 1
    starts = [a for a, _, _ in base]  # in order; furthest[i]: where the first i spans end at most
    furthest = [0, *accumulate((b for _, _, b in base), max)]
    return [s for s in found if furthest[bisect_left(starts, s[2])] <= s[0]]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


TYPE = ("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base:string,spans:string,n_added:bigint>")


def personal_data(text: str | Column = "text", rows: list[tuple[list[str], list[int]]] | None = None) -> Column:
    """Struct of counts by the rules, their spans, all spans (``kind:start:end``) and how many were added.

    Offsets are code points, the end exclusive. Null and empty texts have no spans. The
    field is trained here, from ``rows`` (words and label numbers) or LABELLED, on the
    driver: the table is small by contract, a few hundred lines at most.
    """
    weights, moves = train(rows or labelled_rows())

    def find(texts: pa.Array) -> pa.Array:
        columns = defaultdict(list)
        kept = []  # texts with a digit or an at sign: all others have no spans
        for t in texts.to_pylist():
            kept.append(t if t and SIGNAL.search(t) else "")
        for start in range(0, len(kept), 64):
            part = kept[start : start + 64]
            chains = [chains_of(t) for t in part]
            flat = [features([t[a:b] for a, b in c]) for t, cs in zip(part, chains, strict=True) for c in cs]
            labels = iter(viterbi(flat, weights, moves))
            for t, cs in zip(part, chains, strict=True):
                base = rule_spans(t)
                more = added_spans(t, cs, [next(labels) for _ in cs], base)
                for k, name in enumerate(KINDS):
                    columns[f"n_{name}"].append(sum(s[1] == k for s in base))
                columns["base"].append(joined(base))
                columns["spans"].append(joined(base + more))
                columns["n_added"].append(len(more))
        names = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"]
        kinds = [pa.string() if n in ("base", "spans") else pa.int64() for n in names]
        return pa.StructArray.from_arrays([pa.array(columns[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    column = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(find, TYPE).asNondeterministic()(column)


def find_personal_data(docs: DataFrame, text: str = "text", result: str = "personal") -> DataFrame:
    """``docs`` with the struct of ``personal_data`` in ``result`` (replaced if there), all other columns kept."""
    ship_package(docs.sparkSession)
    return docs.withColumn(result, personal_data(text))

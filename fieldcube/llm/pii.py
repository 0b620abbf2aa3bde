"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import bisect
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .util import append_columns, documents

KINDS = ("email", "ip", "card", "phone")
#: Windows of the network: length and step in characters.
WINDOW, STEP = 96, 64
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
ALPHABET = 100
CUE = re.compile(r"[0-9@]")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, in linear time and only where a cue stands."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((0, start, m.end()))
                done = m.end()
            else:
                done = max(done, at + 1)
            at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if _ip_ok(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# The network


def encode(text: str) -> np.ndarray:
    """Character classes: printable ASCII as such, then line ends, letters, digits and the rest."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 32, 98)
    out[codes >= 192] = 97
    out[codes == 10] = 95
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, one LSTM a direction, a linear layer and CRF transitions; class ALPHABET - 1 is padding."""

    def __init__(self, size: int = 12, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.3, (ALPHABET, size)), "O": r.normal(0, 0.2, (2 * hidden, TAGS)), "o": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS)), "a": np.zeros(TAGS)}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 0.25, (size, 4 * hidden))
            self.p["U" + d] = r.normal(0, 0.25, (hidden, 4 * hidden))
            self.p["v" + d] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        self.hidden = hidden

    def _lstm(self, x, d, trace=None):
        """x: (steps, batch, 4 * hidden) inputs; gates in, forget, out, candidate."""
        n, h = x.shape[1], self.hidden
        hs, hp, cp = np.empty((len(x), n, h)), np.zeros((n, h)), np.zeros((n, h))
        for t in range(len(x)):
            z = x[t] + hp @ self.p["U" + d]
            g = _sigmoid(z[:, : 3 * h])
            i, f, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(z[:, 3 * h :])
            cn = f * cp + i * c
            tc = np.tanh(cn)
            if trace is not None:
                trace.append((i, f, o, c, cp, tc, hp))
            hp, cp = o * tc, cn
            hs[t] = hp
        return hs

    def emissions(self, ids, traces=None):
        """ids: (batch, steps) classes; returns (steps, batch, tags) and the states."""
        e = self.p["E"][ids.T]
        hf = self._lstm(e @ self.p["Wf"] + self.p["vf"], "f", None if traces is None else traces[0])
        hb = self._lstm((e @ self.p["Wb"] + self.p["vb"])[::-1], "b", None if traces is None else traces[1])[::-1]
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["O"] + self.p["o"], h, e

    def decode(self, ids):
        """The best tag sequence of each window (Viterbi)."""
        em = self.emissions(ids)[0]
        steps, n, _ = em.shape
        score, back = em[0] + self.p["a"], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + self.p["A"]
            back[t] = all_.argmax(1)
            score = all_.max(1) + em[t]
        tags = np.empty((steps, n), np.int64)
        tags[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        return tags.T

    def step(self, ids, gold, state, rate):
        """One Adam step on the negative log likelihood of the gold tags; returns the loss a window."""
        traces = ([], [])
        em, h, e = self.emissions(ids, traces)
        steps, n, _ = em.shape
        A, gold = self.p["A"], gold.T
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0] + self.p["a"]
        for t in range(1, steps):
            alpha[t] = em[t] + _lse(alpha[t - 1][:, :, None] + A, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(A + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        dem = np.exp(alpha + beta - z[None, :, None])
        dA = np.zeros_like(A)
        for t in range(1, steps):
            dA += np.exp(alpha[t - 1][:, :, None] + A + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        one = np.eye(TAGS)[gold]
        loss = (z.sum() - (em * one).sum() - self.p["a"][gold[0]].sum() - A[gold[:-1], gold[1:]].sum()) / n
        np.subtract.at(dA, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        da = (dem[0] - one[0]).sum(0)
        dem -= one
        g = {"A": dA, "a": da, "O": np.einsum("tnh,tnk->hk", h, dem), "o": dem.sum((0, 1))}
        dh = dem @ self.p["O"].T
        H = self.hidden
        dx = {}
        for d, part, tr in (("f", dh[:, :, :H], traces[0]), ("b", dh[::-1, :, H:], traces[1])):
            gU, dzs, dhn, dcn = np.zeros_like(self.p["U" + d]), np.empty((steps, n, 4 * H)), np.zeros((n, H)), np.zeros((n, H))
            for t in range(steps - 1, -1, -1):
                i, f, o, c, cp, tc, hp = tr[t]
                dht = part[t] + dhn
                dc = dht * o * (1 - tc * tc) + dcn
                dz = np.concatenate([dc * c * i * (1 - i), dc * cp * f * (1 - f), dht * tc * o * (1 - o), dc * i * (1 - c * c)], axis=1)
                dzs[t], dcn = dz, dc * f
                dhn = dz @ self.p["U" + d].T
                gU += hp.T @ dz
            dx[d] = dzs if d == "f" else dzs[::-1]
            g["U" + d], g["v" + d], g["W" + d] = gU, dx[d].sum((0, 1)), np.einsum("tne,tnk->ek", e, dx[d])
        de = dx["f"] @ self.p["Wf"].T + dx["b"] @ self.p["Wb"].T
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], ids.T.ravel(), de.reshape(-1, de.shape[2]))
        state["t"] = state.get("t", 0) + 1
        for k, x in g.items():
            x = np.clip(x / n, -5, 5)
            m, v = state.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * x, 0.99 * v + 0.01 * x * x
            state[k] = m, v
            self.p[k] -= rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.99 ** state["t"])) + 1e-8)
        return loss


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis, keepdims=True)) + m).squeeze(axis)


# Labelled spans to learn from


def _digits(r, n):
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r):
    return "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "le", "en", "de", "ch", "sch", "ció", "ñ", "é", "à", "ö", "es", "la", "que"]) for _ in range(r.randint(1, 4)))


def _card(r):
    body = _digits(r, r.choice([12, 14, 15, 15, 15, 18]))
    full = next(body + c for c in "0123456789" if luhn(body + c))
    sep = r.choice(["", " ", "-", ".", "."])
    return sep.join(full[i : i + 4] for i in range(0, len(full), 4)) if sep else full


def _phone(r):
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"+{_digits(r, r.randint(1, 2))} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_digits(r, 2)} {a} {b} {c}", f"({a}) {b} {c}", f"+{_digits(r, 11)}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"0{_digits(r, 2)} {_digits(r, 4)} {c}", f"0{_digits(r, 2)} {_digits(r, 4)} {c}"])


def _email(r):
    name = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}.{_digits(r, 2)}", f"{_word(r)}_{_digits(r, 2)}"])
    return f"{name}@{r.choice(['mail', 'post', _word(r)])}{_digits(r, 1)}.{r.choice(['example', _word(r)])}.{r.choice(['com', 'org', 'net', 'de', 'fr'])}"


def _ip(r):
    return ".".join(str(r.randint(0, 255)) for _ in range(4))


def _other(r):
    """Numbers and marks that are no personal data."""
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 12, 24, 32, 40, 64])))
    return r.choice([f'token = "{hexes}"', hexes, f"version {r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1900, 2100)}", f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", f"${_digits(r, 3)}", f"{_digits(r, 2)}:{_digits(r, 2)}", f"2{_digits(r, 3)}-0{r.randint(1, 9)}-{_digits(r, 2)}", f"@{_word(r)}", _digits(r, r.randint(1, 6)), f"AKIA{_digits(r, 8)}ABCD"])


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows with labelled spans: generated contacts and look-alikes between invented words."""
    r = random.Random(seed)
    makers = (_email, _ip, _card, _phone)
    ids, tags = np.full((n, WINDOW), ALPHABET - 1), np.zeros((n, WINDOW), int)
    for k in range(n):
        text, spans = "", []
        junk = r.random() < 0.2
        while len(text) < 3 * WINDOW:
            u = r.random()
            if u < 0.16:
                kind = r.randrange(4)
                s = makers[kind](r)
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                s = _other(r) if u < 0.26 else _word(r)
                text += s.capitalize() if r.random() < 0.1 else s.upper() if r.random() < 0.02 else s
            text += r.choice(["***", "$$$", "%%%", "###", "&&&"]) if junk else r.choice(["", "", "", "", ",", ".", "!!"])
            text += "\n" if r.random() < 0.05 else " "
        cut = r.randrange(len(text) - WINDOW)
        ids[k] = encode(text)[cut : cut + WINDOW]
        for kind, a, b in spans:
            a, b = max(a - cut, 0), min(b - cut, WINDOW)
            if a < b:
                tags[k, a:b] = 2 + 2 * kind
                tags[k, a] = 1 + 2 * kind
    return ids, tags


def train(windows: int = 7000, batch: int = 64, epochs: int = 2, seed: int = 5) -> Tagger:
    """A tagger fitted to ``windows`` generated windows (a fixed number, whatever the input's size); each call fits anew."""
    model, state = Tagger(seed=seed), {}
    ids, tags = examples(windows, seed)
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        for at in np.array_split(order.permutation(windows), windows // batch):
            model.step(ids[at], tags[at], state, 0.02 / (1 + 2 * epoch))
    return model


# Decoding


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a cue; a span without a digit or @ is never valid, so others have none."""
    last = max(0, -(-(len(text) - WINDOW) // STEP))
    starts, k = [], -1
    for m in CUE.finditer(text):
        # Windows that cover this position and are not listed yet.
        first = max(k + 1, -(-(m.start() - WINDOW + 1) // STEP), 0)
        final = min(m.start() // STEP, last)
        if first <= final:
            starts += range(first, final + 1)
            k = final
    return [s * STEP for s in starts]


def valid(kind: int, s: str) -> bool:
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == 0:
        return s.count("@") == 1 and "." in s[s.index("@") :] and not re.search(r"\s", s) and s[0] != "@"
    if kind == 1:
        return bool(IP.fullmatch(s)) and _ip_ok(s)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", s))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", s)) and bool(re.search(r"[ ().-]", s))


def reconcile(found: list[tuple[int, int, int, float]], text: str) -> list[tuple[int, int, int]]:
    """One set of spans for a whole text out of the spans of its windows (kind, start, end, weight).

    Pieces of one kind that overlap or touch are joined, invalid spans go, and of
    those that overlap the set with the largest weight stays.
    """
    joined: list[list] = []
    for kind in range(len(KINDS)):
        for _, a, b, w in sorted(x for x in found if x[0] == kind):
            if joined and joined[-1][0] == kind and a <= joined[-1][2]:
                joined[-1][2] = max(joined[-1][2], b)
                joined[-1][3] += w
            else:
                joined.append([kind, a, b, w])
    ok = []
    for kind, a, b, w in joined:
        while b > a and not text[b - 1].isalnum():
            b -= 1
        edge = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
        if b > a and not edge and valid(kind, text[a:b]):
            ok.append((b, a, kind, w))
    ok.sort()
    best, choice, ends = [0.0], [], [x[0] for x in ok]
    for i, (b, a, _, w) in enumerate(ok):
        j = min(i, bisect.bisect_right(ends, a))
        take = best[j] + w > best[i]
        best.append(max(best[i], best[j] + w))
        choice.append(j if take else None)
    out, i = [], len(ok)
    while i > 0:
        if choice[i - 1] is None:
            i -= 1
        else:
            out.append((ok[i - 1][2], ok[i - 1][1], ok[i - 1][0]))
            i = choice[i - 1]
    return out


def tag(model: Tagger, texts: list[str], batch: int = 1024) -> list[list[tuple[int, int, int]]]:
    """The network's spans of each whole text."""
    places = [(i, s) for i, text in enumerate(texts) for s in windows_of(text)]
    found: list[list] = [[] for _ in texts]
    codes = {i: encode(texts[i]) for i in {i for i, _ in places}}
    for at in range(0, len(places), batch):
        part = places[at : at + batch]
        ids = np.full((len(part), WINDOW), ALPHABET - 1)
        for k, (i, s) in enumerate(part):
            piece = codes[i][s : s + WINDOW]
            ids[k, : len(piece)] = piece
        tags = model.decode(ids)
        for k in np.flatnonzero(tags.any(1)):
            i, s = part[k]
            row, n = tags[k], min(WINDOW, len(texts[i]) - s)
            a = 0
            while a < n:
                if row[a] == 0:
                    a += 1
                    continue
                kind, b = (row[a] - 1) // 2, a + 1
                while b < n and row[b] == 2 + 2 * kind:
                    b += 1
                middle = 1 - abs((a + b) / 2 - WINDOW / 2) / WINDOW
                found[i].append((int(kind), s + a, s + b, (b - a) * middle))
                a = b
    return [reconcile(f, texts[i]) if f else [] for i, f in enumerate(found)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(df: DataFrame, model: Tagger, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with counts of base spans by kind, n_spans (base and added), base_sha256 and spans (base and added ones).

    A span of the network is added where it overlaps no base span.  Positions are
    code points, the end exclusive.  A null text is empty.  A text of any length is
    read whole, in windows; each row for itself, so repeated rows get equal spans.
    Where candidate spans overlap, the set of the largest weight stays, of equal
    ones that which ends first.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = shared.value

        def run(texts: list) -> list:
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            rows = []
            for own, more in zip(base, tag(model, texts), strict=True):
                added = [x for x in more if all(x[2] <= a or x[1] >= b for _, a, b in own)]
                counts = [sum(x[0] == k for x in own) for k in range(len(KINDS))]
                rows.append([*counts, len(own) + len(added), hashlib.sha256(joined(own).encode()).hexdigest(), joined(own + added)])
            return [list(x) for x in zip(*rows, strict=True)]

        return run

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("n_spans", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return append_columns(df, text_col, factory, fields, keep)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), train(), keep=["doc_id"])

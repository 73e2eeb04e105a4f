"""Secret scan: fixed patterns plus a character convolutional network over every candidate.

The patterns give the base findings.  Every candidate (a value after a name and a
separator, or a long token that mixes digits and letters) is scored by a small
convolutional network in numpy that sees the candidate and the text around it; it was
trained on labelled findings made by a rule, its scores are calibrated on a part held
back, and the threshold is the highest that keeps the wanted recall there.  Candidates
that reach it are findings too; where they touch a base finding, that one stays and
takes their score.  A base finding without a candidate has score 1.

Nulls: a null text counts as empty and has no findings.  Repeated rows give repeated
results, an empty table none; further columns are ignored.  Spans are in code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, held_model, mapped, whole_text

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
KINDS = ("assign", "access", "hex", "learned")

#: A text without any of these has no assignment.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
VALUE = re.compile(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.-]+")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")

BEFORE, WINDOW = 32, 96
RECALL = 0.98
SEED, EXAMPLES, EPOCHS = 11, 3600, 8


def base_findings(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base findings, each kind leftmost and without overlap."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[1])))


def named(text: str, at: int) -> bool:
    """Whether a name stands ahead of a separator at this place, however long it is."""
    while at and text[at - 1] == " ":
        at -= 1
    if at and text[at - 1] in "\"'":
        at -= 1
    end = at
    while at and text[at - 1] in NAME_CHARS:
        at -= 1
    return NAME.search(text, at, end) is not None


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of all that may be a secret, base findings among them; longest first where starts agree."""
    found = set()
    if ":" in text or "=" in text:
        found.update(m.span(1) for m in VALUE.finditer(text) if named(text, m.start()))
    found.update(m.span() for m in TOKEN.finditer(text))
    return sorted(found, key=lambda s: (s[0], -s[1]))


_CLASSES = np.zeros(128, np.int8)
for _i, _group in enumerate(("", " ", "\n\t\r", "0123456789", "abcdef", "=", ":", "\"'`", ".", "-", "_", "/", "+", ",;", "@", "()[]{}<>", "&%#$*!?")):
    for _c in _group:
        _CLASSES[ord(_c)] = _i
for _c in range(26):  # other letters each have a class: names matter
    if _CLASSES[97 + _c] == 0:
        _CLASSES[97 + _c] = 17 + _c
    _CLASSES[65 + _c] = 43
N_CLASSES = 44


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Class codes of BEFORE characters ahead of each span and what follows, WINDOW in all; long spans get several rows."""
    rows = []
    for start, end in spans:
        at = start
        while True:
            piece = text[max(0, at - BEFORE) : at - BEFORE + WINDOW]
            codes = np.zeros(WINDOW, np.int8)
            points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            lead = max(0, BEFORE - at)
            codes[lead : lead + len(points)] = np.where(points < 128, _CLASSES[np.minimum(points, 127)], 0)[: WINDOW - lead]
            rows.append(codes)
            at += WINDOW - BEFORE
            if at >= end:
                break
    return np.stack(rows) if rows else np.zeros((0, WINDOW), np.int8)


def labelled_findings(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of made-up findings: half secrets of many forms, half look-alikes."""
    rng = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    base64 = lower + lower.upper() + digits + "+/"

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(low, high + 1)))

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def prose(words: int) -> str:
        return " ".join(some(lower, 1, 9) for _ in range(words))

    names = (
        "password", "passwd", "pwd", "pass", "passphrase", "db_password", "secret", "client_secret", "token", "auth_token", "access_token", "api_key", "apikey",
        "access_key", "private_key", "credential", "credentials", "bearer", "auth", "signing_key",
    )
    plain = ("name", "title", "author", "note", "lang", "city", "topic", "subject", "status", "section", "unit", "file", "path", "class", "host", "url", "see")

    def secret() -> tuple[str, str]:
        name = pick(*names)
        value = pick(
            some(base64, 20, 44), some(digits + "abcdef", 16, 64), some(lower + digits, 10, 32), some(lower + lower.upper() + digits + "_-", 12, 40),
            some(lower, 10, 28), some(lower, 4, 9) + some(digits, 1, 4) + some(lower, 3, 9), some(lower, 3, 8) + "-" + some(lower, 3, 8) + "-" + some(lower, 3, 8),
        )
        if rng.random() < 0.25:
            return "", pick("AKIA" + some(lower.upper() + digits, 16, 16), "ghp_" + some(base64[:62], 36, 36), "sk_live_" + some(base64[:62], 24, 24), "xoxb-" + some(digits, 11, 12) + "-" + some(base64[:62], 24, 24))
        return name + pick("=", ": ", " = ", '": "', ":"), value

    def day() -> str:
        return "20" + some(digits, 2, 2) + pick("-", "") + pick("0", "1") + some("012", 1, 1) + pick("-", "") + some("012", 1, 1) + some(digits, 1, 1)

    def other() -> tuple[str, str]:
        form = rng.integers(12)
        if form == 0:
            return pick("see ", "at ", "") + "https://www." + some(lower, 4, 9) + ".example/", some(lower, 3, 8) + "/" + some(digits, 4, 8) + "/" + some(lower, 4, 9)
        if form == 1:
            return pick("phone: ", "tel=", "fax: "), some(digits, 3, 4) + "-" + some(digits, 3, 4) + "-" + some(digits, 4, 6)
        if form == 2:
            return pick("version=", "date: ", "build: ", "released: ", "built at: ", ""), day() + pick("", "T") + some(digits, 6, 6) + pick("", "Z", "-" + some(digits, 3, 6))
        if form == 3:
            return pick(*plain) + pick("=", ": ", " = "), some(lower, 8, 28)
        if form == 4:
            return "", some(lower, 6, 12) + "_" + some(lower, 4, 9) + "_" + some(digits, 1, 3)
        if form == 5:
            return pick("iban: ", "order: ", "invoice=", "account: ", "isbn: "), some(digits, 10, 20)
        if form == 6:  # serial and file numbers: groups of capitals and of digits
            groups = [some(lower.upper(), 2, 4)] + [some(digits, 2, 6) for _ in range(rng.integers(1, 5))] + [pick("", some(lower.upper(), 1, 3))]
            return pick("", "ref: ", "case: ", "serial=", "no: "), pick("-", "/", "_").join(g for g in groups if g)
        if form == 7:
            return pick("id=", "uuid: ", "trace: ", ""), "-".join(some(digits + "abcdef", n, n) for n in (8, 4, 4, 4, 12))
        if form == 8:
            return pick("", "see ", "file: ", "image="), pick("-", "_").join(some(lower, 3, 9) for _ in range(rng.integers(3, 6))) + pick("-", "_", "-v") + some(digits, 1, 4)
        if form == 9:
            return pick(*plain) + pick("=", ": "), some(lower, 3, 8) + "-" + some(lower, 3, 8) + "-" + some(lower, 3, 8)
        if form == 10:
            return pick("lib=", "version: ", "package: ", ""), some(lower, 4, 9) + "-" + some(digits, 1, 2) + "." + some(digits, 1, 2) + "." + some(digits, 1, 3) + pick("", "-" + some(lower, 3, 6) + some(digits, 1, 1))
        return pick(*plain) + pick("=", ": "), some(lower, 4, 9) + pick("-", "/", ".") + some(lower, 4, 12) + pick("", some(digits, 1, 2))

    rows, labels = [], []
    for i in range(n):
        head, value = (secret if i % 2 == 0 else other)()
        before = prose(5) + pick(" ", "\n", ", ") + head
        text = before + value + pick(" ", "\n", '"', ". ") + prose(6)
        rows.append(windows(text, [(len(before), len(before) + len(value))])[0])
        labels.append(i % 2 == 0)
    return np.stack(rows), np.array(labels, np.float32)


class CharNet:
    """Embedding, two widths of convolution, max pooling over the window, one logistic unit."""

    def __init__(self, seed: int = SEED, width: int = 8, filters: int = 12) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (N_CLASSES, width)).astype(np.float32), "b": np.zeros(1, np.float32)}
        self.spans = (3, 7)
        for k in self.spans:
            self.p[f"w{k}"] = rng.normal(0, (2 / (k * width)) ** 0.5, (k * width, filters)).astype(np.float32)
            self.p[f"c{k}"] = np.zeros(filters, np.float32)
        self.p["o"] = rng.normal(0, 0.3, 2 * filters * 2).astype(np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        e, kept, pooled = self.p["e"][x], {}, []
        for k in self.spans:
            n = WINDOW - k + 1
            col = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), n, -1)
            a = np.maximum(col @ self.p[f"w{k}"] + self.p[f"c{k}"], 0)
            for part in (slice(0, BEFORE), slice(BEFORE, n)):  # what stands ahead and the candidate itself
                at = a[:, part].argmax(1)
                pooled.append(np.take_along_axis(a[:, part], at[:, None], 1)[:, 0])
                kept[k, part.start] = (at + part.start, pooled[-1])
            kept[k] = col
        h = np.concatenate(pooled, 1)
        return h @ self.p["o"] + self.p["b"][0], kept | {"h": h}

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> None:
        rng, first, second, step = np.random.default_rng(SEED), {}, {}, 0
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                z, kept = self._forward(x[pick])
                dz = (1 / (1 + np.exp(-z)) - y[pick]) / len(pick)
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                g["o"], g["b"] = kept["h"].T @ dz, np.array([dz.sum()], np.float32)
                dh, at = dz[:, None] * self.p["o"], 0
                rows = np.arange(len(pick))[:, None]
                for k in self.spans:
                    f = self.p[f"c{k}"].size
                    for start in (0, BEFORE):
                        where, value = kept[k, start]
                        da = dh[:, at : at + f] * (value > 0)
                        at += f
                        seen = kept[k][rows, where]
                        g[f"w{k}"] += np.einsum("nfd,nf->df", seen, da)
                        g[f"c{k}"] += da.sum(0)
                        de = np.einsum("nf,df->nfd", da, self.p[f"w{k}"]).reshape(len(pick), f, k, -1)
                        chars = x[pick][rows[:, :, None], where[:, :, None] + np.arange(k)]
                        np.add.at(g["e"], chars, de)
                step += 1
                for k, v in g.items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * v * v
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling on held-back findings, then the highest threshold that keeps the recall there."""
        z = self.logits(x)
        for _ in range(400):
            d = 1 / (1 + np.exp(-(self.scale * z + self.shift))) - y
            self.scale -= 0.05 * float((d * z).mean())
            self.shift -= 0.05 * float(d.mean())
        p = np.sort(self.scores(x)[y > 0])
        self.threshold = float(p[int((1 - recall) * len(p))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.shift)))


def trained() -> CharNet:
    """The network, trained on three quarters of the labelled findings and calibrated on the rest; the same everywhere."""
    x, y = labelled_findings()
    cut = len(x) * 3 // 4
    net = CharNet()
    net.fit(x[:cut], y[:cut])
    net.calibrate(x[cut:], y[cut:])
    return net


def model() -> CharNet:
    return held_model(trained)


def scan_text(text: str, net: CharNet) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of all findings by start: the base ones, and learned ones that overlap none."""
    base = base_findings(text)
    spans = candidates(text)
    if not spans:
        return [(s, kind, e, 1.0) for s, kind, e in base]
    counts = [max(1, -(-(e - s) // (WINDOW - BEFORE))) for s, e in spans]
    best = np.maximum.reduceat(net.scores(windows(text, spans)), np.cumsum([0, *counts[:-1]]))
    starts, reach = [s for s, _, _ in base], [0]
    for _, _, e in base:
        reach.append(max(reach[-1], e))
    of_base: list[float | None] = [None] * len(base)
    found, end = [], 0
    for (s, e), p in zip(spans, best.tolist(), strict=True):
        upto = bisect_right(starts, e - 1)  # base findings that begin ahead of the candidate's end
        if reach[upto] > s:
            k = upto - 1
            while k >= 0 and reach[k + 1] > s:
                if base[k][2] > s:
                    of_base[k] = max(of_base[k] or 0.0, p)
                k -= 1
        elif p >= net.threshold and s >= end:
            found.append((s, "learned", e, p))
            end = e
    found += [(s, kind, e, 1.0 if p is None else p) for (s, kind, e), p in zip(base, of_base, strict=True)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[1])))


FINDINGS = {"kinds": "array<string>", "starts": "array<int>", "ends": "array<int>", "scores": "array<double>"}


def scan(docs: DataFrame) -> DataFrame:
    """A row per document with its findings by start."""
    arrow_batches(docs.sparkSession)

    def make():
        net = model()

        def work(texts):
            found = [scan_text(t, net) for t in texts]
            return {c: [[f[i] for f in fs] for fs in found] for c, i in (("kinds", 1), ("starts", 0), ("ends", 2), ("scores", 3))}

        return work

    return mapped(docs.select("doc_id", whole_text().alias("__text")), ["doc_id"], ["__text"], make, FINDINGS)


def redact(text: str, findings: list[tuple[int, str, int, float]], mark: str = "[secret]") -> str:
    """The text with each finding replaced by the mark."""
    out, at = [], 0
    for start, _, end, _ in findings:
        if end > at:
            out += [text[at : max(at, start)], mark] if start >= at else []
            at = max(at, end)
    return "".join(out) + text[at:]


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base findings and all spans as text."""
    each = F.arrays_zip("kinds", "starts", "ends")

    def joined(of):
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"])), ",")

    def count(kind):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter(each, lambda x: x["kinds"] != "learned")).cast("binary"), 256).alias("base_sha256"),
        joined(each).alias("spans"), count("learned"),
    )


def base_digest_of(text: str) -> str:
    """base_sha256 of one text, plainly."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base_findings(text)).encode()).hexdigest()

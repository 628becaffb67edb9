"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

Tokens between white space that hold a digit or an at sign are the field's variables; every other token
is outside by definition and acts through the features of its neighbours. Next variables share a chain
potential; equal and similar ones anywhere in the document share a skip potential, and loopy belief
propagation makes their labels agree. Equal tokens hang on one hub per distinct token, hubs on one hub
per shape, so edges grow with the tokens and not with their pairs.

The field is trained here, piece by piece: token potentials by multinomial logistic regression, pair
potentials by counted agreement, on a bounded sample whose labels come from the base patterns and
from openings that announce a secret.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import by_batch, documents

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS, "secret")
#: At most so many documents train the field; hashed features of a token.
TRAIN_DOCUMENTS, DIMENSIONS = 2000, 1 << 13
#: Rounds of message passing, and the least belief of a span that is added.
ROUNDS, BELIEF = 6, 0.7

AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
WORD_BEFORE = re.compile(r"([^\x20\x09-\x0D]{1,30})[\x20\x09-\x0D]+$")
# Openings after which the training sample counts a token as a secret.
SECRET = re.compile(r"^(?:AKIA[0-9A-Z]{12,}|(?:password|passwd|token|secret|api_key)=.+)$|^\"?[0-9a-f]{32,}\"?$")


def emails(text: str):
    """Leftmost non-overlapping addresses: the letters before each at sign, then a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = AFTER_AT.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base matches as (kind, start, end), by kind and start."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        # A part of more than three digits without leading zeros is above 255; no long number is converted.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def shape(token: str) -> str:
    """Runs of letters, digits and other characters, each by its kind once."""
    low = re.sub(r"[A-Z]+", "A", token)
    low = re.sub(r"[^\W\d_A]+", "a", low)
    return re.sub(r"[0-9]+", "0", low)[:24]


def token_features(text: str, start: int, end: int, total: int) -> list[int]:
    """Hashed features of the token at a place."""
    token = text[start:end]
    before = WORD_BEFORE.search(text, max(0, start - 40), start)
    after = text[end:end + 20].split(None, 1)
    digits = sum(c.isdigit() for c in token)
    names = ["bias", f"shape {shape(token)}", f"length {min(len(token), 45) // 3}", f"digits {min(digits, 24)}",
             f"first {token[0]}", f"last {token[-1]}", f"start {token[:4].lower()}",
             f"before {shape(before[1]) if before else ''}", f"word {before[1].lower() if before else ''}",
             f"after {shape(after[0]) if after else ''}", f"share {digits * 8 // len(token)}",
             f"dots {min(token.count('.'), 4)}", f"at {min(token.count('@'), 2)}"]
    return [zlib.crc32(n.encode()) % DIMENSIONS for n in names]


class Tokens:
    """The variables of one document: places, features, and which are neighbours or alike."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.features = [token_features(text, s, e, len(text)) for s, e in self.spans]
        self.words = [text[s:e].strip(".,;:!?()[]\"'") for s, e in self.spans]
        self.shapes = [shape(w) for w in self.words]
        self.next = [i for i in range(len(self.spans) - 1)
                     if not text[self.spans[i][1]:self.spans[i + 1][0]].strip(" \t\n\r\x0b\x0c")]

    def teach(self, text: str) -> list[int]:
        """Labels for training: base spans, and announced secrets."""
        labels = [LABELS.index("secret") if SECRET.match(w) and not w.isdigit() else 0 for w in self.words]
        for kind, s, e in base_spans(text):
            for i, (a, b) in enumerate(self.spans):
                if a < e and s < b:
                    labels[i] = LABELS.index(kind)
        return labels


class Field:
    """Weights of the field."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, same: float, alike: float):
        self.unary, self.chain, self.same, self.alike = unary, chain, same, alike

    @staticmethod
    def fit(samples: list[tuple[list[list[int]], list[int], list[int], list[str], list[str]]], steps: int = 400) -> "Field":
        """``samples``: features, labels, next places, words and shapes of each training document. With no
        tokens all weights are zero, and nothing is added."""
        k = len(LABELS)
        x = np.array([f for s in samples for f in s[0]], np.int64)
        y = np.array([v for s in samples for v in s[1]], np.int64)
        w = np.zeros((DIMENSIONS, k))
        if not len(x):
            return Field(w, np.zeros((k, k)), 0.0, 0.0)
        speed, goal = np.zeros_like(w), np.eye(k)[y]
        for _ in range(steps):
            z = w[x].sum(1)
            p = np.exp(z - z.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True) - goal) / len(x)
            g = 1e-4 * w
            for c in range(k):
                g[:, c] += np.bincount(x.ravel(), np.repeat(p[:, c], x.shape[1]), DIMENSIONS)
            speed = 0.9 * speed - 2.0 * g
            w += speed
        pairs = np.zeros((k, k))
        agree = {"same": [1.0, 1.0], "alike": [1.0, 1.0]}
        for _, labels, following, words, shapes in samples:
            for i in following:
                pairs[labels[i], labels[i + 1]] += 1
            for name, keys in (("same", words), ("alike", shapes)):
                first: dict[str, int] = {}
                for key, label in zip(keys, labels):
                    agree[name][0 if first.setdefault(key, label) == label else 1] += 1
        # Counted neighbours against chance, drawn to chance where few were seen.
        chance = np.outer(pairs.sum(1), pairs.sum(0)) / max(pairs.sum(), 1)
        chain = np.log((pairs + 5) / (chance + 5))
        same, alike = (float(np.clip(np.log(a / b), 0, 4)) / 2 for a, b in (agree["same"], agree["alike"]))
        return Field(w, chain, same, alike / 2)

    def beliefs(self, t: Tokens) -> np.ndarray:
        """Marginals of every token after loopy message passing."""
        n, k = len(t.spans), len(LABELS)
        unary = self.unary[np.array(t.features)].sum(1)
        edges: list[tuple[int, int, np.ndarray]] = [(i, i + 1, self.chain) for i in t.next]
        nodes, same, alike = n, self.same * np.eye(k), self.alike * np.eye(k)
        by_word: dict[str, list[int]] = defaultdict(list)
        for i, word in enumerate(t.words):
            by_word[word].append(i)
        by_shape: dict[str, list[int]] = defaultdict(list)
        for word, own in by_word.items():
            at = own[0]
            if len(own) > 1:
                at, nodes = nodes, nodes + 1
                edges += [(i, at, same) for i in own]
            by_shape[t.shapes[own[0]]].append(at)
        for own in by_shape.values():
            if len(own) > 1:
                edges += [(i, nodes, alike) for i in own]
                nodes += 1
        logs = np.zeros((nodes, k))
        logs[:n] = unary
        if edges:
            a = np.array([e[0] for e in edges] + [e[1] for e in edges])
            b = np.array([e[1] for e in edges] + [e[0] for e in edges])
            tables = np.array([e[2] for e in edges] + [e[2].T for e in edges])
            m = len(edges)
            back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
            messages = np.zeros((2 * m, k))
            for _ in range(ROUNDS):
                total = logs.copy()
                np.add.at(total, b, messages)
                out = _log_sum(tables + (total[a] - messages[back])[:, :, None])
                messages = 0.5 * messages + 0.5 * (out - out.max(1, keepdims=True))
            np.add.at(logs, b, messages)
        p = np.exp(logs[:n] - logs[:n].max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans the field finds besides the base spans: runs of tokens of one label, trimmed."""
        t = Tokens(text)
        if not t.spans:
            return []
        p = self.beliefs(t)
        label = np.where(p.max(1) >= BELIEF, p.argmax(1), 0)
        chained, found, i = set(t.next), [], 0
        taken = sorted((s, e) for _, s, e in base)
        while i < len(label):
            j = i
            while j in chained and label[j + 1] == label[i]:
                j += 1
            if label[i]:
                start, end = t.spans[i][0], t.spans[j][1]
                own = text[start:end]
                start += len(own) - len(own.lstrip("\"'(["))
                end -= len(own) - len(own.rstrip(".,;:!?\"')]"))
                found.append((LABELS[label[i]], start, end))
            i = j + 1
        starts = [s for s, _ in taken]
        ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
        free = []
        for kind, s, e in found:
            at = int(np.searchsorted(starts, e))
            if s < e and (at == 0 or ends[at - 1] <= s):
                free.append((kind, s, e))
        return free


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def train(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> Field:
    """The field, from at most ``most`` distinct texts that have variables, those of the least hashes. Only their
    hashed features pass through the driver."""
    some = documents(docs).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    last = some.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    sample = some.where(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"])

    def build():
        def run(batch):
            rows = []
            for doc, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                t = Tokens(text)
                rows.append((doc, [x for f in t.features for x in f], t.teach(text), t.next, t.words, t.shapes))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()))
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                   ["h", "features", "labels", "following", "words", "shapes"])
        return run
    rows = by_batch(sample.select("h", "text"), build, "h long, features array<int>, labels array<int>, following array<int>, "
                    "words array<string>, shapes array<string>").collect()
    samples = []
    for r in sorted(rows, key=lambda r: (r.h, r.labels)):
        n = len(r.labels)
        samples.append(([r.features[i:i + len(r.features) // n] for i in range(0, len(r.features), len(r.features) // n)] if n else [],
                        r.labels, r.following, r.words, r.shapes))
    return Field.fit(samples)


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: ``doc_id``, the number of base matches of each kind, ``base_sha256`` over the base
    spans, ``spans`` with the field's too, and ``n_added``, how many those are.

    Null and empty texts have no spans; repeated rows and null ids stay. A text without digits and at
    signs has no variables and is done at once.
    """
    field = train(docs) if field is None else field
    order = {k: i for i, k in enumerate((*KINDS, "secret"))}

    def build():
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)

        def run(batch):
            some = pc.match_substring_regex(batch.column("text"), "[0-9@]").to_pylist()
            rows = []
            for i, has in enumerate(some):
                if not has:
                    rows.append(nothing)
                    continue
                text = batch.column("text")[i].as_py()
                base = base_spans(text)
                added = field.added(text, base)
                every = sorted(base + added, key=lambda s: (order[s[0]], s[1]))
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(added)))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            return pa.record_batch([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))],
                                   [x.split()[0] for x in SCHEMA.split(",")])
        return run
    return by_batch(documents(docs), build, SCHEMA)

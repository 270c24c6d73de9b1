"""Personal data in texts: fixed patterns, and a skip-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field then
labels the other number- or address-like tokens: neighbouring tokens share a potential,
and so do distant ones that repeat or resemble each other (the same token, the same last
digits, the local part of an address). Tokens inside pattern spans are observed, so a
phone number that later stands without its country code, or a card number grouped in
another way, takes the label of the place where it was recognised. Labels follow from
loopy belief propagation over all tokens of a document; a token without such support
stays unlabelled, which training teaches (see `_taught`).

Weights are learnt in one task from at most SAMPLE documents, drawn by hash among those
with a digit or an @ and at most LONGEST characters. Repeats of one key are joined to one
hub, so a document has as many skip edges as tokens, however often a token repeats, and
every pass is linear in the text.

Defined results: a null or empty text has no spans; a null doc_id is kept; repeated rows
get equal spans; offsets count code points, ends are exclusive; without any pattern span
in the sample nothing is added, nor to a document without one; an empty table gives an empty result. Extra columns are
not read by `find`, and kept, whatever their names, by `redact`.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: not personal
SAMPLE, LONGEST = 2_000, 20_000
DIMS, SWEEPS, SURE = 1 << 12, 12, 0.9
STEPS, RATE, DECAY = 250, 0.1, 1e-4
SLICE_TOKENS = 20_000  # tokens whose graphs are worked on together

_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]")
_REST = re.compile(r"[^\x20\x09-\x0D]*")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^\x00-\x7F]+")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
SPACES = " \t\n\v\f\r"
EDGE = "!\"#$%&'*,./:;<=>?[\\]^_`{|}~-"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass their checks, in order."""
    found = []
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:
            local = _LOCAL_BACK.match(text[done:at][::-1]).end()
            domain = _DOMAIN.match(text, at + 1) if local else None
            if domain:
                found.append((at - local, 0, domain.end()))
            done = domain.end() if domain else at + 1
            at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Graph:
    """The tokens of a document that may be personal, what is observed of them, and their edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans, raw = [], []
        locals_ = {text[s:e].partition("@")[0].strip(EDGE).lower() for s, k, e in base if k == 0}
        locals_ = {x for x in locals_ if len(x) >= 4 and re.search(r"[0-9._+-]", x)}
        for a, b in _tokens(text, locals_):
            part = text[a:b]
            core = part.strip(EDGE)
            if core:
                a += part.index(core)
                self.spans.append((a, a + len(core)))
                raw.append(core)
        n = len(raw)
        self.observed = np.full(n, -1)
        self.last_of: dict[int, str] = {}  # token that ends a base span: the span's digits
        k = 0
        for i, (a, b) in enumerate(self.spans):
            while k < len(base) and base[k][2] <= a:
                k += 1
            over = next((x for x in base[k : k + 4] if x[0] < b and x[2] > a), None)
            if over is not None:
                self.observed[i] = 1 + over[1]
                if over[2] <= b:
                    self.last_of[i] = _DIGITS.sub("", text[over[0] : over[2]])
        self.chain = [(i, i + 1) for i in range(n - 1) if self.spans[i + 1][0] - self.spans[i][1] <= 8 and not text[self.spans[i][1] : self.spans[i + 1][0]].strip(EDGE + SPACES)]
        digits = [_DIGITS.sub("", x) for x in raw]
        run = [0] * n
        linked = {b for _, b in self.chain}
        begin = 0
        for i in range(n + 1):
            if i == n or i not in linked:
                run[begin:i] = [sum(map(len, digits[begin:i]))] * (i - begin)
                begin = i
        self.skip = self._skips(raw, digits, locals_)
        self.features = np.array([_features(text, a, x, d, r) for (a, _), x, d, r in zip(self.spans, raw, digits, run, strict=True)], dtype=np.int64).reshape(n, N_FEATURES)

    def _skips(self, raw: list[str], digits: list[str], locals_: set[str]) -> list[tuple[int, int]]:
        """Each token with one hub of those that share a key with it: an observed one where there is one."""
        groups: dict[str, list[int]] = {}
        for i, (core, d) in enumerate(zip(raw, digits, strict=True)):
            keys = set()
            low = core.lower()
            local = low.partition("@")[0]
            if len(d) >= 5 or "@" in low:
                keys.add("=" + low)
            if "@" in low or local in locals_:
                keys.add("l" + local.strip(EDGE))
            for x in (d, self.last_of.get(i, "")):
                if len(x) >= 7:
                    keys.add("d" + x[-7:])
            for x in keys:
                groups.setdefault(x, []).append(i)
        edges = set()
        for members in groups.values():
            hub = next((i for i in members if self.observed[i] > 0), members[0])
            edges.update((hub, i) for i in members if i != hub)
        return sorted({(min(e), max(e)) for e in edges})


def _tokens(text: str, locals_: set[str]) -> list[tuple[int, int]]:
    """Runs of other than spaces with a digit or an @, or equal to a local part of the document's addresses."""
    out, done = [], 0
    m = _TRIGGER.search(text)
    while m:
        a = max(done, 1 + max(text.rfind(c, done, m.start()) for c in SPACES))
        done = _REST.match(text, m.start()).end()
        out.append((a, done))
        m = _TRIGGER.search(text, done)
    if locals_:
        out += [t.span() for t in _TOKEN.finditer(text) if not _TRIGGER.search(t[0]) and t[0].strip(EDGE).lower() in locals_]
        out.sort()
    return out


N_FEATURES = 9


def _features(text: str, start: int, core: str, digits: str, run: int) -> list[int]:
    shape = _RUNS.sub(lambda m: ("9" if m[0][0].isdigit() else "a" if m[0][0].islower() else "A") + str(len(m[0])), core)
    classes = _RUNS.sub(lambda m: "9" if m[0][0].isdigit() else "a" if m[0][0].islower() else "A", core)
    checked = f"{len(digits) in range(12, 20)}{12 <= len(digits) <= 19 and luhn(digits)}"
    parts = all(len(p) <= 3 and int(p) <= 255 for p in core.split(".")) if _PARTS.fullmatch(core) else ""
    before = text[max(0, start - 40) : start].split()
    named = ("bias", "s" + shape, "k" + classes, f"n{min(len(digits), 24)}", f"r{min(run, 24)}", "c" + checked, f"p{parts}", f"m{core.count('@')}{core.startswith('+')}", "w" + (_RUNS.sub("9", before[-1]) if before and before[-1][-1:].isdigit() else before[-1].strip(EDGE).lower() if before else ""))
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMS for x in named]


class Model:
    """Weights of tokens' features, of neighbours (from left to right) and of repeats."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, (skip + skip.T) / 2


def beliefs(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, model: Model, sweeps: int = SWEEPS) -> np.ndarray:
    """Label probabilities of all nodes by loopy belief propagation; edges are rows of two nodes. Graphs without a common edge don't touch each other."""
    n, (c, s) = len(unary), (len(chain), len(skip))
    src = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]])
    dst = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]])
    back = np.concatenate([np.arange(c + s, 2 * (c + s)), np.arange(c + s)])
    kinds = ((slice(0, c), model.chain), (slice(c, c + s), model.skip), (slice(c + s, 2 * c + s), model.chain.T), (slice(2 * c + s, 2 * (c + s)), model.skip))
    said = np.zeros((len(src), LABELS))
    total = unary
    for _ in range(sweeps if len(src) else 0):
        held = total[src] - said[back]
        new = np.empty_like(said)
        for at, potential in kinds:
            x = held[at][:, :, None] + potential
            top = x.max(axis=1)
            new[at] = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        said = 0.5 * said + 0.5 * new
        total = unary + np.stack([np.bincount(dst, said[:, y], n) for y in range(LABELS)], axis=1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _edges(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def _joined(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """features, observed, chain, skip of all graphs side by side, and where each begins."""
    first = np.concatenate([[0], np.cumsum([len(g.spans) for g in graphs])]).astype(np.int64)
    chain = np.concatenate([_edges(g.chain) + f for g, f in zip(graphs, first, strict=False)])
    skip = np.concatenate([_edges(g.skip) + f for g, f in zip(graphs, first, strict=False)])
    return np.concatenate([g.features for g in graphs]), np.concatenate([g.observed for g in graphs]), chain, skip, first


def label(graphs: list[Graph], model: Model) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the field adds to each document."""
    features, observed, chain, skip, first = _joined(graphs)
    unary = model.unary[features].sum(axis=1)
    known = observed > 0
    unary[known] = -1e6
    unary[known, observed[known]] = 0.0
    p = beliefs(unary, chain, skip, model)
    best = p.argmax(axis=1)
    best[(p.max(axis=1) < SURE) | known] = 0
    out = []
    for g, f in zip(graphs, first, strict=False):
        spans, linked = [], {b: a for a, b in g.chain}
        mine = best[f : f + len(g.spans)]
        for i in np.flatnonzero(mine):
            kind = int(mine[i]) - 1
            if spans and linked.get(i) == spans[-1][3] and spans[-1][1] == kind:
                spans[-1] = (spans[-1][0], kind, g.spans[i][1], i)
            else:
                spans.append((g.spans[i][0], kind, g.spans[i][1], i))
        out.append([x[:3] for x in spans])
    return out


def _mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(kind, another way to write it) of some of a document's entities, which no pattern matches."""
    out = []
    for s, k, e in dict((text[s:e], (s, k, e)) for s, k, e in base).values():
        x = text[s:e]
        d = _DIGITS.sub("", x)
        if k == 0:
            out.append((0, x.partition("@")[0].strip(EDGE)))
        elif k == 1:
            out.append((1, x.replace(".", "-")))
        elif k == 2:
            out.append((2, ".".join(d[i : i + 4] for i in range(0, len(d), 4))))
        else:
            out += [(3, x.partition(" ")[2] or d[2:]), (3, f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}")]
    return [(k, x) for k, x in out[:8] if not base_spans(x)]


def _decoys(text: str, base: list[tuple[int, int, int]]) -> list[str]:
    """Of some entities, the like that fails its check."""
    out = []
    for s, k, e in base[:8]:
        x = text[s:e]
        if k == 1:
            out.append(re.sub(r"^[0-9]+", "412", x))
        elif k == 2:
            out.append(x[:-1] + str((int(x[-1]) + 5) % 10))
        elif k == 3:
            out.append(x[: len(x) // 2].rstrip(" (-.") if len(_DIGITS.sub("", x[: len(x) // 2])) < 9 else "+1 20")
    return [x for x in out if not base_spans(x)]


def _taught(texts: list[str]) -> tuple[list[Graph], list[np.ndarray]]:
    """Graphs to learn from, with the label of each token.

    Labels are the patterns'. To each text are added its entities written in other ways,
    labelled as they are, and entities that fail their checks; and the other ways to
    write those of the text before, whose evidence is not here: not personal.
    """
    graphs, labels, foreign = [], [], []
    for text in texts:
        base = base_spans(text)
        if not base and not foreign and len(graphs) % 4:
            graphs.append(Graph(text, base))
            labels.append(np.maximum(graphs[-1].observed, 0))
            continue
        own = _mentions(text, base)
        more, told = [text], []
        at = len(text)
        for k, x in [*own, *[(-1, x) for x in _decoys(text, base)], *[(-1, x) for _, x in foreign if x not in text]]:
            more.append(f" so {x} and")
            told.append((at + 4, at + 4 + len(x), 1 + k))
            at += len(x) + 8
        full = "".join(more)
        g = Graph(full, base_spans(full))
        y = np.maximum(g.observed, 0)
        starts = [s for s, _, _ in told]
        for i, (a, _) in enumerate(g.spans):
            k = bisect_right(starts, a) - 1
            if k >= 0 and a < told[k][1] and g.observed[i] < 0:
                y[i] = told[k][2]
        graphs.append(g)
        labels.append(y)
        foreign = own or foreign
    return graphs, labels


def learn(texts: list[str]) -> Model | None:
    """Weights by gradient ascent on the pseudo-likelihood, half of it without neighbours for observed tokens; None without any pattern span."""
    if not any(base_spans(t) for t in texts):
        return None
    graphs, labels = _taught(texts)
    keep = [i for i, g in enumerate(graphs) if g.spans]
    features, observed, chain, skip, _ = _joined([graphs[i] for i in keep])
    y = np.concatenate([labels[i] for i in keep])
    n, one = len(y), np.eye(LABELS)
    alone = observed > 0  # tokens whose own features tell the label
    alone |= y == 0
    weights = [np.zeros((DIMS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    moved = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]

    def gather(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, k], n) for k in range(LABELS)], axis=1)

    for step in range(1, STEPS + 1):
        own = weights[0][features].sum(axis=1)
        around = gather(chain[:, 1], weights[1][y[chain[:, 0]]]) + gather(chain[:, 0], weights[1][:, y[chain[:, 1]]].T)
        s = (weights[2] + weights[2].T) / 2
        around += gather(skip[:, 1], s[y[skip[:, 0]]]) + gather(skip[:, 0], s[y[skip[:, 1]]])
        slopes = []
        for logits, mask in ((own, alone), (own + around, np.ones(n, bool))):
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            slopes.append(np.where(mask[:, None], one[y] - p / p.sum(axis=1, keepdims=True), 0.0))
        up = slopes[0] + slopes[1]
        unary = np.stack([np.bincount(features.ravel(), np.repeat(up[:, k], N_FEATURES), DIMS) for k in range(LABELS)], axis=1)
        both = slopes[1]
        along = np.stack([np.bincount(y[chain[:, 0]], both[chain[:, 1], k], LABELS) for k in range(LABELS)], axis=1) + np.stack([np.bincount(y[chain[:, 1]], both[chain[:, 0], k], LABELS) for k in range(LABELS)], axis=1).T
        apart = sum(np.stack([np.bincount(y[skip[:, a]], both[skip[:, b], k], LABELS) for k in range(LABELS)], axis=1) for a, b in ((0, 1), (1, 0)))
        for w, (m, v), g in zip(weights, moved, (unary, along, (apart + apart.T) / 2), strict=True):
            g = g / n - DECAY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(*weights)


def sample(docs: DataFrame) -> DataFrame:
    """doc_id, text of at most SAMPLE documents that may hold personal data, by hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter((F.length("text") <= LONGEST) & F.col("text").rlike("[0-9@]"))
    picked = texts.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit("personal"), "doc_id"), "doc_id").limit(SAMPLE)
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # SAMPLE rows at most


def fit(docs: DataFrame) -> Model | None:
    """The model, learnt in one task from the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn([t for _, t in rows]))], pa.binary())], names=["model"])

    found = sample(docs).repartition(1).mapInArrow(run, "model binary").first()
    return None if found is None else pickle.loads(found[0])


def all_spans(texts: Iterator[str | None], model: Model | None) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, in order."""
    waiting: list[tuple[list[tuple[int, int, int]], Graph | None]] = []
    tokens = 0

    def flush():
        graphs = [g for _, g in waiting if g is not None]
        added = iter(label(graphs, model)) if graphs else iter(())
        for base, g in waiting:
            yield base, base if g is None else sorted(base + next(added))

    for text in texts:
        base = base_spans(text) if text and _TRIGGER.search(text) else []
        g = Graph(text, base) if base and model is not None else None  # without an observed token nothing is told from afar
        if g is not None and not (g.observed < 0).any():
            g = None
        waiting.append((base, g))
        tokens += len(g.spans) if g is not None else 0
        if tokens > SLICE_TOKENS:
            yield from flush()
            waiting, tokens = [], 0
    yield from flush()


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    model = fit(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, listed = [], []
            for base, every in all_spans((t.as_py() for t in batch.column(1)), shared.value):
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                listed.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(listed, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    model = fit(docs) if model is None else model
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, (_, every) in enumerate(all_spans(iter(texts), shared.value)):
                done, parts = 0, []
                for s, k, e in every:
                    if s >= done:
                        parts += [texts[i][done:s], f"[{KINDS[k].upper()}]"]
                    done = max(done, e)
                if every:
                    texts[i] = "".join(parts) + texts[i][done:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)

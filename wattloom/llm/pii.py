"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans, which always stay.  The model learns from them on a bounded sample of windows and adds
spans that the patterns miss.  It reads overlapping windows over every stretch of text near a digit or an at sign (no kind
of span is without either), and the spans of all windows of a text are reconciled at once: spans cut by a window's border
give way to whole ones, and of the rest the best set without overlaps is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wattloom.llm.support import cut, prepare

KINDS = ("email", "ip", "card", "phone")
WIDTH = 96
STRIDE = 48
#: Characters on either side of a digit or at sign that the model reads.
MARGIN = 24
#: Training windows for each kind and for windows without a span: at most so many, those with the smallest hashes.
SAMPLE = 300
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 16, 24, 9, 64, 0.01
#: A span of the model is added when every character has at least this posterior probability.
SURE = 0.97

_SIGNS = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns, leftmost and without overlaps within a kind; in order of start, then kind."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:  # the run of local characters before each at sign is where the leftmost match starts
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def windows_of(text: str) -> list[tuple[int, int, bool, bool]]:
    """(start, end, open at the left, open at the right) of the windows; open: the stretch goes on beyond the border."""
    stretches: list[list[int]] = []
    for m in _SIGNS.finditer(text):
        lo, hi = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if stretches and lo <= stretches[-1][1]:
            stretches[-1][1] = hi
        else:
            stretches.append([lo, hi])
    out = []
    for lo, hi in stretches:
        at = lo
        while True:
            end = min(hi, at + WIDTH)
            out.append((at, end, at > lo, end < hi))
            if end == hi:
                break
            at += STRIDE
    return out


def char_ids(text: str) -> np.ndarray:
    """ASCII characters by code, other letters 1, other characters 2, fill 0."""
    out = np.zeros(WIDTH, np.int64)
    own = [ord(c) if c < "\x80" else 1 + (not c.isalpha()) for c in text]
    out[: len(own)] = own
    return out


class Tagger:
    """Two LSTMs over character embeddings, scores of 9 tags (O, begin and inside of each kind) and a CRF over them."""

    TAGS = 1 + 2 * len(KINDS)

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": draw(128, EMBED) * 8, "out": draw(2 * HIDDEN, self.TAGS), "out_b": np.zeros(self.TAGS, np.float32), "trans": np.zeros((self.TAGS, self.TAGS), np.float32), "first": np.zeros(self.TAGS, np.float32)}
        for way in "fb":
            self.p["w" + way] = draw(EMBED + HIDDEN, 4 * HIDDEN)
            self.p["b" + way] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        inside = np.arange(2, self.TAGS, 2)
        self.barred = np.zeros((self.TAGS, self.TAGS), np.float32)
        self.barred[:, inside] = -1e4
        self.barred[inside - 1, inside] = 0
        self.barred[inside, inside] = 0
        self.barred_first = np.zeros(self.TAGS, np.float32)
        self.barred_first[inside] = -1e4

    def _lstm(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((n, t, HIDDEN), np.float32), []
        w, b = self.p["w" + way], self.p["b" + way]
        ahead = x @ w[:EMBED] + b
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            z = ahead[:, k] + h @ w[EMBED:]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, k] = h
            kept.append((k, i, f, o, g, tc, *before))
        return out, kept

    def _lstm_back(self, x: np.ndarray, way: str, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x)
        w = self.p["w" + way]
        dw, db, dx = np.zeros_like(w), np.zeros_like(self.p["b" + way]), np.zeros_like(x)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for k, i, f, o, g, tc, c0, h0 in reversed(kept):
            dh = dh + d_out[:, k]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dw[:EMBED] += x[:, k].T @ dz
            dw[EMBED:] += h0.T @ dz
            db += dz.sum(0)
            back = dz @ w.T
            dx[:, k] = back[:, :EMBED]
            dh, dc = back[:, EMBED:], dc * f
        return dx, dw, db

    def scores(self, ids: np.ndarray):
        x = self.p["embed"][ids]
        f, kept_f = self._lstm(x, "f")
        b, kept_b = self._lstm(x, "b")
        both = np.concatenate([f, b], 2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, kept_f, kept_b)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each tag, and the expected transitions summed over positions and windows."""
        trans, first = self.p["trans"] + self.barred, self.p["first"] + self.barred_first
        n, t, k = e.shape
        fwd, bwd = np.zeros((n, t, k)), np.zeros((n, t, k))
        fwd[:, 0] = first + e[:, 0]
        for s in range(1, t):
            m = fwd[:, s - 1].max(1, keepdims=True)
            fwd[:, s] = np.log(np.exp(fwd[:, s - 1] - m) @ np.exp(trans) + 1e-30) + m + e[:, s]
        for s in range(t - 2, -1, -1):
            v = bwd[:, s + 1] + e[:, s + 1]
            m = v.max(1, keepdims=True)
            bwd[:, s] = np.log(np.exp(v - m) @ np.exp(trans).T + 1e-30) + m
        m = fwd[:, -1].max(1, keepdims=True)
        z = np.log(np.exp(fwd[:, -1] - m).sum(1, keepdims=True)) + m
        post = np.exp(fwd + bwd - z[:, :, None])
        left = fwd[:, :-1] - z[:, None, :]
        moves = np.zeros((k, k))
        for s in range(t - 1):
            moves += np.exp(np.minimum(left[:, s, :, None] + trans[None] + (bwd[:, s + 1] + e[:, s + 1])[:, None, :], 0)).sum(0)
        return post, moves

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        trans, first = self.p["trans"] + self.barred, self.p["first"] + self.barred_first
        n, t, k = e.shape
        best, back = first + e[:, 0], np.zeros((n, t, k), np.int8)
        for s in range(1, t):
            all_ = best[:, :, None] + trans[None]
            back[:, s] = all_.argmax(1)
            best = all_.max(1) + e[:, s]
        path = np.zeros((n, t), np.int64)
        path[:, -1] = best.argmax(1)
        for s in range(t - 1, 0, -1):
            path[:, s - 1] = back[np.arange(n), s, path[:, s]]
        return path

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> "Tagger":
        """Adam on the likelihood of the tag sequences."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(ids))
            for lo in range(0, len(order), BATCH):
                own, y = ids[order[lo : lo + BATCH]], tags[order[lo : lo + BATCH]]
                n = len(own)
                e, (x, both, kept_f, kept_b) = self.scores(own)
                post, moves = self.marginals(e.astype(np.float64))
                d = post
                np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
                d = (d / n).astype(np.float32)
                seen = np.zeros_like(moves)
                np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
                g = {"trans": ((moves - seen) / n).astype(np.float32), "first": d[:, 0].sum(0), "out": np.einsum("nth,ntk->hk", both, d, optimize=True), "out_b": d.sum((0, 1))}
                d_both = d @ self.p["out"].T
                dx_f, g["wf"], g["bf"] = self._lstm_back(x, "f", kept_f, d_both[:, :, :HIDDEN])
                dx_b, g["wb"], g["bb"] = self._lstm_back(x, "b", kept_b, d_both[:, :, HIDDEN:])
                g["embed"] = np.zeros_like(self.p["embed"])
                np.add.at(g["embed"], own, dx_f + dx_b)
                step += 1
                rate = RATE * (1 - epoch / epochs) ** 0.5
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.99 * square[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def _tags(start: int, end: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(WIDTH, np.int64)
    for s, e, kind in spans:
        lo, hi = max(s, start), min(e, end)
        if lo < hi and not out[lo - start : hi - start].any():
            out[lo - start : hi - start] = 2 + 2 * KINDS.index(kind)
            out[lo - start] = 1 + 2 * KINDS.index(kind)
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """Fit on windows of the texts, labelled by the base spans; at most ``sample`` of each kind and as many without any.

    At most 5 * ``sample`` windows reach the driver, where the small network is fitted.  No windows: no model.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not _SIGNS.search(text):
                    continue
                spans = base_spans(text)
                for start, end, _, _ in windows_of(text):
                    inside = [s for s in spans if s[0] < end and s[1] > start]
                    own = text[start:end]
                    rows.append((min((s[2] for s in inside), default="none"), xxhash.xxh3_64_intdigest(own.encode()) >> 1, own, _tags(start, end, inside).astype(np.int8).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["kind", "h", "chars", "tags"])

    found = docs.filter("text is not null").select("text").mapInArrow(run, "kind string, h long, chars string, tags binary")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h", "chars", "tags"))  # Spark keeps the first of each task before it deals them out
    rows = found.withColumn("place", place).filter(F.col("place") <= sample).select("kind", "h", "chars", "tags").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return Tagger().fit(np.stack([char_ids(r[2]) for r in rows]), np.stack([np.frombuffer(r[3], np.int8).astype(np.int64) for r in rows]))


def _plausible(kind: str, chars: str) -> bool:
    digits = sum("0" <= c <= "9" for c in chars)
    return ("@" in chars.strip("@")) if kind == "email" else digits >= {"ip": 4, "card": 12, "phone": 7}[kind]


def find_spans(texts: list[str | None], model: Tagger | None, sure: float = SURE) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, kind, base) of each text, in order of start, then kind."""
    out: list[list[tuple[int, int, str, bool]]] = []
    windows: list[tuple[int, int, int, bool, bool]] = []
    for k, text in enumerate(texts):
        out.append([])
        if text and _SIGNS.search(text):
            out[k] = [(*s, True) for s in base_spans(text)]
            if model is not None:
                windows += [(k, *w) for w in windows_of(text)]
    found: dict[int, dict[Span, float]] = {}
    for lo in range(0, len(windows), 256):
        part = windows[lo : lo + 256]
        e, _ = model.scores(np.stack([char_ids(texts[k][s:t]) for k, s, t, _, _ in part]))
        e = e.astype(np.float64)
        path, post = model.viterbi(e), None
        if not path.any():
            continue
        post, _ = model.marginals(e)
        for i, (k, start, end, open_left, open_right) in enumerate(part):
            size, at = end - start, 0
            while at < size:
                tag = path[i, at]
                if tag == 0:
                    at += 1
                    continue
                stop = at + 1
                kind = (tag - 1) // 2
                while stop < size and path[i, stop] == 2 + 2 * kind:
                    stop += 1
                whole = not (open_left and at == 0 or open_right and stop == size)
                if whole:
                    sure_of = float(post[i, np.arange(at, stop), path[i, at:stop]].min())
                    span = (start + at, start + stop, KINDS[kind])
                    mine = found.setdefault(k, {})
                    mine[span] = max(sure_of, mine.get(span, 0.0))
                at = stop
    for k, mine in found.items():
        fixed = [(s, e) for s, e, _, _ in out[k]]
        free = [(s, c) for s, c in mine.items() if c >= sure and _plausible(s[2], texts[k][s[0] : s[1]]) and not any(a < s[1] and s[0] < b for a, b in fixed)]
        out[k] = sorted([*out[k], *((*s, False) for s in _best_set(free))], key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def _best_set(spans: list[tuple[Span, float]]) -> list[Span]:
    """Spans without overlaps whose characters, weighted by their confidence, are most."""
    from bisect import bisect_right

    spans = sorted(spans, key=lambda s: (s[0][1], s[0]))
    ends = [s[0][1] for s in spans]
    best: list[float] = [0.0]
    took: list[bool] = []
    for (start, end, _), c in spans:
        with_it = best[bisect_right(ends, start, 0, len(took))] + c * (end - start)
        took.append(with_it > best[-1])
        best.append(max(best[-1], with_it))
    out, i = [], len(spans)
    while i:
        if took[i - 1]:
            out.append(spans[i - 1][0])
            i = bisect_right(ends, spans[i - 1][0][0], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def finder(spark, model: Tagger | None):
    """Column function: text -> array of struct(start, end, kind, base); positions in code points, null text has no span."""
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<start:long,end:long,kind:string,base:boolean>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
        rows = find_spans(texts.to_pylist(), sent.value)
        return pa.array([[dict(zip(("start", "end", "kind", "base"), s, strict=True)) for s in own] for own in rows], kind)

    return spans


def masker(spark, model: Tagger | None):
    """Column function: text -> text with each span replaced by its kind in angle brackets; overlapping spans as one."""
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        out = []
        for text, own in zip(values, find_spans(values, sent.value), strict=True):
            if not own:
                out.append(text)
                continue
            parts, at = [], 0
            for start, end, kind, _ in own:
                if start >= at:
                    parts += [text[at:start], f"<{kind}>"]
                at = max(at, end)
            out.append("".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return mask


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row; null text counts as empty.  The model is trained on the same texts."""
    model = train(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), finder(docs.sparkSession, model)("text").alias("spans"))

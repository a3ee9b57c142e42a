"""Maximal periodic runs of words, found with string synchronising sets.

A run is a stretch with smallest period q and at least twice that length which no neighbouring word extends.  Documents of a
batch are laid out in one array of word numbers, longest first, each followed by a number of its own, so that no run crosses
documents and all steps are numpy over whole batches.  Windows of 2^k words are named by hashes built by doubling; they give
synchronising sets, equal contexts and longest common extensions, and every run is compared word by word in the end.

* Periods below 16: the array is compared with itself at each distance.
* Periods of 4t to 8t for t = 4, 8, 16, ...: position i is selected if the least name among the windows of t words that start
  in i..i+t is that at i or at i+t; windows of period up to t/3 do not count.  The choice depends on 2t words only, so a run
  selects the same positions in each of its periods, and at least one in any t positions unless 3t-1 words there have a
  period of up to t/3.  Two selected positions with equal contexts of 2t words propose their distance as period.  Equal
  contexts are more than t/3 apart, so a position has at most 24 partners.
* What that leaves out is a run whose whole period has a period p of up to t/3 itself.  It holds two runs of period p that
  meet where its periods meet.  Runs of small periods are known by then; each pair that meets gives its period up to
  multiples of p, and those are proposed.

A proposal is extended both ways; of equal stretches the smallest period is the true one.

Defined cases: null and empty texts have no words, no runs and collapse to the empty text.  A very long document is a batch of
its own (8 bytes a word and level of doubling).  Repeated rows each give their own row.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattloom.llm.support import map_rows

LEAST_LENGTH = 12
#: Periods below are tried one by one; four times the first window width.
DIRECT = 16
#: Words laid out at once; a longer document is laid out alone.
CHUNK_WORDS = 200_000
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit name for pairs of names."""
    with np.errstate(over="ignore"):
        h = x * np.uint64(0x9E3779B97F4A7C15) ^ (y + np.uint64(0x7F4A7C159E3779B9)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class Layout:
    """Documents in one array, longest first, with names of all windows of 2^k words."""

    def __init__(self, docs: Sequence[np.ndarray], salt: int):
        self.lengths = np.array([len(d) for d in docs], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        self.size = int((self.lengths + 1).sum())
        self.words = np.empty(self.size, dtype=np.int64)
        for i, (at, d) in enumerate(zip(self.starts, docs)):
            self.words[at : at + len(d)] = d
            self.words[at + len(d)] = -1 - i
        self.owner = np.repeat(np.arange(len(docs)), self.lengths + 1)
        self.names = [_mix(self.words.astype(np.uint64), np.full(self.size, salt, dtype=np.uint64))]
        width = 1
        while (end := self.end(2 * width)) >= 2 * width:
            last = self.names[-1]
            self.names.append(_mix(last[: end - 2 * width + 1], last[width : end - width + 1]))
            width *= 2

    def end(self, words: int) -> int:
        """End of the documents of at least so many words; they come first."""
        n = int((self.lengths >= words).sum())
        return int(self.starts[n - 1] + self.lengths[n - 1] + 1) if n else 0

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from positions i and j on."""
        n = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            a, b = i + n, j + n
            fits = (a < len(name)) & (b < len(name))
            n[fits] += (name[a[fits]] == name[b[fits]]).astype(np.int64) << k
        return n

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words just before positions i and j."""
        n = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, width = self.names[k], 1 << k
            a, b = i - n - width, j - n - width
            fits = (a >= 0) & (b >= 0) & (a < len(name)) & (b < len(name))
            n[fits] += (name[a[fits]] == name[b[fits]]).astype(np.int64) << k
        return n

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rows (start, end, period) of the stretches of at least two periods around proposals that i and j are a period apart."""
        q = j - i
        start, end = i - self.behind(i, j), j + self.ahead(i, j)
        long = end - start >= 2 * q
        return np.stack([start[long], end[long], q[long]], axis=1)


def least_periods(found: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) with equal ends, the one with the smallest period."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def short_periods(text: Layout) -> np.ndarray:
    """Runs of the periods that are tried one by one."""
    found = []
    for q in range(1, DIRECT):
        end = text.end(2 * q)
        equal = np.zeros(max(end - q, 0) + 2, dtype=np.int8)
        equal[1:-1] = text.words[: max(end - q, 0)] == text.words[q : max(end, q)]
        turns = np.flatnonzero(np.diff(equal)).reshape(-1, 2)
        turns = turns[turns[:, 1] - turns[:, 0] >= q]
        found.append(np.column_stack([turns[:, 0], turns[:, 1] + q, np.full(len(turns), q)]))
    return least_periods(np.concatenate(found).astype(np.int64))


def synchronised(names: np.ndarray, t: int, runs: np.ndarray) -> np.ndarray:
    """Selected positions for windows of t words; ``names`` are those of all windows, ``runs`` hold all runs of period up to t/3."""
    least = names.copy()
    # windows inside a run of small period do not count; the greatest name stands for that
    least[least == np.iinfo(np.uint64).max] -= np.uint64(1)
    small = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    cover = np.zeros(len(least) + 1, dtype=np.int64)
    np.add.at(cover, np.minimum(small[:, 0], len(least)), 1)
    np.add.at(cover, np.minimum(small[:, 1] - t + 1, len(least)), -1)
    least[np.cumsum(cover[:-1]) > 0] = np.iinfo(np.uint64).max
    own, width = least, 1
    while width < t:  # least name of the windows that start at i .. i+t-1
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    first, last = own[: len(own) - t], own[t:]
    least = np.minimum(least[: len(first)], last)
    return np.flatnonzero(((least == first) | (least == last)) & (least != np.iinfo(np.uint64).max))


def context_pairs(text: Layout, t: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions with equal contexts, 4t to 8t words apart, in one document."""
    end = text.end(8 * t)
    level = t.bit_length() - 1
    at = synchronised(text.names[level][: end - t + 1], t, runs)
    context = text.names[level + 1]
    at = at[at < len(context)]
    at = at[np.lexsort((at, context[at]))]
    near, left, right = np.arange(len(at)), [], []
    for k in range(1, len(at)):
        near = near[near + k < len(at)]
        i, j = at[near], at[near + k]
        near = near[(context[i] == context[j]) & (j - i < 8 * t)]
        if not len(near):
            break
        i, j = at[near], at[near + k]
        fits = (j - i >= 4 * t) & (text.owner[i] == text.owner[j])
        left.append(i[fits])
        right.append(j[fits])
    return (np.concatenate(left), np.concatenate(right)) if left else (at[:0], at[:0])


def meeting_pairs(text: Layout, t: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proposals of periods 4t to 8t from runs of one period p up to t/3 that meet."""
    small = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= 4 * t)]
    small = small[np.lexsort((small[:, 0], small[:, 2]))]
    if len(small) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    one, two = small[:-1], small[1:]
    meet = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1]) & (text.owner[one[:, 0]] == text.owner[two[:, 0]])
    one, two = one[meet], two[meet]
    p, seam = one[:, 2], one[:, 1]
    # the rotation of the first run's root at which the second goes on behind the seam
    pair = np.repeat(np.arange(len(p)), p)
    turn = np.arange(len(pair)) - np.repeat(np.cumsum(p) - p, p)
    fits = text.ahead(seam[pair] - p[pair] - turn, seam[pair]) >= p[pair]
    pair, turn = pair[fits], turn[fits]
    most = np.minimum(np.minimum(one[:, 1] - one[:, 0], two[:, 1] - two[:, 0])[pair], 8 * t - 1)
    low = -(-(4 * t - turn) // p[pair])
    count = np.maximum((most - turn) // p[pair] - low + 1, 0)
    which = np.repeat(np.arange(len(pair)), count)
    step = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    q = turn[which] + step * p[pair][which]
    right = seam[pair][which]
    return right - q, right


def all_runs(docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, start, length, period) rows of all runs of at least two periods, by document, start and period; documents are arrays of whole numbers from 0."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    salt = 1
    while True:
        text = Layout([docs[i] for i in order], salt)
        runs = short_periods(text)
        t = DIRECT // 4
        while text.end(8 * t):
            i, j = (np.concatenate(x) for x in zip(context_pairs(text, t, runs), meeting_pairs(text, t, runs)))
            if len(i):
                # most proposals lie in stretches that others have proposed: one per period and first position is enough
                runs = least_periods(np.concatenate([runs, np.unique(text.extend(i, j), axis=0)]))
            t *= 2
        w = text.words
        if all(np.array_equal(w[a : b - q], w[a + q : b]) for a, b, q in runs if q >= DIRECT):
            break
        salt += 1  # two unlike windows had one name
    owner = text.owner[runs[:, 0]]
    out = np.column_stack([np.array(order, dtype=np.int64)[owner], runs[:, 0] - text.starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def planted(words: list, doc_id: int | None) -> list:
    """The words that are searched: every tenth document, by a checksum of its id, repeats a stretch up to its end."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in no run behind its first period."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, runs[:, 1] + runs[:, 3], 1)
    np.add.at(cover, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(cover[:-1]) == 0


def _describe(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    lines = "".join(f"{s},{n},{q}\n" for _, s, n, q in runs.tolist())
    best = (None,) * 4
    if len(runs):
        _, s, n, q = runs[np.lexsort((runs[:, 3], runs[:, 1], -runs[:, 2]))[0]].tolist()
        best = s, n, q, 1000 * n // q
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
    return doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _finder(change: Callable[[list, int | None], list]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def chunk(ids: list, texts: list[list[bytes]]) -> list[tuple]:
        numbers: dict[bytes, int] = {}
        runs = all_runs([np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64) for words in texts])
        runs = runs[runs[:, 2] >= LEAST_LENGTH]
        ends = np.searchsorted(runs[:, 0], np.arange(len(ids) + 1))
        return [_describe(d, w, runs[ends[i] : ends[i + 1]]) for i, (d, w) in enumerate(zip(ids, texts))]

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, texts, size = [], [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = change((text.as_py() or "").encode().split(), doc_id)
            if ids and size + len(words) > CHUNK_WORDS:
                rows += chunk(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
        rows += chunk(ids, texts) if ids else []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return find


def find_runs(docs: DataFrame, change: Callable[[list, int | None], list] = lambda words, doc_id: words) -> DataFrame:
    """Runs of at least twelve words of every document: their number, the longest, digests of all and of the text without their repeats.

    ``change`` maps the words of a document, given its id, to those that are searched.  No rows are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, lambda: _finder(change), SCHEMA)

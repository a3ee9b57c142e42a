"""Token ids in files compressed by a static range asymmetric numeral system (rANS).

A file holds whole documents in ascending id order: a magic word, blocks, a directory and its length.  All files share one
frequency table of the corpus, stored beside them.  A block is independent: its tokens are dealt over interleaved lanes
that take turns, and a checkpoint at every ``SPAN`` tokens keeps the lane states and the place in the word stream, so the
spans of a block are decoded side by side.  Each block has a checksum of its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wattloom.llm.support import OneFile, cut, give_back, map_rows, new_folder, open_store, prepare
from wattloom.llm.tokens import encoder

MAGIC = b"RANS0001"
#: Bits of the scale of all frequencies; the sum over symbols is 2**SCALE_BITS.
SCALE_BITS = 18
LANES = 1024
SPAN = 128 * LANES
BLOCK_TOKENS = 4 * SPAN
FILE_TOKENS = 1 << 22
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def normalise(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each symbol seen."""
    total, scale = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > scale:
        raise ValueError("more symbols than the scale has places")
    freq = np.where(counts > 0, np.maximum(1, counts * scale // total), 0).astype(np.int64)
    excess = int(freq.sum()) - scale
    order = np.argsort(-freq, kind="stable")
    while excess > 0:  # shared among frequent symbols
        for i in order:
            if excess and freq[i] > 1:
                cut_by = min(excess, max(1, int(freq[i]) // 8), int(freq[i]) - 1)
                freq[i] -= cut_by
                excess -= cut_by
    if excess < 0:
        freq[order[0]] -= excess
    return freq


def _starts(freq: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(freq)[:-1]])


def encode_block(ids: np.ndarray, freq: np.ndarray, starts: np.ndarray, bits: int = SCALE_BITS, lanes: int = LANES, span: int = SPAN) -> bytes:
    """One block: header, checkpoints (a place and the lane states for each span), words.

    Lane i holds tokens i, i + lanes, ...; encoding runs backwards, so that decoding runs forwards.
    """
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    span = max(lanes, span // lanes * lanes)
    f_all, c_all = freq[ids].astype(np.uint64), starts[ids].astype(np.uint64)
    state = np.full(lanes, _LOW, np.uint64)
    steps = -(-n // lanes)
    per_span = span // lanes
    words: list[np.ndarray] = []
    points: list[tuple[int, np.ndarray]] = []
    written = 0
    limit_shift = np.uint64(63 - bits)
    shift = np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        lo, hi = t * lanes, min(n, (t + 1) * lanes)
        f, c, x = f_all[lo:hi], c_all[lo:hi], state[: hi - lo]
        big = x >= (f << limit_shift)
        if big.any():
            out = x[big].astype(np.uint32)
            words.append(out)
            written += len(out)
            x = np.where(big, x >> _WORD, x)
        q = x // f
        state[: hi - lo] = (q << shift) + (x - q * f) + c
        if t % per_span == 0:
            points.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = struct.pack("<QIIIQ", n, lanes, span, len(points), len(stream))
    table = b"".join(struct.pack("<Q", written - at) + s.astype("<u8").tobytes() for at, s in reversed(points))
    return head + table + stream.astype("<u4").tobytes()


def decode_block(data: bytes, slots: np.ndarray, freq: np.ndarray, starts: np.ndarray, bits: int = SCALE_BITS, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block, or of its spans ``first`` to ``last`` only; the spans are decoded together."""
    n, lanes, span, n_points, n_words = struct.unpack_from("<QIIIQ", data, 0)
    at = struct.calcsize("<QIIIQ")
    size = 8 + 8 * lanes
    last = n_points if last is None else min(last, n_points)
    places = [struct.unpack_from("<Q", data, at + p * size)[0] for p in range(first, last)]
    states = np.stack([np.frombuffer(data, "<u8", lanes, at + p * size + 8) for p in range(first, last)]).copy() if last > first else np.zeros((0, lanes), np.uint64)
    words = np.frombuffer(data, "<u4", n_words, at + n_points * size).astype(np.uint64)
    rows, per_span = last - first, span // lanes
    out = np.zeros((rows, per_span, lanes), np.int64)
    place = np.array(places, np.int64)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    ends = np.array([min(n, (p + 1) * span) - p * span for p in range(first, last)], np.int64)
    for t in range(per_span):
        active = np.flatnonzero(ends > t * lanes)  # only the last span can end early
        if not len(active):
            break
        x = states[active]
        slot = x & mask
        sym = slots[slot.astype(np.int64)]
        y = freq[sym] * (x >> shift) + slot - starts[sym]
        live = np.arange(lanes)[None, :] < (ends[active] - t * lanes)[:, None]
        low = (y < _LOW) & live
        took = low.sum(1)
        index = place[active][:, None] + np.cumsum(low, 1) - 1
        y[low] = (y[low] << _WORD) | words[index[low]]
        place[active] += took
        states[active] = np.where(live, y, x)
        out[active, t] = sym
    flat = out.reshape(rows, per_span * lanes)
    return np.concatenate([flat[i, : ends[i]] for i in range(rows)]) if rows else np.zeros(0, np.int64)


def _parts(docs: DataFrame, tokenizer: str, end_id: int, file_tokens: int) -> DataFrame:
    """Documents in ascending order as rows that become a file each: (part, seq, docs, lengths, ids)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer, "bytes"), int(end_id).to_bytes(4, "little")
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(b for _, b in held), "<u4")
            kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
            row = [[part], [seq], [[d for d, _ in held]], [[len(b) // 4 for _, b in held]], [np.dtype(kind).itemsize], [ids.astype(kind).tobytes()]]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "docs", "lengths", "width", "ids"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.texts(batch.column(1)), strict=True):
                ids += end
                held.append((doc, ids))
                size += len(ids) // 4
                if size >= file_tokens:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()
        held.clear()
        give_back()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "part int, seq int, docs array<long>, lengths array<long>, width int, ids binary")


def _frequencies(parts: DataFrame) -> np.ndarray:
    """Counts of all ids of the corpus; one row for each id of the vocabulary reaches the driver."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            total = np.zeros(1, np.int64)
            for width, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
            seen = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

        return step

    rows = map_rows(parts.select("width", "ids"), make, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r[0] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r[0]] = r[1]
    return counts


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode all texts and write the files; returns the list of files (name, part, seq, documents, tokens).

    Null text counts as empty.  Documents with equal ids follow each other; a null id comes first.  An empty table writes no
    file.  The list is a written table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = cut(_parts(docs, tokenizer, end_id, file_tokens), "token-parts")
    counts = _frequencies(parts)
    freq = normalise(counts)
    head = OneFile(folder, "frequencies.bin")
    head.write(struct.pack("<II", SCALE_BITS, len(freq)) + freq.astype("<u4").tobytes())
    head.close()

    def make():
        starts = _starts(freq)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for part, seq, doc_ids, lengths, width, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{part:08d}-{seq:06d}.rans"
                all_ids = np.frombuffer(ids, f"<u{width}").astype(np.int64)
                ends = np.cumsum(lengths)
                out = OneFile(folder, name)
                out.write(MAGIC)
                entries, doc, at = [], 0, 0
                while doc < len(lengths):  # a block closes with the document that fills it
                    stop = min(len(lengths), int(np.searchsorted(ends, at + block_tokens)) + 1)
                    own = all_ids[at : ends[stop - 1]]
                    data = encode_block(own, freq, starts)
                    entries.append((out.write(data), len(data), stop - doc, len(own), zlib.crc32(own.astype("<u4").tobytes())))
                    doc, at = stop, int(ends[stop - 1])
                known = np.array([d is not None for d in doc_ids], np.uint8)
                directory = struct.pack("<II", len(entries), len(lengths)) + b"".join(struct.pack("<QQIQI", *e) for e in entries) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.asarray(lengths, "<u8").tobytes()
                out.write(directory + struct.pack("<Q", len(directory)))
                out.close()
                rows.append((name, part, seq, len(lengths), int(ends[-1])))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "part", "seq", "documents", "tokens"])

        return step

    return cut(map_rows(parts, make, "name string, part int, seq int, documents long, tokens long"), "token-files")


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit).

    ``files`` is what ``write_ids`` returned, or any subset of its columns name, part, seq and tokens over whole parts.
    Each file is read by one task, block by block; a wrong checksum stops the read.
    """
    by_part = files.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("part_start", F.sum("all").over(Window.orderBy("part")) - F.col("all")).drop("all")
    within = files.withColumn("before", F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens"))
    starts = within.join(by_part, "part").select("name", (F.col("part_start") + F.col("before")).alias("start"))
    spread = max(1, min(files.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        tables = None
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if tables is None:
                    raw = store.open_input_file(f"{base}/frequencies.bin").readall()
                    bits, n = struct.unpack_from("<II", raw, 0)
                    freq = np.frombuffer(raw, "<u4", n, 8).astype(np.int64)
                    tables = bits, np.repeat(np.arange(n), freq), freq.astype(np.uint64), _starts(freq).astype(np.uint64)
                bits, slots, freq_u, starts_u = tables
                with store.open_input_file(f"{base}/{name}") as source:
                    total = source.size()
                    tail = struct.unpack("<Q", source.read_at(8, total - 8))[0]
                    directory = source.read_at(tail, total - 8 - tail)
                    n_blocks, n_docs = struct.unpack_from("<II", directory, 0)
                    at, size = 8, struct.calcsize("<QQIQI")
                    entries = [struct.unpack_from("<QQIQI", directory, at + i * size) for i in range(n_blocks)]
                    at += n_blocks * size
                    docs = np.frombuffer(directory, "<i8", n_docs, at)
                    known = np.frombuffer(directory, np.uint8, n_docs, at + 8 * n_docs)
                    lengths = np.frombuffer(directory, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
                    doc = 0
                    for offset, length, own_docs, own_tokens, check in entries:
                        ids = decode_block(source.read_at(length, offset), slots, freq_u, starts_u, bits).astype("<u4").tobytes()
                        if len(ids) != 4 * own_tokens or zlib.crc32(ids) != check:
                            raise ValueError(f"{name}: the block at {offset} is damaged")
                        own = lengths[doc : doc + own_docs]
                        ends = np.cumsum(own)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(docs[doc : doc + own_docs], pa.int64(), mask=known[doc : doc + own_docs] == 0),
                                pa.array(start + ends - own, pa.int64()),
                                pa.array(own, pa.int64()),
                                pa.array([ids[4 * (e - n) : 4 * e] for e, n in zip(ends, own, strict=True)], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        start, doc = start + int(ends[-1]), doc + own_docs
        give_back()

    return starts.repartition(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files into a fresh folder of the shared one and read them back."""
    folder = new_folder(docs.sparkSession, "rans")
    return read_ids(write_ids(docs, tokenizer, folder, end_id), folder)

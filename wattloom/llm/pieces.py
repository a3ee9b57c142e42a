"""SentencePiece BPE by a table of the last token of every prefix.

A sequence of tokens is the encoding of its text exactly if each token encodes to itself and each neighbouring pair is
compatible: the two, merged on their own by the model's rules, stay two.  (Until the first merge across a border, merging a
text and merging one of its pairs take the same steps inside the pair.)  So every prefix has one last token: the token that
an automaton finds ending there whose predecessor is the last token of the prefix before it and is compatible with it.  One
pass fills the table, and the ids are read backwards from the end.

The encoding of a text falls apart between characters that no piece holds side by side, as before a space mark that follows
another character.  Such segments are encoded once and remembered by the worker.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattloom.llm.support import map_rows

SPACE = "▁"
#: Segments and pairs remembered by a Python worker; the memories are emptied when full.
SEGMENTS_KEPT = 600_000
PAIRS_KEPT = 1_000_000

_CODECS: dict[str, "PieceCodec"] = {}


def _fields(message: bytes):
    """Number and value of the fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = message[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(message):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, message[i : i + size]
        i += size


class PieceCodec:
    """Encoder and decoder of one model file: BPE with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        top = list(_fields(model.serialized_model_proto()))
        norm = dict(_fields(next(v for k, v in top if k == 3)))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24):
            raise ValueError("only BPE models with byte fallback, identity normaliser and kept spaces are supported")
        self.prefix = SPACE if norm.get(3, 1) else ""
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in range(size)) or any(SPACE in self.names[i].lstrip(SPACE) for i in plain):
            raise ValueError("unused pieces and pieces with an inner space mark are not supported")
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        self.id_of = {self.names[i]: i for i in plain}
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}  # neighbours inside some piece
        self.compatible: dict[tuple[int, int], bool] = {}
        self.foreign: dict[str, int] = {}
        self.text_of = list(self.names)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self.merge(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.out = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else self.names[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            self.out[i] = bytes([b])
        self.is_byte = frozenset(self.byte_ids)
        self.marked = Segments(self, SPACE)
        self.bare = Segments(self, "")

    def merge(self, text: str) -> list[str]:
        """The model's merges on a short text: best score first, the leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            a, b = self.text_of[left], self.text_of[right]
            known = self.merge(a + b) == [a, b]
            if len(self.compatible) >= PAIRS_KEPT:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def token_of(self, char: str) -> int:
        """A number for a character that is no piece."""
        if char not in self.foreign:
            self.foreign[char] = len(self.text_of)
            self.text_of.append(char)
        return self.foreign[char]

    def segment(self, text: str) -> list[int]:
        """Ids of a text that is taken as it stands, by the prefix table."""
        n = len(text)
        last, fits = [-1] * (n + 1), self.fits
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            found[end].append(match)
        compatible = self.compatible
        for end in range(n):
            for length, token in found[end]:
                start = end + 1 - length
                if start == 0:
                    last[end + 1] = token
                    break
                before = last[start]
                known = compatible.get((before, token))
                if known or known is None and fits(before, token):
                    last[end + 1] = token
                    break
            else:
                char = text[end]
                if char in self.id_of:
                    raise AssertionError(f"no token ends at {end}")  # a prefix has one encoding
                last[end + 1] = self.token_of(char)
        ids: list[int] = []
        while n:
            token = last[n]
            if token < len(self.names):
                ids.append(token)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(self.text_of[token].encode()))
            n -= len(self.text_of[token])
        return ids[::-1]

    def encode(self, text: str) -> array:
        """Ids of a whole text without begin and end."""
        ids = array("I")
        if not text:
            return ids
        words = text.split(" ")
        if self.prefix and SPACE not in text and "" not in words:
            ids.frombytes(b"".join(map(self.marked.__getitem__, words)))
            return ids
        whole = self.prefix + text.replace(" ", SPACE)
        for m in re.finditer(f"{SPACE}*[^{SPACE}]+|{SPACE}+", whole):
            ids.frombytes(self.marked[m[0][1:]] if m[0][:1] == SPACE else self.bare[m[0]])
        return ids

    def decode(self, ids) -> str:
        """Text of ids as the library gives it; bytes that are no UTF-8 become U+FFFD each."""
        if self.begin in ids or self.end in ids:  # they end a run of bytes
            text = self._decode_runs(ids)
        else:
            try:
                text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8")
            except UnicodeDecodeError:
                text = self._decode_runs(ids)
        return text[1:] if self.prefix and text.startswith(" ") and self._starts_with_mark(ids) else text

    def _starts_with_mark(self, ids) -> bool:
        for i in ids:
            if i not in (self.begin, self.end):
                return self.names[i].startswith(SPACE)
        return False

    def _decode_runs(self, ids) -> str:
        text, run = [], bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        text.append(bytes(run[at : at + size]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    size = 1
                at += size
            run.clear()

        for i in ids:
            if i in self.is_byte:
                run.extend(self.out[i])
            else:
                close()
                text.append(self.out[i].decode("utf-8"))
        close()
        return "".join(text)


class Segments(dict):
    """Segment without its space mark -> ids as native unsigned 32-bit integers."""

    def __init__(self, codec: PieceCodec, mark: str):
        super().__init__()
        self.codec, self.mark = codec, mark

    def __missing__(self, word: str) -> bytes:
        codec = self.codec
        for at in (word.find("\n"), len(word) - 1):  # no piece, so no merge, covers two characters that no piece joins
            if at > 0 and word[at - 1 : at + 1] not in codec.joined:
                return self[word[:at]] + codec.bare[word[at:]]
        if word[:1] == "\n" and len(word) > 1 and not self.mark and word[:2] not in codec.joined:
            return self["\n"] + self[word[1:]]
        ids = array("I", codec.segment(self.mark + word)).tobytes()
        if len(word) <= 48:
            if len(self) >= SEGMENTS_KEPT:
                self.clear()
            self[word] = ids
        return ids


def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (begin, pieces, end as little-endian unsigned 32-bit), decoded text of each row.

    Null text counts as empty.  Every row gives one row; ids may repeat or be null.
    """

    def make():
        import sys

        assert sys.byteorder == "little" and array("I").itemsize == 4
        c = codec(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = [], []
            for text in batch.column(1).to_pylist():
                own = c.encode(text or "")
                texts.append(c.decode(own))
                ids.append(array("I", [c.begin]).tobytes() + own.tobytes() + array("I", [c.end]).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

        return step

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, ids binary, decoded string")



"""Token ids of whole texts by the tokenizers library, with a bounded memory of the words met before.

Both vocabularies split at ASCII white space before they merge, so the ids of a text are those of its words in a row.
Texts where that does not hold (added tokens, other white space next to ASCII white space) go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wattloom.llm.support import take_memory

#: Words that a Python worker remembers, about; beyond that those used last stay, so memory never grows with the data.
WORDS_KEPT = 400_000

_ENCODERS: dict[tuple[str, str], "Words"] = {}
_OTHER_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_OTHER_SPACE_RE2 = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BYTE_WORDS = re.compile(rb" ?\S+|\s+(?!\S)|\s")
_MARKS = (b"\xcc", b"\xcd")


class Words(dict):
    """UTF-8 word -> little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[bytes, bytes] = {}

    def direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            # a final comma or full stop after an ASCII letter is a token of its own
            if len(word) > 2 and word[-1:] in (b",", b".") and word[-2:-1].isalpha():
                ids = self[word[:-1]] + self[word[-1:]]
            else:
                ids = self.direct(word.decode("utf-8"))
        if len(word) <= 64:
            self[word] = ids
        return ids

    def joined(self, words: list[bytes]) -> bytes:
        """Ids of words in a row."""
        if dict.__len__(self) >= WORDS_KEPT // 4:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, words))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each stretch, one stretch after the other."""
    at = np.arange(size.sum())
    at += np.repeat(begin - (np.cumsum(size) - size), size)
    return at


class Batches(Words):
    """Distinct words of a batch are looked up together, in Arrow and numpy: about 40 bytes a word that is remembered."""

    def __init__(self, path: str):
        super().__init__(path)
        self.marks = np.frombuffer(self.direct(",") + self.direct("."), "<u4")
        #: Words remembered; place and number of their ids, and the batch that used them last.
        self.known = pa.array([], pa.string())
        self.place, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")
        self.batch = 0

    def __len__(self) -> int:
        return super().__len__() + len(self.known)

    def _forget(self) -> None:
        """Keep the half of the words that was used last."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[: WORDS_KEPT // 2])
        self.ids = self.ids.take(_spread(self.place[stay], self.size[stay]))
        self.known, self.size, self.used = self.known.take(pa.array(stay)), self.size[stay], self.used[stay]
        self.place = np.cumsum(self.size) - self.size

    def units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as they are within a text, one after the other, and the number of each; no word holds white space."""
        # a final comma or full stop after an ASCII letter is a token of its own
        stop = pc.match_substring_regex(words, "[A-Za-z][,.]$")
        coded = pc.if_else(stop, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        stems, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.fill_null(pc.index_in(stems, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.batch += 1
        self.used[at[at >= 0]] = self.batch
        left = np.flatnonzero(at < 0)
        new = stems.take(pa.array(left))
        ids, size = self._encoded(new)
        at[left] = len(self.known) + np.arange(len(left))
        store, sizes = np.concatenate([self.ids, ids, self.marks]), np.concatenate([self.size, size])
        places = np.concatenate([self.place, len(self.ids) + np.cumsum(size) - size])
        stopped = stop.to_numpy(zero_copy_only=False)
        mark = np.where(pc.ends_with(words, ".").to_numpy(zero_copy_only=False), 1, 0) + len(store) - len(self.marks)
        # each word is a stretch of ids and a stretch of no or one mark
        begin, n = (np.stack(v, axis=1).ravel() for v in ((places[at[code]], mark), (sizes[at[code]], stopped.astype(np.int64))))
        out = store.take(_spread(begin, n))
        short = pc.binary_length(new).to_numpy(zero_copy_only=False) < 64
        if not short.all():
            ids, new, size = ids.take(_spread((np.cumsum(size) - size)[short], size[short])), new.filter(pa.array(short)), size[short]
        self.known, self.ids = pa.concat_arrays([self.known, new]), np.concatenate([self.ids, ids])
        self.place = np.concatenate([self.place, len(self.ids) - len(ids) + np.cumsum(size) - size])
        self.size, self.used = np.concatenate([self.size, size]), np.concatenate([self.used, np.full(len(size), self.batch)])
        if len(self.known) > WORDS_KEPT:
            self._forget()
        return out, n.reshape(-1, 2).sum(axis=1)


class DroppedSpace(Batches):
    """Vocabulary of lower-cased words whose white space is dropped."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words; those of ASCII letters are encoded as one text, as each ends with a token that ends a word."""
        letters = pc.match_substring_regex(words, "^[A-Za-z]{1,64}$").to_numpy(zero_copy_only=False)
        plain, size = words.filter(pa.array(letters)), np.zeros(len(words), np.int64)
        ids = np.array(self.tokenizer.encode(" ".join(plain.to_pylist()), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(plain):
            letters[:] = False
            ids, ends = ids[:0], ends[:0]
        each = [self.direct(w) for w in words.filter(pa.array(~letters)).to_pylist()]
        size[letters], size[~letters] = np.diff(ends, prepend=0), np.fromiter(map(len, each), np.int64, len(each)) // 4
        # back into the order of the words
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        place = np.zeros(len(words), np.int64)
        place[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([ids, np.frombuffer(b"".join(each), "<u4")]).take(_spread(place, size)), size

    def texts(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a batch, null as empty."""
        if not len(column):
            return []
        strings = pc.fill_null(column.cast(pa.string()), "")
        # ASCII lower case first makes more words equal; not where combining marks could compose differently
        as_is = pc.match_substring_regex(strings, r"[\x{300}-\x{37f}]")
        for added in self.added:
            as_is = pc.or_(as_is, pc.match_substring(strings, added))
        split = pc.ascii_split_whitespace(pc.if_else(as_is, strings, pc.ascii_lower(strings)))
        coded = split.flatten().dictionary_encode()
        ids, size = self.units(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = size[code]
        out = ids.take(_spread((np.cumsum(size) - size)[code], n)).tobytes()
        text_of = np.repeat(np.arange(len(strings)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        stops = (4 * np.cumsum(np.bincount(text_of, n, len(strings)).astype(np.int64))).tolist()
        return [out[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


class ByteLevel(Batches):
    """Byte-level vocabulary, where a word holds the one space before it; the dictionary has only what begins a line."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token: one for each character of its name.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def text(self, text: str) -> bytes:
        if _OTHER_SPACE.search(text) or any(a in text for a in self.added):
            return self.direct(text)
        return self.joined(_BYTE_WORDS.findall(text.encode("utf-8")))

    def _together(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text and how many each piece of so many bytes has; None where a token crosses pieces."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends, read = np.cumsum(lengths), np.cumsum(self.width[ids])
        at = np.searchsorted(read, ends)
        if not len(read) or read[-1] != ends[-1] or (read[at] != ends).any():
            return None
        return ids, np.diff(at + 1, prepend=0)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each get a space before them, and the number of each; all are encoded as one text."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        if (got := self._together(text, pc.binary_length(words).to_numpy().astype(np.int64) + 1)) is not None:
            return got
        each = [self.direct(" " + w) for w in words.to_pylist()]
        return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4

    def bare(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that begin a text or a line; new ones are encoded as the lines of one text."""
        if dict.__len__(self) >= WORDS_KEPT // 4:
            self.older = dict(self)
            self.clear()
        stems = {p[:-1] if p[-1:] in (b",", b".") and p[-2:-1].isalpha() else p for p in set(pieces) if p not in self}
        new = [p for p in stems if p not in self and p not in self.older and len(p) <= 64 and not p[:1].isspace()]
        if new and (got := self._together(b"\n".join([*new, b""]).decode(), np.fromiter(map(len, new), np.int64, len(new)) + 1)):
            raw, ends = got[0].tobytes(), (4 * np.cumsum(got[1])).tolist()
            # the last token of a line is its end
            if (self.width[got[0][np.cumsum(got[1]) - 1]] == 1).all():
                self.update(zip(new, (raw[a : b - 4] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        return list(map(self.__getitem__, pieces))

    def texts(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a batch, null as empty; a word after a single space is looked up once for the batch.

        Where white space follows white space, a piece depends on more than one word: these texts are split one by one.
        """
        if not len(column):
            return []
        strings = pc.fill_null(column.cast(pa.string()), "")
        split = pc.split_pattern(strings, " ")
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(n_words) - n_words
        every = np.arange(len(strings))
        uneven = pc.match_substring_regex(words, r"^$|^[\t-\r]|[\t-\r]$").to_numpy(zero_copy_only=False)
        one_by_one = np.bincount(np.repeat(every, n_words)[uneven[codes]], minlength=len(strings)) > 0
        one_by_one |= pc.match_substring_regex(strings, _OTHER_SPACE_RE2).to_numpy(zero_copy_only=False)
        for added in self.added:
            one_by_one |= pc.match_substring(strings, added).to_numpy(zero_copy_only=False)
        lines = pc.match_substring_regex(words, r"[\t-\r]").to_numpy(zero_copy_only=False)
        by_word = ~np.repeat(one_by_one, n_words)
        after = by_word.copy()
        after[first] = False
        needed = np.zeros(len(words), bool)
        needed[codes[after]] = True
        own, broken, begun = np.flatnonzero(needed & ~lines), np.flatnonzero(needed & lines), np.flatnonzero(~one_by_one)
        pick = lambda at: words.take(pa.array(at)).view(pa.binary()).to_pylist()
        # pieces of words that hold ends of lines, and of first words, which have no space before them
        split_up = [_BYTE_WORDS.findall(b" " + w) for w in pick(broken)] + [_BYTE_WORDS.findall(w) for w in pick(codes[first[begun]])]
        pieces = [p for ps in split_up for p in ps]
        spaced = np.fromiter((len(p) > 1 and p[0] == 32 for p in pieces), bool, len(pieces))
        ids, size = self.units(pa.concat_arrays([words.take(pa.array(own)), pa.array([p[1:] for p in pieces if len(p) > 1 and p[0] == 32], pa.binary()).view(pa.string())]))
        other = self.bare([p for p in pieces if not (len(p) > 1 and p[0] == 32)]) + [self.text(strings[i].as_py()) for i in np.flatnonzero(one_by_one).tolist()]
        # units: own words, spaced pieces, other pieces, whole texts
        store = np.concatenate([ids, np.frombuffer(b"".join(other), "<u4")])
        size = np.concatenate([size, np.fromiter(map(len, other), np.int64, len(other)) // 4])
        place = np.cumsum(size) - size
        unit = np.concatenate([np.zeros(len(pieces), np.int64), np.arange(len(own)), len(own) + len(pieces) + np.arange(one_by_one.sum())])
        unit[: len(pieces)][spaced] = len(own) + np.arange(spaced.sum())
        unit[: len(pieces)][~spaced] = len(own) + spaced.sum() + np.arange((~spaced).sum())
        # stretch of units of each word, and of the first word of each text
        n, begin = np.zeros(len(words) + len(strings), np.int64), np.zeros(len(words) + len(strings), np.int64)
        entry = np.concatenate([broken, len(words) + begun])
        n[entry] = np.fromiter(map(len, split_up), np.int64, len(split_up))
        begin[entry] = np.cumsum(n[entry]) - n[entry]
        for entry, at in ((own, len(pieces)), (len(words) + np.flatnonzero(one_by_one), len(pieces) + len(own))):
            n[entry], begin[entry] = 1, at + np.arange(len(entry))
        codes[first] = len(words) + every
        by_word[first] = True
        codes = codes[by_word]
        took = n[codes]
        units = unit[_spread(begin[codes], took)]
        sizes = size[units]
        out = store.take(_spread(place[units], sizes)).tobytes()
        text_of = np.repeat(np.repeat(every, n_words)[by_word], took)
        stops = (4 * np.cumsum(np.bincount(text_of, sizes, len(strings)).astype(np.int64))).tolist()
        return [out[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def encoder(path: str, kind: str) -> Words:
    """The worker's encoder of a vocabulary file; kind is ``dropped`` or ``bytes``."""
    take_memory("tokens", _ENCODERS.clear)
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = {"dropped": DroppedSpace, "bytes": ByteLevel}[kind](path)
    return _ENCODERS[path, kind]

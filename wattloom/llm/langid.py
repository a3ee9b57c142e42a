"""Language identification: words first, shorter and shorter character n-grams for words not seen.

The model keeps for each language the relative frequency of its words and of the character n-grams of its words.  Only those
above a least relative frequency are kept, so a language has at most 1 / least entries of each kind, however large the
corpus; the counts behind them cover all of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattloom.llm.support import cut, give_back, prepare, take_memory

#: Words and n-grams of a smaller share of their language are unknown to the model.
LEAST_WORD = 1e-5
LEAST_GRAM = 2e-5
GRAMS = (4, 3, 2, 1)
#: Entries of a worker's counter or memory before it is passed on or emptied.
HELD = 300_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def _grams(word: str) -> Iterator[str]:
    marked = f"^{word}$"
    for n in GRAMS:
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


def _counts(schema_names: list[str], rows: Counter) -> pa.RecordBatch:
    keys = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(rows.values()), pa.int64())], schema_names)


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all words of all texts with a language; words are runs of letters in lower case."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("language-counts", give_back)  # workers come from other operators with what these remember
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            out: Counter = Counter()
            for lang, tokens in held.items():
                for token, n in tokens.items():
                    for word in [token] if token.isalpha() else _LETTERS.findall(token):
                        out[lang, word] += n
            held.clear()
            return _counts(["lang", "word", "n"], out)

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(text.lower().split())
                if sum(map(len, held.values())) >= HELD:
                    yield flush()
        if held:
            yield flush()
        give_back()

    counted = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """(lang, gram, n) over the counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("language-counts", give_back)
        held: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for gram in _grams(word):
                    held[lang, gram] += n
                if len(held) >= HELD:
                    yield _counts(["lang", "gram", "n"], held)
                    held.clear()
        if held:
            yield _counts(["lang", "gram", "n"], held)
        held.clear()
        give_back()

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies over the languages, by word and by n-gram."""

    def __init__(self, langs: list[str], words: dict[str, tuple[float, ...]], grams: dict[str, tuple[float, ...]]):
        self.langs, self.words, self.grams = langs, words, grams
        self.nothing = (0.0,) * len(langs)

    def word(self, word: str) -> tuple[float, ...]:
        """A known word's log frequencies; an unseen one has the mean of those of its longest known n-grams."""
        known = self.words.get(word)
        if known is not None:
            return known
        marked, grams = f"^{word}$", self.grams
        for n in GRAMS:
            hits = [g for i in range(len(marked) - n + 1) if (g := grams.get(marked[i : i + n])) is not None]
            if hits:
                return tuple(sum(c) / len(hits) for c in zip(*hits, strict=True))
        return self.nothing

    def vector(self, token: str) -> tuple[float, ...]:
        """Sum over the words of a token."""
        if token.isalpha():
            return self.word(token)
        words = _LETTERS.findall(token)
        if len(words) == 1:
            return self.word(words[0])
        return tuple(map(sum, zip(*map(self.word, words), strict=True))) if words else self.nothing


def _vectors(rows: list[tuple[str, str, int]], langs: list[str], totals: dict[str, int]) -> dict[str, tuple[float, ...]]:
    if not langs:
        return {}
    at = {lang: i for i, lang in enumerate(langs)}
    floor = max(math.log(0.5 / (totals.get(lang, 0) + 1)) for lang in langs)  # absent says the same of a large and a small language
    out: dict[str, list[float]] = {}
    for lang, key, n in rows:
        out.setdefault(key, [floor] * len(langs))[at[lang]] = max(floor, math.log(n / totals[lang]))
    return {key: tuple(v) for key, v in out.items()}


def train(docs: DataFrame, least_word: float = LEAST_WORD, least_gram: float = LEAST_GRAM) -> Model:
    """Learn from the text and lang of all rows that have both; no rows give a model without languages.

    To the driver come the totals by language and at most 1 / least entries of each kind and n-gram length for a language.
    """
    words = cut(count_words(docs), "language-words")

    def kept(counts: DataFrame, key: str, least: float) -> tuple[list, dict[str, int]]:
        totals = {r[0]: int(r[1]) for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
        rule = F.lit(False)
        for lang, total in totals.items():
            rule = rule | ((F.col("lang") == lang) & (F.col("n") >= max(2.0, total * least)))
        return [(r[0], r[1], int(r[2])) for r in counts.filter(rule).select("lang", key, "n").collect()], totals

    word_rows, word_totals = kept(words, "word", least_word)
    gram_rows, gram_totals = kept(cut(count_grams(words), "language-grams"), "gram", least_gram / len(GRAMS))
    langs = sorted(word_totals, key=lambda k: (-word_totals[k], k))
    return Model(langs, _vectors(word_rows, langs, word_totals), _vectors(gram_rows, langs, gram_totals))


def predictor(spark, model: Model):
    """Column function: text -> struct(lang, score).

    Null text and text without a letter give ``und`` with score 0, as does a model without languages.  The score is the
    share of the language in a softmax over the mean evidence of the words, so it lies between 0 and 1; of equal languages
    the one with more training words wins.
    """
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the least frequencies

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        own = sent.value
        take_memory("langid", lambda: own.__dict__.pop("rows", None))
        if not hasattr(own, "rows"):
            own.rows, own.index = np.zeros((1024, max(1, len(own.langs)))), {}
        langs, scores = [], []
        for text in texts.to_pylist():
            if text is None or not own.langs or not _LETTERS.search(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            if len(own.index) > HELD:
                own.index = {}
            index = own.index
            tokens = text.lower().split()
            for token in set(tokens).difference(index):
                if len(index) >= len(own.rows):
                    own.rows = np.concatenate([own.rows, np.zeros_like(own.rows)])
                own.rows[len(index)] = own.vector(token)
                index[token] = len(index)
            total = own.rows[list(map(index.__getitem__, tokens))].sum(0)
            best = int(np.argmax(total))
            langs.append(own.langs[best])
            scores.append(float(1 / np.exp((total - total[best]) / max(1, len(tokens)) ** 0.5).sum()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, text, lang, held_out, lang_pred and score of all rows; learns from the rows whose id is not held out.

    A row with a null id is neither learned from nor held out.  Rows that share an id stay rows of their own.
    """
    docs = docs.select("doc_id", "text", "lang")
    rest = remainder("doc_id", folds)
    model = train(docs.filter(rest != held))
    found = docs.withColumn("_found", predictor(docs.sparkSession, model)("text"))
    return found.withColumn("held_out", F.coalesce(rest == held, F.lit(False))).withColumn("lang_pred", F.col("_found.lang")).withColumn("score", F.col("_found.score")).drop("_found")

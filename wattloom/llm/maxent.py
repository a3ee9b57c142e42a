"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Words are predicted down a tree of classes: a softmax over the children of each node on the way, over sums of weight rows that
hashed features of the history pick (the last word, the last two, and two features that skip words; a history is made of the
hashes of its own words, frequent or not).  The leaves are the frequent words, the end, and hash buckets of the other words,
within which a word has its smoothed relative frequency.  The tree is the 16-ary Huffman tree of the counts.  Weights start
from the corpus frequencies and follow gradients that Spark sums in rounds: the training texts are dealt to the rounds by hash,
so that each of them gives its gradient once in a fit, at the weights that the rounds before have left.  A task adds up its
texts, then blocks of rows are added up by key.

Words above a least relative frequency (at most 1 / LEAST of them) are looked up by the task that reads a text; what is left
of a text's words meets the count table in a join.  The number of weight rows follows the counted tokens up to ROWS_MOST, which
bounds a worker's memory; beyond that more features share a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wattloom.llm.langid import remainder
from wattloom.llm.support import cut, give_back, prepare

#: Children of a node of the tree.
CLASS = 16
LEAST = 5e-7
HELD = 300_000
#: Words of a hash bucket, about, and the most buckets.
BUCKET = 256
BUCKETS_MOST = 1 << 16
#: Counted tokens for each row of the hashed weights, and least and most rows.
TOKENS_A_ROW = 160
ROWS_LEAST = 1 << 14
ROWS_MOST = 1 << 20
#: Rows of a block of gradients.
BLOCK = 1024
#: Rounds of gradients and step.
ROUNDS = 4
STEP = 0.1
CHUNK = 8192
END = b"\n"  # no word holds white space

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_ONES = np.ones(CLASS, np.float32)
#: Two weights as one number to add, and a row as one value to copy.
_PAIR = np.complex64
_ROW = np.dtype((np.void, 4 * CLASS))
#: Seed of Spark's xxhash64.
SEED = 42


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, END last; the place of each token among them, and the number of tokens of each text.

    Words are in ASCII lower case, split at ASCII white space; a null text has no word, and an end follows each text.
    """
    texts = pc.fill_null(texts.cast(pa.binary()).view(pa.string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    none = pc.index(distinct, "").as_py()  # what white space at either side of a text leaves
    if none >= 0:
        text, codes = text[codes != none], codes[codes != none]
    lengths = np.bincount(text, minlength=len(texts)) + 1
    out = np.full(len(codes) + len(texts), len(distinct), np.int64)
    out[np.arange(len(codes)) + text] = codes
    return pa.concat_arrays([distinct.view(pa.binary()), pa.array([END], pa.binary())]), out, lengths


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, n) over all words and ends of the texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            distinct, codes, _ = words_of(batch.column(0))
            n = np.bincount(codes, minlength=len(distinct))
            held.append(pa.table({"word": distinct, "n": pa.array(n, pa.int64())}).filter(pa.array(n > 0)))
            if sum(map(len, held)) >= HELD:
                held = [summed()]
                if 2 * len(held[0]) >= HELD:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from summed().to_batches()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hash64(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """Hash bucket of each word, as Spark's xxhash64 gives it; ``buckets`` is a power of two."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, SEED) & (buckets - 1) for w in words], np.int64)


def _tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman tree of leaves: first step of each leaf (and the end), node and child of each step, log share of each child."""
    n = len(mass)
    pad = (-(n - 1)) % (CLASS - 1) if n > 1 else CLASS - 1
    order = np.concatenate([np.full(pad, -1, np.int64), np.argsort(mass, kind="stable")])
    weight = np.where(order < 0, 0.0, mass[order]).tolist()
    merges = (len(order) - 1) // (CLASS - 1)
    sums: list[float] = []
    leaf_node, leaf_child, node_node, node_child = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(merges, -1, np.int64), np.zeros(merges, np.int64)
    share = np.full((merges, CLASS), -np.inf)
    at, inner = 0, 0
    for node in range(merges):
        total = 0.0
        for child in range(CLASS):
            if inner >= len(sums) or (at < len(weight) and weight[at] <= sums[inner]):
                if order[at] >= 0:
                    leaf_node[order[at]], leaf_child[order[at]], share[node, child] = node, child, weight[at]
                total += weight[at]
                at += 1
            else:
                node_node[inner], node_child[inner], share[node, child] = node, child, sums[inner]
                total += sums[inner]
                inner += 1
        sums.append(total)
    leaf, node, child = np.arange(n), leaf_node, leaf_child
    steps = []
    while len(leaf):
        steps.append((leaf, node, child))
        up = node_node[node] >= 0
        leaf, node, child = leaf[up], node_node[node[up]], node_child[node[up]]
    leaf, node, child = (np.concatenate(v) for v in zip(*steps, strict=True))
    by = np.argsort(leaf, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))])
    share = np.where(np.isfinite(share), np.log(np.maximum(share, 1e-30) / np.array(sums)[:, None]), -1e30)
    return first, node[by].astype(np.int32), child[by].astype(np.int8), share.astype(np.float32)


def _add_rows(to: np.ndarray, row: np.ndarray, g: np.ndarray) -> None:
    """Add to rows of which each is named once; ``g`` is written over."""
    g += to.take(row, axis=0)
    to.view(_ROW)[row] = g.view(_ROW)


class Model:
    """Vocabulary, counts of frequent words, tree and weights; bounded by the parameters above.

    ``masses`` and ``sizes`` are the counts and the distinct words of each bucket of words outside the vocabulary.
    """

    def __init__(self, vocabulary: list[bytes], frequent: list[bytes], counts: list[int], total: int, distinct: int, masses: np.ndarray, sizes: np.ndarray):
        hashes = _hash64(frequent) if frequent else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.logs = np.concatenate([np.log10(np.asarray(counts, float) + 1)[order] if frequent else np.zeros(0), [0.0]])
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        self.rare, self.buckets = len(vocabulary), len(masses)
        #: Leaf of each frequent word; of others -1.
        self.leaf_at = np.array([self.vocabulary.get(w, -1) for w in frequent] + [-1], np.int64)[np.concatenate([order, [len(frequent)]])]
        self.total, self.distinct = total, distinct
        self.bucket_scale = np.log10(masses + sizes + 1.0)
        at = dict(zip(frequent, counts, strict=True))
        mass = np.concatenate([np.array([at[w] for w in vocabulary], float), np.maximum(masses, 1.0)])
        self.first, self.node, self.child, self.bias = _tree(mass)
        #: What a step adds to the hash of a history.
        self.mark = (self.node.astype(np.uint64) + np.uint64(1)) * _Q
        #: Hashes that stand for leaves where only these are given.
        self.leaf_hash = np.concatenate([_hash64(vocabulary) if vocabulary else np.zeros(0, np.uint64), (np.arange(self.buckets).astype(np.uint64) + np.uint64(2)) * _Q])
        self.rows = min(ROWS_MOST, max(ROWS_LEAST, total // TOKENS_A_ROW)) // BLOCK * BLOCK
        self.weights = np.zeros((self.rows, CLASS), np.float32)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, place in the counts and hash of each word; a word that is not frequent has the last place."""
        h = _hash64(words)
        order = np.argsort(h)  # sorted words are found in the cache
        place = np.empty(len(h), np.int64)
        place[order] = np.searchsorted(self.keys, h[order])
        if len(self.keys):
            near = np.minimum(place, len(self.keys) - 1)
            place = np.where(self.keys[near] == h, near, len(self.keys))
        leaf = self.leaf_at[place]
        out = np.flatnonzero(leaf < 0)
        leaf[out] = self.rare + _buckets([words[i] for i in out.tolist()], self.buckets)
        return leaf, place, h

    def histories(self, hashes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Tokens in chunks, with the hashed history of each in one row for each feature; histories do not cross texts."""
        start = np.repeat(np.cumsum(lengths) - lengths, lengths)
        for lo in range(0, len(hashes), CHUNK):
            hi = min(len(hashes), lo + CHUNK)
            at = np.arange(lo, hi) - start[lo:hi]
            back = []
            for k in (1, 2, 3):
                own = np.ones(hi - lo, np.uint64)
                own[max(0, k - lo) :] = hashes[max(0, lo - k) : max(0, hi - k)]
                own[at < k] = 1
                back.append(own)
            raw = [back[0], back[0] * _Q + back[1], back[1], back[0] * _Q + back[2]]
            mixed = [(h ^ (h >> _HALF)) * _P + np.uint64(k << 60) for k, h in enumerate(raw, 1)]
            yield slice(lo, hi), np.stack([h ^ (h >> _HALF) for h in mixed])

    def steps(self, ids: np.ndarray, h: np.ndarray, blank: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First step of each token, children taken, weight rows of each step by feature, and logits of its children.

        ``blank``: all weights are zero, and none is read.
        """
        begin = self.first.take(ids)
        n = self.first.take(ids + 1) - begin
        end = np.cumsum(n)
        first = end - n
        at = np.arange(end[-1]) + np.repeat(begin - first, n)
        x = h.take(np.repeat(np.arange(len(ids)), n), axis=1)
        x ^= self.mark.take(at)
        x *= _P
        x >>= _HALF
        x *= np.uint64(self.rows)
        x >>= _HALF
        rows = x.view(np.int64)
        logits = self.bias.take(self.node.take(at), axis=0)
        picked = np.empty_like(logits)
        for r in () if blank else rows:
            self.weights.take(r, axis=0, out=picked, mode="clip")
            logits += picked
        return first, self.child.take(at).astype(np.int64), rows, logits

    def log10(self, ids: np.ndarray, lengths: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each token; of a word outside the vocabulary that of its bucket."""
        out = np.zeros(len(ids))
        for own, h in self.histories(self.leaf_hash[ids] if hashes is None else hashes, lengths):
            first, child, _, logits = self.steps(ids[own], h)
            got = logits.reshape(-1).take(np.arange(len(child)) * CLASS + child)
            # a weight is at most STEP a round, so sums of exponents stay far from the ends of a float
            np.exp(logits, out=logits)
            out[own] = np.add.reduceat(got - np.log(logits @ _ONES), first, dtype=np.float64)
        return out / np.log(10)

    def add_gradient(self, to: np.ndarray, ids: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, blank: bool = False) -> None:
        """Add the gradient of the log probability by the weights, summed over tokens."""
        last = np.empty(self.rows, np.int32)
        for own, h in self.histories(hashes, lengths):
            _, child, rows, p = self.steps(ids[own], h, blank)
            n = len(p)
            np.exp(p, out=p)
            p *= (-1 / (p @ _ONES))[:, None]
            p.reshape(-1)[np.arange(n) * CLASS + child] += 1
            # one entry of each row is written as it is; the others of a row are added up first, so that a row is written twice at most
            row, step = rows.ravel(), np.tile(np.arange(n), len(rows))
            entry = np.arange(len(row), dtype=np.int32)
            last[row] = entry
            alone = last.take(row) == entry
            once = np.flatnonzero(alone)
            _add_rows(to, row.take(once), p.take(step.take(once), axis=0))
            if len(rest := np.flatnonzero(~alone)):
                order = np.sort(row.take(rest).view(np.uint64) << _HALF | step.take(rest).view(np.uint64))
                row, step = (order >> _HALF).view(np.int64), (order & _LOW).view(np.int64)
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                g = np.add.reduceat(p.view(_PAIR).take(step, axis=0), start, axis=0)
                _add_rows(to, row.take(start), g.view(np.float32))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vocabulary": {}}


def _batch_ids(model: Model, texts: list[bytes | None] | pa.Array) -> tuple[tuple[pa.Array, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and places of the tokens among them, tokens of each text; leaf, place in the counts and hash of each token."""
    distinct, codes, lengths = words_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
    return (distinct, codes), lengths, *(v.take(codes) for v in model.look_up(distinct.to_numpy(zero_copy_only=False).tolist()))


def train(docs: DataFrame, vocabulary: int | None = None, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the written table (word, n) of all counts; ``vocabulary`` bounds the words with leaves of their own.

    Each round takes the texts whose hash falls to it; over the rounds every text is taken once.
    """
    spark = docs.sparkSession
    counts = cut(count_tokens(docs), "lm-counts")
    total, distinct = (int(v or 0) for v in counts.agg(F.sum("n"), F.count("*")).first())
    frequent = counts.filter(F.col("n") >= max(2.0, total * LEAST)).orderBy(F.desc("n"), "word").collect() if total else []
    words, n = [bytes(r[0]) for r in frequent], [int(r[1]) for r in frequent]
    rank = {w: i for i, w in enumerate(words)}
    chosen = sorted([w for w in words if w != END][: None if vocabulary is None else vocabulary - 1] + [END] * (END in rank), key=rank.__getitem__)
    buckets = 1
    while buckets < BUCKETS_MOST and buckets * BUCKET < distinct - len(chosen):
        buckets *= 2
    masses, sizes = np.zeros(buckets), np.zeros(buckets)
    for b, m, k in counts.groupBy(F.xxhash64("word").bitwiseAND(F.lit(buckets - 1).cast("long")).alias("b")).agg(F.sum("n"), F.count("*")).collect():
        masses[b], sizes[b] = m, k
    if chosen:
        own = _buckets(chosen, buckets)
        np.subtract.at(masses, own, np.array([n[rank[w]] for w in chosen], float))
        np.subtract.at(sizes, own, 1.0)
    model = Model(chosen, words, n, total, distinct, masses, sizes)
    del frequent, words, n, rank, chosen
    give_back()
    squares = np.ones_like(model.weights)  # gradients are counts of tokens: what is seen once moves less
    # one task for each core: what leaves a task is as large as the weights, however many texts it read
    cores = max(1, spark.sparkContext.defaultParallelism)
    # by all columns: copies of a text under other ids fall to other rounds
    dealt = F.pmod(F.xxhash64(*docs.columns), F.lit(max(1, rounds)))
    for at_round in range(rounds if total else 0):
        texts = docs.filter(dealt == at_round).select("text").coalesce(cores)
        sent, blank = spark.sparkContext.broadcast(model), not model.weights.any()

        def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, tokens = sent.value, 0
            g = np.zeros_like(own.weights)
            for batch in batches:
                _, lengths, ids, _, hashes = _batch_ids(own, batch.column(0))
                own.add_gradient(g, ids, lengths, hashes, blank)
                tokens += len(ids)
            for at in range(0, len(g) if tokens else 0, BLOCK):
                if (part := g[at : at + BLOCK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["at", "g"])

        def add_up(rows: pa.Table) -> pa.Table:
            g = np.zeros(BLOCK * CLASS)
            for b in rows["g"]:
                g += np.frombuffer(b.as_buffer(), np.float32)
            return pa.table({"at": rows["at"][:1], "g": pa.array([g.astype(np.float32).tobytes()], pa.binary())})

        kind = "at int, g binary"
        # through a table, so that the driver holds the weights and one part of the sums, never all blocks of two rounds
        summed = cut(texts.mapInArrow(gradients, kind).groupBy("at").applyInArrow(add_up, kind), "lm-gradients")
        sent.destroy()
        for at, b in summed.toLocalIterator():
            g, s = np.frombuffer(b, np.float32).reshape(BLOCK, CLASS), squares[at : at + BLOCK]
            s += g * g
            model.weights[at : at + BLOCK] += np.float32(STEP) * g / np.sqrt(s)
        give_back()
    return model, counts


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Learns from the rows whose id is not held out.  Null and empty texts have one token, the end.  A row with a null id is
    neither learned from nor held out.  Without training rows all base scores are 0.
    """
    spark = docs.sparkSession
    rest = remainder("doc_id", folds)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, counts = train(docs.filter(rest != held))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = sent.value, TaskContext.get().partitionId() << 32
        names = ["row", "doc_id", "n_tokens", "n_known", "logs", "model_log", "word", "times"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())
        for batch in batches:
            (distinct, codes), lengths, ids, place, hashes = _batch_ids(own, batch.column(1))
            first = np.cumsum(lengths) - lengths
            total = lambda v: np.add.reduceat(v, first)
            logs, known = own.logs[place], place < len(own.keys)
            rare = ids >= own.rare
            model_log = own.log10(ids, lengths, hashes)
            model_log[rare] += logs[rare] - own.bucket_scale[ids[rare] - own.rare]
            n = len(lengths)
            rows = np.arange(row, row + n)
            row += n
            main = [rows, batch.column(0), lengths, total(known.astype(np.int64)), total(logs), total(model_log), None, None]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, k) if v is None else pa.array(v, k) if isinstance(v, np.ndarray) else v for v, k in zip(main, kinds, strict=True)], names)
            if not known.all():
                text = np.repeat(np.arange(n), lengths)[~known]
                pair, times = np.unique(text * len(distinct) + codes[~known], return_counts=True)
                m = len(pair)
                side = [pa.array(rows[pair // len(distinct)], pa.int64()), *(pa.nulls(m, k) for k in kinds[1:6]), distinct.take(pa.array(pair % len(distinct))), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(side, names)

    parts = docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, logs double, model_log double, word binary, times long")
    parts = cut(parts, "lm-parts")
    # words that are not frequent: their counts come by a join, and an absent word adds log10(0 + 1) = 0 and no known token
    # a partition of the counts has each of its words once and is small: it is hashed, and the words of the texts are not sorted
    rare = parts.filter("word is not null").select("row", "word", "times").join(counts.filter(F.col("n") < max(2.0, model.total * LEAST)).hint("shuffle_hash"), "word")
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.col("times").alias("n_known"), (F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"), (F.col("times") * F.log10(F.col("n") + 1.0)).alias("model_log"))
    sums = parts.filter("word is null").drop("word", "times").unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "model_log")))
    scale = float(np.log10(model.total + model.distinct + 1))
    return sums.select(
        "doc_id",
        F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * scale).alias("base_score"),
        F.col("model_log").alias("score"),
    )

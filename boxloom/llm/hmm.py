"""Language model: a hidden Markov model over word classes, trained by Baum-Welch on the whole corpus.

A word belongs to the class ``crc32(word) mod CLASSES``.  A latent state s emits a class, and a class
one of its words, so P(word | s) = P(class | s) * P(word | class): states are learned per class, whose
table has a fixed size and is broadcast, while P(word | class) comes from the counts of all words, which
stay in tables and grow with the corpus.  The end of a text is a token in a class of its own.

* Blocks: each task turns its texts into blocks of about ``BLOCK`` tokens: the block's distinct words and,
  for each document, positions in that list.  So words meet their counts once for each block, not once
  for each token, and no step shuffles a text.
* E step: each task sums the expected counts of its blocks; Spark sums those of the tasks.
* M step: on the driver, over ``STATES * (CLASSES + 1)`` numbers, however large the corpus.
* Scoring: scaled forward recursion over every whole text.

Unseen words: each class holds, besides its words, one unseen word with the count (n1 + 1) / CLASSES,
where n1 is the number of words seen once.  So the words of all classes, with one unseen word each, share
probability one in every state.

Long texts are cut into segments.  A segment's transfer matrix says how it maps the
distribution before it to that behind it; products of these matrices give the exact distributions at every
cut, so that segments of one text are worked on side by side and memory does not grow with the text.

Null and empty texts have one token, the end.  Rows whose id is null are never held out.  Repeated
rows are documents of their own.  An empty table gives an empty result; with no training rows all
words are unseen and the model stays as it began.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, text_or_empty

#: Word classes; those of words are numbered from 0, the end of a text is class number CLASSES.
CLASSES = 1 << 16
#: Latent states, rounds of Baum-Welch, and the weight of the corpus-wide distribution in a state's.
STATES, ROUNDS, PRIOR = 6, 4, 500.0
#: Tokens of a block, of a segment (at least), and of the segments that are worked on together.
BLOCK, SEGMENT, GROUP = 1 << 20, 512, 1 << 19
#: So many texts at least go on side by side without being cut.
WIDE = 48


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---- the model in one task: numpy over many sequences side by side


class Model:
    """start (K), move (K, K), emit (CLASSES + 1, K): rows of ``move`` and columns of ``emit`` sum to one."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def first_model(share: np.ndarray, states: int) -> Model:
    """States that stay as they are nine times in ten and differ a little in the classes they prefer."""
    tilt = 0.5 + np.random.default_rng(1).random((len(share), states))
    emit = share[:, None] * tilt
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return Model(np.full(states, 1 / states), move if states > 1 else np.ones((1, 1)), emit / emit.sum(0))


def next_model(starts: np.ndarray, moves: np.ndarray, counts: np.ndarray, share: np.ndarray, unseen: float, total: float) -> Model:
    """The M step.  ``counts`` (CLASSES + 1, K) are expected; every class of words also gets its unseen word's part."""
    mass = counts.sum(0)
    emit = counts + PRIOR * share[:, None]
    emit[:-1] += mass * (unseen / max(total, 1.0))
    return Model((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emit / emit.sum(0))


class Steps:
    """Segments side by side, longest first: their tokens step by step, all first tokens before all second ones.

    ``rows[t]`` is where step t begins; in each step, segments stand in the same order, those that ended left out.
    """

    def __init__(self, model: Model, codes: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        self.rows = np.append(0, np.cumsum(self.active))
        self.column = np.arange(self.rows[-1]) - np.repeat(self.rows[:-1], self.active)
        self.code = codes[start[self.column] + np.repeat(np.arange(length[0]), self.active)]
        self.emit = model.emit[self.code]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of the values of each segment's tokens."""
        return np.bincount(self.column, values)


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and number within its sequence of every segment; sequences lie end to end.

    Only texts so long that fewer than WIDE are as long are cut: the others keep every step busy.
    """
    most = max(SEGMENT, int(np.partition(lengths, -WIDE)[-WIDE])) if len(lengths) >= WIDE else SEGMENT
    pieces = np.where(lengths > most, -(-lengths // SEGMENT), 1)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(lengths) - lengths, pieces) + number * SEGMENT
    return start, np.minimum(np.repeat(lengths, pieces) - number * SEGMENT, np.where(np.repeat(pieces, pieces) > 1, SEGMENT, most)), number


def groups(length: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Segments, longest first, in groups of about ``most`` tokens."""
    order = np.argsort(-length, kind="stable")
    part = np.cumsum(length[order]) // most
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []


def forward(model: Model, steps: Steps, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion: distributions over states and scales, by token.

    ``before`` holds the distribution over states of each segment's first token, before that token is seen.
    """
    seen, scales, ones = np.empty_like(steps.emit), np.empty(len(steps.emit), steps.emit.dtype), np.ones(len(model.start), steps.emit.dtype)
    for t, n in enumerate(steps.active):
        at = slice(steps.rows[t], steps.rows[t] + n)
        now = seen[at]
        if t:
            np.matmul(seen[steps.rows[t - 1] : steps.rows[t - 1] + n], model.move, out=now)
        else:
            now[:] = before
        now *= steps.emit[at]
        np.matmul(now, ones, out=scales[at])
        now /= scales[at][:, None]
    return seen, scales


def backward(model: Model, steps: Steps, scales: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled backward recursion: by token, the weights of states, and those of the next token's states times what these emit.

    ``last`` has a row for each segment: the weights at its last token.
    """
    weights, ahead = np.empty_like(steps.emit), steps.emit / scales[:, None]
    back = np.ascontiguousarray(model.move.T)
    weights[steps.rows[-2] :] = last[: steps.active[-1]]
    for t in range(len(steps.active) - 1, 0, -1):
        n, low = steps.active[t], steps.rows[t - 1]
        at = slice(steps.rows[t], steps.rows[t] + n)
        ahead[at] *= weights[at]
        np.matmul(ahead[at], back, out=weights[low : low + n])
        weights[low + n : steps.rows[t]] = last[n : steps.active[t - 1]]
    return weights, ahead


def transfers(model: Model, codes: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the segments ``which``: (n, K, K) matrices, from the first token's states to those of the token behind, and their log scales."""
    k = len(model.start)
    out, log = np.empty((len(which), k, k), model.emit.dtype), np.empty(len(which))
    for g in groups(length[which], max(GROUP // k, 1)):
        steps = Steps(model, codes, start[which[g]], length[which[g]])
        now, scales = np.repeat(np.eye(k, dtype=model.emit.dtype)[None], len(g), 0), np.empty(len(steps.emit))
        for t, n in enumerate(steps.active):
            out[g[n : len(now)]] = now[n:]
            at = slice(steps.rows[t], steps.rows[t] + n)
            now = now[:n] * steps.emit[at][:, None, :]
            scales[at] = now.reshape(n, -1) @ np.ones(k * k, now.dtype)
            now = (now.reshape(n * k, k) @ model.move).reshape(n, k, k)
            now /= scales[at].astype(now.dtype)[:, None, None]
        out[g[: len(now)]] = now
        log[g] = steps.sums(np.log(scales))
    return out, log


def chained(model: Model, matrices: np.ndarray, logs: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the segments of long texts: the distribution before each, the likelihood of what follows each, log likelihoods.

    All three have a row for each segment; the last holds the text's value at its last segment.
    """
    k = len(model.start)
    before, after = np.empty((len(number), k)), np.ones((len(number), k))
    log = np.zeros(len(number))
    now, rows = None, np.flatnonzero(number == 0)
    while len(rows):
        before[rows] = model.start if now is None else now
        now = np.einsum("nk,nkj->nj", before[rows], matrices[rows])
        scale = now.sum(1)
        now /= scale[:, None]
        log[rows] += np.log(scale) + logs[rows]
        more = (rows + 1 < len(number)) & (number[np.minimum(rows + 1, len(number) - 1)] > 0)
        log[rows[more] + 1] = log[rows[more]]
        rows, now = rows[more] + 1, now[more]
    last = np.append(number[1:] == 0, True)
    rows = np.flatnonzero(last)
    while len(rows := rows[number[rows] > 0]):
        value = np.einsum("nkj,nj->nk", matrices[rows], after[rows])
        rows = rows - 1
        after[rows] = value / value.sum(1, keepdims=True)
    return before, after, log


def log_likelihoods(model: Model, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithm of each sequence's probability."""
    start, length, number = segments(lengths)
    first = np.flatnonzero(number == 0)
    single = np.append(number[1:] == 0, True)[first]
    found = np.empty(len(lengths))
    short, docs = first[single], np.flatnonzero(single)
    for g in groups(length[short], GROUP):
        steps = Steps(model, codes, start[short[g]], length[short[g]])
        found[docs[g]] = steps.sums(np.log(forward(model, steps, np.broadcast_to(model.start, (len(g), len(model.start))))[1]))
    pieces = np.diff(np.append(first, len(number)))
    long = np.flatnonzero(np.repeat(pieces > 1, pieces))
    if len(long):
        log = chained(model, *transfers(model, codes, start, length, long), number[long])[2]
        found[~single] = log[np.append(number[long][1:] == 0, True)]
    return found


def expected_counts(model: Model, codes: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The E step: adds to ``counts`` (CLASSES + 1, K) and returns the expected starts and moves."""
    k = len(model.start)
    start, length, number = segments(lengths)
    before, after = np.empty((len(start), k)), np.ones((len(start), k))
    before[number == 0] = model.start
    first = np.flatnonzero(number == 0)
    pieces = np.diff(np.append(first, len(number)))
    long = np.flatnonzero(np.repeat(pieces > 1, pieces))
    cut = np.zeros(len(start), bool)  # segments that another of the same text follows
    if len(long):
        before[long], after[long], _ = chained(model, *transfers(model, codes, start, length, long), number[long])
        cut[long] = np.append(number[long][1:] > 0, False)
    starts, moves = np.zeros(k), np.zeros((k, k))
    for g in groups(length, GROUP):
        steps = Steps(model, codes, start[g], length[g])
        seen, scales = forward(model, steps, before[g].astype(model.emit.dtype))
        # a segment ends with weight one, or with what the next one says, scaled to the distribution there
        last, rows = np.ones((len(g), k)), np.flatnonzero(cut[g])
        if len(rows):
            here = seen[steps.rows[length[g][rows] - 1] + rows]
            tail = after[g][rows]
            value = tail @ model.move.T
            norm = (here * value).sum(1, keepdims=True)
            last[rows] = value / norm
            moves += here.T @ (tail / norm)
        weights, ahead = backward(model, steps, scales, last.astype(model.emit.dtype))
        # the token before row r of step t stands in row r of step t - 1
        inner = np.arange(steps.rows[1], steps.rows[-1])
        moves += seen[inner - np.repeat(steps.active[:-1], steps.active[1:])].T @ ahead[steps.rows[1] :]
        seen *= weights
        starts += seen[: steps.rows[1]][number[g] == 0].sum(0)
        for j in range(k):
            counts[:, j] += np.bincount(steps.code, seen[:, j], minlength=len(counts))
    return starts, moves * model.move


# ---- blocks


_BLOCK = "block bigint, ids array<string>, held array<boolean>, lengths array<int>, words array<binary>, trained array<bigint>, classes binary, tokens binary"
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_TYPES = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    import zstandard

    number = count(TaskContext.get().partitionId() << 33)
    rows: list[tuple] = []
    size = 0

    def block() -> pa.RecordBatch:
        numbers: dict = defaultdict(count().__next__)
        tokens = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for _, _, words in rows]
        trained = np.zeros(len(numbers), np.int64)
        if learn := [t for t, (_, held, _) in zip(tokens, rows) if not held]:
            trained += np.bincount(np.concatenate(learn), minlength=len(numbers))
        classes = np.fromiter((zlib.crc32(w) % CLASSES for w in numbers), np.int32, len(numbers))
        packed = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in (classes, np.concatenate([*tokens, np.empty(0, np.int32)]))]
        cells = [next(number), [i for i, _, _ in rows], [h for _, h, _ in rows], [len(w) for _, _, w in rows], list(numbers), trained, *packed]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, _TYPES)], names=_NAMES)

    for batch in batches:
        for i, held, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode().lower().split()
            rows.append((i, held, words))
            size += len(words)
            if size >= BLOCK or len(rows) >= BLOCK // 16:
                yield block()
                rows, size = [], 0
    if rows:
        yield block()


def _opened(tokens: bytes, lengths: list[int], classes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the word list, document by document; lengths; classes of the words; codes with the ends."""
    import zstandard

    at, of = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int32) for x in (tokens, classes))
    n = np.array(lengths, np.int64)
    codes = np.full(len(at) + len(n), CLASSES, np.int32)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(n + 1) - 1] = False
    codes[inside] = of[at]
    return at, n, of, codes


# ---- training and scoring


class Trained:
    """The model, the counts of all words in the blocks (table: block, at, n) and what follows from them.

    ``size`` has the tokens of each class, ``total`` all tokens, ``distinct`` the different ones, ``unseen`` an unseen word's count.
    """

    def __init__(self, model: Model, counted: DataFrame, size: np.ndarray, total: int, distinct: int, unseen: float):
        self.model, self.counted, self.size, self.total, self.distinct, self.unseen = model, counted, size, total, distinct, unseen


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """Blocks of documents (ids as strings), those to learn from and those to score only, written to the shared folder.

    Where the input comes in fewer parts than there are cores, the blocks are dealt out, for later steps take longer than this.
    """
    held = held_out(id_col) if held is None else held
    blocks = docs.select(F.col(id_col).cast("string"), held, text_or_empty(text_col)).mapInArrow(_blocks, _BLOCK)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return stored(blocks.repartition(cores) if blocks.rdd.getNumPartitions() < cores else blocks)


def train(blocks: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Trained:
    spark = blocks.sparkSession
    # each word's count in all blocks, at every block that has it; a word's first block stands for the word
    occurrences = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.trained").alias("own"))
    whole = Window.partitionBy("word")
    counted = occurrences.select("block", "at", F.sum("own").over(whole).alias("n"), (F.row_number().over(whole.orderBy("block")) == 1).alias("first"), (F.crc32("word") % CLASSES).cast("int").alias("class"))
    counted = stored(counted.where("n > 0"))
    by_class = counted.where("first").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).collect()
    size = np.zeros(CLASSES + 1)
    for r in by_class:
        size[r["class"]] = r.n
    ends, number = blocks.select(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)), F.count("*")).first()
    words, distinct, once = (sum(r[k] for r in by_class) for k in ("n", "v", "once"))
    size[CLASSES] = ends
    total = words + ends
    unseen = (once + 1) / CLASSES
    share = size + unseen
    share[CLASSES] = max(ends, 1)
    share /= share.sum()
    model = first_model(share, states)
    # a task's table of counts is as large as a block, so where there are enough tasks each takes several blocks
    read = blocks.where(F.exists("held", lambda h: ~h)).select("held", "lengths", "classes", "tokens")
    read = read.coalesce(max(2 * spark.sparkContext.defaultParallelism, number // 8))
    for _ in range(rounds if ends else 0):
        shared = spark.sparkContext.broadcast(model)
        summed = read.mapInArrow(_e_step(shared), "code int, n array<float>").groupBy("code").agg(*[F.sum(F.col("n")[j].cast("double")).alias(f"n{j}") for j in range(states)])
        table = np.zeros((CLASSES + 2 + states, states))
        for r in summed.collect():  # one row for each class
            table[r[0]] = r[1:]
        model = next_model(table[CLASSES + 1], table[CLASSES + 2 :], table[: CLASSES + 1], share, unseen, float(total))
        shared.unpersist()
    return Trained(model, counted.select("block", "at", "n"), size, total, distinct + (ends > 0), unseen)


def _e_step(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = shared.value
        # single precision is enough for counts; scores are computed in double precision
        model = Model(*(x.astype(np.float32) for x in (full.start, full.move, full.emit)))
        k = len(model.start)
        counts, rest = np.zeros((CLASSES + 1, k)), np.zeros((1 + k, k))
        for batch in batches:
            for b in range(batch.num_rows):
                held, lengths, classes, tokens = (c[b].as_py() for c in batch.columns)
                _, n, _, codes = _opened(tokens, lengths, classes)
                learn = ~np.array(held, bool)
                starts, moves = expected_counts(model, codes[np.repeat(learn, n + 1)], (n + 1)[learn], counts)
                rest += np.vstack([starts, moves])
        table = np.vstack([counts, rest])
        at = np.flatnonzero(table.any(1)).astype(np.int32)
        for part in np.array_split(at, -(-len(at) // 10_000)) if len(at) else []:
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part].astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["code", "n"])

    return run


_SCORE = "id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_SCORED = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def score(blocks: DataFrame, got: Trained) -> DataFrame:
    """One row per document: id (as text), held_out, n_tokens, n_known, train_tokens, base_score, score."""
    known = got.counted.groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("known"))
    rows = blocks.select("block", "ids", "held", "lengths", "classes", "tokens").join(known, "block", "left").drop("block")
    shared = blocks.sparkSession.sparkContext.broadcast((got.model, got.size, got.total, got.distinct, got.unseen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, size, total, distinct, unseen = shared.value
        ends, least = int(size[CLASSES]), np.log10(total + distinct + 1.0)
        for batch in batches:
            for b in range(batch.num_rows):
                ids, held, lengths, classes, tokens = (batch.column(j)[b].as_py() for j in range(5))
                at, n, of, codes = _opened(tokens, lengths, classes)
                c = np.zeros(len(of), np.int64)
                if batch.column(5)[b].is_valid:
                    pairs = batch.column(5)[b].values
                    c[pairs.field("at").to_numpy()] = pairs.field("n").to_numpy()
                inside = np.log10(np.where(c > 0, c, unseen)) - np.log10(size[of] + unseen)
                doc = np.repeat(np.arange(len(n)), n)
                per = lambda w: np.bincount(doc, w[at], minlength=len(n))
                cells = [
                    ids, held, n + 1, per((c > 0).astype(float)).astype(np.int64) + (ends > 0), np.full(len(n), total),
                    per(np.log10(c + 1.0)) + np.log10(ends + 1.0) - (n + 1) * least, log_likelihoods(model, codes, n + 1) / np.log(10) + per(inside),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, _SCORED)], names=[c.split()[0] for c in _SCORE.split(", ")])

    return rows.mapInArrow(run, _SCORE)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """Learns from the rows that are not held out and scores all; the id keeps its type."""
    blocks = encode(docs, id_col, text_col, held)
    found = score(blocks, train(blocks))
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *found.columns[1:])

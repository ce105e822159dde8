"""Language-model scoring: a log-bilinear model over corpus-wide counts.

Counts of all training tokens are gathered with one aggregation. The most
frequent words (HEAD, a fixed bound) are broadcast; counts of all other words
are joined, so any vocabulary fits. The log-bilinear model predicts a token's
class - a frequent word, the end, or one of the rare words' classes, which are
told apart by their endings - from the two tokens before it; a rare word's share
of its class comes from its count.

One pass over all training texts trains the model by noise-contrastive estimation
where the tokens are: each task goes over every token of its part, from one common
start, and the tasks' parameters are averaged by their tokens. The same pass counts
the pairs of classes at distance one and two, and the averaged model is then moved
to the pair counts of all texts: the likelihood of a log-bilinear model of the whole
corpus depends on nothing else, so that its exact gradient is a few matrix products
and the driver holds classes, not documents.

Scores are normalised: with S1 and S2 the scores that the two context words
give each class, the normaliser of every context pair is one matrix product,
exp(S1) @ exp(S2 + bias).T, done once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, byte_lists, checkpointed, remainder, table

#: Words whose counts are broadcast, those of them that are classes of their own, and classes of all other words.
HEAD, CLASSES, ENDINGS = 150_000, 768, 256
#: Bytes at a word's end that tell its class.
ENDING = 2
#: Noise-contrastive estimation: width of the vectors, classes of noise a batch, tokens a batch, rate.
WIDTH, NOISE, BATCH, RATE = 32, 16, 16_384, 0.06
#: Gradient steps over the pair counts of all texts, how far they move, and what holds weights back where pairs are few.
STEPS, STEP_RATE, PENALTY = 150, 0.03, 30.0
#: The end token's word in tables of counts: words never hold a space.
END_WORD = " "
END = 0  # class number; those of endings follow, then the words
#: Words that a task counts before it hands them on.
FLUSH = 400_000
#: Tokens whose pairs are added up at a time.
PAIR_TOKENS = 1_000_000


@dataclass
class LogBilinear:
    """Tables of the trained model, in natural logarithms, by class number."""

    first: np.ndarray  # (token before, class)
    second: np.ndarray  # (token before that, class), with the bias
    normaliser: np.ndarray  # (token before, token before that)

    def log_probabilities(self, classes: np.ndarray) -> np.ndarray:
        """Of each class given the two before it; a text starts after two ends."""
        one, two = before(classes)
        return self.first[one, classes] + self.second[two, classes] - self.normaliser[one, two]


def normalised(context: np.ndarray, target: np.ndarray, turn: np.ndarray, bias: np.ndarray) -> LogBilinear:
    """Scores and normalisers of all contexts by matrix products."""
    context, target, turn, bias = (np.asarray(x, np.float64) for x in (context, target, turn, bias))
    first = context @ turn[0] @ target.T
    second = context @ turn[1] @ target.T + bias
    top, top2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
    mass = np.exp(first - top) @ np.exp(second - top2).T
    return LogBilinear(first.astype(np.float32), second.astype(np.float32), (np.log(np.maximum(mass, 1e-300)) + top + top2.T).astype(np.float32))


def before(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each, and the one before that; a text starts after two ends."""
    return np.concatenate([[END], classes[:-1]]), np.concatenate([[END, END], classes[:-2]])[: len(classes)]


class Contrast:
    """Context, target, turn and bias by noise-contrastive estimation, batch by batch.

    ``counts`` tell how frequent classes are; noise is drawn by them, and is the
    same for all tokens of a batch. Equal counts and seeds start alike.
    """

    def __init__(self, counts: np.ndarray, batch: int = BATCH, seed: int = 3):
        n = len(counts)
        self.random, self.batch = np.random.default_rng(seed), batch
        context, target = self.random.normal(0, 0.1, (2, n, WIDTH)).astype(np.float32)
        noise = (counts + 1) / (counts + 1).sum()
        self.own = [context, target, np.stack([np.eye(WIDTH, dtype=np.float32)] * 2), np.log(noise).astype(np.float32)]
        self.squares = [np.full_like(x, 1e-6) for x in self.own]
        self.up_to, self.log_noise = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        self.tokens = 0

    def _by_class(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows added up by their classes."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out = np.zeros_like(self.own[0])
        out[at[starts]] = np.add.reduceat(rows[order], starts, axis=0)
        return out

    def _step(self, one: np.ndarray, two: np.ndarray, now: np.ndarray) -> None:
        context, target, turn, bias = self.own
        drawn = np.minimum(np.searchsorted(self.up_to, self.random.random(NOISE)), len(bias) - 1)
        q = (context @ turn[0])[one] + (context @ turn[1])[two]
        its, over = target[now], bias - self.log_noise
        good = np.einsum("ij,ij->i", q, its) + over[now]
        bad = q @ target[drawn].T + over[drawn]
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))  # pull of the data
        down = -1 / (1 + np.exp(np.clip(-bad, -30, 30)))  # push of the noise
        gq = its * up[:, None] + down @ target[drawn]
        gt = self._by_class(now, up[:, None] * q)
        np.add.at(gt, drawn, down.T @ q)
        gb = np.bincount(now, up, len(bias)) + np.bincount(drawn, down.sum(axis=0), len(bias))
        g1, g2 = self._by_class(one, gq), self._by_class(two, gq)
        grads = (g1 @ turn[0].T + g2 @ turn[1].T, gt, np.stack([context.T @ g1, context.T @ g2]), gb)
        for x, g, s in zip(self.own, grads, self.squares, strict=True):
            g = g.astype(np.float32) / np.float32(len(now) ** 0.5)
            s += g * g
            x += np.float32(RATE) * g / np.sqrt(s)

    def learn(self, one: np.ndarray, two: np.ndarray, now: np.ndarray) -> None:
        """From every token, with the two classes before each."""
        one, two, now = (x.astype(np.uint16 if len(self.up_to) < 1 << 16 else np.int64) for x in (one, two, now))  # short numbers are sorted fast
        for k in range(0, len(now), self.batch):
            self._step(one[k : k + self.batch], two[k : k + self.batch], now[k : k + self.batch])
        self.tokens += len(now)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.own]).astype(np.float64)

    def shaped(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """The parameters of a list of numbers."""
        parts = np.split(flat, np.cumsum([x.size for x in self.own])[:-1])
        return tuple(p.reshape(x.shape).astype(np.float32) for p, x in zip(parts, self.own, strict=True))


def train(texts: list[np.ndarray], n_classes: int, passes: int = 1, batch: int = BATCH) -> LogBilinear:
    """Noise-contrastive estimation alone, over class sequences, each closed by END."""
    one, two = (np.concatenate(x) for x in zip(*map(before, texts), strict=True))
    now = np.concatenate(texts)
    model = Contrast(np.bincount(now, minlength=n_classes), batch)
    for _ in range(passes):
        model.learn(one, two, now)
    return normalised(*model.own)


def fitted(start: tuple[np.ndarray, ...], pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Context, target, turn and bias of greater likelihood, by Adam, of the texts with these pair counts.

    ``pairs`` counts (distance - 1, class, class that follows) over all texts.
    """
    pairs = pairs.astype(np.float32)
    total = pairs[0].sum(dtype=np.float64)
    if not total:
        return start
    context, target, turn, bias = own = [np.array(x, np.float32) for x in start]
    # the two before a token are a pair too, but that the end closes a text and two ends open it
    both = pairs[0].T.copy()
    both[END] = 0
    both[END, END] = pairs[0][:, END].sum()
    # without pairs the model is that of single classes
    rest = [np.zeros_like(context), np.zeros_like(target), np.stack([np.eye(turn.shape[1], dtype=np.float32)] * 2), np.log((pairs[0].sum(axis=0) + 1) / np.float32(total + len(bias)))]
    firsts, seconds = [np.zeros_like(x) for x in own], [np.zeros_like(x) for x in own]
    for step in range(1, STEPS + 1):
        first, second = context @ turn[0] @ target.T, context @ turn[1] @ target.T + bias
        first -= first.max(axis=1, keepdims=True)
        second -= second.max(axis=1, keepdims=True)
        np.exp(first, out=first)
        np.exp(second, out=second)
        share = both / np.maximum(first @ second.T, 1e-30)
        # what the texts have over what the model expects, for each context and class
        seen, first_seen = share @ second, share.T @ first
        first *= seen
        second *= first_seen
        np.subtract(pairs[0], first, out=first)
        np.subtract(pairs[1], second, out=second)
        del share, seen, first_seen
        g1, g2 = first @ target, second @ target
        grads = [g1 @ turn[0].T + g2 @ turn[1].T, first.T @ (context @ turn[0]) + second.T @ (context @ turn[1]), np.stack([context.T @ g1, context.T @ g2]), second.sum(axis=0)]
        rate = STEP_RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for x, x0, g, m, v in zip(own, rest, grads, firsts, seconds, strict=True):
            g = (g - np.float32(PENALTY) * (x - x0)) / np.float32(total)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return context, target, turn, bias


def tokens_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def _count_batches(batches):
    counts: Counter = Counter()

    def handed():
        words = [w.decode("utf-8", "replace") if isinstance(w, bytes) else w for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for raw in byte_lists(batch.column("text")):
            counts.update(tokens_of(raw))
            counts[END_WORD] += 1
        if len(counts) > FLUSH:
            yield handed()
            counts.clear()
    if counts:
        yield handed()


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of docs; END_WORD counts the documents."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def ending_class(word: bytes, endings: int) -> int:
    """The class of a word that is none of its own, known or not."""
    return 1 + zlib.crc32(word[-ENDING:]) % endings


class Classes(dict):
    """Class of each word: of its own, or by its ending; remembers words up to a bound."""

    def __init__(self, words: list[bytes], endings: int):
        super().__init__((w, k + 1 + endings) for k, w in enumerate(words))
        self.endings, self.most = endings, len(words) + FLUSH

    def __missing__(self, word: bytes) -> int:
        value = ending_class(word, self.endings)
        if len(self) < self.most and len(word) < 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """Classes of a text's words, with the end."""
        return np.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), END)


def _pair_batches(batches, shared, endings):
    """(code, value): counts of pairs of classes and, as numbers under 0, what the task has learned, times its tokens, and these."""
    words, class_counts = shared.value
    classes, model = Classes(words, endings), Contrast(class_counts)
    n = len(class_counts)
    counts = np.zeros(2 * n * n, np.int64)
    held, size = [], 0

    def taken():
        one, two, now = (np.concatenate(x) for x in zip(*held, strict=True))
        model.learn(one, two, now)
        return np.bincount(np.concatenate([one * n + now, (n + two) * n + now]), minlength=len(counts))

    for batch in batches:
        for raw in byte_lists(batch.column("text")):
            now = classes.of(tokens_of(raw))
            held.append((*before(now), now))
            size += len(now)
            if size > PAIR_TOKENS:
                counts += taken()
                held, size = [], 0
    if held:
        counts += taken()
    if model.tokens:
        found = np.flatnonzero(counts)
        learned = np.append(model.flat() * model.tokens, model.tokens)
        code, value = np.concatenate([found, -1 - np.arange(len(learned))]), np.concatenate([counts[found].astype(float), learned])
        for k in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 100_000]), pa.array(value[k : k + 100_000])], names=["code", "value"])


def _pack_batches(batches):
    """One row of compressed codes and values, so that the driver receives few bytes and no rows of single numbers."""
    parts = [(b.column("code").to_numpy(), b.column("value").to_numpy()) for b in batches]
    if parts:
        code, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(code)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x[order].tobytes(), 1)], pa.binary()) for x in (code, value)], names=["code", "value"])


def contrasted(docs: DataFrame, words: list[bytes], class_counts: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(pairs, parameters): counts of (distance - 1, class, class that follows), and the model, of all tokens of docs.

    ``words`` are the classes of their own, ``class_counts`` the tokens of each class.
    Every token is learned from once; parameters are averaged over the tasks.
    """
    bounded_batches(docs.sparkSession)
    shared, endings = docs.sparkSession.sparkContext.broadcast((words, class_counts)), ENDINGS
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _pair_batches(batches, shared, endings), "code bigint, value double")
    packed = rows.groupBy("code").agg(F.sum("value").alias("value")).mapInArrow(_pack_batches, "code binary, value binary")
    n, model = len(class_counts), Contrast(class_counts)
    pairs, learned = np.zeros(2 * n * n, np.int64), np.append(np.zeros(len(model.flat())), 0.0)
    for r in packed.collect():  # a row a partition, two numbers for each pair of classes and parameter at most
        code, value = np.frombuffer(zlib.decompress(r["code"]), np.int64), np.frombuffer(zlib.decompress(r["value"]), np.float64)
        own = code >= 0
        pairs[code[own]] = value[own]
        learned[-1 - code[~own]] = value[~own]
    parameters = model.shaped(learned[:-1] / learned[-1]) if learned[-1] else tuple(model.own)
    return pairs.reshape(2, n, n), parameters


@dataclass
class Scorer:
    """What a task needs: broadcast, bounded by HEAD and CLASSES."""

    number: dict[bytes, int]  # the head's words, most frequent first
    count: np.ndarray
    ends: int
    words: list[bytes]  # classes of their own: the first of the head
    ending_log: np.ndarray  # by class: log10 of what the shares of its rare words are of
    model: LogBilinear


def _scores(batches, shared):
    own = shared.value
    endings = len(own.ending_log) - 1
    classes_of, get = Classes(own.words, endings), own.number.get
    log_count = np.log10(own.count + 0.5)
    names = ["n_tokens", "head_known", "head_log", "class_log", "rare_log"]
    for batch in batches:
        columns, tails = [], []
        for raw in byte_lists(batch.column("text")):
            words = tokens_of(raw)
            number = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            classes = classes_of.of(words)
            head = number[number >= 0]
            rare = head[head >= len(own.words)]
            logs = log_count[head].sum() + np.log10(own.ends + 0.5)
            class_log = own.model.log_probabilities(classes).sum(dtype=np.float64) / np.log(10)
            in_class = classes[(classes > END) & (classes <= endings)]
            rare_log = log_count[rare].sum() - own.ending_log[in_class].sum()
            columns.append((len(words) + 1, len(head) + (own.ends > 0), logs, class_log, rare_log))
            tail = Counter(w for w, k in zip(words, number.tolist(), strict=True) if k < 0) if len(head) < len(words) else {}
            tails.append([{"word": w.decode("utf-8", "replace"), "n": n} for w, n in tail.items()])
        parts = list(zip(*columns, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        pairs = pa.array(tails, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "text_hash")), *(pa.array(p, k) for p, k in zip(parts, kinds, strict=True)), pairs],
            names=["doc_id", "text_hash", *names, "tail"],
        )


def _in_head(words: DataFrame) -> Column:
    """Whether a word is one of the most frequent, about HEAD at most.

    Those over a count that a histogram of counts gives; of the words at that count,
    some by their hash. Bins are sixteenths of a power of two, so the histogram is
    small, and no task sends more than its share of the head.
    """
    bin_of = F.floor(F.log2("c") * 16).cast("int")
    bins = words.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()  # a thousand bins at most
    left = HEAD
    for b, n in sorted(((r["b"], r["n"]) for r in bins), reverse=True):
        if n > left:
            some = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int((1 << 30) * left / n)
            return (bin_of > F.lit(b)) | ((bin_of == F.lit(b)) & some)
        left -= n
    return F.lit(True)


def _ending_totals(words: DataFrame, own: list[bytes], head: dict) -> np.ndarray:
    """(tokens, words) of each rare class, over all words that are no class of their own."""
    ending = (F.crc32(F.substring(F.col("word").cast("binary"), -ENDING, ENDING)) % ENDINGS + 1).cast("int")
    out = np.zeros((1 + ENDINGS, 2))
    for r in words.groupBy(ending.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row a class
        out[r["k"]] = r["c"], r["n"]
    for w in own:
        out[ending_class(w, ENDINGS)] -= head[w], 1
    return out


def score(docs: DataFrame, train_docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Null texts count as empty: their one token is the end. Long texts are learned
    from and scored as a whole. With no training document every count is 0; an
    empty table has no score. Repeated rows are scored once and keep all rows.
    Bytes that are not UTF-8 are read as U+FFFD when counted.

    Words beyond the head are joined by the word: each is less than one in HEAD of
    all tokens, so no word's rows are many of a task's.
    """
    spark = docs.sparkSession
    counts = checkpointed(token_counts(train_docs))
    of_end = F.coalesce(F.max(F.when(F.col("word") == END_WORD, F.col("c"))), F.lit(0))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), of_end).first()
    words = counts.where(F.col("word") != END_WORD)
    in_head = _in_head(words)
    head = words.where(in_head).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    number = {w.encode("utf-8", "replace"): k for k, w in enumerate(head["word"])}
    head_counts = head["c"].to_numpy(np.int64)
    own = list(number)[:CLASSES]
    totals = _ending_totals(words, own, dict(zip(number, head_counts.tolist(), strict=True)))
    ending_log = np.log10(np.maximum(totals[:, 0], 0) + 0.5 * (np.maximum(totals[:, 1], 0) + 1))

    class_counts = np.concatenate([[ends], np.maximum(totals[1:, 0], 0), head_counts[: len(own)]]).astype(np.int64)
    pairs, start = contrasted(train_docs, own, class_counts)
    scorer = Scorer(number, head_counts, int(ends), own, ending_log, normalised(*fitted(start, pairs)))
    del pairs
    shared = spark.sparkContext.broadcast(scorer)

    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    own_columns = ["n_tokens", "head_known", "head_log", "class_log", "rare_log"]
    part = rows.mapInArrow(
        lambda batches: _scores(batches, shared),
        f"doc_id {kind}, text_hash bigint, n_tokens bigint, head_known bigint, head_log double, class_log double, rare_log double, "
        "tail array<struct<word:string,n:bigint>>",
    )
    # each row adds one marker that holds its own sums and matches no word
    marker = F.struct(F.concat(F.lit("  "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_hash").cast("string")).alias("word"), F.lit(0).cast("bigint").alias("n"))
    flat = part.withColumn("x", F.explode(F.concat(F.array(marker), "tail"))).select(
        "doc_id", "text_hash", F.col("x.word").alias("word"), F.col("x.n").alias("n"), *(F.when(F.col("x.n") == 0, F.col(c)).alias(c) for c in own_columns)
    )
    count = F.coalesce("c", F.lit(0))
    summed = (
        flat.join(words.where(~in_head), "word", "left")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count("n_tokens").alias("copies"),
            *(F.max(c).alias(c) for c in own_columns),
            F.sum(F.col("n") * F.log10(count + 0.5)).alias("tail_log"),
            F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        )
    )
    tail = F.col("tail_log") / F.col("copies")
    base = float(np.log10(total + 0.5 * (distinct + 1)))
    return summed.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + (F.col("tail_known") / F.col("copies")).cast("bigint")).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("head_log") + tail - F.col("n_tokens") * base).alias("base_score"),
        (F.col("class_log") + F.col("rare_log") + tail).alias("score"),
    )


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's scores, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 1
    return score(docs, docs.where(~held_out)).withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Masked pseudo-likelihood scores from a bidirectional window network.

Every token is predicted from the tokens on both sides of it, itself masked;
a document's score is the sum of these conditional log-probabilities.

1. *Blocks.*  Texts become places in the word list of their block (about 24 MB of
   text); words (A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``) are counted by hash over
   all blocks, none is left out.
2. *Classes.*  Their number grows with the cube root of the distinct words.  The
   most frequent words have a class each, the others share bands of frequency;
   ``p(word | class)`` is the word's share of its class.  Block lists meet this
   table in a join on the hash, so no vocabulary reaches the driver or a worker.
3. *Network.*  Two words on each side: neighbour embeddings by offset, a tanh
   layer, and a softmax over groups of classes and inside the group.  Each task
   runs Adam over its own texts, then parameters are averaged by tokens; every
   round takes all texts, on large inputs in four turns of a quarter each.
4. *Scores.*  The network's log p(class | neighbours) of every token plus its
   log p(word | class), summed per text.

``vocabulary``, ``context_counts`` and ``WindowNetwork`` are the one-neighbour
model on bounded counts, kept to compare with; the scores do not use them.

Edge cases: null, empty or word-less text has no tokens, log-probability 0 and
a null mean; ties in frequency go to the smaller hash; repeated rows each
count; an empty table trains an uninformed network and gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.wordhash import NON_SPACE, slices_by_bytes, words
from quire.session import materialize, ship_package

WORDS = 1 << 15
CLASSES = 64     # the last one is for unknown words
OWN = 40         # most frequent words with a class each
_EDGE = CLASSES  # neighbour beyond a text's end
_STEP = 2 << 20


# ---- corpus counts -----------------------------------------------------------

def _batch_words(batch):
    for i, j in slices_by_bytes(batch.column("text"), _STEP):
        h, first = words(batch.column("text").slice(i, j - i), NON_SPACE)
        yield i, j, h, first


def _word_counts(batches):
    for b in batches:
        h = np.sort(np.concatenate([x[2] for x in _batch_words(b)] or [np.empty(0, np.uint64)]))
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)),
                                          pa.array(np.diff(np.append(at, len(h))).astype(np.int64))], ["h", "n"])


class Vocabulary:
    """Known words' hashes (sorted), their classes, and log p(word | class)."""

    def __init__(self, top: list[tuple[int, int]], kinds: int, tokens: int):
        h = np.array([x for x, _ in top], dtype=np.int64).view(np.uint64)
        n = np.array([x for _, x in top], dtype=float)
        bands = CLASSES - 1 - OWN
        rank = np.arange(len(h))
        spread = np.log(max(len(h), OWN + 2) / OWN)
        cls = np.where(rank < OWN, rank, OWN + np.minimum(
            bands - 1, (np.log(np.maximum(rank, OWN) / OWN) / spread * bands).astype(int)))
        mass = np.bincount(cls, n, CLASSES)
        order = np.argsort(h)
        self.hashes, self.classes = h[order], cls[order].astype(np.int64)
        self.log_in_class = np.log(n / mass[cls])[order]
        self.log_unknown = -np.log(max(1, kinds - len(h)))

    def classify(self, h: np.ndarray):
        """Class and log p(word | class) of word hashes."""
        if not len(self.hashes):
            return np.full(len(h), CLASSES - 1), np.full(len(h), self.log_unknown)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, self.classes[at], CLASSES - 1), np.where(known, self.log_in_class[at], self.log_unknown)


def _neighbours(cls: np.ndarray, first: np.ndarray):
    """Classes to the left and right of every word, within its text."""
    left, right = np.empty_like(cls), np.empty_like(cls)
    left[1:], right[:-1] = cls[:-1], cls[1:]
    some = first[:-1][first[:-1] < first[1:]]
    left[some] = _EDGE
    right[first[1:][first[:-1] < first[1:]] - 1] = _EDGE
    return left, right


def vocabulary(docs: DataFrame) -> Vocabulary:
    counts = materialize(docs.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    kinds, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = counts.orderBy(F.desc("n"), "h").limit(WORDS).collect()
    return Vocabulary([(r.h, r.n) for r in top], kinds, tokens)


def context_counts(docs: DataFrame, vocab) -> np.ndarray:
    """[left, right, class] counts over all documents."""
    width = CLASSES + 1

    def count(batches):
        total = np.zeros(width * width * CLASSES, np.int64)
        for b in batches:
            for _, _, h, first in _batch_words(b):
                if len(h):
                    cls, _ = vocab.value.classify(h)
                    left, right = _neighbours(cls, first)
                    total += np.bincount((left * width + right) * CLASSES + cls, minlength=len(total))
        rows = total.reshape(width, -1)
        live = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)),
                                          pa.array([rows[i].tobytes() for i in live], pa.binary())], ["left", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"left": table.column("left").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema, out = "left int, counts binary", np.zeros((width, width, CLASSES), np.int64)
    for r in docs.mapInArrow(count, schema).groupBy("left").applyInArrow(add, schema).collect():
        out[r["left"]] = np.frombuffer(r["counts"], np.int64).reshape(width, CLASSES)
    return out


# ---- the network -------------------------------------------------------------

class WindowNetwork:
    """Class probabilities from the classes on both sides:
    softmax(tanh(L[left] + R[right] + b) U + c)."""

    def __init__(self, hidden: int = 32, seed: int = 7):
        rng, w = np.random.default_rng(seed), CLASSES + 1
        self.p = {"L": rng.normal(0, 0.3, (w, hidden)), "R": rng.normal(0, 0.3, (w, hidden)), "b": np.zeros(hidden),
                  "U": rng.normal(0, 0.3, (hidden, CLASSES)), "c": np.zeros(CLASSES)}

    def log_probabilities(self) -> np.ndarray:
        """[left, right, class] for every context."""
        z = self._hidden() @ self.p["U"] + self.p["c"]
        z -= z.max(-1, keepdims=True)
        return z - np.log(np.exp(z).sum(-1, keepdims=True))

    def _hidden(self):
        return np.tanh(self.p["L"][:, None] + self.p["R"][None] + self.p["b"])

    def train(self, counts: np.ndarray, rounds: int = 300, rate: float = 0.05) -> list[float]:
        """Full-batch Adam on the mean loss over every counted token."""
        total, losses = max(1, counts.sum()), []
        share, context = counts / total, counts.sum(-1, keepdims=True) / total
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.p["c"] = np.log((counts.sum((0, 1)) + 1) / (total + CLASSES))
        for t in range(1, rounds + 1):
            h, logp = self._hidden(), self.log_probabilities()
            losses.append(float(-(share * logp).sum()))
            dz = context * np.exp(logp) - share
            dh = (dz @ self.p["U"].T) * (1 - h * h)
            g = {"U": np.einsum("lrh,lrc->hc", h, dz, optimize=True), "c": dz.sum((0, 1)), "b": dh.sum((0, 1)),
                 "L": dh.sum(1), "R": dh.sum(0)}
            for k, x in g.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
        return losses


# ---- the wide network ---------------------------------------------------------

OFFSETS = (-2, -1, 1, 2)
_BEYOND = 0            # class of a neighbour beyond a text's end; words' classes begin at 1
_BLOCK = 24 << 20      # bytes of text that share one word list
_CHUNK = 4096          # parameters a row
_MANY = 4 << 20        # tokens from which a round takes a quarter of the texts


def class_count(kinds: int) -> int:
    """Classes for a vocabulary of so many distinct words."""
    return max(CLASSES, math.ceil(1.5 * kinds ** (1 / 3)))


class WideNetwork:
    """Class probabilities from ``OFFSETS`` neighbours on both sides:
    h = tanh(sum of E[offset, neighbour] + b), then a softmax over groups of
    classes and one inside the group, so a token costs the root of the classes."""

    def __init__(self, mass: np.ndarray, hidden: int = 32, seed: int = 7):
        """``mass``: tokens of each class (class 1 first)."""
        rng, self.classes, self.hidden = np.random.default_rng(seed), len(mass), hidden
        self.size = math.ceil(math.sqrt(len(mass)))
        self.groups = -(-len(mass) // self.size)
        mass = np.pad(np.asarray(mass, float) + 1, (0, self.groups * self.size - len(mass))).reshape(self.groups, -1)
        with np.errstate(divide="ignore"):
            inside = np.maximum(np.log(mass / mass.sum(1, keepdims=True)), -60.0)
        self.p = {"E": rng.normal(0, 0.2, (len(OFFSETS), self.classes + 1, hidden)), "b": np.zeros(hidden),
                  "V": rng.normal(0, 0.2, (hidden, self.groups)), "d": np.log(mass.sum(1) / mass.sum()),
                  "U": rng.normal(0, 0.2, (self.groups, hidden, self.size)), "c": inside}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at:at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def _hidden(self, near: np.ndarray) -> np.ndarray:
        z = np.repeat(self.p["b"][None], near.shape[1], 0)
        for o, x in enumerate(near):
            z += self.p["E"][o][x]
        return np.tanh(z)

    def _log_softmax(self, z: np.ndarray) -> np.ndarray:
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def _by_group(self, cls: np.ndarray):
        """(group, rows whose class is in it, their places inside it)."""
        g = ((cls - 1) // self.size).astype(np.int16)
        order = np.argsort(g, kind="stable")
        ends = np.searchsorted(g[order], np.arange(self.groups + 1))
        for i in np.flatnonzero(np.diff(ends)):
            rows = order[ends[i]:ends[i + 1]]
            yield i, rows, (cls[rows] - 1) % self.size

    def log_probabilities(self, near: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log p(class | neighbours) of each token; ``near`` is [offset, token]."""
        h, out = self._hidden(near), np.empty(len(cls))
        groups = self._log_softmax(h @ self.p["V"] + self.p["d"])
        for i, rows, at in self._by_group(cls):
            inside = self._log_softmax(h[rows] @ self.p["U"][i] + self.p["c"][i])
            out[rows] = groups[rows, i] + inside[np.arange(len(rows)), at]
        return out

    def gradients(self, near: np.ndarray, cls: np.ndarray) -> dict:
        """Of the mean loss over these tokens."""
        h, n, g = self._hidden(near), np.float32(len(cls)), {k: np.zeros_like(x) for k, x in self.p.items()}
        dz = np.exp(self._log_softmax(h @ self.p["V"] + self.p["d"]))
        dz[np.arange(len(cls)), (cls - 1) // self.size] -= 1
        dh = dz @ self.p["V"].T
        g["V"], g["d"] = h.T @ dz / n, dz.sum(0) / n
        for i, rows, at in self._by_group(cls):
            dz = np.exp(self._log_softmax(h[rows] @ self.p["U"][i] + self.p["c"][i]))
            dz[np.arange(len(rows)), at] -= 1
            dh[rows] += dz @ self.p["U"][i].T
            g["U"][i], g["c"][i] = h[rows].T @ dz / n, dz.sum(0) / n
        dh *= (1 - h * h) / n
        g["b"] = dh.sum(0)
        for o, x in enumerate(near):
            order = np.argsort(x.astype(np.int16), kind="stable")
            there = x[order]
            first = np.flatnonzero(np.concatenate(([True], there[1:] != there[:-1])))
            g["E"][o][there[first]] = np.add.reduceat(dh[order], first, axis=0)
        return g

    def train(self, batches, rate: float) -> int:
        """Adam over (near, class) batches; how many tokens there were."""
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        seen = t = 0
        for near, cls in batches:
            t, seen = t + 1, seen + len(cls)
            a, b = 1 - 0.9**t, 1 - 0.99**t
            for k, x in self.gradients(near, cls).items():
                m[k] += np.float32(0.1) * (x - m[k])
                v[k] += np.float32(0.01) * (x * x - v[k])
                self.p[k] -= np.float32(rate / a) * m[k] / (np.sqrt(v[k] / np.float32(b)) + np.float32(1e-7))
        return seen


def windows(cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[offset, token] classes of every word's neighbours, within its text."""
    wide = max(OFFSETS)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(cls)) + wide * (of + 1)
    line = np.full(len(cls) + wide * len(first), _BEYOND, cls.dtype)
    line[at] = cls
    return np.stack([line[at + o] for o in OFFSETS]) if len(cls) else np.empty((len(OFFSETS), 0), cls.dtype)


# ---- words of blocks, their classes --------------------------------------------

def encode(d: DataFrame) -> DataFrame:
    """Blocks of texts: a row (block, key, turn, ids) per text, ids being places in
    its block's word list, and a row (block, h, n) with the list and its counts."""
    schema = T.StructType([T.StructField("block", T.LongType()), d.schema["key"], T.StructField("turn", T.IntegerType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("h", T.ArrayType(T.LongType())),
                           T.StructField("n", T.ArrayType(T.LongType()))])

    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        out = None
        for b in batches:
            out = out or pa.schema([pa.field("block", pa.int64()), b.schema.field("key"), pa.field("turn", pa.int32()),
                                    pa.field("ids", pa.binary()), pa.field("h", pa.list_(pa.int64())),
                                    pa.field("n", pa.list_(pa.int64()))])
            for i, j in slices_by_bytes(b.column("text"), _BLOCK):
                part = b.slice(i, j - i)
                cut = [(x[2], np.diff(x[3])) for x in _batch_words(part)]
                h = np.concatenate([x for x, _ in cut])
                ends = np.concatenate([[0], np.cumsum(np.concatenate([x for _, x in cut]))])
                order = np.argsort(h)
                there = h[order]
                new = np.concatenate(([True], there[1:] != there[:-1])) if len(h) else np.empty(0, bool)
                ids = np.empty(len(h), np.int32)
                ids[order] = np.cumsum(new) - 1
                first, rows = np.flatnonzero(new), j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, block)), part.column("key"), pa.array(np.arange(rows, dtype=np.int32) % 4),
                     pa.array([ids[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                     pa.nulls(rows, out.field("h").type), pa.nulls(rows, out.field("n").type)], schema=out)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.nulls(1, out.field("key").type), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()),
                         pa.array([there[first].view(np.int64)], out.field("h").type),
                         pa.array([np.diff(np.append(first, len(h))).astype(np.int64)], out.field("n").type)], schema=out)
                block += 1

    for f in schema:
        f.nullable = True
    return d.mapInArrow(run, schema)


def word_classes(counts: DataFrame, classes: int) -> DataFrame:
    """(h, cls, inside) of every counted word: the most frequent have a class
    each, the others share bands of frequency; inside is log p(word | class)."""
    own = classes * OWN // CLASSES
    bands = classes - own
    top = counts.orderBy(F.desc("n"), "h").limit(own).collect()
    least = max(2, top[-1].n if top else 2)
    named = counts.sparkSession.createDataFrame([(r.h, i) for i, r in enumerate(top, 1)], "h long, own int")
    band = F.least(F.lit(bands - 1), F.floor(bands * (1 - F.log("n") / math.log(least + 1)))).cast("int")
    c = counts.join(F.broadcast(named), "h", "left").withColumn("cls", F.coalesce("own", own + 1 + band))
    mass = c.groupBy("cls").agg(F.sum("n").alias("mass"))
    return c.join(F.broadcast(mass), "cls").select("h", "cls", "mass", F.log(F.col("n") / F.col("mass")).alias("inside"))


def classify(blocks: DataFrame, listed: DataFrame, known: DataFrame) -> DataFrame:
    """Per text: key, turn, n_tokens, the sum of its words' log p(word | class),
    and its words' classes (two bytes each)."""
    texts = blocks.where("ids is not null").select("block", "key", "turn", "ids")
    found = listed.join(known, "h").select(F.col("block").alias("of"), "slot", "cls", "inside")
    out = T.StructType([texts.schema["key"], T.StructField("turn", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("inside", T.DoubleType()), T.StructField("classes", T.BinaryType())])

    def code(texts: pa.Table, words: pa.Table) -> pa.Table:
        size = words.num_rows
        cls, inside = np.zeros(size, np.uint16), np.zeros(size)
        slot = words.column("slot").to_numpy()
        cls[slot], inside[slot] = words.column("cls").to_numpy(), words.column("inside").to_numpy()
        ids = [np.frombuffer(x, np.int32) for x in texts.column("ids").to_pylist()]
        return pa.table([texts.column("key"), texts.column("turn"), pa.array([len(x) for x in ids], pa.int64()),
                         pa.array([float(inside[x].sum()) for x in ids], pa.float64()),
                         pa.array([cls[x].tobytes() for x in ids], pa.binary())], names=out.fieldNames())

    return texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(code, out)


def _class_batches(batches, size: int):
    """(rows from, rows to, near, classes) of at most about ``size`` tokens or one text."""
    for b in batches:
        held = [np.frombuffer(x, np.uint16) for x in b.column("classes").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
        i = 0
        while i < len(held):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, side="right")) - 1)
            cls = np.concatenate(held[i:j]).astype(np.int32)
            yield b, i, j, windows(cls, ends[i:j + 1] - ends[i]), cls
            i = j


def _train(coded: DataFrame, net: WideNetwork, tokens: int) -> None:
    """Rounds over all texts: each task trains on its own, their parameters are averaged."""
    turns = 4 if tokens > _MANY else 1
    rounds = turns * max(1, min(16, round(_MANY / max(1, tokens)) * 4)) if tokens else 0
    step = max(64, min(8192, tokens // 2048))

    def learn(rate):
        def run(batches):
            got = ((near[:, i:i + step], cls[i:i + step]) for _, _, _, near, cls in _class_batches(batches, 1 << 19)
                   for i in range(0, len(cls), step))
            weight = net.train(got, rate)
            if weight:
                flat = net.flat().astype(np.float64) * weight
                cut = range(0, len(flat), _CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), weight, np.int64)),
                     pa.array([flat[i:i + _CHUNK].tobytes() for i in cut], pa.binary())], ["chunk", "weight", "sums"])
        return run

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for x in table.column("sums"):
            total = total + np.frombuffer(x.as_py(), np.float64)
        weight = sum(table.column("weight").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "weight": pa.array([weight], pa.int64()),
                         "sums": pa.array([(total / weight).tobytes()], pa.binary())})

    schema = "chunk int, weight long, sums binary"
    for r in range(rounds):
        some = coded.where(F.col("turn") == r % turns) if turns > 1 else coded
        got = some.select("classes").mapInArrow(learn(0.02 / math.sqrt(1 + r / turns)), schema).groupBy("chunk").applyInArrow(add, schema).collect()
        if got:
            net.load(np.concatenate([np.frombuffer(x.sums, np.float64) for x in sorted(got, key=lambda x: x.chunk)]))


# ---- scores ------------------------------------------------------------------

def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_tokens, log_prob (natural log, summed), mean_log_prob."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = materialize(encode(d), "blocks")
    listed = blocks.where("h is not null").select("block", F.posexplode(F.arrays_zip("h", "n")).alias("slot", "w")).select(
        "block", "slot", "w.h", "w.n")
    counts = materialize(listed.groupBy("h").agg(F.sum("n").alias("n")), "words")
    kinds, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = class_count(kinds)
    known = materialize(word_classes(counts, classes), "classes")
    mass = np.zeros(classes)
    for r in known.groupBy("cls").agg(F.first("mass").alias("mass")).collect():
        mass[r.cls - 1] = r.mass
    coded = materialize(classify(blocks, listed.drop("n"), known), "coded")
    net = WideNetwork(mass)
    _train(coded, net, tokens)
    held = spark.sparkContext.broadcast(net)
    out = T.StructType([d.schema["key"], T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())])

    def score(batches):
        for b, i, j, near, cls in _class_batches(batches, 1 << 16):
            n = b.column("n_tokens").to_numpy()[i:j]
            logp = [held.value.log_probabilities(near[:, x:x + (1 << 16)], cls[x:x + (1 << 16)])
                    for x in range(0, len(cls), 1 << 16)]
            total = b.column("inside").to_numpy()[i:j] + np.bincount(
                np.repeat(np.arange(j - i), n), np.concatenate([np.empty(0), *logp]), j - i)
            yield pa.RecordBatch.from_arrays([b.column("key").slice(i, j - i), pa.array(n), pa.array(total)], out.fieldNames())

    return coded.select("key", "n_tokens", "inside", "classes").mapInArrow(score, out).select(
        F.col("key").alias(key), "n_tokens", "log_prob",
        F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))

"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts up to ``ORDER`` bytes holds how often
each byte followed each context in the training texts.  A byte is coded in its
longest known context; if it never followed there, an escape (as many counts
as the context has distinct followers) leads to the next shorter one, down to a
uniform byte.  Under these frozen statistics a text's code length in each
language is exact, and the shortest wins.

Training counts (ORDER + 1)-byte strings over all training texts: each task
counts its own, and packed counts are summed by (language, part of the key
space).  A language keeps at most ``NODES`` strings (the most frequent ones), so
the model that is broadcast has a proven size.  Bytes are folded first: A-Z to
lower case, white space and control bytes to a space, digits to ``0``, other
ASCII marks to a dot.

At scoring, every byte string that any language kept has its code length in
all languages worked out once; a text is a lookup per byte.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so
is everything when nothing can be learned; rows with a null language are not
learned from; equal code lengths go to the first language by name; a null key
counts as the empty text when the fold is drawn; repeated rows each count; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.wordhash import slices_by_bytes, text_buffer
from quire.session import ship_package

ORDER = 3
NODES = 1 << 17      # strings kept per language (12 bytes each)
PARTS = 16
_STEP = 1 << 20

_fold = np.full(256, ord("."), np.uint8)
_fold[:33] = ord(" ")
_fold[127] = ord(" ")
_fold[48:58] = ord("0")
_fold[65:91] = np.arange(97, 123)
_fold[97:123] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER):
    """The (order + 1)-byte strings of folded texts as numbers, and how many
    each text has before it (one entry per text, plus the end)."""
    n = len(data)
    if n <= order:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    g = np.zeros(n - order, np.uint32)
    for j in range(order + 1):
        g = (g << np.uint32(8)) | data[j:n - order + j]
    lengths = np.maximum(np.diff(offsets) - order, 0)
    inside = np.zeros(n + 1, np.int32)  # +1 where a text's strings begin, -1 after them
    np.add.at(inside, offsets[:-1], (lengths > 0).astype(np.int32))
    np.add.at(inside, offsets[:-1] + lengths, -(lengths > 0).astype(np.int32))
    return g[np.cumsum(inside[:n - order]) > 0], np.concatenate(([0], np.cumsum(lengths)))


# ---- training ----------------------------------------------------------------

def _merge(keys: list, counts: list):
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k, c = k[order], np.concatenate(counts)[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(k) else c


def _count(batches):
    held: dict[str, tuple[list, list]] = {}
    for b in batches:
        for i, j in slices_by_bytes(b.column("text"), _STEP):
            part = b.slice(i, j - i)
            data, offsets = text_buffer(part.column("text"))
            g, first = grams(_fold[data], offsets)
            names, code = np.unique(np.array(part.column("lang").to_pylist(), dtype=str), return_inverse=True)
            of = np.repeat(code, np.diff(first))
            for c, name in enumerate(names.tolist()):
                mine = np.sort(g[of == c])
                at = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1]))) if len(mine) else []
                keys, counts = held.setdefault(name, ([], []))
                keys.append(mine[at] if len(mine) else mine)
                counts.append(np.diff(np.append(at, len(mine))).astype(np.int64) if len(mine) else np.empty(0, np.int64))
                if sum(map(len, keys)) > 1 << 20:
                    held[name] = tuple([x] for x in _merge(keys, counts))
    for name, (keys, counts) in held.items():
        k, c = _merge(keys, counts)
        part = (k * np.uint32(2654435761)) >> np.uint32(28)
        yield pa.RecordBatch.from_arrays([
            pa.array([name] * PARTS), pa.array(range(PARTS), pa.int32()),
            pa.array([k[part == p].tobytes() for p in range(PARTS)], pa.binary()),
            pa.array([c[part == p].tobytes() for p in range(PARTS)], pa.binary())], ["lang", "part", "keys", "counts"])


def _sum_part(table: pa.Table) -> pa.Table:
    k, c = _merge([np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()],
                  [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
    top = np.sort(np.lexsort((k, -c))[:NODES // PARTS])
    return pa.table({"lang": table.column("lang").slice(0, 1), "part": table.column("part").slice(0, 1),
                     "keys": pa.array([k[top].tobytes()], pa.binary()), "counts": pa.array([c[top].tobytes()], pa.binary())})


def train(texts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """``texts``: text, lang.  Per language: sorted strings and their counts."""
    ship_package(texts.sparkSession)
    schema = "lang string, part int, keys binary, counts binary"
    rows = (texts.where("text is not null and lang is not null").select("text", "lang")
            .mapInArrow(_count, schema).groupBy("lang", "part").applyInArrow(_sum_part, schema).collect())
    model = {}
    for name in sorted({r["lang"] for r in rows}):
        mine = [r for r in rows if r["lang"] == name]
        model[name] = _merge([np.frombuffer(r["keys"], np.uint32) for r in mine],
                             [np.frombuffer(r["counts"], np.int64) for r in mine])
    return model


# ---- code lengths ---------------------------------------------------------------

class CodeLengths:
    """Code length in bits of a byte after its context, in every language.

    Level k has the strings of k + 1 bytes that some language kept, with the
    bits of their last byte in all languages, and the contexts of k bytes with
    the bits of their escapes (0 where a language does not know the context,
    which then costs nothing to leave)."""

    def __init__(self, model: dict):
        self.languages = sorted(model)
        self.levels = []
        wide = len(self.languages)
        for k in range(ORDER + 1):
            parts = [_merge([(model[x][0] & np.uint32((1 << (8 * (k + 1))) - 1)) if k < 3 else model[x][0]], [model[x][1]])
                     for x in self.languages]
            keys = np.unique(np.concatenate([p for p, _ in parts])) if parts else np.empty(0, np.uint32)
            contexts = np.unique(keys >> np.uint32(8))
            escape = np.zeros((len(contexts), wide))
            bits = self.unseen(k, keys)  # by way of the shorter context, escapes not yet added
            for c, (key, count) in enumerate(parts):
                at = np.searchsorted(contexts, key >> np.uint32(8))
                total = np.bincount(at, count, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                known = total > 0
                escape[known, c] = -np.log2(kinds[known] / (total + kinds)[known])
                own = np.searchsorted(keys, key)
                missing = np.ones(len(keys), bool)
                missing[own] = False
                bits[missing, c] += escape[np.searchsorted(contexts, keys[missing] >> np.uint32(8)), c]
                bits[own, c] = -np.log2(count / (total + kinds)[at])
            self.levels.append((keys, bits, contexts, escape))

    def unseen(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Bits of the strings' last byte one level further down."""
        if k == 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        return self.bits(k - 1, keys & np.uint32((1 << (8 * k)) - 1))

    def bits(self, k: int, keys: np.ndarray) -> np.ndarray:
        """[string, language] bits of (k + 1)-byte strings."""
        known, table, contexts, escape = self.levels[k]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        out = table[at] if len(known) else np.zeros((len(keys), len(self.languages)))
        lost = np.flatnonzero(~found)
        if len(lost):
            out[lost] = self.unseen(k, keys[lost])
            before = keys[lost] >> np.uint32(8)
            c = np.minimum(np.searchsorted(contexts, before), max(len(contexts) - 1, 0))
            seen = contexts[c] == before if len(contexts) else np.zeros(len(lost), bool)
            out[lost[seen]] += escape[c[seen]]
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[text, language] bits of whole texts."""
        data = _fold[data]
        g, first = grams(data, offsets)
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        for i in range(0, len(g), _STEP // 4):
            b = self.bits(ORDER, g[i:i + _STEP // 4])
            total = np.concatenate((np.zeros((1, b.shape[1])), np.cumsum(b, axis=0)))
            lo, hi = np.clip(first[:-1] - i, 0, len(b)), np.clip(first[1:] - i, 0, len(b))
            sums += total[hi] - total[lo]
        for k in range(ORDER):  # a text's first bytes have shorter contexts
            has = np.flatnonzero(np.diff(offsets) > k)
            key = np.zeros(len(has), np.uint32)
            for j in range(k + 1):
                key = (key << np.uint32(8)) | data[offsets[has] + j]
            sums[has] += self.bits(k, key)
        return sums


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep``, lang_pred, score (the posterior of the prediction
    under equal priors) per row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    d = docs.select(F.col(key).alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep], F.col(text).alias("text"),
                    F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    out = T.StructType([f for f in d.schema if f.name not in ("text", "letter")]
                       + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        code = CodeLengths(shared.value)
        names = np.array(code.languages + ["und"], dtype=object)
        for b in batches:
            best, score = [], []
            for i, j in slices_by_bytes(b.column("text"), _STEP):
                letter = b.column("letter").slice(i, j - i).to_numpy(zero_copy_only=False)
                data, offsets = text_buffer(b.column("text").slice(i, j - i))
                if not code.languages:
                    best.append(np.zeros(j - i, np.int64))
                    score.append(np.zeros(j - i))
                    continue
                bits = code.texts(data, offsets)
                post = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                best.append(np.where(letter, bits.argmin(1), len(names) - 1))
                score.append(np.where(letter, post, 0.0))
            head = [b.column(f.name) for f in out.fields[:-2]]
            pick = names[np.concatenate(best)] if best else []
            yield pa.RecordBatch.from_arrays(head + [pa.array(pick, pa.string()), pa.array(
                np.concatenate(score) if score else [], pa.float64())], out.fieldNames())

    return d.mapInArrow(predict, out).select(
        F.col("key").alias(key), *[F.col(f"keep_{c}").alias(c) for c in keep], "lang_pred", "score")


def fold_of(key, parts: int):
    """crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts

"""Language identification by rank-order profiles: the most frequent character
n-grams of a language, in order, are its profile; a document has the language
from whose profile its own ranking is out of place least.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out

#: Length of a profile, longest n-gram.
PROFILE = 300
GRAM = 3
#: Documents a language is learned from, at most about so many: a share told by a hash of the id.
TRAIN_DOCS = 2000
_BOUND = 32
#: Code points that are counted at once; longer texts go in pieces whose counts are added.
CHARS = 1 << 20

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the n-grams of 1 to GRAM characters of all words: runs
    of letters, lower-cased, with one space on either side. A key packs the
    code points, 21 bits each."""
    parts, at = [], 0
    while at < len(text):  # pieces end at a space, so every word is whole
        end = text.find(" ", at + CHARS) if len(text) - at > CHARS else -1
        end = len(text) if end < 0 else end
        parts.append(_grams(text[at:end]))
        at = end
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, _BOUND).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = len(letter) > 1 and letter[1]
    keep[:-1] |= letter[1:]
    c, letter = c[keep], letter[keep]  # runs of other characters are one or two spaces
    found, key = [c[letter]], c
    for n in range(2, GRAM + 1):
        key = (key[:-1] << 21) | c[n - 1 :]
        # at least one letter, and no space inside
        ok = letter[: len(key)] | letter[n - 1 :] if n == 2 else np.logical_and.reduce([letter[i : len(key) + i] for i in range(1, n - 1)])
        found.append(key[ok])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys in order, ties by key."""
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.keys)), -1, np.int64)
        for row, lang in zip(self.ranks, self.langs):
            row[np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): least out-of-place distance, ties to the first
        name; the score is 1 less the distance's share of the largest one.
        ``und`` and 0 without a letter or without any profile."""
        keys, counts = grams(text or "")
        if not len(keys) or not self.langs:
            return "und", 0.0
        own = ranked(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        rank = np.where(self.keys[at] == own, self.ranks[:, at], -1)
        far = np.where(rank >= 0, np.abs(rank - np.arange(len(own))), self.size).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def fit(spark: SparkSession, docs: DataFrame, train_docs: int = TRAIN_DOCS, size: int = PROFILE) -> Profiles:
    """(doc_id, text, lang) -> profiles of the non-null languages, from about
    ``train_docs`` whole texts of each that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rates = {r["lang"]: train_docs / r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not rates:
        return Profiles({}, size)
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("lang"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("lang"), "doc_id"), 11) / F.lit(float(1 << 53))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = defaultdict(list)

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in sums[lang]]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([c for _, c in sums[lang]])).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                sums[lang].append(grams(text.as_py()))
                if len(sums[lang]) >= 64:
                    sums[lang] = [merged(lang)]
        for lang in sums:
            keys, counts = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "key", "n"])

    counted = known.filter(u < rate).select("lang", "text").mapInArrow(count, "lang string, key bigint, n bigint")
    totals = counted.groupBy("lang", "key").agg((-F.sum("n")).alias("less"))
    # the first of each of 64 parts of a language, then the first of those
    best = F.slice(F.sort_array(F.collect_list(F.struct("less", "key"))), 1, size)
    some = totals.groupBy("lang", F.pmod(F.xxhash64("key"), F.lit(64)).alias("part")).agg(best.alias("best"))
    firsts = some.select("lang", F.inline("best")).groupBy("lang").agg(best.alias("best"))
    return Profiles({r["lang"]: [x["key"] for x in r["best"]] for r in firsts.collect()}, size)


def predict(spark: SparkSession, docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score``."""
    shared = spark.sparkContext.broadcast(profiles)  # PROFILE keys a language
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), "lang_pred string, score double"])
    return docs.mapInArrow(run, schema)
